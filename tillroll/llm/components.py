"""Connected components of a link table.

In a round every node joins the first of itself and its neighbours, in an order by hash
that is new in each round. Nodes that join the same one become one node, and links inside
it go: nodes and links fall by a share in every round, so all rounds together read about
as many links as the first few. Rounds are written to the shared scratch folder, so a lost
executor costs a re-read; aggregation before the shuffle keeps a node with very many links
cheap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tillroll.operators.scratch import materialize


def components(links: DataFrame) -> DataFrame:
    """``links`` has columns a and b; gives (id, label), label being the component's least id.

    Nodes without links have no row. Links of a node with itself, repeated links and
    nulls change nothing.
    """
    ordered = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    links = links.where("a is not null and b is not null and a <> b")
    left = materialize(links.select(*ordered("a", "b")).distinct(), "links")
    rounds = []
    while not rounds or left.limit(1).count():
        place = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("h"), F.col(c).alias("id"))
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(place("b")).alias("first"))
        joined = first.select(F.col("a").alias("id"), F.least(place("a"), "first").getField("id").alias("to"))
        rounds.append(materialize(joined, "joined"))
        to = lambda x: rounds[-1].select(F.col("id").alias(x), F.col("to").alias("to_" + x))
        moved = left.join(to("a"), "a").join(to("b"), "b").where("to_a <> to_b")
        left = materialize(moved.select(*ordered("to_a", "to_b")).distinct(), "links")

    def onward(late: DataFrame, early: DataFrame) -> DataFrame:
        """Where the nodes of a round end up, from where those of the next one do."""
        ends = late.select(F.col("id").alias("to"), F.col("to").alias("end"))
        return early.join(ends, "to", "left").select("id", F.coalesce("end", "to").alias("to"))

    ends = materialize(reduce(onward, reversed(rounds)), "ends")
    least = ends.groupBy("to").agg(F.min("id").alias("label"))
    return materialize(ends.join(least, "to").select("id", "label"), "labels")
