"""Products bought together.

The lines are read once, into a stored table of distinct (order, product); everything
else works on that. Counting pairs means expanding every order into its pairs, which is
linear in the data only while orders are small. Orders wider than ``max_width`` products
are therefore never expanded as a whole:

* narrow orders are expanded and counted;
* a pair seen in narrow orders gets its wide orders by probing them for the pair, a join
  on the product cut into a grid of cells (``grid_join``), since a product may be in very
  many candidates and very many wide orders;
* a pair seen in wide orders only can matter only if it occurs in at least as many
  of them as the result asks for, so both its products do too. Only such products
  are paired inside the wide orders: an order of n of them is dealt into n / BLOCK blocks,
  and every two blocks of it are a key of their own, with at most about BLOCK * BLOCK
  pairs, whatever the order's width. With fewer wide orders than the threshold there are
  none.

Together this is exact for any mix of orders. Which products exist is asked of the
products (one row each, counted map-side), never of the lines: lines only lose the
products that turn out to be unknown, and stay where they are otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, functions as F

from tillroll.functions.exact import pct
from tillroll.operators import skew
from tillroll.operators.scratch import materialize
from tillroll.operators.skew import HotKeys, attach, exact_hot, grid_join, salted_join, with_group_values
from tillroll.sources.tables import RetailTables

MAX_WIDTH = 200
#: Products of a wide order in one block.
BLOCK = 200


@dataclass(frozen=True)
class BasketInput:
    """``lines(order_id, product_id)`` of any status, ``keys(order_id)`` of the orders
    that count, those orders themselves, ``products(product_id, product_name,
    category)``. Without keys the lines are stored, distinct and of orders that count;
    without orders every order that counts has lines."""

    lines: DataFrame
    keys: DataFrame | None
    orders: DataFrame | None
    products: DataFrame


def product_baskets(t: RetailTables) -> BasketInput:
    stored = t.stored_sold_products()
    lines = t.order_items if stored is None else stored
    return BasketInput(
        lines.select("order_id", "product_id"),
        t.completed_keys() if stored is None else None,
        None if t.orders_have_lines else t.completed(),
        t.products.select("product_id", "product_name", "category"),
    )


def _pairs_of(sets: DataFrame) -> DataFrame:
    """Pairs a < b of every set, generated in place: no join, no further shuffle."""
    return sets.select(F.posexplode("members").alias("at", "a"), "members").select(
        "a", F.explode(F.slice("members", F.col("at") + 2, F.size("members"))).alias("b")
    )


def _count_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count("*").alias("together"))


def _blocked_pairs(baskets: DataFrame, hot_orders: HotKeys) -> DataFrame:
    """Pairs within wide orders, two blocks of an order at a time."""
    sized = with_group_values(baskets, "order_id", hot_orders, {"n": F.count("*")})
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (
        sized.select("order_id", "product_id", blocks.alias("blocks"))
        .withColumn("block", F.pmod(F.xxhash64("product_id"), F.col("blocks").cast("bigint")).cast("int"))
        .groupBy("order_id", "block", "blocks")
        .agg(F.collect_list("product_id").alias("members"))
    )
    # Stored, since both sides below repeat it.
    dealt = materialize(dealt, "blocks")
    first = dealt.select(
        "order_id",
        F.col("block").alias("i"),
        F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"),
        F.col("members").alias("one"),
    )
    second = dealt.select(
        "order_id",
        F.explode(F.sequence(F.lit(0), "block")).alias("i"),
        F.col("block").alias("j"),
        F.col("members").alias("two"),
    )
    each = first.join(second, ["order_id", "i", "j"]).select("i", "j", F.explode("one").alias("x"), "two")
    each = each.select("i", "j", "x", F.explode("two").alias("y")).where("i < j or x < y")
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _pairs_with_wide(
    narrow: DataFrame, wide: DataFrame, n_wide: int, hot_orders: HotKeys, at_least: int, top_k: int | None
) -> DataFrame:
    """``a, b, together`` over all orders for every pair that can be in the result,
    from the pair counts of the narrow orders and the baskets of the wide ones."""
    if top_k:
        # the k-th best narrow count bounds the k-th best count from below
        best = narrow.orderBy(F.desc("together")).limit(top_k).agg(
            F.count("*").alias("n"), F.min("together").alias("kth")
        ).first()
        if best["n"] == top_k:
            at_least = max(at_least, best["kth"])

    candidates = narrow.where(F.col("together") >= at_least - n_wide)
    probed = grid_join(
        candidates.select("a", "b"), wide.withColumnRenamed("product_id", "a"), "a", ["b"], ["order_id"]
    ).join(wide.withColumnRenamed("product_id", "b"), ["order_id", "b"])
    counts = (
        candidates.join(
            _count_pairs(probed).withColumnRenamed("together", "in_wide"),
            ["a", "b"],
            "left",
        )
        .select(
            "a",
            "b",
            (F.col("together") + F.coalesce("in_wide", F.lit(0))).alias("together"),
        )
    )
    if n_wide < at_least:
        return counts
    recurring = wide.groupBy("product_id").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    recurring = materialize(recurring, "recurring")
    paired = salted_join(
        wide, recurring.select("product_id"), "product_id", exact_hot(recurring, "product_id", "n"), ["order_id"]
    )
    only_wide = _count_pairs(_blocked_pairs(paired, hot_orders)).join(narrow.select("a", "b"), ["a", "b"], "left_anti")
    return counts.unionByName(only_wide)


def _named(kept: DataFrame, products: DataFrame) -> tuple[DataFrame, int]:
    """Every product sold with its order count and name (``known`` is false if it has
    none), and how many unknown ones there are."""
    singles = kept.groupBy("product_id").agg(F.count("*").alias("orders"))
    known = products.withColumn("known", F.lit(True))
    named = singles.join(known, "product_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    named = materialize(named, "products-sold")
    return named, named.where("not known").count()


def _affinity(source: BasketInput, min_pair_orders: int, top_k: int | None, max_width: int):
    """Pair counts that qualify, the products sold, and the number of orders that count."""
    at_least = max(1, min_pair_orders)
    items = source.lines if source.keys is None else materialize(source.lines.distinct(), "items")
    widths = items.groupBy("order_id").agg(F.count("*").alias("width"))
    if source.keys is not None:
        widths = widths.join(source.keys, "order_id", "left_semi")
    orders = materialize(widths, "widths")
    total = (orders if source.orders is None else source.orders).agg(F.count("*")).scalar()
    size = orders.agg(F.count_if(F.col("width") > max_width), F.max("width")).first()
    n_wide, widest = size[0], size[1] or 0
    hot = exact_hot(orders, "order_id", "width") if widest > skew.ROWS_PER_TASK else HotKeys()
    kept = salted_join(items, orders, "order_id", hot, ["product_id"])
    named, unknown = _named(kept, source.products)
    if unknown:
        # An unknown product is in no pair, so it must not take a place among the first top_k.
        lost = named.where("not known").select("product_id", F.lit(True).alias("lost"))
        most = named.agg(F.max("orders")).first()[0]
        parts = max(2, ceil(most / skew.ROWS_PER_TASK))
        kept = attach(kept, lost, "product_id", unknown, parts).where("lost is null").drop("lost")

    # A narrow order has at most max_width products in its set.
    sets = kept.where(F.col("width") <= max_width).groupBy("order_id").agg(
        F.sort_array(F.collect_list("product_id")).alias("members")
    )
    pairs = _count_pairs(_pairs_of(sets))
    if n_wide:
        wide = materialize(kept.where(F.col("width") > max_width).select("order_id", "product_id"), "wide")
        pairs = _pairs_with_wide(materialize(pairs, "narrow-pairs"), wide, n_wide, hot, at_least, top_k)

    pairs = pairs.where(F.col("together") >= at_least)
    if top_k:
        return pairs.orderBy(F.desc("together"), "a", "b").limit(top_k), named, total
    return materialize(pairs, "pairs"), named, total


def _with_product(pairs: DataFrame, end: str, named: DataFrame, top_k: int | None) -> DataFrame:
    """Attach the product of one end of the pairs. With a limit the pairs are at most
    ``top_k`` rows, and so broadcast; without one a product may be in a large part of them."""
    side = named.where("known").select(
        F.col("product_id").alias(end),
        F.col("orders").alias(f"orders_{end}"),
        F.col("product_name").alias(f"name_{end}"),
        F.col("category").alias(f"category_{end}"),
    )
    if top_k:
        return side.join(F.broadcast(pairs), end)
    hot = HotKeys()
    if pairs.count() > skew.ROWS_PER_TASK:
        hot = exact_hot(pairs.groupBy(end).agg(F.count("*").alias("n")), end, "n")
    return salted_join(pairs, side, end, hot, ["a", "b"])


def market_basket_pairs(
    t: RetailTables,
    min_pair_orders: int = 10,
    top_k: int | None = 20,
    max_width: int = MAX_WIDTH,
    source: BasketInput | None = None,
) -> DataFrame:
    source = source or product_baskets(t)
    pairs, named, total = _affinity(source, min_pair_orders, top_k, max_width)
    for end in ("a", "b"):
        stored = pairs if top_k or end == "a" else materialize(pairs, "named-pairs")
        pairs = _with_product(stored, end, named, top_k)
    together = F.col("together")
    return pairs.select(
        F.col("a").alias("product_a_id"),
        F.col("name_a").alias("product_a_name"),
        "category_a",
        F.col("b").alias("product_b_id"),
        F.col("name_b").alias("product_b_name"),
        "category_b",
        together.alias("times_bought_together"),
        F.col("orders_a").alias("orders_with_product_a"),
        F.col("orders_b").alias("orders_with_product_b"),
        pct(together, total, 2).alias("basket_support_pct"),
        pct(together, F.col("orders_a"), 1).alias("confidence_a_to_b_pct"),
        pct(together, F.col("orders_b"), 1).alias("confidence_b_to_a_pct"),
    ).orderBy(F.desc("times_bought_together"), "product_a_id", "product_b_id")


def top_pairs_dashboard(
    t: RetailTables,
    top_k: int = 10,
    max_width: int = MAX_WIDTH,
    source: BasketInput | None = None,
) -> DataFrame:
    source = source or product_baskets(t)
    pairs, named, total = _affinity(source, 1, top_k, max_width)
    for end in ("a", "b"):
        pairs = _with_product(pairs, end, named, top_k)
    return pairs.orderBy(F.desc("together"), "a", "b").select(
        F.col("name_a").alias("p1_name"),
        F.col("category_a").alias("p1_cat"),
        F.col("name_b").alias("p2_name"),
        F.col("category_b").alias("p2_cat"),
        F.col("together").alias("co_orders"),
        pct(F.col("together"), total, 2).alias("support_pct"),
    )
