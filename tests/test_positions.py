from collections import defaultdict

from pyspark.sql import functions as F

from tillroll.operators.positions import positions


def test_positions_of_groups_larger_than_a_slice(spark):
    rows = spark.range(5_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        (F.xxhash64("id") % 500).alias("v"),
        "id",
    )
    got = positions(rows, ["g"], [F.desc("v"), F.col("id")]).collect()
    assert len(got) == 5_000
    groups = defaultdict(list)
    for r in got:
        groups[r.g].append(r)
    for of in groups.values():
        of.sort(key=lambda r: (-r.v, r.id))
        assert [r.pos for r in of] == list(range(len(of)))
        assert {r.size for r in of} == {len(of)}


def test_whole_table_and_empty_table(spark):
    rows = spark.range(1_000).withColumn("v", F.col("id") % 7)
    got = positions(rows, [], [F.col("v"), F.desc("id")])
    assert [r.id for r in got.orderBy("pos").collect()] == sorted(range(1_000), key=lambda i: (i % 7, -i))
    empty = positions(rows.where("id < 0"), [], [F.col("v")])
    assert empty.columns == ["id", "v", "pos", "size"] and empty.count() == 0


def test_nulls_in_the_order_come_first(spark):
    rows = spark.createDataFrame([("a", None), ("a", 2), ("a", 1), ("b", None)], "g string, v int")
    got = positions(rows, ["g"], [F.asc_nulls_first("v")]).collect()
    assert {(r.g, r.v, r.pos, r.size) for r in got} == {("a", None, 0, 3), ("a", 1, 1, 3), ("a", 2, 2, 3), ("b", None, 0, 1)}
