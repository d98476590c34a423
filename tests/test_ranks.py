import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators.ranks import ranked


@pytest.mark.parametrize("group", [[], ["g"], ["g", "h"]])
def test_equal_to_row_number_on_skewed_groups(spark, group):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 17 == 0, None).otherwise((F.col("id") % 40).cast("string")).alias("g"),
        (F.col("id") % 2).alias("h"), F.when(F.col("id") % 5 != 0, F.col("id") % 11).alias("x"), "id", F.lit(-1).alias("rank"),
    )
    order = [F.desc_nulls_last("x"), F.col("id")]
    found = ranked(rows, group, order)
    assert found.columns == ["g", "h", "x", "id", "rank"]
    window = Window.partitionBy(*group).orderBy(*order)
    wanted = rows.select("id", F.row_number().over(window).alias("rank"))
    assert sorted(map(tuple, found.select("id", "rank").collect())) == sorted(map(tuple, wanted.collect()))


def test_ties_repeated_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a")] * 5 + [(None, None)] * 3, "k int, v string")
    found = ranked(rows, ["k"], [F.col("v")], "n").collect()
    assert sorted((r.k or 0, r.n) for r in found) == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (1, 4), (1, 5)]
    assert ranked(rows.limit(0), ["k"], [F.col("v")], "n").count() == 0


def test_a_hot_group_is_spread(spark):
    rows = spark.range(8000).select(F.lit("one").alias("g"), F.xxhash64("id").alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ranked(rows, ["g"], [F.col("x")])
        parts = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(parts) == 8000 and max(parts) < 4000
