"""Tables that outlive a lost executor, readers of the given tables and a cut by counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.storage import Scratch, shared_dir

__all__ = ["Scratch", "most_frequent", "read", "shared_dir"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def most_frequent(counted: DataFrame, column: str, limit: int) -> DataFrame:
    """Rows with the greatest counts, `limit` at most: those above a cut that a histogram of fixed size gives.

    A plain order with a limit would send so many rows of every part to the driver.
    """
    step = (F.log2(F.col(column) + F.lit(1)) * 64).cast("int")
    bins = {r["b"]: r["n"] for r in counted.groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 4,096 rows at most
    cut, total = max(bins, default=0) + 1, 0
    for b in sorted(bins, reverse=True):
        total += bins[b]
        if total > limit:
            break
        cut = b
    return counted.where(step >= cut)
