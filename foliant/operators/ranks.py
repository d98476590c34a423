"""Ranks and running sums over ranges of sorted rows, without one window over a whole group.

Rows are dealt into ranges of the order by sampled quantiles, sorted inside their range and
saved; each range then holds a run of every group in it.  Runs are summed, their sums carried
on from range to range, and a row's rank is the sum before its run plus its place in the run.
A group of any size is spread over as many ranges as its rows fill, so the largest task does
not follow the largest group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.storage import Scratch

_RANGE, _PLACE = 33, (1 << 33) - 1


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank", *, scratch: Scratch | None = None) -> DataFrame:
    """All columns of `df` and `name` (long): the row's number within its group, from 1.

    Equal to row_number() over (partition by group order by order); rows that tie in the
    whole order are numbered in any order, and with nothing to group by the whole table
    is one group.  Null is a group of its own.  `df` is read twice (once to sample), so
    pass a saved table where it is costly.  An existing column `name` is replaced; an
    empty table gives no rows.
    """
    scratch = scratch or Scratch(df.sparkSession, "ranks")
    rows = df.drop(name)
    keys = [F.col(c) for c in group] + order
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.save(placed, f"{name}-sorted")
    part = F.shiftright("_at", _RANGE)
    runs = placed.groupBy(part.alias("_part"), *group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # A group has one row for each range it fills, and the shuffle bounds the number of ranges.
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.struct("_part", *group).alias("_run"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    runs = scratch.save(runs, f"{name}-runs")
    own = F.struct(part.alias("_part"), *[placed[c] for c in group])  # a struct is never null, and nulls in it are equal
    return placed.join(runs, own == F.col("_run")).select(*[placed[c] for c in rows.columns], (F.col("_at") + F.col("_shift")).alias(name))
