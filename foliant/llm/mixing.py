"""Mixing sources to target weights by systematic sampling.

Targets are shares of a budget by weight, held at a multiple of each source's size, the excess
shared anew by weight.  Within a source documents lie from the longest to the shortest; each has
an expected number of copies, their prefix sums are shifted by one random offset, and a document
is emitted once for each integer that its stretch crosses.  A source's few longest documents are
drawn at the source's rate; the rate of the others makes up for what those took too much or too
little, so the words taken end near the target even where one document outweighs hundreds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.ranks import ranked
from foliant.storage import Scratch

#: Copies are counted in whole parts of 2**-28, so prefix sums are exact.
UNIT = 1 << 28
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _level(sources: DataFrame, budget: Column) -> float:
    """The level at which every source's target is the lesser of its cap and level times weight.

    Each round shares what capped sources leave among the others and caps those that
    now have too much.  A round is one aggregation to a single row, and the level rises
    by Newton's method on a concave function, so few rounds are needed.
    """
    level, capped = -1.0, -1
    while True:
        over = F.col("_cap") <= F.lit(level) * F.col("_weight")
        row = sources.agg(
            budget.alias("budget"), F.count_if(over).alias("n"),
            F.sum(F.when(over, F.col("_cap")).otherwise(F.lit(0))).alias("held"), F.sum(F.when(over, F.lit(0)).otherwise(F.col("_weight"))).alias("weight"),
        ).first()
        if row["n"] == capped or not row["weight"]:
            return level
        level, capped = (row["budget"] - row["held"]) / row["weight"], row["n"]


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), *, percent: int = 150, most: int = 2) -> DataFrame:
    """(_source, _source_size long, _target double): one row per source of `sized` (_source, _size).

    Sources by code point, null last, weigh `weights`, repeating, and share `percent` of
    all sizes; a target stops at `most` times its source's size.  A source without words
    has the target 0; where the budget is more than all caps, every target is its cap.
    """
    scratch = Scratch(sized.sparkSession, "targets")
    summed = scratch.save(sized.groupBy("_source").agg(F.sum("_size").alias("_source_size")), "summed")
    numbers = ranked(summed, [], [F.asc_nulls_last("_source")], "_number", scratch=scratch)
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("_number") - 1, F.lit(len(weights))).cast("int"))
    sources = scratch.save(numbers.select("_source", "_source_size", weight.alias("_weight"), (F.col("_source_size") * most).alias("_cap")), "sources")
    level = _level(sources, F.sum("_source_size") * percent / 100)
    target = F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("_weight"))
    return sources.select("_source", "_source_size", target.alias("_target"))


def _crossed(before: Column, expected: Column, offset: Column) -> Column:
    """Integers in (before + offset, before + expected + offset], all in parts of UNIT."""
    whole = lambda x: F.shiftright(x, 28)
    return whole(before + expected + offset) - whole(before + offset)


def mix_sources(
    docs: DataFrame, size: Column, source: Column, *, key: str = "doc_id", weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, long_share: int = 256, seed: str = "mix",
) -> DataFrame:
    """All columns of `docs` plus _size, _source_size, _target and _copies (long, 0 to `most`).

    Documents of at least 1/long_share of their source's size, so `long_share` of them a
    source at most, are drawn first.  Order and offset come from md5 sums of `key` and
    the source, so reruns agree whatever the partitions.  A null source is a source of
    its own, and not that of an empty name; documents without words have a place in the
    order and may be emitted like others.  Rows that repeat key, source and size are
    interchangeable.  Columns of `docs` with the added names are replaced, others may
    have any name; an empty table gives no rows.  Rows meet their source's figures in a
    join whose hot keys adaptive execution splits, and are sorted in ranges, so no
    source is in one task.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    added = ("_size", "_source_size", "_target", "_copies")
    given = [c for c in docs.columns if c not in added]
    rows = docs.select(F.struct(*[docs[c] for c in given]).alias("_row"), size.cast("long").alias("_size"), source.cast("string").alias("_source"), F.md5(F.coalesce(docs[key].cast("string"), F.lit("")).cast("binary")).alias("_tie"))
    rows = scratch.save(rows, "rows")
    targets = source_targets(rows.select("_source", "_size"), weights, percent=percent, most=most)
    # Parts of UNIT: the number of copies that every document of the source is expected to get.
    rate = F.when(F.col("_source_size") > 0, F.least(F.floor(F.col("_target") / F.col("_source_size") * UNIT), F.lit(most * UNIT))).otherwise(0).cast("long")
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n"))).cast("binary"))
    offset = F.conv(F.substring(drawn, 1, 7), 16, 10).cast("long")
    plan = scratch.save(targets.select(F.struct("_source").alias("_of"), "_source_size", "_target", rate.alias("_rate"), offset.alias("_offset")), "plan")

    def of_source(left: DataFrame, figures: DataFrame) -> DataFrame:
        return left.join(figures, F.struct("_source") == F.col("_of")).drop("_of")  # a struct: null meets null

    is_long = (F.col("_size") > 0) & (F.col("_size") * long_share >= F.col("_source_size"))
    longest = of_source(rows.select("_source", "_size", "_tie"), plan).where(is_long)
    order = Window.partitionBy("_source").orderBy(F.desc("_size"), "_tie")  # long_share rows a source at most
    nth = F.row_number().over(order).cast("long") - 1
    longest = longest.withColumn("_copies", _crossed(nth * F.col("_rate"), F.col("_rate"), F.col("_offset")))
    heads = longest.groupBy("_source").agg(F.count(F.lit(1)).alias("_heads"), F.sum("_size").alias("_long"), F.sum(F.col("_size") * F.col("_copies")).alias("_taken"))
    left, short = F.col("_target") - F.coalesce("_taken", F.lit(0)), F.col("_source_size") - F.coalesce("_long", F.lit(0))
    rest = F.when(short > 0, F.least(F.greatest(F.floor(left / short * UNIT), F.lit(0)), F.lit(most * UNIT))).otherwise(F.col("_rate")).cast("long")
    heads = heads.select(F.struct("_source").alias("_head_of"), "_heads", "_long", "_taken")
    plan = plan.join(heads, F.col("_of") == F.col("_head_of"), "left").select("_of", "_source_size", "_target", "_rate", "_offset", F.coalesce("_heads", F.lit(0)).alias("_heads"), rest.alias("_rest"))
    plan = scratch.save(plan, "rates")

    placed = ranked(rows, ["_source"], [F.desc("_size"), F.col("_tie")], "_nth", scratch=scratch)
    found = of_source(placed, plan)
    # The prefix sum of a row's source up to the row: the long documents' rate, then the others'.
    among = F.col("_nth") - 1
    before = F.least(among, F.col("_heads")) * F.col("_rate") + F.greatest(among - F.col("_heads"), F.lit(0)) * F.col("_rest")
    expected = F.when(among < F.col("_heads"), F.col("_rate")).otherwise(F.col("_rest"))
    return found.select("_row.*", "_size", "_source_size", "_target", _crossed(before, expected, F.col("_offset")).alias("_copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of mix_sources() as often as it was drawn, with _copy from 0."""
    added = ("_size", "_source_size", "_target", "_copies")
    rows = mixed.where("_copies > 0")
    return rows.select(*[c for c in rows.columns if c not in added], F.explode(F.sequence(F.lit(0), F.col("_copies").cast("int") - 1)).alias("_copy"))
