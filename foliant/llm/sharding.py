"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt into logical blocks.  How many rows of each block go to each
shard is drawn exactly: shard capacities are split along a binary tree over the
blocks, every split being a multivariate hypergeometric draw made of univariate
ones.  Blocks are permuted locally, cut by their row of the matrix, exchanged,
and permuted again inside the shard.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch

#: Terms of Stirling's series for log(n!) are below 1e-15 from here on.
_SERIES_FROM = 12


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once instead of at each mention."""
    return F.transform(F.array(value), body)[0]


def _log_factorial(n: Column) -> Column:
    table = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(_SERIES_FROM)])
    series = lambda x: x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return _let(F.greatest(n, F.lit(0.0)), lambda x: F.when(x < _SERIES_FROM, F.get(table, x.cast("int"))).otherwise(series(x)))


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def hypergeometric(total: Column, good: Column, draws: Column, uniform: Column) -> Column:
    """Number of good items among `draws` taken from `total` without replacement.

    Inversion that visits the values outwards from the mode, so the work is a few
    standard deviations.  `uniform` lies in (0, 1); all other values are doubles.
    """

    def walk(x: Column) -> Column:
        """x: low, high and mode of the values, total, good, draws, p(mode)."""
        start = F.struct(
            x["mode"].alias("up"), x["mode"].alias("down"), x["p"].alias("p_up"), x["p"].alias("p_down"),
            (x["uniform"] - x["p"]).alias("left"), x["mode"].alias("value"),
        )
        rest = x["total"] - x["good"] - x["draws"]

        def step(s: Column, _: Column) -> Column:
            up, down = s["up"], s["down"]
            p_up = F.when(up < x["high"], s["p_up"] * (x["good"] - up) * (x["draws"] - up) / ((up + 1) * (rest + up + 1))).otherwise(0.0)
            p_down = F.when(down > x["low"], s["p_down"] * down * (rest + down) / ((x["good"] - down + 1) * (x["draws"] - down + 1))).otherwise(0.0)
            above, below = F.least(up + 1, x["high"]), F.greatest(down - 1, x["low"])
            moved = _let(
                F.struct(p_up.alias("u"), p_down.alias("d")),
                lambda p: F.struct(
                    above.alias("up"), below.alias("down"), p["u"].alias("p_up"), p["d"].alias("p_down"),
                    (s["left"] - p["u"] - F.when(s["left"] <= p["u"], 0.0).otherwise(p["d"])).alias("left"),
                    F.when(s["left"] <= p["u"], above).otherwise(below).alias("value"),
                ),
            )
            return F.when(s["left"] <= 0, s).otherwise(moved)

        deviation = F.sqrt(x["draws"] * x["good"] / F.greatest(x["total"], F.lit(1.0)) + 1)
        steps = F.greatest(F.least(F.ceil(9 * deviation) + 4, x["high"] - x["low"] + 1), F.lit(1.0)).cast("int")
        return F.when(x["high"] <= x["low"], x["low"]).otherwise(F.aggregate(F.sequence(F.lit(1), steps), start, step)["value"])

    given = F.struct(total.alias("total"), good.alias("good"), draws.alias("draws"), uniform.alias("uniform"))
    ranged = lambda g: F.struct(g["total"].alias("total"), g["good"].alias("good"), g["draws"].alias("draws"), g["uniform"].alias("uniform"), F.greatest(F.lit(0.0), g["draws"] - (g["total"] - g["good"])).alias("low"), F.least(g["draws"], g["good"]).alias("high"))
    centre = lambda r: F.least(F.greatest(F.floor((r["draws"] + 1) * (r["good"] + 1) / (r["total"] + 2)).cast("double"), r["low"]), r["high"])
    log_p = lambda r: _log_choose(r["good"], r["mode"]) + _log_choose(r["total"] - r["good"], r["draws"] - r["mode"]) - _log_choose(r["total"], r["draws"])
    with_mode = _let(_let(given, ranged), lambda r: r.withField("mode", centre(r)))
    return _let(_let(with_mode, lambda r: r.withField("p", F.exp(log_p(r)))), walk)


def _uniform(*parts: Column) -> Column:
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _split(capacity: Column, rows: Column, *key: Column) -> Column:
    """Multivariate hypergeometric draw: how many of `rows` rows go to each shard."""
    zero = F.struct(F.aggregate(capacity, F.lit(0.0), lambda a, c: a + c).alias("total"), rows.alias("rows"), F.array().cast("array<double>").alias("out"))

    def take(s: Column, at: Column) -> Column:
        good = F.get(capacity, at)
        k = hypergeometric(s["total"], good, s["rows"], _uniform(*key, at))
        return _let(k, lambda v: F.struct((s["total"] - good).alias("total"), (s["rows"] - v).alias("rows"), F.concat(s["out"], F.array(v)).alias("out")))

    return F.aggregate(F.sequence(F.lit(0), F.size(capacity) - 1), zero, take)["out"]


def communication_matrix(block_rows: DataFrame, shards: int, levels: int, seed: int) -> DataFrame:
    """(_matrix_block, _shard, _first, _last): positions of a block that go to a shard.

    `block_rows` has (block, n) for up to 2**levels blocks.  The tree has one node for
    each range of blocks; its rows number is bounded by the block count, which
    is a parameter and not a size of the data.
    """
    width = 1 << levels
    counts = block_rows.agg(F.map_from_entries(F.collect_list(F.struct("block", F.col("n").cast("double")))).alias("m"))
    # Sums of every tree node's range from the block counts.
    n_of = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: F.coalesce(F.try_element_at(F.col("m"), b), F.lit(0.0)))
    base = counts.select(n_of.alias("n"))
    total = F.aggregate("n", F.lit(0.0), lambda a, x: a + x)
    share = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(total / shards).cast("double") + F.when(s < F.pmod(total, F.lit(float(shards))), 1.0).otherwise(0.0))
    node = base.select(F.lit(0).alias("at"), "n", share.alias("capacity"))
    split = _split(F.col("capacity"), F.col("left_rows"), F.lit(seed), F.col("level"), F.col("at"))  # built once: it is a large expression
    for level in range(levels):
        half = width >> (level + 1)
        left_rows = F.aggregate(F.slice("n", 1, half), F.lit(0.0), lambda a, x: a + x)
        node = node.withColumns({"left_rows": left_rows, "level": F.lit(level)}).withColumn("left", split)
        node = node.select(
            F.explode(
                F.array(
                    F.struct((F.col("at") * 2).alias("at"), F.slice("n", 1, half).alias("n"), F.col("left").alias("capacity")),
                    F.struct((F.col("at") * 2 + 1).alias("at"), F.slice("n", half + 1, half).alias("n"), F.zip_with("capacity", "left", lambda c, x: c - x).alias("capacity")),
                )
            ).alias("x")
        ).select("x.*")
    cells = node.select(F.col("at").alias("block"), F.posexplode("capacity").alias("shard", "rows"), F.col("capacity"))
    before = F.aggregate(F.slice("capacity", 1, F.col("shard")), F.lit(0.0), lambda a, x: a + x)
    return cells.where("rows > 0").select(F.col("block").alias("_matrix_block"), F.col("shard").alias("_shard"), before.cast("long").alias("_first"), (before + F.col("rows")).cast("long").alias("_last"))


def uniform_shards(docs: DataFrame, shards: int = 16, *, seed: int = 20240229, block_rows: int = 1 << 16, cell_rows: int = 1 << 16, least: int = 64) -> DataFrame:
    """All columns of `docs` plus `_shard` int and `_slot` long: a uniform shuffle.

    Shard sizes differ by one row at most and slots of a shard are gapless from 0.
    Rows are numbered once, in a saved table, and everything is drawn from that table:
    no later reading of the input can number them anew.  Blocks depend on these numbers
    and not on values, so nulls, repeated rows and equal keys cannot make one block
    large.  The number of blocks and of the parts of a shard follows the row count, so
    a task sorts about block_rows or cell_rows rows; there are `least` blocks at least.
    Columns of `docs` named _shard or _slot are replaced; an empty input gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    given = [c for c in docs.columns if c not in ("_shard", "_slot")]
    placed = scratch.save(docs.select(F.struct(*[docs[c] for c in given]).alias("_row"), F.monotonically_increasing_id().alias("_place")), "placed")
    n = placed.count()
    levels = max(0, math.ceil(math.log2(max(least, n / block_rows))))
    cells = max(least, math.ceil(n / shards / cell_rows))
    placed = placed.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), "_place"), F.lit(1 << levels)).cast("int"))
    counts = placed.groupBy(F.col("_block").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    matrix = scratch.save(communication_matrix(counts, shards, levels, seed), "matrix")
    if (matrix.agg(F.sum(F.col("_last") - F.col("_first"))).first()[0] or 0) != n:
        raise RuntimeError("the communication matrix does not add up to the rows")

    def dealt(rows: DataFrame) -> DataFrame:
        local = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed + 101), "_place"), "_place")
        ranked = rows.withColumn("_at", F.row_number().over(local) - 1)
        hit = (F.col("_block") == F.col("_matrix_block")) & (F.col("_at") >= F.col("_first")) & (F.col("_at") < F.col("_last"))
        out = ranked.join(matrix, hit).drop("_matrix_block", "_first", "_last", "_at", "_block")
        return out.withColumn("_cell", F.pmod(F.xxhash64(F.lit(seed + 202), "_place"), F.lit(cells)).cast("int"))

    thin = dealt(placed.select("_place", "_block")).groupBy("_shard", "_cell").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("_shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = thin.select("_shard", "_cell", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_shard", "_cell").orderBy(F.xxhash64(F.lit(seed + 303), "_place"), "_place")
    final = dealt(placed).withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["_shard", "_cell"])
    return final.select("_row.*", F.col("_shard").cast("int").alias("_shard"), (F.col("_before") + F.col("_rank")).alias("_slot"))
