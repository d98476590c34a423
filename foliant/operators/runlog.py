"""The run log as an append-only table, queue edits, healing and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages of a document from which on batches are so small.
LANES = ((300, 5), (120, 10))


def starts(requests: DataFrame, now: str) -> DataFrame:
    """Log rows of runs that begin: running, with at least attempt 1."""
    return requests.select("id", "doc_id", "task", "source", F.lit("running").alias("status"), F.greatest(F.lit(1), F.coalesce("attempt", F.lit(1))).alias("attempt"), F.lit(None).cast("string").alias("checkpoint_json"), F.lit(None).cast("string").alias("error_message"), F.lit(now).alias("updated_at"), F.lit(0).alias("version"))


def fold_log(log: DataFrame) -> DataFrame:
    """The state of each run from its rows: each column's last value by version that is not null.

    A run is written as a first row and later ones for checkpoints and its end; rows
    are never changed in place.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(c)
    columns = [c for c in log.columns if c not in ("id", "version")]
    return log.groupBy("id").agg(*[last(c) for c in columns])


def healed(stats: DataFrame, now: int, *, heartbeat_ttl: int = 30) -> DataFrame:
    """Queue counters with a stuck in_progress set to 0.

    `stats` has length, in_progress, has_lock, heartbeat_at and running_since.  A count is
    stuck when the queue is empty, nothing holds the lock, the heartbeat is missing or
    older than twice its lifetime, and the running task is unknown or old.
    """
    limit = 2 * heartbeat_ttl
    stale = F.col("heartbeat_at").isNull() | (F.lit(now) - F.col("heartbeat_at") > limit)
    old = F.col("running_since").isNull() | (F.lit(now) - F.col("running_since") > max(60, limit))
    stuck = (F.col("in_progress") > 0) & (F.col("length") == 0) & ~F.col("has_lock") & stale & old
    return stats.withColumn("in_progress", F.when(stuck, 0).otherwise(F.col("in_progress")))


def move_item(queue: DataFrame, at: int, to: int) -> DataFrame:
    """`queue` (position from 0, ...) with one item moved; a place outside leaves it as it is.

    Positions are shifted by a formula: no row is numbered anew.
    """
    n = queue.agg(F.count(F.lit(1)).alias("n"))
    p = F.col("position")
    target = F.greatest(F.lit(0), F.least(F.lit(to), F.col("n") - 1))
    moved = F.when(p == at, target).when((p > at) & (p <= target), p - 1).when((p < at) & (p >= target), p + 1).otherwise(p)
    valid = (F.lit(at) >= 0) & (F.lit(at) < F.col("n"))
    return queue.crossJoin(F.broadcast(n)).withColumn("position", F.when(valid, moved).otherwise(p).cast("long")).drop("n")


def remove_item(queue: DataFrame, at: int) -> DataFrame:
    p = F.col("position")
    return queue.where(p != at).withColumn("position", F.when(p > at, p - 1).otherwise(p))


def peek(queue: DataFrame, limit: int = 20) -> DataFrame:
    """The first items; a bare number is a full run of that document, other text is handed on raw."""
    entry = F.trim("entry")
    parsed = F.when(entry.startswith("{"), F.from_json(entry, "doc_id long, task string"))
    number = F.when(entry.rlike(r"^\d+$"), entry.cast("long"))
    rows = queue.where(F.col("position") < max(1, limit))
    return rows.select("position", F.coalesce(parsed["doc_id"], number).alias("doc_id"), F.coalesce(parsed["task"], F.when(number.isNotNull(), "full")).alias("task"), F.when(parsed["doc_id"].isNull() & parsed["task"].isNull() & number.isNull(), F.col("entry")).alias("raw"))


def batches(pages: DataFrame) -> DataFrame:
    """(doc_id, batch, first, last, n) of pages still to read: small batches for long documents.

    `pages` has doc_id, page_count and page; 5 pages from 300 on, 10 from 120, else all at once.
    """
    size = F.when(F.col("page_count") >= LANES[0][0], LANES[0][1]).when(F.col("page_count") >= LANES[1][0], LANES[1][1]).otherwise(F.lit(1 << 30))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    cut = pages.withColumn("batch", F.floor(k / size).cast("int"))
    return cut.groupBy("doc_id", "batch").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count(F.lit(1)).alias("n"))


def embed_batch_size(chunks: Column) -> Column:
    """16, and less for documents of many chunks."""
    return F.when(chunks >= 1200, 4).when(chunks >= 600, 6).when(chunks >= 250, 8).otherwise(16)


def merged_source(old: Column, new: Column) -> Column:
    """Bookkeeping of a document embedded from another layer too: 'both'."""
    return F.when(old.isNull() | (old == new), new).otherwise("both")


def unchanged_embedding(current: DataFrame, stored: DataFrame) -> DataFrame:
    """`current` (doc_id, content_hash, model, chunk_count) plus skip: hash, model and chunk count are those stored."""
    old = stored.select("doc_id", F.struct("content_hash", "model", "chunk_count").alias("old"))
    same = F.struct("content_hash", "model", "chunk_count").eqNullSafe(F.col("old"))
    return current.join(old, "doc_id", "left").withColumn("skip", same & F.col("old").isNotNull()).drop("old")


def progress(state: DataFrame, now: int) -> DataFrame:
    """`state` (name, done, total, started_at) with percent and eta_seconds; nothing done has no ETA."""
    left = F.greatest(F.lit(0), F.col("total") - F.col("done"))
    percent = F.when(F.col("total") > 0, F.round(100.0 * F.least("done", "total") / F.col("total"), 1)).otherwise(0.0)
    rate = (F.lit(now) - F.col("started_at")) / F.col("done")
    return state.withColumns({"percent": percent, "eta_seconds": F.when((F.col("done") > 0) & (F.lit(now) > F.col("started_at")), F.floor(rate * left).cast("long"))})
