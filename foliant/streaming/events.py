"""Streams over the run log: windows, deduplication, delayed tasks and incremental sync."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from foliant.sources.versioned import VersionedTable

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, *, max_files: int = 10) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, *, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window and type; works on streams and tables."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type")
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", *, late: str = "1 hour") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    out = grouped.agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("w.end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


def first_of_key(events: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Enqueue with a dedupe key: later requests of a key are dropped within the watermark."""
    keyed = events.withColumn("task_key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return keyed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["task_key"])


def incremental_sync(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run `merge` once for each micro-batch of what is new; the checkpoint is the high-water mark."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_into(table: VersionedTable, order: str) -> Callable[[DataFrame, int], None]:
    """A merge that keeps, for each key of `table`, the newest row by `order`.

    What a batch writes follows its own rows, and a batch that is run again is written once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table.upsert(batch, order=F.col(order), batch=number)

    return merge


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
