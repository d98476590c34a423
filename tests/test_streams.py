import pandas as pd
from pyspark.sql import functions as F

from foliant.sources.versioned import VersionedTable
from foliant.streaming import events


def _rows(spark, path, rows):
    frame = spark.createDataFrame(rows, events.EVENTS)
    frame.coalesce(1).write.mode("append").parquet(path)


def test_incremental_sync_keeps_the_newest_row(spark, tmp_path):
    at = lambda m: pd.Timestamp(f"2024-01-01 00:{m:02d}:00").to_pydatetime()
    source, target, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    _rows(spark, source, [(1, at(1), 7, "view", 1.0, "{}"), (2, at(5), 7, "view", 2.0, "{}")])
    stream = events.event_stream(spark, source).select("user_id", "ts", "value")
    table = VersionedTable(spark, target, ["user_id"], buckets=4)
    merge = events.upsert_into(table, "ts")
    events.incremental_sync(stream, merge, mark).awaitTermination()
    assert [r.value for r in table.read().collect()] == [2.0]
    _rows(spark, source, [(3, at(9), 7, "view", 3.0, "{}"), (4, at(9), 8, "view", 4.0, "{}")])
    events.incremental_sync(stream, merge, mark).awaitTermination()
    assert sorted(r.value for r in table.read().collect()) == [3.0, 4.0] and [r.value for r in table.read(0).collect()] == [2.0]
    merge(spark.createDataFrame([(7, at(59), 9.0)], "user_id long, ts timestamp, value double"), 1)  # a batch that was written already
    assert table.manifest()["version"] == 1


def test_stream_and_batch_windows_agree(spark, tmp_path):
    rows = [(i, pd.Timestamp("2024-01-01").to_pydatetime() + pd.Timedelta(minutes=7 * i).to_pytimedelta(), i % 3, "view", float(i), "{}") for i in range(60)]
    source = str(tmp_path / "in")
    _rows(spark, source, rows)
    live = events.windowed_counts(events.event_stream(spark, source), "1 hour")
    query = live.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = events.windowed_counts(spark.read.parquet(source).withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, batch.collect()))
