"""The task queue as keyed state of a stream: commands in, changes of each task out.

A task lives under its key.  Enqueueing a key that is there is a no-op, a front request moves a
queued task forward but leaves delayed and running ones, a delayed task is queued when its time
has come, and cancelling takes away what has not started.  State and timers are in Spark's state
store, so a restart goes on where the last committed micro-batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

#: Commands: what is asked of a task (op is one of OPS), when (at, microseconds), in which order (seq) and how long to wait.
COMMANDS = "task_key string, seq long, at long, op string, delay_s long, ts timestamp"
OPS = ("enqueue", "front", "delay", "start", "done", "cancel")
CHANGES = "task_key string, step long, seq long, at long, action string, status string, position long, due long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ABSENT = ("absent", 0, 0)


def change(task: tuple[str, int, int], op: str, at: int, delay_s: int) -> tuple[str, tuple[str, int, int]]:
    """(action, task) after a command on a task (status, position, due).

    Positions order the queue: the later a task is put at the back the greater, the
    later at the front the smaller.
    """
    status = task[0]
    if status == "absent" and op in ("enqueue", "front"):
        return "added", ("queued", at if op == "enqueue" else -at, 0)
    if status == "absent" and op == "delay":
        return "added", ("delayed", 0, at + max(1, delay_s) * 1_000_000)
    if status == "queued" and op == "front":
        return "moved", ("queued", -at, 0)
    if status == "queued" and op == "start":
        return "started", ("running", 0, 0)
    if status == "running" and op == "done":
        return "finished", ABSENT
    if status in ("queued", "delayed") and op == "cancel":
        return "cancelled", ABSENT
    return "skipped", task


class TaskState(StatefulProcessor):
    """One task: its status, place and due time, the number of its changes, and a timer while it waits."""

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", "status string, position long, due long, step long")

    def _read(self) -> tuple[tuple[str, int, int], int]:
        if not self.task.exists():
            return ABSENT, 0
        status, position, due, step = self.task.get()
        return (status, position, due), step

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        task, step = self._read()
        for row in sorted(rows, key=lambda r: (r.at, r.seq)):  # a micro-batch's commands of one task
            if task[0] == "delayed" and task[2] <= row.at:
                task, step = ("queued", task[2], 0), step + 1
                yield Row(task_key=key[0], step=step, seq=row.seq, at=task[1], action="due", status=task[0], position=task[1], due=0)
            action, task = change(task, row.op, row.at, row.delay_s or 0)
            step += 1
            yield Row(task_key=key[0], step=step, seq=row.seq, at=row.at, action=action, status=task[0], position=task[1], due=task[2])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if task[0] == "delayed":
            self.handle.registerTimer(-(-task[2] // 1000))
        self.task.update((*task, step))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        task, step = self._read()
        if task[0] == "delayed":
            task, step = ("queued", task[2], 0), step + 1
            self.task.update((*task, step))
            yield Row(task_key=key[0], step=step, seq=None, at=task[1], action="due", status=task[0], position=task[1], due=0)

    def close(self) -> None:
        pass


def task_changes(commands: DataFrame, *, late: str = "0 seconds") -> DataFrame:
    """A stream of CHANGES of a stream of COMMANDS; commands older than the watermark are left out.

    Commands of a null key or an unknown op are left out too; a task's commands are
    taken by time, then by number.
    """
    known = commands.where(F.col("task_key").isNotNull() & F.col("op").isin(*OPS))
    return known.withWatermark("ts", late).groupBy("task_key").transformWithState(TaskState(), CHANGES, outputMode="append", timeMode="eventTime")


def run(spark: SparkSession, changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the changes of everything new to a table at `path`; state stores of RocksDB are asked for while it starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        return changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


def queue_state(changes: DataFrame, now: Column) -> DataFrame:
    """One row per task from its changes, as of `now` (microseconds): a delayed task whose time has come is queued.

    Counts are of changes by action; partial sums and maxima go before the shuffle.
    """
    count = lambda a: F.count_if(F.col("action") == a)
    last = F.max_by(F.struct("status", "position", "due"), "step")
    out = changes.groupBy("task_key").agg(last.alias("x"), *[count(a).alias(a) for a in ("added", "moved", "due", "skipped", "finished", "cancelled")])
    ripe = (F.col("x.status") == "delayed") & (F.col("x.due") <= now)
    return out.select(
        "task_key", F.when(ripe, "queued").otherwise(F.col("x.status")).alias("status"), F.when(ripe, F.col("x.due")).otherwise(F.col("x.position")).alias("position"),
        "added", "moved", (F.col("due") + ripe.cast("long")).alias("due"), "skipped", "finished", "cancelled",
    )
