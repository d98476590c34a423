import random
from collections import defaultdict

import pandas as pd
from pyspark.sql import functions as F

from foliant.streaming import queue


def by_definition(commands, now):
    """Each task's status, place and counts, one command after another over the whole history."""
    tasks, counts = {}, defaultdict(lambda: defaultdict(int))
    for key, _, at, op, delay in sorted(commands, key=lambda c: (c[2], c[1])):
        n, t = counts[key], tasks.get(key)
        if t and t["due"] and t["due"] <= at:
            t.update(place=t["due"], due=None)
            n["due"] += 1
        if t is None and op in ("enqueue", "front", "delay"):
            tasks[key] = {"place": {"enqueue": at, "front": -at, "delay": 0}[op], "due": at + max(1, delay) * 10**6 if op == "delay" else None, "running": False}
            n["added"] += 1
        elif t and op == "front" and not t["due"] and not t["running"]:
            t["place"] = -at
            n["moved"] += 1
        elif t and op == "start" and not t["due"] and not t["running"]:
            t.update(running=True, place=0)
        elif t and op == "done" and t["running"]:
            del tasks[key]
            n["finished"] += 1
        elif t and op == "cancel" and not t["running"]:
            del tasks[key]
            n["cancelled"] += 1
        else:
            n["skipped"] += 1
    out = {}
    for key, n in counts.items():
        t = tasks.get(key)
        if t and t["due"] and t["due"] <= now:
            t.update(place=t["due"], due=None)
            n["due"] += 1
        status = "absent" if not t else "running" if t["running"] else "delayed" if t["due"] else "queued"
        out[key] = (status, t["place"] if t else 0, *[n[a] for a in ("added", "moved", "due", "skipped", "finished", "cancelled")])
    return out


def write(spark, path, rows):
    frame = spark.createDataFrame([(*r, pd.Timestamp(r[2] * 1000).to_pydatetime()) for r in rows], queue.COMMANDS)
    frame.coalesce(1).write.mode("append").parquet(path)


def test_state_timers_and_restart(spark, tmp_path):
    rng = random.Random(4)
    base = 1_700_000_000_000_000
    commands = [(f"{rng.randrange(8)}:full", i, base + i * 1_000_000, rng.choice(queue.OPS), rng.choice([0, 1, 5, 60])) for i in range(400)]
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for lo, hi in ((0, 150), (150, 151), (151, 400)):  # each run goes on from the state of the one before
        write(spark, source, commands[lo:hi] + ([(None, 900, base, "enqueue", 0), ("x", 901, base, "unknown", 0)] if lo == 0 else []))
        stream = spark.readStream.schema(queue.COMMANDS).option("maxFilesPerTrigger", 1).parquet(source)
        query = queue.run(spark, queue.task_changes(stream), out, mark)
        query.awaitTermination(240)
        assert query.exception() is None
        now = commands[hi - 1][2]
        found = queue.queue_state(spark.read.parquet(out), F.lit(now)).collect()
        assert {r.task_key: tuple(r)[1:] for r in found} == by_definition(commands[:hi], now)
    log = spark.read.parquet(out)
    assert log.groupBy("task_key", "step").count().where("count > 1").isEmpty()
