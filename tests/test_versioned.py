import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliant.sources.versioned import Conflict, VersionedTable

ROW = "k long, s string, v double"


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def state(table, version=None):
    return {(r.k, r.s): r.v for r in table.read(version).collect()}


def test_versions_compaction_and_vacuum_against_a_dict(spark, tmp_path):
    rng = random.Random(5)
    table = VersionedTable(spark, str(tmp_path / "t"), ["k", "s"], buckets=4, max_layers=3)
    wanted, seen = {}, {}
    for step in range(9):
        rows = [(rng.choice([None, *range(12)]), rng.choice(["a", None]), float(100 * step + i)) for i in range(rng.randrange(0, 9))]
        drop = {v for _, _, v in rows if rng.random() < 0.3}
        frame = spark.createDataFrame(rows, ROW)
        version = table.upsert(frame, order=F.col("v"), gone=F.col("v").isin([-1.0, *drop]))
        for k, s, v in rows:
            wanted[k, s] = v
        for k, s, v in rows:
            if wanted.get((k, s)) in drop:
                del wanted[k, s]
        assert state(table) == wanted
        seen[version] = dict(wanted)
        assert all(len(own) <= 3 for own in table.manifest()["layers"].values())
    assert all(state(table, v) == rows for v, rows in seen.items())
    table.compact()
    assert state(table) == wanted and all(len(own) == 1 for own in table.manifest()["layers"].values())
    before = size(tmp_path)
    assert table.vacuum() > 0 and size(tmp_path) < before and state(table) == wanted and table.vacuum() == 0


def test_bytes_written_follow_the_batch(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=16)
    rows = spark.range(40_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("s"), F.rand(1).alias("v"))
    table.upsert(rows)
    whole = size(tmp_path)
    table.upsert(rows.where("k IN (7, 8)").withColumn("v", F.lit(-1.0)))
    assert size(tmp_path) - whole < whole / 50
    assert table.read().count() == 40_000 and table.read().where("v < 0").count() == 2


def test_a_crash_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=2)
    one = spark.createDataFrame([(1, "a", 1.0)], ROW)
    table.upsert(one, batch=0)

    def die(self, manifest):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_switch", die)
        with pytest.raises(RuntimeError):
            table.upsert(one.withColumn("v", F.lit(2.0)), batch=1)
    assert [r.v for r in table.read().collect()] == [1.0] and table.manifest()["batch"] == 0
    table.upsert(one.withColumn("v", F.lit(2.0)), batch=1)
    table.upsert(one.withColumn("v", F.lit(3.0)), batch=1)  # run again: written once
    assert [r.v for r in table.read().collect()] == [2.0]
    assert table.vacuum() == 1  # the layer that was lost; the other two are listed


def test_two_writers_and_wrong_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    table = VersionedTable(spark, path, ["k"], buckets=2)
    with pytest.raises(ValueError):
        table.read()
    one = spark.createDataFrame([(1, "a", 1.0)], ROW)
    table.upsert(one)
    with pytest.raises(Conflict):
        table._switch(table.manifest())
    with pytest.raises(ValueError):
        table.upsert(one.drop("v"))
    table.upsert(one.limit(0))
    assert state_of(table) == [(1, "a", 1.0)]


def state_of(table):
    return [tuple(r) for r in table.read().collect()]
