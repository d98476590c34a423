"""A keyed table in versions: upserts write their own rows only, and a manifest switches to them at once.

Rows lie in buckets of their keys' hash.  An upsert adds a layer, the newest row of each of its
keys and marks of deleted ones, to the buckets that it touches; a manifest lists the layers of
every bucket.  Readers take the layers of one manifest and each key's newest row, so a crash
between writing a layer and the switch leaves the table as it was.  A bucket with many layers is
rewritten as one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.storage import delete, file_system

OWN = ("_bucket", "_layer", "_gone")


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class VersionedTable:
    """The table at `path` with `keys` unique; all paths belong to a file system that executors share.

    `buckets` and `max_layers` are fixed when the table is made.  A manifest has an entry
    for each layer of a bucket, so its size is bounded by them and not by the rows.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], *, buckets: int = 64, max_layers: int = 8) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.buckets, self.max_layers = buckets, max_layers

    # ---- manifests ----

    def versions(self) -> list[int]:
        fs, folder = file_system(self.spark, f"{self.path}/_versions")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """{version, batch, schema, layers}: layers is a list of [layer, folder] for each bucket that has rows."""
        there = self.versions()
        if not there:
            return {"version": -1, "batch": None, "schema": None, "layers": {}}
        file = f"{self.path}/_versions/v{there[-1] if version is None else version:08d}.json"
        return json.loads("".join(r.value for r in self.spark.read.text(file, wholetext=True).collect()))

    def _switch(self, manifest: dict) -> int:
        """Make a manifest the newest; the name of a version can be taken once."""
        jvm = self.spark._jvm
        fs, temporary = file_system(self.spark, f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions/v{manifest['version']:08d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(temporary, target, options)
        except Exception as error:
            fs.delete(temporary, False)
            raise Conflict(f"version {manifest['version']} is there already") from error
        return manifest["version"]

    # ---- rows ----

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _layers(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        """Every row of every layer, with its bucket, layer and mark."""
        schema = StructType.fromJson(manifest["schema"]).add("_gone", "boolean").add("_layer", "long")
        folders = [f"{self.path}/{folder}/_bucket={b}" for b, own in manifest["layers"].items() if only is None or int(b) in only for _, folder in own]
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("_bucket", F.lit(0))
        return self.spark.read.schema(schema).parquet(*folders).withColumn("_bucket", self._bucket())

    def _newest(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        rest = [c for c in columns if c not in self.keys] + ["_gone"]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_layer").alias("_x"))
        return newest.select(*self.keys, "_x.*")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default; buckets of one layer are read as they are."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError(f"{self.path} has no version yet")
        columns = StructType.fromJson(manifest["schema"]).fieldNames()
        single = {int(b) for b, own in manifest["layers"].items() if len(own) == 1}
        several = {int(b) for b, own in manifest["layers"].items() if len(own) > 1}
        rows = self._layers(manifest, single).where("NOT _gone").select(*columns)
        if several:
            rows = rows.unionByName(self._newest(self._layers(manifest, several), columns).where("NOT _gone").select(*columns))
        return rows

    def upsert(self, rows: DataFrame, *, order: Column | None = None, gone: Column | None = None, batch: int | None = None) -> int:
        """Put `rows` in place of those with equal keys; returns the version.

        Of rows with equal keys the greatest by `order` counts, any without it.  Where
        `gone` is true the key is taken away.  A `batch` number that is not above the
        last one's changes nothing, so a micro-batch that is run again is written once.
        Columns must be those of the table; a null key is a key.
        """
        manifest = self.manifest()
        if batch is not None and manifest["batch"] is not None and batch <= manifest["batch"]:
            return manifest["version"]
        given = rows.columns
        schema = rows.schema if manifest["schema"] is None else StructType.fromJson(manifest["schema"])
        if set(schema.fieldNames()) != set(given):
            raise ValueError(f"columns {given} are not those of the table")
        rows = rows.select(*schema.fieldNames())
        marked = rows.withColumn("_gone", F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False))
        rest = [c for c in marked.columns if c not in self.keys]
        newest = marked.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order if order is not None else F.lit(0)).alias("_x")).select(*self.keys, "_x.*")
        version = manifest["version"] + 1
        folder = self._write(newest.withColumn("_layer", F.lit(version).cast("long")), schema)
        layers = {int(b): own for b, own in manifest["layers"].items()}
        for b in self._written(folder):
            layers.setdefault(b, []).append([version, folder])
        self._switch({"version": version, "batch": batch if batch is not None else manifest["batch"], "schema": schema.jsonValue(), "layers": layers})
        full = {b for b, own in layers.items() if len(own) > self.max_layers}
        return self.compact(full) if full else version

    def _write(self, rows: DataFrame, schema: StructType) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        out = rows.withColumn("_bucket", self._bucket()).select(*schema.fieldNames(), "_gone", "_layer", "_bucket")
        out.repartition("_bucket").write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        return folder

    def _written(self, folder: str) -> list[int]:
        fs, target = file_system(self.spark, f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in fs.listStatus(target)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("_bucket="))

    def compact(self, only: set[int] | None = None) -> int:
        """Rewrite buckets of several layers as one layer each, without marks; other buckets stay where they are."""
        manifest = self.manifest()
        chosen = {int(b) for b, own in manifest["layers"].items() if len(own) > 1 and (only is None or int(b) in only)}
        if not chosen:
            return manifest["version"]
        schema = StructType.fromJson(manifest["schema"])
        version = manifest["version"] + 1
        rows = self._newest(self._layers(manifest, chosen), schema.fieldNames()).where("NOT _gone").withColumn("_layer", F.lit(version).cast("long"))
        folder = self._write(rows, schema)
        kept = {int(b): own for b, own in manifest["layers"].items() if int(b) not in chosen}
        self._switch(manifest | {"version": version, "layers": kept | {b: [[version, folder]] for b in self._written(folder)}})
        return version

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests but the newest `keep`, and folders that these do not list; returns the number of folders.

        Run it when no upsert is under way: a layer that is not switched to yet is not listed.
        """
        there = self.versions()
        listed = {folder for v in there[-keep:] for own in self.manifest(v)["layers"].values() for _, folder in own}
        for v in there[:-keep]:
            delete(self.spark, f"{self.path}/_versions/v{v:08d}.json")
        fs, data = file_system(self.spark, f"{self.path}/data")
        gone = [s.getPath().getName() for s in fs.listStatus(data) if f"data/{s.getPath().getName()}" not in listed] if fs.exists(data) else []
        for name in gone:
            delete(self.spark, f"{self.path}/data/{name}")
        return len(gone)
