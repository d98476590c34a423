"""Intermediate tables in the shared folder named by spark.checkpoint.dir, and work on that folder's files."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and there is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = "file://" + tempfile.mkdtemp(prefix="foliant-")
    return _roots[app]


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The Hadoop file system of a path and the path as it knows it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def delete(spark: SparkSession, path: str) -> None:
    try:
        fs, target = file_system(spark, path)
        fs.delete(target, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


class Scratch:
    """A folder of Parquet tables that cut lineage; each can be read by every executor.

    Tables stay until drop() or the end of the driver, so a lost executor never
    costs more than the tasks it was running.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(delete, spark, self.path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """Save `df` in buckets of `key`: a join by that key leaves it where it is."""
        table = f"foliant_{uuid.uuid4().hex}"
        atexit.register(_forget, self.spark, table)
        df.write.format("parquet").option("compression", "zstd").option("path", f"{self.path}/{name}").bucketBy(buckets, key).saveAsTable(table)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.path}/{name}")


def _forget(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # the session has ended, and its catalogue with it
        pass
