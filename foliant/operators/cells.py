"""An inverted file of vectors: k-means cells in a saved table, searched by cells, with an exact way on top."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators.vectors import block_best, unit_rows
from foliant.storage import Scratch

#: Scores are rounded to six digits, so a bound must clear them by this much.
SLACK = 2e-6


class VectorCells:
    """The index under `path`: unit vectors by cell, and one row for each cell with its centre, rows and radius.

    The centres are fitted by k-means on at most about `sample_rows` rows chosen by a hash of
    vec_id; every row is put into the cell of its nearest centre.  Centres are broadcast, and
    their size is bounded by `max_cells` times the width.  Rows without an id or a vector, with
    a null or non-finite component, or of another width than most are left out of the index.
    """

    def __init__(self, spark: SparkSession, path: str, *, max_cells: int = 4096, sample_rows: int = 200_000, block_rows: int = 2048) -> None:
        self.spark, self.path = spark, path
        self.max_cells, self.sample_rows, self.block_rows = max_cells, sample_rows, block_rows

    # ---- building ----

    def build(self, points: DataFrame, *, cells: int | None = None) -> None:
        """Index `points` (vec_id, embedding); without `cells`, the square root of the number of rows."""
        scratch = Scratch(self.spark, "cells")
        rows = scratch.save(_valid(points), "rows")
        # Widths are few; ties go to the lesser.
        widths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
        width, total = (widths[0]["width"], widths[0]["count"]) if widths else (0, 0)
        rows = rows.where(F.size("x") == width)
        k = min(self.max_cells, cells or max(1, round(total**0.5)))
        centres = self.spark.sparkContext.broadcast(self._fit(rows, k, total) if total else np.zeros((1, 1)))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = unit_rows(batch["x"])
                    near = x @ centres.value.T
                    # The nearest centre by distance: centres are means, not of unit length.
                    cell = (2 * near - (centres.value**2).sum(axis=1)).argmax(axis=1)
                    far = np.linalg.norm(x - centres.value[cell], axis=1)
                    yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["x"], pa.array(far), pa.array(cell, pa.int32())], names=["vec_id", "embedding", "far", "cell"])

        placed = rows.mapInArrow(assign, "vec_id long, embedding array<float>, far double, cell int")
        # Ranges split a cell of many rows over several files, and leave a small one in one.
        placed.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id").write.option("compression", "zstd").partitionBy("cell").parquet(f"{self.path}/vectors")
        scratch.drop("rows")
        table = self.spark.createDataFrame([(i, c) for i, c in enumerate(centres.value.tolist())], "cell int, centre array<double>")
        sizes = self._vectors().groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("far").alias("radius"))
        table.join(sizes, "cell").repartition(1).write.parquet(f"{self.path}/cells")

    def _fit(self, rows: DataFrame, k: int, total: int) -> np.ndarray:
        if k == 1:
            return np.zeros((1, len(rows.first()["x"])))
        share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, self.sample_rows / total)) + 1
        norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
        units = rows.where(share).withColumn("norm", norm).where("norm > 0")
        sample = units.select(array_to_vector(F.transform("x", lambda v: v.cast("double") / F.col("norm"))).alias("features"))
        if not sample.take(1):
            return np.zeros((1, len(rows.first()["x"])))
        model = KMeans(k=k, maxIter=10, seed=7).fit(sample)
        return np.array(model.clusterCenters())

    def _vectors(self) -> DataFrame:
        return self.spark.read.schema("vec_id long, embedding array<float>, far double, cell int").parquet(f"{self.path}/vectors")

    def cells(self) -> DataFrame:
        """(cell, centre, rows, radius): at most max_cells rows."""
        return self.spark.read.schema("cell int, centre array<double>, rows long, radius double").parquet(f"{self.path}/cells")

    # ---- searching ----

    def nearest(self, queries: DataFrame, k: int, *, probes: int = 8, exact: bool = True, least: float | None = None) -> DataFrame:
        """(query_id, vec_id, score, rank): as vectors.nearest, from the cells that can matter.

        Each query looks into its `probes` nearest cells first.  With `exact` it then goes to
        every cell whose centre and radius leave room for a score from its k-th best on, so
        the answer is that of a search through all rows; without, the answer is approximate.
        Ids are unique on both sides; queries of another width or with a bad component find nothing.
        """
        scratch = Scratch(self.spark, "probe")
        wanted = _valid(queries)
        first = scratch.save(self._scan(self._routes(wanted, probes), k, least), "first")
        if not exact:
            return _ranked(first, k)
        # Fewer than k rows so far, or none: every cell may hold one.
        best = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        room = wanted.join(best, wanted["vec_id"] == best["query_id"], "left").select("vec_id", "x", F.greatest(F.coalesce("kth", F.lit(-2.0)), F.lit(-2.0 if least is None else least)).alias("kth"))
        return _ranked(first.unionByName(self._scan(self._routes(room, probes, rest=True), k, least)), k)

    def probes_for(self, queries: DataFrame, k: int, *, recall: float = 0.9, most: int = 200) -> int:
        """The least number of probes with which approximate search finds `recall` of the k nearest rows.

        Measured on about `most` queries chosen by a hash of their id: their exact neighbours
        are looked up, and each counts at the place of its cell in the query's order of cells.
        """
        some = _valid(queries).orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("vec_id", F.col("x").alias("embedding"))
        some = Scratch(self.spark, "sample").save(some, "rows")
        found = self.nearest(some, k).select("query_id", "vec_id")
        cell_of = self._vectors().select("vec_id", "cell").join(F.broadcast(found), "vec_id")  # most * k rows at most
        every = self._routes(_valid(some), self.max_cells).select(F.col("vec_id").alias("query_id"), "cell", "place")
        places = cell_of.join(every, ["query_id", "cell"]).groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").toPandas()  # max_cells rows at most
        if places.empty:
            return 1
        share = places["n"].cumsum() / places["n"].sum()
        return int(places["place"][(share >= recall).idxmax()])

    def routes(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, cell): the cells that the first step of a search looks into."""
        return self._routes(_valid(queries), probes).select(F.col("vec_id").alias("query_id"), "cell")

    def _routes(self, queries: DataFrame, probes: int, *, rest: bool = False) -> DataFrame:
        """(vec_id, x, cell, place): the nearest cells of each query by place from 1, or those beyond them that its kth score allows."""
        known = self.cells().orderBy("cell").toPandas()  # max_cells rows at most
        if known.empty:
            return queries.select("vec_id", "x", F.lit(0).alias("cell"), F.lit(0).alias("place")).limit(0)
        centres, radius, names = np.stack(known["centre"].to_list()), known["radius"].to_numpy(), known["cell"].to_numpy(np.int32)
        shared = self.spark.sparkContext.broadcast((centres, radius, names))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, radius, names = shared.value
            for batch in batches:
                fit = np.flatnonzero(np.array([len(v) for v in batch["x"]]) == centres.shape[1])
                batch = batch.take(pa.array(fit))
                if not batch.num_rows:
                    continue
                near = unit_rows(batch["x"]) @ centres.T
                order = np.argsort((centres**2).sum(axis=1) - 2 * near, axis=1, kind="stable")
                place = np.empty(near.shape, np.int32)
                np.put_along_axis(place, order, np.arange(1, near.shape[1] + 1, dtype=np.int32)[None, :], axis=1)
                chosen = place <= probes
                if rest:
                    # q.x = q.c + q.(x - c) is at most q.c + radius.
                    chosen = ~chosen & (near + radius >= batch["kth"].to_numpy()[:, None] - SLACK)
                row, cell = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays([batch["vec_id"].take(pa.array(row)), batch["x"].take(pa.array(row)), pa.array(names[cell]), pa.array(place[row, cell])], names=["vec_id", "x", "cell", "place"])

        return queries.mapInArrow(route, "vec_id long, x array<float>, cell int, place int")

    def _scan(self, routes: DataFrame, k: int, least: float | None) -> DataFrame:
        """The k best rows of each query in each block of its cells.

        A cell's rows and the queries that come to it are dealt into blocks of about
        block_rows, so a cell of a third of all rows is as many tasks as it needs.
        """
        routes = Scratch(self.spark, "routes").save(routes, "rows")
        asked = routes.groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
        sizes = self.cells().select("cell", "rows").join(asked, "cell")
        blocks = lambda n: F.ceil(F.col(n) / self.block_rows).cast("int")
        sizes = sizes.select("cell", blocks("rows").alias("p_blocks"), blocks("asked").alias("q_blocks"))
        deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        # At most max_cells rows are broadcast, and only the folders of cells that are asked for are read.
        cells = [r["cell"] for r in sizes.select("cell").collect()]
        sizes = F.broadcast(sizes)
        q = routes.join(sizes, "cell").select("vec_id", F.col("x").alias("embedding"), "cell", deal("q_blocks").alias("qb"), every("p_blocks").alias("pb"))
        p = self._vectors().where(F.col("cell").isin(cells)).join(sizes, "cell").select("vec_id", "embedding", "cell", deal("p_blocks").alias("pb"), every("q_blocks").alias("qb"))
        keys = ["cell", "qb", "pb"]
        return q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInArrow(block_best(k, least), "query_id long, vec_id long, score double")


def _valid(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows with an id and a vector of finite components."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x: Column = F.col("embedding").cast("array<float>")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND size(x) > 0").where(finite)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """A query has at most k rows for each block that it looked into."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
