"""An inverted index of chunks under the hashed-token embedder: a query reads its own buckets, not the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.search import coded_tokens
from foliant.operators.vectors import hashed_embedding

POSTINGS = "doc_id long, page int, weight int, norm long"


class Postings:
    """The index under `path`: postings in a folder for each bucket, and the chunks themselves.

    A posting is a chunk's signed count in a bucket and the chunk's squared norm.  A search
    reads the folders of the query's buckets, so its work follows the number of chunks
    in them and not the length of texts; texts are read for the hits alone, from the parts
    that hold them.  Scores are those of search.lexical_scores, to the last digit.
    """

    def __init__(self, spark: SparkSession, path: str, *, width: int = 64, parts: int = 16) -> None:
        self.spark, self.path, self.width, self.parts = spark, path, width, parts

    def build(self, chunks: DataFrame) -> None:
        """Index `chunks`: doc_id, page and text, unique by the first two, and any other columns; chunks without a token go."""
        kept = chunks.where(F.lower("text").rlike("[a-z0-9]")).withColumn("_part", self._part())
        kept.repartition("_part").sortWithinPartitions("doc_id", "page").write.option("compression", "zstd").partitionBy("_part").parquet(f"{self.path}/chunks")
        kept.limit(0).write.parquet(f"{self.path}/columns")  # an index without chunks has them too
        codes = self._chunks().select("doc_id", "page", F.explode(coded_tokens(F.col("text"), self.width)).alias("code"))
        counts = codes.groupBy("doc_id", "page", F.shiftright("code", 1).alias("bucket")).agg(F.sum(1 - 2 * F.col("code").bitwiseAND(1)).cast("int").alias("weight"))
        norms = counts.groupBy("doc_id", "page").agg(F.sum(F.col("weight").cast("long") * F.col("weight")).alias("norm"), F.collect_list(F.struct("bucket", "weight")).alias("ps"))
        rows = norms.select("doc_id", "page", "norm", F.explode("ps").alias("p")).select("doc_id", "page", "p.weight", "norm", "p.bucket").where("weight != 0")
        # A bucket that holds most chunks is written by as many tasks as any other.
        rows.repartition("bucket", self._part()).sortWithinPartitions("bucket", "doc_id", "page").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/postings")

    def _chunks(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/columns").schema).parquet(f"{self.path}/chunks")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(self.parts)).cast("int")

    def scores(self, query: str) -> DataFrame:
        """(doc_id, page, score) of the chunks that share a bucket with the query."""
        weights = {b: w for b, w in enumerate(hashed_embedding(query, self.width)) if w}
        schema = f"{POSTINGS}, bucket int"
        if not weights:
            return self.spark.createDataFrame([], "doc_id long, page int, score double")
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/postings").where(F.col("bucket").isin(*weights))
        given = F.create_map(*[F.lit(x) for item in weights.items() for x in item])
        part = F.struct("bucket", (F.col("weight") * given[F.col("bucket")]).alias("x"))
        # Added up in the order of buckets, as the score over a whole text is.
        dot = F.aggregate(F.array_sort(F.collect_list(part)), F.lit(0.0), lambda a, p: a + p["x"])
        return rows.groupBy("doc_id", "page", "norm").agg(dot.alias("dot")).select("doc_id", "page", F.round(F.col("dot") / F.sqrt("norm"), 6).alias("score"))

    def top(self, query: str, k: int) -> DataFrame:
        """The first k chunks by score descending, doc_id and page, with all their columns.

        Chunks that share no bucket with the query score 0.  They are looked at only where
        fewer than k chunks score above 0.
        """
        chunks = self._chunks()
        order = [F.desc("score"), "doc_id", "page"]
        scored = self.scores(query)
        best = scored.where("score > 0").orderBy(*order).limit(k)
        if best.count() < k:
            every = chunks.select("doc_id", "page").join(scored, ["doc_id", "page"], "left")
            best = every.withColumn("score", F.coalesce("score", F.lit(0.0))).orderBy(*order).limit(k)
        # k rows; the part of each says which folders of texts are read.
        return chunks.join(F.broadcast(best.withColumn("_part", self._part())), ["_part", "doc_id", "page"]).drop("_part")
