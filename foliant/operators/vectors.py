"""Exact vector search, duplicates, votes, centroids and integrity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where a norm is 0; the shorter length counts."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
    return F.when(norm > 0, _dot(x, y) / norm).otherwise(0.0)


def inverse_distance(a: Column, b: Column) -> Column:
    """1 / (1 + cosine distance)."""
    return 1 / (2 - cosine(a, b))


def distance_limit(score: float) -> float | None:
    """Largest distance for a least score of 1/(1+d): none for s <= 0, 0 for s >= 1."""
    return None if score <= 0 else 0.0 if score >= 1 else max(0.0, 1 / score - 1)


def knn(points: DataFrame, query: list[float], k: int, *, least: float | None = None, mode: str = "cosine", exclude: Column | None = None) -> DataFrame:
    """The k best points (vec_id, embedding, ...) for one vector, which travels as a literal."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    score = cosine(F.col("embedding"), vector) if mode == "cosine" else inverse_distance(F.col("embedding"), vector)
    scored = points.withColumn("score", F.round(score, 6))
    if exclude is not None:
        scored = scored.where(~exclude)
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return scored.drop("embedding").orderBy(F.desc("score"), "vec_id").limit(k)


def unit_rows(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    x = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def block_best(k: int, least: float | None):
    """Of two blocks of (vec_id, embedding), queries and points, the k best points of each query, its own row aside."""
    kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            y, ids, owners = unit_rows(right["embedding"]).T, right["vec_id"].to_numpy(), left["vec_id"].to_numpy()
            x = unit_rows(left["embedding"])
            for at in range(0, len(x), 512):
                scores = np.round(x[at : at + 512] @ y, 6)
                scores[owners[at : at + 512, None] == ids[None, :]] = -np.inf
                # All points from the k-th best score on: ties are settled by vec_id below.
                cut = np.partition(scores, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
                for own, row, low in zip(owners[at : at + 512].tolist(), scores, cut.tolist(), strict=True):
                    some = np.flatnonzero((row >= low) & (row > -np.inf) & (row >= (-np.inf if least is None else least)))
                    some = some[np.lexsort((ids[some], -row[some]))][:k]
                    out.append((np.full(len(some), own), ids[some], row[some]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return best


def nearest(queries: DataFrame, points: DataFrame, k: int, *, least: float | None = None, block_rows: int = 2048) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest points of every query row.

    Both sides are dealt into blocks of about block_rows rows, as many as their row
    counts ask for, and each pair of blocks is one task of matrix products that keeps k
    rows a query: a task holds two blocks at most and no side is broadcast.  Ties go to
    the lesser vec_id, and a query's own row is left out.  All vectors have one width.
    """
    sides = [f.where(F.size("embedding") > 0).select("vec_id", "embedding") for f in (queries, points)]
    q_blocks, p_blocks = (max(1, -(-f.count() // block_rows)) for f in sides)
    # An int like the numbers of `every`: an equal long has another hash, and a pair's sides would miss each other.
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = sides[0].select("vec_id", "embedding", deal(q_blocks).alias("qb"), every(p_blocks).alias("pb"))
    p = sides[1].select("vec_id", "embedding", deal(p_blocks).alias("pb"), every(q_blocks).alias("qb"))
    pairs = q.groupBy("qb", "pb").cogroup(p.groupBy("qb", "pb")).applyInArrow(block_best(k, least), "query_id long, vec_id long, score double")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k)


def vote(neighbours: DataFrame, attributes: DataFrame, *, keep: dict[str, int]) -> DataFrame:
    """Weighted vote: (query_id, kind, name, weight, rank) of the best names of a kind.

    `neighbours` has query_id, vec_id and score, `attributes` vec_id, kind and name;
    ties go to the lesser name.
    """
    sums = neighbours.join(attributes, "vec_id").where("name IS NOT NULL AND name != ''").groupBy("query_id", "kind", "name").agg(F.round(F.sum("score"), 6).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.desc("weight"), "name"))
    allowed = F.create_map(*[F.lit(x) for item in keep.items() for x in item])
    return sums.withColumn("rank", rank).where(F.col("rank") <= allowed[F.col("kind")])


def centroids(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, centroid): mean of the chunk vectors of the first chunk's width.

    Vectors of another width are skipped, but the divisor is the number of all chunks.
    """
    width = chunks.groupBy("doc_id").agg(F.min_by(F.size("embedding"), "chunk").alias("width"), F.count(F.lit(1)).alias("n_chunks"))
    parts = chunks.join(width, "doc_id").where(F.size("embedding") == F.col("width")).select("doc_id", "n_chunks", F.posexplode("embedding").alias("at", "x"))
    sums = parts.groupBy("doc_id", "n_chunks", "at").agg(F.sum(F.col("x").cast("double")).alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("at", F.round(F.col("s") / F.col("n_chunks"), 6).alias("v"))))
    return sums.groupBy("doc_id", "n_chunks").agg(F.transform(ordered, lambda e: e["v"]).alias("centroid"))


def integrity_totals(found: DataFrame) -> DataFrame:
    """One row over integrity() rows: documents by state and missing vectors."""
    return found.agg(F.count_if(F.col("state") == "fully_missing").alias("fully_missing"), F.count_if(F.col("state") == "partially_missing").alias("partially_missing"), F.coalesce(F.sum(F.col("expected") - F.col("found")), F.lit(0)).alias("missing_vectors"))


def integrity(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose expected chunks (doc_id, chunk_count) are not all stored.

    `stored` has doc_id, chunk and embedding; an empty vector counts as missing.
    """
    wanted = expected.where("chunk_count > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("chunk_count") - 1)).alias("chunk"))
    there = stored.where(F.size("embedding") > 0).select("doc_id", "chunk").distinct().withColumn("found", F.lit(1))
    per = wanted.join(there, ["doc_id", "chunk"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("expected"), F.count("found").alias("found"))
    return per.where("found < expected").select("doc_id", "expected", "found", F.when(F.col("found") == 0, "fully_missing").otherwise("partially_missing").alias("state"))


#: The layers that each kind of embedding has vectors of.
LAYERS = {"both": ("text_layer", "vision_ocr"), "baseline": ("text_layer",), "text_layer": ("text_layer",), "vision": ("vision_ocr",), "vision_ocr": ("vision_ocr",)}


def audited(embedded: DataFrame, stored: DataFrame, titles: DataFrame) -> DataFrame:
    """Expected and found vectors of every embedded document, layer by layer.

    `embedded` has doc_id, embedding_source, chunk_count and embedded_at, `stored` has
    doc_id, source, chunk and embedding, `titles` has doc_id and title.  Documents without
    chunks, of an unknown kind or without a row in titles are not scanned.  An embedding of
    both layers expects each chunk twice.  A null or empty vector, one beyond the last chunk
    or of another layer, and a second one at a place are not counted.
    """
    known = F.create_map(*[x for k, v in LAYERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    layers = F.try_element_at(known, F.lower(F.trim("embedding_source")))
    docs = embedded.where("chunk_count > 0").withColumn("layers", layers).where("layers IS NOT NULL").join(titles, "doc_id")
    need = docs.select("doc_id", "layers", "chunk_count")
    there = stored.where(F.size("embedding") > 0).select("doc_id", "source", "chunk").join(need, "doc_id").where((F.col("chunk") >= 0) & (F.col("chunk") < F.col("chunk_count")) & F.array_contains("layers", F.col("source")))
    found = there.groupBy("doc_id").agg(F.count_distinct("source", "chunk").alias("found_vectors"))
    out = docs.join(found, "doc_id", "left").withColumn("found_vectors", F.coalesce("found_vectors", F.lit(0)).cast("long"))
    out = out.withColumn("expected_vectors", F.size("layers") * F.col("chunk_count").cast("long"))
    return out.select("doc_id", "title", "embedding_source", "chunk_count", "expected_vectors", "found_vectors", (F.col("found_vectors") == 0).alias("fully_missing"), "embedded_at")


def audit_report(rows: DataFrame, *, limit: int = 100, provider: str = "unknown") -> DataFrame:
    """One row over audited() rows; items are the first `limit` (1 at least) affected documents by id."""
    limit = max(1, limit)
    bad = F.col("found_vectors") < F.col("expected_vectors")
    totals = rows.agg(F.count(F.lit(1)).alias("scanned_docs"), F.count_if(bad).alias("affected_docs"), F.count_if(bad & F.col("fully_missing")).alias("fully_missing_docs"), F.count_if(bad & ~F.col("fully_missing")).alias("partial_missing_docs"))
    first = rows.where(bad).orderBy("doc_id").limit(limit)
    items = first.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("items"))
    return totals.crossJoin(items).select(F.lit(provider).alias("provider"), "scanned_docs", "affected_docs", "fully_missing_docs", "partial_missing_docs", F.lit(limit).alias("limit"), (F.col("affected_docs") > limit).alias("truncated"), "items")


#: The place of each layer in a point id.
SOURCE_OFFSETS = {"text_layer": 1, "baseline": 1, "vision_ocr": 2, "vision": 2}


def source_offset(source: Column) -> Column:
    """The place of a layer in a point id, 0 for an unknown one."""
    known = F.create_map(*[F.lit(x) for item in SOURCE_OFFSETS.items() for x in item])
    return F.coalesce(F.try_element_at(known, source), F.lit(0))


def point_id(doc_id: Column, offset: Column, chunk: Column) -> Column:
    return doc_id * F.lit(1_000_000_000) + offset * F.lit(1_000_000) + chunk


def hashed_embedding(text: str, width: int = 64) -> list[float]:
    """Offline default embedder: signed counts of hashed tokens, of unit length."""
    import hashlib
    import re

    out = [0.0] * width
    for token in re.findall(r"[a-z0-9]+", text.lower()):
        digest = hashlib.md5(token.encode()).hexdigest()
        out[int(digest[:4], 16) % width] += 1.0 if int(digest[4], 16) % 2 == 0 else -1.0
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


def embed_or_split(chunks: DataFrame, embed, limit: int) -> DataFrame:
    """`chunks` plus `embedding`; a text over `limit` characters is embedded in parts, and their mean is taken.

    `embed` gives the vector of one text and may be any provider; a part that it refuses
    with an error is halved and tried again, down to single characters.
    """

    def vector(text: str) -> list[float]:
        parts = [text[k : k + limit] for k in range(0, len(text), limit)] or [""]
        found = []
        while parts:
            part = parts.pop(0)
            try:
                found.append(embed(part))
            except ValueError:
                if len(part) < 2:
                    raise
                parts[:0] = [part[: len(part) // 2], part[len(part) // 2 :]]
        return np.mean(found, axis=0).tolist()

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: vector(t or ""))

    return chunks.withColumn("embedding", run("text"))


def embed_texts(chunks: DataFrame, width: int = 64) -> DataFrame:
    """`chunks` plus `embedding` by the default embedder, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: hashed_embedding(t or "", width))

    return chunks.withColumn("embedding", embed("text"))
