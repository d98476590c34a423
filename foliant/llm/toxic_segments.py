"""Toxicity by maximum-scoring segments over token log-odds.

Training counts, for each token, the documents of either label that hold it and
turns them into log-odds with an informative Dirichlet prior.  A token is a
lower-case word without outer punctuation; a word also stands for its prefixes,
so that inflected and compound forms share what is known about their stem.  A
linear scan finds every maximal scoring segment of a document, extreme-value
statistics make segments of documents of any length comparable, and a logistic
fit on training documents that were not counted turns them into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.llm import words as W
from foliant.llm.scratch import Scratch

PREFIXES = (4, 5, 6, 7)
#: Texts that are looked at together, and features that are counted before they go on: bounds on a task's memory.
SLICE_ROWS, HELD_FEATURES = 256, 100_000
TRIM = " \t\n\r\x0b\x0c.,!?;:\"'()[]{}|#$%&*<>-_/\\"
LAMBDAS = np.exp(np.linspace(math.log(0.02), math.log(4.0), 60))
SEGMENT = "struct<start:int,end:int,score:double,p_value:double>"


def tokens(text: str | None) -> list[str]:
    """Words between white space of a text, A-Z in lower case."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return [w.decode("utf-8", "replace") for w in raw]


def features(word: str) -> list[str]:
    """What a word counts as: itself without outer punctuation, and its prefixes."""
    core = word.strip(TRIM)
    if not core:
        return []
    return ["=" + core] + [core[:n] for n in PREFIXES if len(core) >= n]


@dataclass
class Model:
    """Weights of at most `max_features` features and the calibration."""

    weights: dict[str, tuple[float, float]]  # feature -> (|z|, log-odds)
    drift: float
    rate: float = 1.0
    log_k: float = 0.0
    coefficients: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    learned: bool = False  # has weights and was calibrated on both labels


class WordScores(dict):
    """Score of a word, computed when first met; forgets all when it grows large."""

    def __init__(self, model: Model, limit: int = 200_000) -> None:
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        known = [self.model.weights[f] for f in features(word.decode("utf-8", "replace")) if f in self.model.weights]
        self[word] = value = max(known)[1] if known else 0.0
        return value


def maximal_segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by a single scan.

    `at` and `score` are the tokens whose score is not 0; every token also costs
    `drift`.  Each found segment keeps a link to the last one that starts lower, so
    merging never looks at a segment twice.
    """
    start: list[int] = []
    end: list[int] = []
    low: list[float] = []
    high: list[float] = []
    link: list[int] = []
    total, last = 0.0, 0
    for position, value in zip(at.tolist(), score.tolist(), strict=True):
        total -= drift * (position - last)
        last = position + 1
        before, total = total, total + value - drift
        if total <= before:
            continue
        new = (position, position + 1, before, total)
        while True:
            k = len(start) - 1
            while k >= 0 and low[k] >= new[2]:
                k = link[k]
            if k < 0 or high[k] >= new[3]:
                break
            new = (start[k], new[1], low[k], new[3])
            for column in (start, end, low, high, link):
                del column[k:]
        for column, value_of in zip((start, end, low, high, link), (*new, k), strict=True):
            column.append(value_of)
    return [(s, e, hi - lo) for s, e, lo, hi in zip(start, end, low, high, strict=True)]


def scan(text: str | None, scores: WordScores) -> tuple[int, np.ndarray, list[tuple[int, int, float]]]:
    """Token count, the scores that are not 0, and the maximal segments of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    values = np.fromiter(map(scores.__getitem__, words), float, len(words))
    at = np.flatnonzero(values)
    return len(words), values[at], maximal_segments(at, values[at], scores.model.drift)


def evidence(n: int, segments: list[tuple[int, int, float]], model: Model) -> tuple[float, float, float, list[float]]:
    """Features of a document: best and summed normalised scores, and p-values."""
    if not segments:
        return -3.0, 0.0, 0.0, []
    normal = model.rate * np.array([s[2] for s in segments]) - model.log_k - math.log(max(n, 1))
    p = -np.expm1(-np.exp(-np.clip(normal, -30, 600)))
    significant = normal[p < 0.05]
    return float(np.clip(normal.max(), -3, 12)), float(min(significant.sum(), 60.0)), len(significant) / max(n, 1) * 20, p.tolist()


def probability(x: tuple[float, float, float, list[float]], model: Model) -> float:
    b = model.coefficients
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, b[0] + b[1] * x[0] + b[2] * x[1] + b[3] * x[2]))))


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    ridge = np.eye(len(beta)) * 1e-2
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 30_000, max_features: int = 65_536, z_limit: float = 3.0, prior: float = 10.0, seed: int = 7) -> Model:
    """Fit on at most `max_rows` labelled documents of either label.

    `docs` has doc_id and text, `labels` doc_id and toxic (0 or 1); other rows are
    not used.  The documents are the first by a hash of doc_id, and copies of a text
    count once.  Both bounds are parameters of the classifier; scoring has none.
    Where one label is missing among the rows counted or among those held for the
    calibration, all rows are counted and calibrated by cross-fitting in five parts.
    Without both labels, or where no feature tells them apart, the model has no weights
    and scores the share of toxic labels, (toxic + 0.1) / (labels + 1), for every text;
    its `learned` is false.  An empty table or one without labels is such a case; rows
    that repeat a doc_id are texts of their own, and a doc_id labelled both ways is toxic.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxic")
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    picked = known.where("toxic = 1").orderBy("_h").limit(max_rows).unionByName(known.where("toxic = 0").orderBy("_h").limit(max_rows))
    picked = scratch.save(picked, "picked")  # 2 * max_rows rows of 20 bytes at most
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    texts = texts.withColumn("_t", F.xxhash64("text")).groupBy("_t").agg(F.max("toxic").alias("toxic"), F.min("_h").alias("_h"), F.min("text").alias("text"))
    texts = scratch.save(texts.withColumn("fold", F.pmod("_h", F.lit(10))), "texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def counted() -> pa.RecordBatch:
            both = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_pydict({"feature": pa.array(both, pa.string()), "clean": pa.array([seen[0][f] for f in both], pa.int64()), "toxic": pa.array([seen[1][f] for f in both], pa.int64())})
            for own in seen:
                own.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for label, text in zip(part["toxic"].to_pylist(), part["text"].to_pylist(), strict=True):
                    seen[label].update({f for w in set(tokens(text)) for f in features(w)})
                if len(seen[0]) + len(seen[1]) >= HELD_FEATURES:
                    yield counted()
        yield counted()

    def weights_of(counted: DataFrame) -> Model | None:
        sums = counted.mapInArrow(W.give_back(count), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
        size = {r["toxic"]: r["n"] for r in counted.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not size.get(0) or not size.get(1):
            return None
        n_c, n_t = float(size[0]), float(size[1])
        alpha = F.lit(prior) * (F.col("c") + F.col("t")) / (n_c + n_t)
        odds = lambda n, total: F.log((F.col(n) + F.col("alpha")) / F.greatest(total + prior - F.col(n) - F.col("alpha"), F.lit(0.5)))
        scored = sums.where("c + t >= 3").withColumn("alpha", alpha).withColumn("delta", odds("t", n_t) - odds("c", n_c))
        scored = scored.withColumn("z", F.col("delta") / F.sqrt(1 / (F.col("t") + F.col("alpha")) + 1 / (F.col("c") + F.col("alpha"))))
        top = scored.where(F.col("z") >= z_limit).orderBy(F.desc("z"), "feature").limit(max_features).select("feature", "z", "delta").collect()
        # Two standard errors off: a weight that few documents support counts for less.
        return Model({r["feature"]: (r["z"], r["delta"] * (1 - 2 / r["z"])) for r in top}, 0.1)

    def measured(model: Model, frame: DataFrame) -> pd.DataFrame:
        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scores = WordScores(model)
            for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
                rows = []
                for label, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    n, values, segments = scan(text, scores)
                    growth = (np.exp(np.outer(LAMBDAS, values - model.drift)).sum(1) + (n - len(values)) * np.exp(-LAMBDAS * model.drift)).tolist()
                    rows.append((label, n, [s[2] for s in segments], growth))
                yield pa.RecordBatch.from_pylist([dict(zip(("toxic", "n", "segments", "growth"), r, strict=True)) for r in rows], schema=pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("segments", pa.list_(pa.float64())), ("growth", pa.list_(pa.float64()))]))

        found = frame.mapInArrow(W.give_back(measure), "toxic int, n long, segments array<double>, growth array<double>").toPandas()
        return found[found["n"] > 0]

    def unlearned() -> Model:
        n, toxic = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        share = (toxic + 0.1) / (n + 1)
        return Model({}, 0.1, coefficients=(math.log(share / (1 - share)), 0.0, 0.0, 0.0))

    model = weights_of(texts.where("fold < 7"))
    held = measured(model, texts.where("fold >= 7")) if model else None
    if held is None or held["toxic"].nunique() < 2:
        model = weights_of(texts)
        if not model:
            return unlearned()
        parts = []
        for k in range(5):
            own = F.col("fold") % 5 == k
            parts.append(measured(weights_of(texts.where(~own)) or Model({}, 0.1), texts.where(own)))
        held = pd.concat(parts, ignore_index=True)
    clean = held[held["toxic"] == 0]
    if len(clean) and len(clean) < len(held):
        mean = np.sum(clean["growth"].tolist(), axis=0) / clean["n"].sum()
        below = np.flatnonzero(mean < 1)
        model.rate = float(LAMBDAS[below.max()]) if len(below) else float(LAMBDAS[0])
        best = np.array([max(s) if len(s) else 0.0 for s in clean["segments"]])
        model.log_k = float(np.mean((model.rate * best - np.log(clean["n"]))[best > 0]) - 0.5772) if (best > 0).any() else -3.0
        x = np.array([evidence(n, [(0, 0, v) for v in s], model)[:3] for n, s in zip(held["n"], held["segments"], strict=True)])
        if not model.weights:
            return unlearned()
        model.learned = True
        model.coefficients = tuple(float(b) for b in _fit_logistic(x, held["toxic"].to_numpy(float)))
    return model if model.learned else unlearned()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` plus `_score` and `_segments`, which replace columns of these names.

    Null and empty texts have no segment and get the score of a text without
    evidence; repeated rows are scored each, and an empty table gives no rows.  Segments are token ranges with score and p-value, in text order.
    """
    docs = docs.drop("_score", "_segments")
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # max_features entries at most

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        scores = WordScores(own)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p_value", pa.float64())]))
        for batch in (b.slice(first, SLICE_ROWS) for b in batches for first in range(0, b.num_rows, SLICE_ROWS)):
            result, found = [], []
            for text in batch.column(at).to_pylist():
                n, _, segments = scan(text, scores)
                x = evidence(n, segments, own)
                result.append(probability(x, own))
                found.append([{"start": s, "end": e, "score": v, "p_value": p} for (s, e, v), p in zip(segments, x[3], strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(result, pa.float64()), pa.array(found, kind)], names=[*batch.schema.names, "_score", "_segments"])

    return docs.mapInArrow(W.give_back(apply), StructType([*docs.schema.fields, *StructType.fromDDL(f"_score double, _segments array<{SEGMENT}>").fields]))
