"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits in lower case.  Rare n-grams of the test items, by
the number of different passages that hold them against the item's other n-grams, join
passages to items at once.  An n-gram that stands out, as a stock phrase does, joins a passage to an item only where a
word of the item that is rare beside that n-gram stands in the passage too; a passage
that lacks them all has too few of the item's words for the threshold, so nothing is
lost.  Local alignment of the words decides, equal passages once, so that copies with
replaced, dropped or added words are found too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import words as W
from foliant.llm.scratch import Scratch

FILTER_BITS = 1 << 22
MATCH, MISMATCH, GAP = 2, -1, 1
PASSAGES = "doc_id {0}, first_word int, keys array<long>, seeds array<long>"


def item_grams(items: DataFrame, n: int) -> DataFrame:
    """(item_id, keys) with the word hashes and (gram) of each item, exploded by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch["text"]):
                found = W.words(part, lower=True, separators=W.NOT_ALNUM)
                at, gram = W.grams(found, n)
                word_cut = np.searchsorted(found.row, np.arange(part.rows + 1))
                gram_cut = np.searchsorted(found.row[at], np.arange(part.rows + 1))
                split = lambda values, cuts: pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["item_id"].slice(part.first_row, part.rows), split(found.key, word_cut), split(gram, gram_cut)], names=["item_id", "keys", "grams"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, keys array<long>, grams array<long>")


def _hits(known: np.ndarray, grams: np.ndarray) -> np.ndarray:
    mask = np.uint64(FILTER_BITS - 1)
    return known[0][(grams & mask).astype(np.int64)] & known[1][(grams >> np.uint64(32) & mask).astype(np.int64)]


def _filter_of(grams: DataFrame) -> np.ndarray:
    """Two bit arrays of fixed size that hold every gram; others pass by chance only."""
    out = np.zeros((2, FILTER_BITS), bool)
    for row, shift in enumerate((0, 32)):
        spots = grams.select(F.shiftrightunsigned("gram", shift).bitwiseAND(F.lit(FILTER_BITS - 1)).alias("b"))
        out[row, spots.distinct().toPandas()["b"].to_numpy(np.int64)] = True  # FILTER_BITS values at most
    return np.packbits(out, axis=1)


def _passages(shared, n: int, margin: int):
    """Word hashes around the seeds of each document; overlapping ranges are one passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value, axis=1).astype(bool)
        for batch in batches:
            for part in W.slices(batch["text"]):
                found = W.words(part, lower=True, separators=W.NOT_ALNUM)
                at, gram = W.grams(found, n)
                hit = _hits(known, gram)
                at, gram = at[hit], gram[hit]
                if not len(at):
                    continue
                row = found.row[at]
                first_of = np.searchsorted(found.row, row)
                end_of = np.searchsorted(found.row, row, "right")
                lo, hi = np.maximum(at - margin, first_of), np.minimum(at + n + margin, end_of)
                new = np.concatenate([[True], (lo[1:] > hi[:-1]) | (row[1:] != row[:-1])])
                head = np.flatnonzero(new)
                lo, hi = lo[head], np.maximum.reduceat(hi, head)
                sizes = hi - lo
                words_at = np.repeat(lo - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
                cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                seeds = np.append(head, len(at)).astype(np.int32)
                ids = batch["doc_id"].slice(part.first_row, part.rows).take(pa.array(row[head]))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array((lo - first_of[head]).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.key[words_at].view(np.int64))), pa.ListArray.from_arrays(pa.array(seeds), pa.array(gram.view(np.int64))),
                    ],
                    names=["doc_id", "first_word", "keys", "seeds"],
                )

    return run


def _best(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Score and end (item word, text word) of the best local alignment, by rows."""
    slope = GAP * np.arange(len(text) + 1)
    above = np.zeros(len(text) + 1, np.int64)
    best, end = 0, (0, 0)
    for i, word in enumerate(item.tolist(), 1):
        row = np.maximum(above - GAP, 0)
        np.maximum(row[1:], above[:-1] + np.where(text == word, MATCH, MISMATCH), out=row[1:])
        above = np.maximum.accumulate(row + slope) - slope
        j = int(above.argmax())
        if above[j] > best:
            best, end = int(above[j]), (i, j)
    return best, *end


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int, int]:
    """(share of the item's full score, first and last text word, words of the item spanned)."""
    score, i, j = _best(item, text)
    if not score:
        return 0.0, 0, 0, 0
    _, back_i, back_j = _best(item[:i][::-1], text[:j][::-1])
    return score / (MATCH * len(item)), j - back_j, j - 1, back_i


def _alignments(threshold: float):
    """Alignments of pairs, without those whose common words cannot reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for k, (i, t) in enumerate(zip(batch["item_keys"].to_pylist(), batch["keys"].to_pylist(), strict=True)):
                item, text = np.array(i), np.array(t)
                if np.isin(item, text).sum() >= threshold * len(item):
                    rows.append(align(item, text))
                    at.append(k)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32())
            taken = [batch[name].take(pa.array(at, pa.int64())) for name in ("a", "b", "item_id", "size")]
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["a", "b", "item_id", "size", "score", "first", "last", "item_words"])

    return run


def _candidates(passages: DataFrame, known: DataFrame, seeds: DataFrame, threshold: float, rare: int, scratch: Scratch) -> DataFrame:
    """(a, b, item_id): the passages and items that share a rare seed, or a frequent one and a word that is rare beside it."""
    hits = passages.select("a", "b", F.explode(F.array_distinct("seeds")).alias("gram")).join(seeds.select("gram").distinct(), "gram")
    hits = scratch.save(hits, "hits")
    # Copies of an item bring all its n-grams, so one that stands out among them is a stock phrase.
    counted = seeds.join(hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    usual = counted.groupBy("item_id").agg(F.percentile("n", F.lit(0.5)).alias("usual"))
    judged = counted.join(usual, "item_id").select("item_id", "gram", (F.col("n") > rare * F.greatest(F.lit(1.0), F.col("usual"))).alias("frequent"))
    judged = scratch.save(judged, "judged")
    often = judged.where("frequent").select("item_id", "gram")
    direct = hits.join(judged.where("NOT frequent"), "gram").select("a", "b", "item_id")

    # Word by word, with its number of places in the item.
    words = known.select("item_id", F.size("keys").alias("size"), F.explode("keys").alias("word")).groupBy("item_id", "size", "word").agg(F.count(F.lit(1)).alias("places"))
    wanted = often.join(words, "item_id")
    # A passage's words are spelled out once, and not for each of its n-grams.
    spelled = passages.select("a", "b", F.explode(F.array_distinct("keys")).alias("word")).join(wanted.select("word").distinct(), "word")
    beside = hits.join(wanted.select("gram", "word").distinct(), "gram").join(spelled, ["a", "b", "word"])
    beside = scratch.save(beside.select("a", "b", "gram", "word"), "beside")
    counts = beside.groupBy("gram", "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = wanted.join(counts, ["gram", "word"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # An alignment from the threshold on has this many of the item's words, so of the
    # others and one more, whichever they are, the passage holds at least one.
    need = F.ceil(F.col("size") * threshold - 1e-9)
    before = F.sum("places").over(Window.partitionBy("item_id", "gram").orderBy("n", "word")) - F.col("places")
    second = ranked.withColumn("before", before).where((F.col("before") <= F.col("size") - need) & (F.col("n") > 0)).select("gram", "word", "item_id")
    return direct.unionByName(beside.join(second, ["gram", "word"]).select("a", "b", "item_id")).distinct()


def contaminated(docs: DataFrame, items: DataFrame, *, n: int = 3, threshold: float = 0.5, min_words: int = 8, rare: int = 16) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of each document that holds an item.

    Every n-gram of an item is a seed; those in more than `rare` times as many different
    passages as the item's median n-gram (taken as 1 at least) need a second, rare word,
    which changes the work and not the result.  `score` is the best local alignment over that
    of the whole item; pairs from `threshold` on that span min_words words, or the
    whole item, are returned, one row for each doc_id and item.  Passages of equal words
    are aligned once.  Null texts and items under n words match nothing, empty tables give
    no rows, repeated rows of a doc_id give one; equal scores go to the least first_word.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "bench")
    known = scratch.save(item_grams(items, n), "items")
    seeds = scratch.save(known.select("item_id", F.explode("grams").alias("gram")).distinct(), "seeds")
    longest = known.agg(F.max(F.size("keys"))).first()[0] or 0

    chosen = spark.sparkContext.broadcast(_filter_of(seeds))
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    # With m matches and e edits, 2 m - e >= 2 * threshold * words, so an alignment spans m + e words: this many at most.
    margin = int(np.ceil(longest * (3 - 2 * threshold)))
    found = docs.select("doc_id", "text").mapInArrow(_passages(chosen, n, margin), PASSAGES.format(kind))
    found = scratch.save(found.select("*", F.xxhash64("keys").alias("a"), F.xxhash64(F.lit(1), "keys").alias("b")), "passages")
    # 128 bits stand for a word sequence, which also fixes its seeds.
    passages = scratch.save(found.select("a", "b", "keys", "seeds").dropDuplicates(["a", "b"]), "distinct")
    pairs = _candidates(passages, known, seeds, threshold, rare, scratch)
    item_words = known.select("item_id", F.col("keys").alias("item_keys"), F.size("keys").alias("size"))
    both = pairs.join(passages.drop("seeds"), ["a", "b"]).join(item_words, "item_id")
    aligned = both.select("a", "b", "item_id", "size", "keys", "item_keys").mapInArrow(_alignments(threshold), f"a long, b long, item_id {item_kind}, size int, score double, first int, last int, item_words int")
    hit = aligned.where((F.col("score") >= threshold) & (F.col("item_words") >= F.least(F.lit(min_words), F.col("size"))))
    placed = found.select("doc_id", "first_word", "a", "b").join(hit, ["a", "b"]).select("doc_id", "item_id", "score", (F.col("first_word") + F.col("first")).alias("first_word"), (F.col("first_word") + F.col("last")).alias("last_word"))
    best = placed.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("first_word")).alias("before"), "last_word")).alias("x"))
    return best.select("doc_id", "item_id", F.round("x.score", 6).alias("score"), (-F.col("x.before")).alias("first_word"), F.col("x.last_word").alias("last_word"))
