"""Page texts in layers, their coverage and recleaning, and chunks of pages, sentences and word boxes."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.textops import clean_text, estimate_tokens, pack_chunks
from foliant.operators.vectors import hashed_embedding

BOX = "struct<text:string,bbox:array<double>>"


def layers(*frames: DataFrame) -> DataFrame:
    """The pages (doc_id, page, source, ...) of all layers, by page and source."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.orderBy("doc_id", F.coalesce("page", F.lit(0)), F.coalesce("source", F.lit("")))


def text_of(clean: Column, text: Column) -> Column:
    """The stored clean text, or the text cleaned now where that is blank."""
    return F.when(F.trim(F.coalesce(clean, F.lit(""))) != "", clean).otherwise(clean_text(text))


def coverage(docs: DataFrame, pages: DataFrame, source: str) -> DataFrame:
    """(id, expected, done, missing, complete, percent, max_page) of one layer.

    Only pages from 1 to the expected number count; where that is unknown every
    positive page counts as done, and nothing is complete.
    """
    seen = pages.where((F.col("source") == source) & (F.col("page") > 0)).select(F.col("doc_id").alias("id"), "page").distinct()
    known = docs.select("id", F.when(F.col("page_count") > 0, F.col("page_count")).alias("expected"))
    inside = F.col("page").isNotNull() & (F.col("expected").isNull() | (F.col("page") <= F.col("expected")))
    per = known.join(seen, "id", "left").groupBy("id", "expected").agg(F.count_if(inside).alias("done"), F.max("page").alias("max_page"))
    missing = F.when(F.col("expected").isNotNull(), F.greatest(F.lit(0), F.col("expected") - F.col("done")))
    percent = F.bround(F.col("done") / F.col("expected") * 100.0, 2)
    return per.select("id", "expected", "done", missing.cast("long").alias("missing"), F.coalesce(F.col("done") >= F.col("expected"), F.lit(False)).alias("complete"), percent.alias("percent"), "max_page")


def reclean(pages: DataFrame, clean: Callable[[Column], Column] = clean_text) -> DataFrame:
    """Page texts with their derived columns computed anew, and whether any of them changed.

    `pages` has text, raw_text, clean_text, token_estimate_raw and token_estimate_clean;
    a null raw_text reads as text.
    """
    raw = F.coalesce("raw_text", "text", F.lit(""))
    rows = pages.withColumn("new_raw", raw).withColumn("new_clean", clean(F.col("new_raw")))
    new = {"raw_text": F.col("new_raw"), "clean_text": F.col("new_clean"), "token_estimate_raw": estimate_tokens(F.col("new_raw")), "token_estimate_clean": estimate_tokens(F.col("new_clean"))}
    changed = F.lit(False)
    for name, value in new.items():
        changed = changed | ~F.col(name).eqNullSafe(value)
    new["text"] = F.col("new_raw")
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in pages.columns], changed.alias("changed"))


def reclean_totals(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(F.count(F.lit(1)).alias("processed"), F.count_if("changed").alias("updated"))


def stored_vectors(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """Points (doc_id, chunk, embedding) of some documents: chunks, or the centroid (chunk -1) where there are none."""
    own = points.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    chunked = own.where("chunk >= 0")
    return chunked.unionByName(own.where("chunk < 0").join(chunked.select("doc_id").distinct(), "doc_id", "left_anti"))


def sentences_of(text: str) -> list[str]:
    return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text.strip())) if s]


def merge_sentences(text: str, max_chars: int, overlap: int, least: float, embed: Callable[[str], list[float]] = hashed_embedding) -> list[str]:
    """Neighbouring sentences of one subject, packed up to max_chars.

    A sentence starts a chunk where its cosine with the one before is below `least`.
    """
    groups: list[list[str]] = []
    room, before = 0, None
    for sentence in sentences_of(text):
        vector = embed(sentence)
        if before is not None:
            norm = math.sqrt(sum(x * x for x in before)) * math.sqrt(sum(x * x for x in vector))
            near = norm > 0 and sum(x * y for x, y in zip(before, vector, strict=False)) / norm >= least
        if before is None or not near or len(sentence) + 1 > room:
            groups.append([])
            room = max_chars + 1
        groups[-1].append(sentence)
        room -= len(sentence) + 1
        before = vector
    whole = [" ".join(g) for g in groups]
    return whole[:1] + [f"{a[-overlap:]}\n{b}" for a, b in zip(whole, whole[1:], strict=False)] if overlap > 0 else whole


def pack_words(sizes: list[int], max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last + 1) of runs of words, given their lengths, that fit max_chars when joined by spaces.

    A run starts with the words at the end of the one before that reach `overlap` characters.
    """
    out: list[tuple[int, int]] = []
    first = used = 0
    for k, size in enumerate(sizes):
        need = size + (k > first)
        if k > first and used + need > max_chars:
            out.append((first, k))
            tail, first = 0, k
            while overlap > 0 and first > out[-1][0] and tail < overlap:
                first -= 1
                tail += sizes[first] + (tail > 0)
            used = sum(sizes[first:k]) + max(0, k - first - 1)
        used += need
    if sizes:
        out.append((first, len(sizes)))
    return out


def hull(boxes: Column) -> Column:
    """The least box around boxes [x0, y0, x1, y1]; null for none."""
    side = lambda i, pick: pick(F.transform(boxes, lambda b: F.get(b, F.lit(i))))
    return F.when(F.size(boxes) > 0, F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max)))


def word_chunks(pages: DataFrame, *, max_chars: int = 1200, overlap: int = 200) -> DataFrame:
    """(doc_id, page, chunk, text, bbox) of pages (doc_id, page, words array of text and bbox)."""

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def cut(lengths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in lengths:
            yield batch.map(lambda n: [{"first": a, "last": b} for a, b in pack_words(list(n), max_chars, overlap)])

    ranged = pages.select("doc_id", "page", "words", F.posexplode(cut(F.transform("words", lambda w: F.length(w["text"])))).alias("chunk", "r"))
    own = F.slice("words", F.col("r.first") + 1, F.col("r.last") - F.col("r.first"))
    out = ranged.select("doc_id", "page", "chunk", F.trim(F.array_join(F.transform(own, lambda w: w["text"]), " ")).alias("text"), hull(F.transform(own, lambda w: w["bbox"])).alias("bbox"))
    return out.where("text != ''")


def page_chunks(docs: DataFrame, pages: DataFrame, *, mode: str = "heuristic", max_chars: int = 1200, overlap: int = 200, least: float = 0.75, source: str = "text_layer") -> DataFrame:
    """(doc_id, page, source, quality, chunk, text): chunks of each page, or of the whole text of a document without pages.

    Mode "semantic" merges sentences by their vectors; every other mode packs paragraphs.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: merge_sentences(t or "", max_chars, overlap, least) if mode == "semantic" else pack_chunks(t or "", max_chars, overlap))

    columns = ["doc_id", "page", "source", "quality", "text"]
    bare = docs.join(pages.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("int").alias("page"), F.lit(source).alias("source"), F.lit(None).cast("int").alias("quality"), "text")
    rows = pages.select(*columns).unionByName(bare)
    return rows.select("doc_id", "page", "source", "quality", F.posexplode(cut("text")).alias("chunk", "text"))
