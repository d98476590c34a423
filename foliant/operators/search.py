"""Hybrid retrieval, source selection, chat history and evidence."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.pages import hull
from foliant.operators.vectors import hashed_embedding


def pages_of(docs: DataFrame, size: int = 1500) -> DataFrame:
    """(doc_id, source, page, text): texts cut into pages of `size` characters."""
    n = F.ceil(F.length("text") / size).cast("int")
    paged = docs.where(F.length("text") > 0).select("doc_id", "source", "text", F.explode(F.sequence(F.lit(1), n)).alias("page"))
    return paged.select("doc_id", "source", "page", F.substring("text", (F.col("page") - 1) * size + 1, F.lit(size)).alias("text"))


def coded_tokens(text: Column, width: int = 64) -> Column:
    """The hashed tokens of a text in order: twice the bucket, plus one for a negative sign."""
    digits = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.conv(F.substring(F.md5(t), 1, 5), 16, 10).cast("int"))
    return F.sort_array(F.transform(digits, lambda n: F.shiftright(n, 4) % width * 2 + n.bitwiseAND(1)))


def lexical_scores(chunks: DataFrame, query: str, width: int = 64) -> DataFrame:
    """`chunks` plus `score`: cosine with the query under the hashed-token embedder; chunks without a token go.

    Only built-in functions inside the row: each token's bucket and sign come from its
    md5 digest, and one fold over the sorted buckets adds up norm and product.
    """
    weights = F.array(*[F.lit(x) for x in hashed_embedding(query, width)])
    coded = coded_tokens(F.col("text"), width)
    zero = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("run"), F.lit(0.0).alias("dot"), F.lit(0.0).alias("norm"))

    def closed(s: Column) -> tuple[Column, Column]:
        return s["dot"] + s["run"] * F.coalesce(F.get(weights, s["at"]), F.lit(0.0)), s["norm"] + s["run"] * s["run"]

    def add(s: Column, code: Column) -> Column:
        at, sign = F.shiftright(code, 1), (1 - 2 * code.bitwiseAND(1)).cast("double")
        dot, norm = closed(s)
        same = F.struct(s["at"].alias("at"), (s["run"] + sign).alias("run"), s["dot"].alias("dot"), s["norm"].alias("norm"))
        return F.when(at == s["at"], same).otherwise(F.struct(at.alias("at"), sign.alias("run"), dot.alias("dot"), norm.alias("norm")))

    def score(s: Column) -> Column:
        dot, norm = closed(s)
        return F.when(norm > 0, F.round(dot / F.sqrt(norm), 6)).otherwise(0.0)

    # The pattern says which chunks have a token, so nothing filters on the score and it is evaluated once.
    return chunks.where(F.lower("text").rlike("[a-z0-9]")).withColumn("score", F.aggregate(coded, zero, add, score))


def hybrid_search(hits: DataFrame, query: str, *, quality: DataFrame | None = None, top_k: int = 10, min_quality: int | None = None, source: str | None = None, rerank: bool = True, dedupe: bool = True) -> DataFrame:
    """Re-ranked hits of a query.

    `hits` has doc_id, page, source, text, score and quality, unless a frame (doc_id,
    quality) gives that.  The best 6 * top_k by score are taken first; quality is joined
    and filters on it and on source come after that cut, and must not be moved before it.
    """
    q = query.strip().lower()
    tokens = sorted({t for t in re.findall(r"[a-z0-9]+", q) if len(t) >= 2})
    cut = hits.orderBy(F.desc("score"), "doc_id", "page").limit(max(top_k * 6, top_k))
    cut = cut if quality is None else cut.join(quality, "doc_id", "left")
    cut = cut.withColumn("quality", F.coalesce("quality", F.lit(100)))
    if source:
        cut = cut.where(F.col("source") == source)
    if min_quality is not None:
        cut = cut.where(F.col("quality") >= min_quality)
    text = F.lower("text")
    found = sum((F.when(text.contains(t), 1).otherwise(0) for t in tokens), F.lit(0))
    bonus = F.when(text.contains(q), 0.5).otherwise(0.0) if q else F.lit(0.0)
    combined = F.col("score") * F.col("quality") / 100.0 + found / max(1, len(tokens)) * 0.35 + bonus
    out = cut.withColumn("combined_score", F.round(combined, 6)).withColumn("snippet", F.substring("text", 1, 240))
    metric = "combined_score" if rerank else "score"
    if dedupe:
        first = Window.partitionBy("doc_id", "page").orderBy(F.desc(metric), F.desc("score"))
        out = out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return out.drop("text").orderBy(F.desc(metric), F.desc("score"), "doc_id", "page").limit(top_k)


def select_sources(hits: DataFrame, *, top_k: int = 6, min_quality: int | None = None, chronological: bool = False) -> DataFrame:
    """Sources of an answer, renumbered from 1.

    `hits` has hit_rank, doc_id, page, source, quality, score, text and doc_date.  Of
    the hits of one (doc_id, page, source) the best by score * quality stays, at the
    place of the first; a quality of 0 counts as 100 here.
    """
    kept = hits.withColumn("quality", F.coalesce("quality", F.lit(100)))
    if min_quality is not None:
        kept = kept.where(F.col("quality") >= min_quality)
    by_key = Window.partitionBy("doc_id", "page", "source")
    weight = F.col("score") * F.when(F.col("quality") == 0, 100).otherwise(F.col("quality")) / 100.0
    ranked = kept.withColumn("_w", F.round(weight, 6)).withColumn("_n", F.row_number().over(by_key.orderBy(F.desc("_w"), "hit_rank"))).withColumn("_first", F.min("hit_rank").over(by_key))
    best = ranked.where("_n = 1").orderBy("_first").limit(top_k)
    order = [F.col("doc_date").isNull(), F.col("doc_date"), F.col("doc_id"), F.col("page"), F.col("_first")] if chronological else [F.col("_first")]
    numbered = best.withColumn("id", F.row_number().over(Window.orderBy(*order)))  # top_k rows
    return numbered.select("id", "doc_id", "page", "source", "quality", "score", F.substring("text", 1, 500).alias("snippet"), F.substring("text", 1, 1200).alias("text"))


def format_sources(sources: DataFrame) -> DataFrame:
    line = F.format_string("[%d] doc_id=%d page=%d source=%s text=%s", "id", "doc_id", "page", "source", "text")
    return sources.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def chat_history(turns: DataFrame, *, last: int = 12, max_chars: int = 1600) -> DataFrame:
    """(conv_id, history): question and answer pairs of the last turns, or 'None'."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.withColumn("answer", F.lead("text").over(after)).withColumn("next_role", F.lead("role").over(after)).where("role = 'user'")
    paired = paired.withColumn("answer", F.when(F.col("next_role") == "assistant", F.col("answer")).otherwise(""))
    cut = lambda c: F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, max_chars)
    rows = paired.select("conv_id", "turn", cut("text").alias("q"), cut("answer").alias("a")).where("q != '' AND a != ''")
    recent = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("n") <= last)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("User: "), "q", F.lit("\nAssistant: "), "a").alias("x")))), lambda e: e["x"])
    joined = recent.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("history"))
    return turns.select("conv_id").distinct().join(joined, "conv_id", "left").select("conv_id", F.coalesce("history", F.lit("None")).alias("history"))


def valid_bbox(box: Column) -> Column:
    """Four numbers with x1 > x0 and y1 > y0."""
    at = lambda i: F.get(box, i)
    return F.coalesce((F.size(box) == 4) & (at(2) > at(0)) & (at(3) > at(1)) & ~F.exists(box, lambda v: v.isNull()), F.lit(False))


def evidence_error(doc_id: Column, page: Column, bbox: Column, snippet: Column) -> Column:
    """What is wrong with a citation, null if nothing is; a right bbox needs no snippet."""
    good, blank = valid_bbox(bbox), F.trim(F.coalesce(snippet, F.lit(""))) == ""
    return F.when((doc_id <= 0) | (page <= 0), "invalid_doc_or_page").when(good, F.lit(None)).when(bbox.isNotNull(), "invalid_bbox").when(blank, "empty_snippet")


def evidence_status(citations: DataFrame, *, max_pages: int = 3) -> DataFrame:
    """Status of each citation (ordinal, doc_id, page, snippet, bbox) within the page budget.

    The first max_pages (1 to 5) distinct pages by ordinal count; others are dropped.
    """
    limit = max(1, min(max_pages, 5))
    doc, page = F.coalesce("doc_id", F.lit(0)), F.coalesce("page", F.lit(0))
    c = citations.withColumn("doc_id", doc).withColumn("page", page)
    # A list of citations is bounded by the request that made it, and pages by it.
    pages = c.groupBy("doc_id", "page").agg(F.min("ordinal").alias("first")).orderBy("first").limit(limit)
    kept = c.join(F.broadcast(pages), ["doc_id", "page"], "left_semi")
    error = evidence_error(F.col("doc_id"), F.col("page"), F.col("bbox"), F.col("snippet"))
    status = F.when(error.isNotNull(), "error").when(valid_bbox(F.col("bbox")), "ok").otherwise("no_match")
    return kept.select("ordinal", F.greatest("doc_id", F.lit(0)).alias("doc_id"), F.greatest("page", F.lit(0)).alias("page"), status.alias("status"), error.alias("error"), F.when(status == "ok", 1.0).otherwise(0.0).alias("confidence"))


def norm_tokens(text: Column) -> Column:
    """Lower-case words with everything but letters, digits and _ taken out; blanks dropped."""
    parts = F.split(F.lower(text), r"\s+")
    return F.filter(F.transform(parts, lambda t: F.regexp_replace(t, r"(?U)[^\w]+", "")), lambda t: t != "")


def locate_snippets(snippets: DataFrame, pages: DataFrame, *, anchor: int = 2) -> DataFrame:
    """(item_id, doc_id, page, start): first exact place of a snippet's tokens on a page.

    Of the windows of `anchor` tokens of a snippet the one that the pages hold least
    often is its anchor; only places of anchors are compared in full, so no page meets
    every snippet and a common window meets few of them.
    """
    windows = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - anchor + 1), lambda i: F.array_join(F.slice(c, i, anchor), " "))
    wanted = snippets.select("item_id", norm_tokens(F.col("text")).alias("want")).where(F.size("want") >= anchor)
    own = wanted.select("item_id", F.posexplode(windows("want")).alias("at", "key"))
    words = pages.select("doc_id", "page", norm_tokens(F.col("text")).alias("have")).where(F.size("have") >= anchor)
    spots = words.select("doc_id", "page", F.posexplode(windows("have")).alias("start", "key")).join(own.select("key").distinct(), "key", "left_semi")
    times = spots.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # A snippet with a window that no page holds is nowhere.
    rarest = own.join(times, "key", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "key")).alias("x")).where("x.n > 0")
    places = spots.join(rarest.select("item_id", "x.at", "x.key"), "key").select("item_id", "doc_id", "page", (F.col("start") - F.col("at")).alias("start")).where("start >= 0")
    hit = places.join(wanted, "item_id").join(words, ["doc_id", "page"]).where(F.slice("have", F.col("start") + 1, F.size("want")) == F.col("want"))
    return hit.groupBy("item_id", "doc_id", "page").agg(F.min("start").alias("start"))


def best_window(words: list[str], want: list[str], *, exact_from: float = 0.6, accept: float = 0.72) -> tuple[int, float]:
    """(first word, score) of the window of `words` that is most like `want`, or (-1, 0).

    The score is the share of equal tokens in place; from `exact_from` on a window that
    does not beat the best so far may do so by the likeness of its letters.  The first
    exact window wins; windows with a blank token do not count.
    """
    n, best, found = len(want), 0.0, -1
    if n < 2 or len(words) < n:
        return -1, 0.0
    same = np.array([[w == x for w in words] for x in want])
    blank = np.convolve([not w for w in words], np.ones(n), "valid") > 0
    shares = np.add.reduce([same[k, k : len(words) - n + 1 + k] for k in range(n)]) / n
    phrase = " ".join(want)
    for at in np.flatnonzero(~blank).tolist():
        share = float(shares[at])
        if share <= best and share >= exact_from:
            share = difflib.SequenceMatcher(None, phrase, " ".join(words[at : at + n])).ratio()
        if share > best:
            best, found = share, at
            if best >= 1:
                break
    return (found, best) if best >= accept else (-1, 0.0)


def match_citations(citations: DataFrame, anchors: DataFrame) -> DataFrame:
    """(ordinal, doc_id, page, bbox, score) of citations (ordinal, doc_id, page, snippet) on their pages.

    `anchors` has doc_id, page and words (text and bbox).  The box is the hull of the
    matched words that have a real box; without a match both are null and 0.
    """

    @F.pandas_udf("first int, score double")
    def match(words: pd.Series, want: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_window(list(w), list(x)) if w is not None else (-1, 0.0) for w, x in zip(words, want, strict=True)], columns=["first", "score"])

    plain = lambda c: F.lower(F.regexp_replace(c, r"(?U)[^\w]+", ""))
    j = citations.join(anchors.select("doc_id", "page", "words"), ["doc_id", "page"], "left").withColumn("want", norm_tokens(F.coalesce("snippet", F.lit(""))))
    j = j.withColumn("m", match(F.transform("words", lambda w: plain(w["text"])), F.col("want")))
    boxes = F.filter(F.transform(F.slice("words", F.col("m.first") + 1, F.size("want")), lambda w: w["bbox"]), valid_bbox)
    box = F.when(F.col("m.first") >= 0, hull(boxes))
    return j.select("ordinal", "doc_id", "page", box.alias("bbox"), F.when(box.isNull(), 0.0).otherwise(F.col("m.score")).alias("score"))
