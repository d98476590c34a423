"""Answers with their evidence: from hits to sources, a model's answer and the places of its sources on their pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.search import evidence_error, match_citations, valid_bbox
from foliant.operators.suggest import ask, fill_prompt, follow_ups
from foliant.operators.textops import _strip

Model = Callable[[str], str]
EMPTY_SOURCES, EMPTY_HISTORY = "No sources available.", "None"
CITATION = ("id int", "doc_id long", "page int", "source string", "quality int", "score double", "snippet string", "bbox array<double>", "evidence_status string", "evidence_confidence double", "evidence_error string")


def sources_of(hits: DataFrame, *, top_k: int = 6, source: str | None = None, min_quality: int | None = None, chronological: bool = False) -> DataFrame:
    """The sources of many questions, numbered from 1 within each.

    `hits` has question_id, hit_rank, doc_id, page, source, quality, score, text, doc_date
    and bbox.  The first max(3, 3 * top_k) of a question count, and filters come after that
    cut.  Of one (doc_id, page, source) the best by score * quality stays, at the place of
    the first; a null quality counts as 100, and 0 too where hits are weighed.
    """
    mine = Window.partitionBy("question_id")
    cut = hits.withColumn("_r", F.row_number().over(mine.orderBy("hit_rank"))).where(F.col("_r") <= max(3, 3 * top_k))
    cut = cut.withColumn("quality", F.coalesce("quality", F.lit(100)).cast("int"))
    if source:
        cut = cut.where(F.col("source") == source)
    if min_quality is not None:
        cut = cut.where(F.col("quality") >= min_quality)
    place = Window.partitionBy("question_id", "doc_id", "page", "source")
    weight = F.round(F.col("score") * F.when(F.col("quality") == 0, 100).otherwise(F.col("quality")) / 100.0, 6)
    one = cut.withColumn("_n", F.row_number().over(place.orderBy(weight.desc(), "hit_rank"))).withColumn("_first", F.min("hit_rank").over(place)).where("_n = 1")
    kept = one.withColumn("_r", F.row_number().over(mine.orderBy("_first"))).where(F.col("_r") <= top_k)
    order = [F.col("doc_date").isNull(), F.col("doc_date"), F.col("doc_id"), F.col("page"), F.col("_first")] if chronological else [F.col("_first")]
    numbered = kept.withColumn("id", F.row_number().over(mine.orderBy(*order)))
    return numbered.select("question_id", "id", F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), "source", "quality", "score", F.left("text", F.lit(500)).alias("snippet"), F.left("text", F.lit(1200)).alias("text"), F.col("bbox").cast("array<double>").alias("bbox"))


def with_evidence(sources: DataFrame, anchors: DataFrame, *, min_chars: int = 20, max_pages: int = 3) -> DataFrame:
    """`sources` (sources_of) plus evidence_status, evidence_confidence and evidence_error, and bbox where it was found.

    Snippets under `min_chars` are not looked for, nor those beyond the first `max_pages`
    (1 to 5) pages of a question by number: their three columns are null.  A bbox that is
    given and right is taken; without one the snippet is looked for among the words of its
    page (`anchors`: doc_id, page, words).  What is found goes back by question, document,
    page and snippet; of sources that share these the last one's find counts.
    """
    key = [F.coalesce("doc_id", F.lit(0)).alias("k_doc"), F.coalesce("page", F.lit(0)).alias("k_page"), F.trim(F.coalesce("snippet", F.lit(""))).alias("k_snippet")]
    keyed = sources.select("*", *key)
    wanted = keyed.where(F.length("k_snippet") >= min_chars).select("question_id", "id", "k_doc", "k_page", "k_snippet", "bbox")
    first = wanted.withColumn("_first", F.min("id").over(Window.partitionBy("question_id", "k_doc", "k_page")))
    near = first.withColumn("_p", F.dense_rank().over(Window.partitionBy("question_id").orderBy("_first"))).where(F.col("_p") <= max(1, min(max_pages, 5)))
    error = evidence_error(F.col("k_doc"), F.col("k_page"), F.col("bbox"), F.col("k_snippet"))
    near = near.withColumn("error", error).withColumn("_given", F.col("error").isNull() & valid_bbox(F.col("bbox")))
    # A snippet of a page is looked for once, however many questions cite it.
    loose = near.where(F.col("error").isNull() & ~F.col("_given")).select(F.col("k_snippet").alias("ordinal"), F.col("k_doc").alias("doc_id"), F.col("k_page").alias("page"), F.col("k_snippet").alias("snippet")).distinct()
    found = match_citations(loose, anchors).where("bbox IS NOT NULL").select(F.col("ordinal").alias("k_snippet"), F.col("doc_id").alias("k_doc"), F.col("page").alias("k_page"), F.col("bbox").alias("_box"), F.col("score").alias("_score"))
    state = near.join(found, ["k_doc", "k_page", "k_snippet"], "left")
    box = F.when(F.col("_given"), F.col("bbox")).when(F.col("error").isNull(), F.col("_box"))
    status = F.when(F.col("error").isNotNull(), "error").when(box.isNotNull(), "ok").otherwise("no_match")
    score = F.when(F.col("_given"), 1.0).when(box.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_score")))).otherwise(0.0)
    match = F.struct(status.alias("status"), score.alias("confidence"), F.col("error").alias("error"), box.alias("box"))
    last = state.groupBy("question_id", "k_doc", "k_page", "k_snippet").agg(F.max_by(match, "id").alias("m"))
    back = keyed.join(last, ["question_id", "k_doc", "k_page", "k_snippet"], "left")
    return back.select(*[c for c in sources.columns if c != "bbox"], F.coalesce("m.box", "bbox").alias("bbox"), F.col("m.status").alias("evidence_status"), F.col("m.confidence").alias("evidence_confidence"), F.col("m.error").alias("evidence_error"))


def prompts(questions: DataFrame, sources: DataFrame, template: str) -> DataFrame:
    """`questions` plus `prompt`: {question}, {sources} and {history} of the template filled in, in this order."""
    line = F.format_string("[%d] doc_id=%d page=%d source=%s text=%s", "id", "doc_id", "page", "source", "text")
    told = sources.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n").alias("_sources"))
    j = questions.join(told, "question_id", "left")
    values = {"question": _strip(F.coalesce("question", F.lit(""))), "sources": F.coalesce("_sources", F.lit(EMPTY_SOURCES)), "history": F.coalesce(F.nullif("history", F.lit("")), F.lit(EMPTY_HISTORY))}
    return j.withColumn("prompt", fill_prompt(template, values)).drop("_sources")


def answered(questions: DataFrame, hits: DataFrame, anchors: DataFrame, model: Model, *, template: str, top_k: int = 6, source: str | None = None, min_quality: int | None = None, chronological: bool = False, min_chars: int = 20, max_pages: int = 3) -> DataFrame:
    """(question_id, question, answer, conversation_id, citations): one row for each question, with or without hits.

    `questions` has question_id, question, history and conversation_id; a blank one gets an
    id made from the question's, so that a task that runs twice gives the same.  Citations
    are all sources in their order; `cited` says whether the answer names one as [id].
    """
    sources = sources_of(hits.join(questions.select("question_id"), "question_id", "left_semi"), top_k=top_k, source=source, min_quality=min_quality, chronological=chronological)
    said = ask(prompts(questions, sources, template), model).drop("prompt")
    names = [c.split()[0] for c in CITATION]
    cited = with_evidence(sources, anchors, min_chars=min_chars, max_pages=max_pages).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("_c"))
    j = said.join(cited, "question_id", "left")
    # The numbers in brackets are read once for an answer, and not once for each source.
    j = j.withColumn("_named", F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(r"\[(\d{1,9})\]"), F.lit(1)).cast("array<int>"))
    empty = F.array().cast(f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in CITATION)}, cited:boolean>>")
    citations = F.coalesce(F.transform("_c", lambda c: F.struct(*[c[n].alias(n) for n in names], F.array_contains("_named", c["id"]).alias("cited"))), empty)
    own = F.coalesce(F.nullif(_strip(F.coalesce("conversation_id", F.lit(""))), F.lit("")), F.md5(F.col("question_id").cast("string")))
    return j.select("question_id", "question", "answer", own.alias("conversation_id"), citations.alias("citations"))


def with_follow_ups(answers: DataFrame, model: Model, template: str) -> DataFrame:
    """`answers` (answered) plus `follow_ups`: up to five questions that a model proposes from the answer and its citations."""
    short = F.transform("citations", lambda c: F.struct(c["doc_id"].alias("doc_id"), c["page"].alias("page"), F.left(F.coalesce(c["snippet"], F.lit("")), F.lit(240)).alias("snippet")))
    values = {"question": _strip(F.coalesce("question", F.lit(""))), "answer": _strip(F.coalesce("answer", F.lit(""))), "citations": F.to_json(short)}
    said = ask(answers.select("question_id", fill_prompt(template, values).alias("prompt")), model)
    return answers.join(said.select("question_id", follow_ups(F.col("answer")).alias("follow_ups")), "question_id")
