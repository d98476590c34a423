"""Missing work of documents: planner, process-missing counters and previews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of task names that raise a preview's priority.
PRIORITY_MARKERS = ("page_notes", "summary_hierarchical", "suggestions_vision", "vision_ocr", "embeddings_vision")


@dataclass(frozen=True)
class PlanOptions:
    """What to plan; the defaults plan everything."""

    vision_enabled: bool = True
    vision_ocr: bool = True
    evidence: bool = True
    embeddings: bool = True
    embeddings_baseline: bool = True
    embeddings_vision: bool = True
    embeddings_mode: str = "auto"
    similarity: bool = True
    suggestions_baseline: bool = True
    suggestions_vision: bool = True
    page_notes: bool = True
    summary: bool = True
    large_pages: int = 20

    @property
    def notes_source(self) -> str:
        return "vision_ocr" if self.vision_enabled and self.vision_ocr else "text_layer"


def followup_tasks(o: PlanOptions) -> list[tuple[str, str | None]]:
    """Tasks after a sync, in order, without repeats; vision embeddings come before vision OCR here."""
    vision = o.vision_enabled and o.vision_ocr
    tasks: list[tuple[str, str | None]] = []
    add = lambda when, task, source=None: tasks.append((task, source)) if when and (task, source) not in tasks else None
    add(o.evidence, "evidence_index")
    if o.embeddings:
        both = o.embeddings_mode == "both"
        if o.embeddings_mode in ("baseline", "vision", "both"):
            add((both or o.embeddings_mode == "baseline") and o.embeddings_baseline, "embeddings_baseline")
            add((both or o.embeddings_mode == "vision") and o.embeddings_vision and vision, "embeddings_vision")
        elif vision and o.embeddings_vision:
            add(True, "embeddings_vision")
        else:
            add(o.embeddings_baseline, "embeddings_baseline")
    add(o.similarity and o.embeddings, "similarity_index")
    notes, source = o.page_notes or o.summary, "vision_ocr" if vision else "text_layer"
    add(vision, "vision_ocr")
    add(notes, "page_notes_vision" if vision else "page_notes_baseline")
    add(o.summary, "summary_hierarchical", source)
    add(o.suggestions_baseline, "suggestions_baseline")
    add(vision and o.suggestions_vision, "suggestions_vision")
    return tasks


def task_sequence(*, vision: bool, sync: bool = False, force: bool = False) -> list[dict]:
    """All tasks of one document in order, for a request that asks for everything anew."""
    source, layer = ("vision_ocr", "vision") if vision else ("text_layer", "baseline")
    names = ["sync"] * sync + ["evidence_index"] + ["vision_ocr"] * vision + [f"embeddings_{layer}", "similarity_index", f"page_notes_{layer}", "summary_hierarchical", "suggestions_baseline"] + ["suggestions_vision"] * vision
    extra = {"vision_ocr": {"force": force}, "summary_hierarchical": {"source": source}}
    return [{"task": n, **extra.get(n, {})} for n in names]


def _reached(count: str, expected: Column) -> Column:
    """All expected pages are there; with an unknown number any page will do."""
    n = F.coalesce(count, F.lit(0))
    return F.when(expected > 0, n >= expected).otherwise(n > 0)


def document_facts(docs: DataFrame, *, embedded: DataFrame, page_texts: DataFrame, suggested: DataFrame, anchors: DataFrame, notes: DataFrame, summaries: DataFrame, similarity: DataFrame, options: PlanOptions) -> DataFrame:
    """One wide row per document from children that are reduced by key first.

    Pages count where they are expected: from 1 to page_count, or all positive ones
    where that is unknown.
    """
    o = options
    key = F.col("doc_id").alias("id")
    vision = page_texts.where("source = 'vision_ocr'").groupBy(key).agg(F.collect_set("page").alias("vision_pages"), F.max("created_at").alias("vision_at"))
    given = suggested.groupBy(key).agg(F.bool_or(F.col("source") == "text_layer").alias("has_sugg_baseline"), F.bool_or(F.col("source") == "vision_ocr").alias("has_sugg_vision"))
    index = anchors.groupBy(key).agg(F.collect_set(F.when(F.col("status").isin("ok", "no_text_layer"), F.col("page"))).alias("anchor_pages"), F.bool_or((F.col("status") == "ok") & (F.col("token_count") > 0)).alias("text_layer"), F.bool_or(F.col("status") == "error").alias("anchor_error"))
    noted = notes.where((F.col("source") == o.notes_source) & (F.col("status") == "ok")).groupBy(key).agg(F.collect_set("page").alias("note_pages"), F.max("processed_at").alias("notes_at"))
    vectors = embedded.select(key, "embedded_at", "embedding_source")
    out = docs
    for child in (vision, given, index, noted, vectors, summaries.select(key, "summary_at"), similarity.select(key, "similarity_at")):
        out = out.join(child, "id", "left")
    expected = F.coalesce("page_count", F.lit(0))
    inside = lambda c: F.when(F.col(c).isNotNull(), F.size(F.filter(c, lambda p: (p >= 1) & ((expected <= 0) | (p <= expected)))))
    return out.withColumns({c: inside(c) for c in ("vision_pages", "anchor_pages", "note_pages")})


def evaluate(facts: DataFrame, options: PlanOptions) -> DataFrame:
    """Flags of what each document needs, and its ordered tasks.

    needs_vision and needs_suggestions_vision do not ask whether vision is enabled;
    vision embeddings do.  Notes and summaries are for large documents only.
    """
    o, lit = options, F.lit
    expected = F.coalesce("page_count", lit(0))
    some = lambda c: F.coalesce(F.col(c), lit(False))
    has_evidence = _reached("anchor_pages", expected)
    no_text = F.col("anchor_pages").isNotNull() & has_evidence & ~some("text_layer")
    complete = _reached("vision_pages", expected)
    source = F.coalesce("embedding_source", lit(""))
    base_there, vision_there = source.isin("baseline", "both"), source.isin("vision", "both")
    want_base = lit(o.embeddings and o.embeddings_baseline)
    want_vision = lit(o.embeddings and o.embeddings_vision and o.vision_enabled) & (complete | lit(o.vision_ocr))
    if o.embeddings_mode == "baseline":
        need_base, need_vision = want_base & ~base_there, lit(False)
    elif o.embeddings_mode == "vision":
        need_base, need_vision = lit(False), want_vision & ~vision_there
    elif o.embeddings_mode == "both":
        need_base, need_vision = want_base & ~base_there, want_vision & ~vision_there
    else:
        need_base, need_vision = ~want_vision & want_base & ~base_there, want_vision & ~vision_there
    large = (expected >= o.large_pages) | (F.coalesce("tokens", lit(0)) >= max(3000, o.large_pages * 250))
    wanted = lit(o.page_notes or o.summary)
    notes_stale = F.col("notes_at").isNull() | (lit(o.notes_source == "vision_ocr") & F.coalesce(F.col("notes_at") < F.col("vision_at"), lit(False)))
    flagged = facts.withColumns(
        {
            "large_doc": large, "evidence_no_text_layer": no_text,
            "needs_evidence_index": lit(o.evidence) & ~no_text & (~has_evidence | some("anchor_error")),
            "needs_vision": lit(o.vision_ocr) & (~complete | F.col("vision_at").isNull()),
            "needs_embeddings_baseline": need_base, "needs_embeddings_vision": need_vision,
            "needs_suggestions_baseline": lit(o.suggestions_baseline) & ~some("has_sugg_baseline"), "needs_suggestions_vision": lit(o.suggestions_vision) & ~some("has_sugg_vision"),
            "needs_page_notes": wanted & large & (~_reached("note_pages", expected) | notes_stale),
            "needs_summary": lit(o.summary) & large & (F.col("summary_at").isNull() | F.coalesce(F.col("summary_at") < F.col("notes_at"), lit(False))),
        }
    )
    stale = F.col("similarity_at").isNull() | F.coalesce(F.col("similarity_at") < F.col("embedded_at"), lit(False))
    embed = F.col("needs_embeddings_baseline") | F.col("needs_embeddings_vision")
    flagged = flagged.withColumn("needs_embeddings", embed).withColumn("needs_similarity", lit(o.similarity) & (embed | ((source != "") & stale)))
    notes_task = "page_notes_vision" if o.notes_source == "vision_ocr" else "page_notes_baseline"
    order = (
        ("needs_evidence_index", "evidence_index"), ("needs_vision", "vision_ocr"), ("needs_embeddings_baseline", "embeddings_baseline"), ("needs_embeddings_vision", "embeddings_vision"), ("needs_similarity", "similarity_index"),
        ("needs_page_notes", notes_task), ("needs_summary", "summary_hierarchical"), ("needs_suggestions_baseline", "suggestions_baseline"), ("needs_suggestions_vision", "suggestions_vision"),
    )
    tasks = F.filter(F.array(*[F.when(F.col(flag), F.lit(task)) for flag, task in order]), lambda t: t.isNotNull())
    return flagged.withColumn("tasks", tasks)


def process_missing(plan: DataFrame) -> DataFrame:
    """Counters of missing work over all planned documents."""
    flags = [c for c in plan.columns if c.startswith("needs_")]
    return plan.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.size("tasks") > 0).alias("missing_docs"), F.sum(F.size("tasks")).alias("tasks"), *[F.count_if(c).alias(c.replace("needs_", "missing_")) for c in flags])


def preview(plan: DataFrame, limit: int = 20) -> DataFrame:
    """The first documents with missing work in scan order: fewest pages first, unknown last."""
    return plan.where(F.size("tasks") > 0).orderBy(F.asc_nulls_last("page_count"), "id").limit(limit).select("id", "page_count", F.array_join("tasks", ",").alias("tasks"))


def preview_priority(plan: DataFrame, limit: int = 20) -> DataFrame:
    """Documents by priority: 2 for each marked task, 3 for a large one; 3 and more is high."""
    marked = F.size(F.filter("tasks", lambda t: F.exists(F.array(*map(F.lit, PRIORITY_MARKERS)), lambda m: F.lower(t).contains(m))))
    score = marked * 2 + F.when(F.col("large_doc") & (F.col("needs_page_notes") | F.col("needs_summary")), 3).otherwise(0)
    ranked = plan.where(F.size("tasks") > 0).select("id", score.alias("priority"), F.size("tasks").alias("n_tasks"))
    return ranked.withColumn("is_high", F.col("priority") >= 3).orderBy(F.desc("priority"), F.desc("n_tasks"), "id").limit(limit)


def continued(plan: DataFrame) -> DataFrame:
    """(doc_id, position, task): what a document's pipeline goes on with, in order."""
    return plan.select(F.col("id").alias("doc_id"), F.posexplode("tasks").alias("position", "task"))


def pipeline_status(plan: DataFrame) -> DataFrame:
    """(id, step, required, done) of the six steps of each document."""
    rows = (
        ("evidence", ~F.col("evidence_no_text_layer"), ~F.col("needs_evidence_index")), ("vision_ocr", F.lit(True), ~F.col("needs_vision")), ("embeddings", F.lit(True), ~F.col("needs_embeddings")),
        ("similarity", F.lit(True), ~F.col("needs_similarity")), ("page_notes", F.col("large_doc"), ~F.col("needs_page_notes")), ("suggestions", F.lit(True), ~(F.col("needs_suggestions_baseline") | F.col("needs_suggestions_vision"))),
    )
    steps = F.array(*[F.struct(F.lit(s).alias("step"), r.alias("required"), d.alias("done")) for s, r, d in rows])
    return plan.select("id", F.explode(steps).alias("x")).select("id", "x.*")
