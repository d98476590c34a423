"""Hand-built cases of the archive operators."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import model_text
from foliant.operators import corpus, merge, planner, review, runs, search, textops, vectors
from foliant.sources import rest


@pytest.fixture(scope="module")
def archive(spark):
    docs = spark.createDataFrame([(7101, 7001, None), (7102, 7001, None), (7103, 7002, None), (7104, None, None), (7105, None, "DELETED upstream @ x")], "id long, correspondent_id long, deleted_at string").withColumn("page_count", F.lit(None).cast("int"))
    key = spark.createDataFrame([(7101, "vision_ocr"), (7103, "vision_ocr"), (7105, "vision_ocr")], "doc_id long, source string")
    return corpus.processing_flags(docs.where(corpus.is_active("DELETED upstream")), key, key, key, "vision_ocr")


def test_dashboard(spark, archive):
    row = corpus.corpus_stats(archive).first()
    assert (row.total, row.embeddings, row.fully, row.unprocessed) == (4, 2, 2, 2)
    names = spark.createDataFrame([(7001, "Alpha"), (7002, "Beta")], "id long, name string")
    top = corpus.top_groups(archive.withColumnRenamed("id", "doc_id"), "correspondent_id", names, "Unassigned")
    assert [tuple(r) for r in top.collect()] == [("Alpha", 2, 1), ("Beta", 1, 0), ("Unassigned", 1, 1)]
    pages = dict(corpus.page_count_histogram(archive).collect())
    assert pages["Unknown"] == 4 and pages["100+"] == 0 and len(pages) == 9


def test_search_quality_and_evidence(spark):
    hits = spark.createDataFrame([(901, 1, "vision_ocr", 40, "an invoice", 0.9), (902, 1, "vision_ocr", 85, "an invoice", 0.7), (902, 1, "text_layer", 85, "other", 0.69)], "doc_id long, page int, source string, quality int, text string, score double")
    assert [r.doc_id for r in search.hybrid_search(hits, "invoice", min_quality=80).collect()] == [902]
    sources = search.select_sources(hits.withColumn("hit_rank", F.monotonically_increasing_id()).withColumn("doc_date", F.lit(None).cast("string")))
    assert [(r.id, r.doc_id) for r in sources.collect()] == [(1, 901), (2, 902), (3, 902)]
    cited = spark.createDataFrame([(1, 5, 1, "a", [10.0, 20.0, 30.0, 40.0]), (2, 5, 1, "a", [30.0, 20.0, 10.0, 40.0]), (3, 5, 2, " ", None), (4, 5, 2, "b", None), (5, 0, 0, "b", None), (6, 6, 9, "late", None)], "ordinal int, doc_id long, page int, snippet string, bbox array<double>")
    got = {r.ordinal: (r.status, r.error) for r in search.evidence_status(cited).collect()}
    assert got == {1: ("ok", None), 2: ("error", "invalid_bbox"), 3: ("error", "empty_snippet"), 4: ("no_match", None), 5: ("error", "invalid_doc_or_page")}


def test_text_cleaning_and_chunks(spark):
    assert spark.createDataFrame([("Rech-\nnung\nPage 12\nBetrag: 10,00 EUR",)], "t string").select(textops.clean_text(F.col("t")).alias("x")).first().x == "Rechnung\nBetrag: 10,00 EUR"
    page = "<table><tr><td>Datum</td><td>2024-01-01</td></tr><tr><td>Betrag</td><td>19,99&nbsp;EUR</td></tr></table>"
    out = spark.createDataFrame([(page,)], "t string").select(textops.clean_text(F.col("t")).alias("x")).first().x
    assert "Datum | 2024-01-01" in out and "Betrag | 19,99" in out
    long = "very long ocr content " * 2500
    parts = textops.chunks(spark.createDataFrame([(1, long), (2, None), (3, "a\n\nb")], "doc_id long, text string"), max_tokens=300).collect()
    assert all(len(p.text) / 3.5 <= 301 for p in parts) and {p.doc_id for p in parts} == {1, 3}
    assert textops.pack_chunks("a\n\nb", 1200, 200) == ["a\n\nb"]
    chunks = textops.pack_chunks("x" * 3000, 1200, 200)
    assert len(chunks) == 3 and chunks[1].startswith("x" * 200 + "\n")
    q = textops.score_quality(spark.createDataFrame([("",), ("aaaaaaaaaaaaaaaa",), (None,)], "text string")).collect()
    assert q[0].quality.reasons == ["empty"] and q[2].quality.score == 0 and "long_repeats" in q[1].quality.reasons
    notes = spark.createDataFrame([(1, p, "n" * 1200) for p in (1, 2, 3)], "doc_id long, page int, text string")
    sections = textops.note_sections(notes, max_tokens=700).collect()
    assert [s.section_key for s in sections] == ["1-2", "3-3"]


def test_runs_and_retries(spark):
    log = spark.createDataFrame([(1, 11, "sync", None, "completed"), (2, 11, "sync", "", "running"), (3, 11, "vision_ocr", "v", "failed")], "id long, doc_id long, task string, source string, status string").withColumn("created_at", F.lit("x"))
    assert {(r.task, r.status) for r in runs.latest_runs(log).collect()} == {("sync", "running"), ("vision_ocr", "failed")}
    messages = ["context size", "timed out", "Connection refused", "x"]
    got = spark.createDataFrame([(m,) for m in messages], "m string").select(runs.classify_error(F.col("m")).alias("e")).collect()
    assert [r.e for r in got] == ["EMBED_CONTEXT_OVERFLOW", "LLM_TIMEOUT", "NETWORK_CONNECTION_ERROR", "WORKER_TASK_ERROR"]
    failed = spark.createDataFrame([(1, 1, "LLM_TIMEOUT", 0, True), (2, 1, "LLM_TIMEOUT", 2, True), (3, 1, "X", 0, False)], "id long, doc_id long, error_type string, attempt int, retryable boolean")
    assert [(r.action, r.delay_s) for r in runs.retry_plan(failed).orderBy("id").collect()] == [("retry", 5), ("dead_letter", None), ("dead_letter", None)]
    points = log.select("doc_id").distinct()
    assert rest.fetch_many(points.withColumnRenamed("doc_id", "id"), points.select(F.col("doc_id").alias("id"))).count() == 1


def test_vectors(spark):
    pts = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0]), (0, 2, [5.0])], "doc_id long, chunk int, embedding array<double>")
    assert vectors.centroids(pts).first().centroid == [0.333333, 0.333333]
    expected = spark.createDataFrame([(67, 4), (68, 4), (69, 1)], "doc_id long, chunk_count int")
    stored = spark.createDataFrame([(68, 0, [1.0]), (68, 3, [1.0]), (69, 0, [1.0]), (67, 0, [])], "doc_id long, chunk int, embedding array<double>")
    assert {r.doc_id: r.state for r in vectors.integrity(expected, stored).collect()} == {67: "fully_missing", 68: "partially_missing"}
    assert vectors.distance_limit(0) is None and vectors.distance_limit(1) == 0 and vectors.distance_limit(0.5) == 1


def test_review_and_writeback(spark):
    schema = "doc_id long, title string, issue_date string, correspondent_id long, tags array<long>, note string, note_id long"
    local = spark.createDataFrame([(1, "A", None, 3, [1, 2], "Neu\nAI summary", None)], schema)
    remote = spark.createDataFrame([(1, " A ", "", 3, [2, 1], "Alt\nAI summary", 9)], schema)
    plan = review.change_plan(local, remote)
    assert plan.first().changed == ["note"] and plan.first().note_action == "replace"
    assert [r.method for r in review.writeback_calls(plan).orderBy("step").collect()] == ["DELETE", "POST"]
    rows = [(True, None, None), (False, None, None), (False, "2024-01-01T00:00:00Z", "2024-02-01"), (False, "2024-03-01", "2024-02-01T00:00:00Z"), (False, "never", None)]
    states = spark.createDataFrame(rows, "o boolean, r string, m string").select(review.review_status(F.col("o"), F.col("r"), F.col("m")).alias("s")).collect()
    assert [r.s for r in states] == ["needs_review", "unreviewed", "needs_review", "reviewed", "unreviewed"]


def test_merge(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    new = spark.createDataFrame([(2, "first", 1), (2, "second", 2), (3, "c", 3)], "id long, name string, o int")
    assert sorted(tuple(r) for r in merge.upsert(base, new, ["id"], F.col("o")).collect()) == [(1, "a"), (2, "first"), (3, "c")]
    assert merge.prune(base, new.limit(0), "id").count() == 0
    notes = spark.createDataFrame([(1, 10, "old"), (1, 11, "stale"), (2, 20, "mine"), (3, 30, "safe")], "document_id long, id long, note string")
    given = spark.createDataFrame([(1, "10", "new", 1), (1, "10", "again", 2), (1, "20", "moved here", 3), (3, "x", "bad", 1)], "document_id long, raw_id string, note string, ordinal int")
    assert sorted(tuple(r) for r in merge.merge_notes(notes, given).collect()) == [(1, 10, "new"), (1, 20, "moved here"), (2, -1, "mine"), (3, 30, "safe")]
    assert merge.next_local_id(notes).first()[0] == -1


def test_planner_order_and_followups():
    tasks = [t for t, _ in planner.followup_tasks(planner.PlanOptions())]
    assert tasks.index("embeddings_vision") < tasks.index("vision_ocr") and tasks[0] == "evidence_index"
    plain = [t for t, _ in planner.followup_tasks(planner.PlanOptions(vision_enabled=False))]
    assert "page_notes_baseline" in plain and "suggestions_vision" not in plain


def test_model_text(spark):
    rows = ['```json\n{"a": 1}\n```', 'x {"a": {"b": "c', "none", '{"a": [1,], "b": 2}', None]
    got = [r.j for r in spark.createDataFrame([(r,) for r in rows], "t string").select(model_text.json_object(F.col("t")).alias("j")).collect()]
    assert got == ['{"a": 1}', '{"a": {"b": "c"}}', None, '{"a": [1], "b": 2}', None]
    notes = spark.createDataFrame([("Facts:\n- one\n2) two\nZahlen\n* 12,50 EUR",), ("plain line\n12",)], "t string").select(model_text.parse_notes(F.col("t")).alias("n")).collect()
    assert notes[0].n.facts == ["one", "two"] and notes[0].n.key_numbers == ["12,50 EUR"] and notes[1].n.uncertainties == ["model_returned_non_json"]
    s = spark.createDataFrame([('{"parsed": {"title": " T ", "date": "2024-02-30", "tags": ["a", "a", " ", "b"]}}',)], "p string").select(model_text.suggestion(F.col("p")).alias("s")).first().s
    assert (s.title, s.date, s.tags) == ("T", "", ["a", "b"])
