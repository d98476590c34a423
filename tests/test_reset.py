import random

from pyspark.sql import functions as F

from foliant.operators import reset, vectors
from foliant.sources import rest
from foliant.sources.versioned import VersionedTable
from tests.test_upstream import Archive, archive  # noqa: F401


def rows_of(frame):
    return sorted(r.doc_id for r in frame.collect())


def test_cleared_frames_and_counts(spark):
    ids = [1, 1, 2, 3, 3, 3]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    names = [*reset.DERIVED, "points", "task_runs", "notes"]
    frames = {n: frame for n in names} | {"ocr_scores": frame.limit(0)}
    some = spark.createDataFrame([(1,), (3,), (3,), (None,), (8,)], "doc_id long")
    left, counts = reset.cleared(frames, some)
    assert {n: rows_of(f) for n, f in left.items()} == {n: [] if n == "ocr_scores" else ids if n == "notes" else [2] for n in names}
    assert {r.name: (r.removed, r.kept) for r in counts.collect()} == {n: (0, 0) if n == "ocr_scores" else (0, 6) if n == "notes" else (5, 1) for n in names}
    left, counts = reset.cleared(frames)
    assert {n for n, f in left.items() if f.count()} == {"task_runs", "notes"}
    assert {r.name for r in counts.where("kept > 0").collect()} == {"task_runs", "notes"}


def test_documents_start_over(spark):
    documents = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old")], "id long, title string")
    remote = spark.createDataFrame([("new", 1), ("new", 2), ("first", 4)], "title string, id long")
    wanted = spark.createDataFrame([(1,), (1,), (3,), (4,), (None,)], "doc_id long")
    merged, tasks, report = reset.restarted(wanted, documents, remote, vision=True)
    assert {r.id: r.title for r in merged.collect()} == {1: "new", 2: "old", 3: "old", 4: "first"}
    got = {}
    for r in tasks.orderBy("doc_id", "position").collect():
        got.setdefault(r.doc_id, []).append(r.task)
    assert set(got) == {1, 4} and got[1] == got[4] == ["evidence_index", "vision_ocr", "embeddings_vision", "similarity_index", "page_notes_vision", "summary_hierarchical", "suggestions_baseline", "suggestions_vision"]
    assert tasks.where("force").select("task").distinct().collect()[0].task == "vision_ocr"
    assert {r.doc_id: (r.synced, r.enqueued) for r in report.collect()} == {1: (True, 8), 3: (False, 0), 4: (True, 8)}
    _, none, report = reset.restarted(wanted, documents, remote, vision=False, enqueue=False)
    assert none.count() == 0 and {r.enqueued for r in report.collect()} == {0}


def test_cleanup_counts(spark):
    tidy = lambda c: F.regexp_replace(c, r"\s+", " ")
    rows = [(1, 1, "a", "x  y", "x  y", "x y", 1, 1), (1, 2, "b", "x", "x", "x", 1, 1), (2, 1, "a", "z", None, None, None, None), (3, 1, "a", "", "", "", 0, 0)]
    pages = spark.createDataFrame(rows, "doc_id long, page int, source string, text string, raw_text string, clean_text string, token_estimate_raw int, token_estimate_clean int")
    ids = spark.createDataFrame([(1,), (2,), (9,)], "doc_id long")
    totals = lambda *a, **k: tuple(reset.cleanup(pages, *a, clean=tidy, **k)[1].first())
    assert totals() == (3, 4, 1) and totals(ids) == (3, 3, 1) and totals(source="b") == (3, 1, 0) and totals(ids, source="a", clear_first=True) == (3, 2, 2)
    assert {(r.doc_id, r.clean_text) for r in reset.cleanup(pages, ids, source="a", clean=tidy)[0].collect()} == {(1, "x y"), (2, "z")}
    tasks = reset.cleanup_tasks(pages.select(F.col("doc_id").alias("id")).distinct(), source="a", clear_first=True).collect()
    assert sorted((t.doc_id, t.task, t.source, t.clear_first) for t in tasks) == [(d, "cleanup_texts", "a", True) for d in (1, 2, 3)]


def test_audit_against_counting(spark):
    rng = random.Random(8)
    kinds = ["both", "vision", "baseline", " Both ", "odd", None]
    embedded = [(d, rng.choice(kinds), rng.choice([None, 0, 1, 3]), "t") for d in range(80)]
    stored = [(d, rng.choice(["text_layer", "vision_ocr", "other"]), rng.randrange(-1, 4), rng.choice([None, [], [1.0], [1.0, 2.0]])) for d in range(80) for _ in range(rng.randrange(0, 9))]
    titles = [(d, f"d{d}") for d in range(70)]
    rows = vectors.audited(
        spark.createDataFrame(embedded, "doc_id long, embedding_source string, chunk_count int, embedded_at string"),
        spark.createDataFrame(stored, "doc_id long, source string, chunk int, embedding array<double>"), spark.createDataFrame(titles, "doc_id long, title string"),
    )
    want = {}
    for d, kind, n, _ in embedded:
        layers = {"both": ["text_layer", "vision_ocr"], "vision": ["vision_ocr"], "baseline": ["text_layer"]}.get((kind or "").strip().lower())
        if layers and n and d < 70:
            places = {(s, c) for x, s, c, v in stored if x == d and v and s in layers and 0 <= c < n}
            want[d] = (len(layers) * n, len(places), not places)
    assert {r.doc_id: (r.expected_vectors, r.found_vectors, r.fully_missing) for r in rows.collect()} == want
    bad = sorted(d for d, (e, f, _) in want.items() if f < e)
    report = vectors.audit_report(rows, limit=4, provider="p").first()
    full = sum(want[d][2] for d in bad)
    assert (report.scanned_docs, report.affected_docs, report.fully_missing_docs, report.partial_missing_docs, report.truncated) == (len(want), len(bad), full, len(bad) - full, True)
    assert [i.doc_id for i in report["items"]] == bad[:4] and report["items"][0].title == f"d{bad[0]}"
    none = vectors.audit_report(rows.limit(0), limit=0).first()
    assert (none.scanned_docs, none.limit, none.truncated, none["items"]) == (0, 1, False, [])


def test_missing_documents_are_fetched_once(spark, archive, tmp_path):  # noqa: F811
    Archive.rows = {i: f"2024-01-{i:02d}" for i in range(1, 9)}
    Archive.asked, Archive.broken, Archive.other = [], {6}, {7}
    table = VersionedTable(spark, str(tmp_path / "t"), ["id"], buckets=2)
    schema = "id long, title string, modified string"
    table.upsert(spark.createDataFrame([(1, "mine", "m"), (2, "mine", "m")], schema))
    wanted = spark.createDataFrame([(i,) for i in (1, 3, 3, 4, 6, 7, 50, None)], "id long")
    got = {r.id: r.state for r in rest.sync_missing(wanted, table, f"{archive}/docs", "t", schema).collect()}
    assert got == {1: "local", 3: "synced", 4: "synced", 6: "failed", 7: "invalid", 50: "missing"}
    assert sorted(Archive.asked) == [3, 4, 6, 7, 50]
    assert {r.id: r.title for r in table.read().collect()} == {1: "mine", 2: "mine", 3: "t3", 4: "t4"}
    Archive.broken, Archive.asked = set(), []
    got = {r.id: r.state for r in rest.sync_missing(wanted, table, f"{archive}/docs", "t", schema).collect()}
    assert got[3] == "local" and got[6] == "synced" and sorted(Archive.asked) == [6, 7, 50]
    fresh = VersionedTable(spark, str(tmp_path / "fresh"), ["id"], buckets=2)
    assert {r.state for r in rest.sync_missing(wanted.where("id = 50"), fresh, f"{archive}/docs", "t", schema).collect()} == {"missing"} and fresh.versions() == []
