import json

from pyspark.sql import functions as F

from foliant.operators.stages import Stage, Summaries, resume_from


def slow_resume(raw, stage, source, total):
    """The rules of a checkpoint as told in resume_from's docstring, one after another."""
    try:
        c = json.loads(raw or "")
    except ValueError:
        return 0
    if not isinstance(c, dict):
        return 0
    c = c["resume_from"] if isinstance(c.get("resume_from"), dict) else c
    wrong = c.get("stage") != stage or (c.get("source") or source) != source or (c.get("total") or total) != total
    return 0 if wrong else max(0, min(int(c.get("current") or 0), total))


def test_resume_from_against_the_rules(spark):
    full = {"stage": "notes", "source": "v", "current": 3, "total": 9}
    cases = [None, "", "x", "[1]", "{", json.dumps(full), json.dumps(full | {"stage": "other"}), json.dumps(full | {"source": ""}), json.dumps(full | {"source": "t"}), json.dumps(full | {"total": 8}), json.dumps(full | {"total": 0}), json.dumps(full | {"current": 20}), json.dumps(full | {"current": -1}), json.dumps({"stage": "other", "resume_from": full}), json.dumps(full | {"resume_from": {}}), json.dumps(full | {"resume_from": None}), json.dumps({"stage": "notes"})]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, c string")
    got = {r.i: r.n for r in rows.select("i", resume_from(F.col("c"), "notes", source="v", total=F.lit(9)).alias("n")).collect()}
    assert got == {i: slow_resume(c, "notes", "v", 9) for i, c in enumerate(cases)}
    assert sorted(set(got.values())) == [0, 3, 9]


def logged(path):
    """A model that writes down what it is asked, and fails on texts with 'bad' until a file says otherwise."""

    def model(text):
        with open(f"{path}/calls", "a") as out:
            out.write(text + "\n")
        import os

        if "bad" in text and not os.path.exists(f"{path}/mended"):
            raise ValueError("no answer")
        return text.upper()

    return model


def stop_after(n):
    """A stop flag that is raised at the n-th look."""
    looks = []

    def stop():
        looks.append(1)
        return len(looks) > n

    return stop


def calls(path):
    return (path / "calls").read_text().split("\n")[:-1] if (path / "calls").exists() else []


def test_a_stopped_stage_goes_on_where_it_was(spark, tmp_path):
    items = spark.createDataFrame([(i, "bad" if i == 7 else "" if i == 3 else f"t{i}") for i in range(30)], "k int, input string")
    stage = Stage(spark, str(tmp_path / "s"), ["k"], slice_rows=8, buckets=2)
    assert stage.results(items).count() == 0
    model = logged(tmp_path)
    assert not stage.run(items, model, stop=stop_after(2))
    first = calls(tmp_path)
    assert 0 < len(first) < 29
    assert stage.run(items, model)
    assert sorted(set(calls(tmp_path))) == sorted({f"t{i}" for i in range(30) if i not in (3, 7)} | {"bad"})
    assert len(set(first)) == len(first) and len([c for c in calls(tmp_path) if c != "bad"]) == 28  # each good one once
    state = {r.k: (r.status, r.result, r.error) for r in stage.results(items).collect()}
    assert state == {i: ("error", None, "no answer") if i == 7 else ("skipped", None, "empty_input") if i == 3 else ("ok", f"T{i}", None) for i in range(30)}
    assert stage.progress(items).first().asDict() == {"total": 30, "done": 29, "errors": 1, "open": 1}
    (tmp_path / "mended").touch()
    n = len(calls(tmp_path))
    changed = items.withColumn("input", F.when(F.col("k") == 5, "new").otherwise(F.col("input")))
    assert stage.results(changed).where("k = 5").count() == 0  # a result of another input does not show
    assert stage.run(changed, model) and sorted(calls(tmp_path)[n:]) == ["bad", "new"]
    assert {r.k: r.result for r in stage.results(changed).where("k IN (5, 7)").collect()} == {5: "NEW", 7: "BAD"}


def test_three_levels_stopped_at_every_point_equal_a_whole_run(spark, tmp_path):
    docs = spark.createDataFrame([(1, 30, "x"), (2, 2, "small"), (3, None, "y" * 20_000), (4, 40, None), (5, 50, "")], "doc_id int, page_count int, text string")
    rows = [(d, p, "vision_ocr", f"d{d}p{p}") for d in (1, 2, 5) for p in range(1, 6)] + [(3, p, "text_layer", f"d3p{p}") for p in (2, 1)] + [(1, 9, "text_layer", "unread"), (5, 6, "vision_ocr", "  "), (5, 7, "vision_ocr", None)]
    pages = spark.createDataFrame(rows, "doc_id int, page int, source string, text string")
    make = lambda where: Summaries(spark, str(tmp_path / where), source="vision_ocr", section_pages=2, slice_rows=6, buckets=1)
    section, document = lambda t: t.replace("\n\n", "|"), lambda t: t.replace("\n\n", "#")
    whole = make("whole")
    assert whole.run(docs, pages, str.upper, section, document)
    want = {(r.doc_id, r.source): r.summary for r in whole.summaries(docs, pages).collect()}
    part = lambda d, ps: f"Section {ps[0]}-{ps[-1]}: " + "|".join(f"Page {p}: D{d}P{p}" for p in ps)
    assert want == {(d, "vision_ocr"): "#".join(part(d, ps) for ps in ([1, 2], [3, 4], [5])) for d in (1, 5)} | {(3, "text_layer"): part(3, [1, 2])}
    resumed, turns = make("resumed"), 0
    while not resumed.run(docs, pages, logged(tmp_path), section, document, stop=stop_after(1)):
        turns += 1
    assert turns >= 4 and sorted(calls(tmp_path)) == sorted([f"d{d}p{p}" for d in (1, 5) for p in range(1, 6)] + ["d3p1", "d3p2"])
    assert {(r.doc_id, r.source): r.summary for r in resumed.summaries(docs, pages).collect()} == want


def test_errors_of_sections_and_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, 30, ""), (2, 30, "")], "doc_id int, page_count int, text string")
    pages = spark.createDataFrame([(d, p, "text_layer", f"d{d}p{p}") for d in (1, 2) for p in (1, 2)], "doc_id int, page int, source string, text string")

    def section(text):
        if "d2" in text or "p2" in text:
            raise RuntimeError("lost")
        return text

    def document(text):
        raise RuntimeError("z" * 300)

    run = Summaries(spark, str(tmp_path / "e"), source="text_layer", section_pages=1, buckets=1)
    assert run.run(docs, pages, str.strip, section, document)
    (row,) = run.summaries(docs, pages).collect()  # the second document has no section, so no summary
    assert (row.doc_id, row.summary, row.confidence_note) == (1, "", "global_summary_error:" + "z" * 200)
    assert run.run(docs.limit(0), pages, str.strip, section, document) and run.summaries(docs.limit(0), pages).count() == 0
