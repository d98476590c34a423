"""Brute-force and hand-built cases of text cleaning, chunks, evidence, writeback, ingest and the REST source."""

import difflib
import json
import random
import re
import threading
import unicodedata
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import display, model_text
from foliant.operators import context, merge, models, pages, planner, review, runlog, search, suggest, textops, vectors, writeback
from foliant.sources import ingest, rest


def slow_clean(text):
    """Cleaning by the definition: break k joins when line k may run on and break k - 1 has not joined."""
    lines = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if not re.fullmatch(r"(seite|page)?\s*\d+", x.strip(), re.IGNORECASE)]

    def runs_on(a, b):
        a, b = a.rstrip(), b.lstrip()
        if a.endswith("-") and b[:1].isalpha():
            return a[:-1] + b
        if a and b and a[-1] not in ".:;?!" and not re.match(r"[-*•]\s", b):
            return a + " " + b
        return None

    out, joined = [], False
    for k, line in enumerate(lines):
        if joined:
            joined = False
            continue
        both = runs_on(line, lines[k + 1]) if k + 1 < len(lines) else None
        joined = both is not None
        out.append(both if joined else line.rstrip())
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "\n".join(out))).strip()


def test_cleaning_against_brute_force(spark):
    rng = random.Random(3)
    parts = ["Rech-", "nung", "a.", "b:", " x ", "", "", "- item", "-", "•  dot", "Page 12", "12", "seite 3 ", "é", "3-", "Wort -", "two words", "\t", "end!", "*", " nb "]
    texts = [rng.choice(["\n", "\r\n", "\n", "\r"]).join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(700)] + ["", "a\n\n\n\n\nb", "x  \t y"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", textops.clean_plain(F.col("t")).alias("t")).orderBy("i").collect()]
    assert [g for g in zip(texts, got, strict=True) if g[1] != slow_clean(g[0])] == []


def test_scores_and_noise_against_brute_force(spark):
    rng = random.Random(5)
    alphabet = "abeiouXYZ äöé0129  \n\t\r.,;!?_²日…"
    texts = ["".join(rng.choice(alphabet) * rng.choice([1, 1, 1, 3, 9]) for _ in range(rng.randint(1, 80))) for _ in range(150)] + ["a", "aa", "12 ab_c d1e fg"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    q = {r.i: r.quality for r in textops.score_quality(rows).collect()}
    m = {r.i: r.m for r in rows.select("i", textops.noise(F.col("text")).alias("m")).collect()}
    white = "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f \x85\xa0"
    for i, text in enumerate(texts):
        c = text.strip(white)
        letters, digits, alnum = sum(x.isalpha() for x in c), sum(unicodedata.category(x) == "Nd" for x in c), sum(unicodedata.category(x)[0] in "LN" for x in c)
        words = re.findall("[A-Za-z0-9ÄÖÜäöüß]+", c)
        got = q[i].metrics
        assert (got.length, got.letters, got.word_count) == (len(c), letters, len(words))
        if c:
            assert abs(got.digit_ratio - digits / len(c)) < 1e-9 and abs(got.non_alnum_ratio - (1 - alnum / len(c))) < 1e-9
            assert got.max_run == max(len(x.group()) for x in re.finditer(r"(.)\1*", c, re.DOTALL))
            assert abs(got.vowel_ratio - sum(x in "aeiouAEIOUäöüÄÖÜ" for x in c) / max(1, letters)) < 1e-9
        if words:
            assert abs(got.wordlike_ratio - sum(bool(set(w) & set("aeiouAEIOUäöüÄÖÜ")) for w in words) / len(words)) < 1e-9 and abs(got.avg_word_len - sum(map(len, words)) / len(words)) < 1e-9
        n, own = len(text), re.findall(r"\b[^\W\d_]{2,}\b", text)
        lines = re.split(r"\r\n|\r|\n", text)
        assert abs(m[i].digit_ratio - sum(x.isdecimal() for x in text) / n) < 1e-9 and m[i].line_count == len(lines) and abs(m[i].avg_line_len - sum(map(len, lines)) / len(lines)) < 1e-9
        assert abs(m[i].avg_word_len - (sum(map(len, own)) / len(own) if own else 0)) < 1e-9 and abs(m[i].multispace_ratio - len(re.findall(r"[ \t]{3,}", text)) / max(1, n / 200)) < 1e-9


def test_html_and_budget_chunks(spark):
    html = "<style>x{}</style><p>A&amp;B</p><ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>b</td></tr></table><br/>end"
    out = spark.createDataFrame([(html,)], "t string").select(textops.clean_text(F.col("t")).alias("x"), textops.looks_like_html(F.col("t")).alias("h")).first()
    assert out.h and "A&B" in out.x and "a | b" in out.x and "<" not in out.x and "x{}" not in out.x
    text = "One two. " * 300
    parts = textops.split_budget(text, 50, 1200, 20)
    assert all(len(p) <= 175 for p in parts) and parts[0] + "".join(p[20:] for p in parts[1:]) == text


def test_notes_by_heading():
    got = model_text._notes("intro\nFacts:\n- one\n2) two\n\nKEY-NUMBERS\n* 5 EUR\nEntities\n")
    assert got["facts"] == ["one", "two"] and got["key_numbers"] == ["5 EUR"] and got["entities"] == []
    bare = model_text._notes("- first line\nok\n12,50 EUR")
    assert bare["facts"] == ["first line", "12,50 EUR"] and bare["uncertainties"] == ["model_returned_non_json"] and "12,50 EUR" in bare["key_numbers"]
    assert model_text._notes(None)["facts"] == []


def test_semantic_and_word_chunks(spark):
    vector = {"A": [1.0, 0.0], "B": [0.0, 1.0]}
    embed = lambda s: vector[s[0]]
    assert pages.merge_sentences("A one. A two! B three? B four.", 100, 0, 0.75, embed) == ["A one. A two!", "B three? B four."]
    assert pages.merge_sentences("A one. A two. A three.", 13, 3, 0.75, embed) == ["A one. A two.", "wo.\nA three."]
    assert pages.merge_sentences("  ", 10, 2, 0.5, embed) == []
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(1, 9) for _ in range(rng.randint(0, 30))]
        limit, overlap = rng.randint(10, 40), rng.choice([0, 5, 12])
        runs = pages.pack_words(sizes, limit, overlap)
        assert (not sizes and not runs) or (runs[0][0] == 0 and runs[-1][1] == len(sizes))
        width = lambda a, b: sum(sizes[a:b]) + b - a - 1
        for (a, b), (c, d) in zip(runs, runs[1:], strict=False):
            assert a < b and c <= b < d and (overlap == 0) == (c == b)
            if overlap:
                assert width(c, b) >= overlap or c == a
                assert c == b - 1 or width(c + 1, b) < overlap
            assert width(a, b + 1) + (overlap == 0 and a > 0) > limit
    words = [{"text": t, "bbox": [float(i), 0.0, i + 0.5, 1.0]} for i, t in enumerate("aa bb cc dd".split())]
    frame = spark.createDataFrame([(1, 1, words), (2, 1, [])], f"doc_id long, page int, words array<{pages.BOX}>")
    got = pages.word_chunks(frame, max_chars=5, overlap=2).orderBy("chunk").collect()
    assert [(r.text, r.bbox) for r in got] == [("aa bb", [0.0, 0.0, 1.5, 1.0]), ("bb cc", [1.0, 0.0, 2.5, 1.0]), ("cc dd", [2.0, 0.0, 3.5, 1.0])]
    docs = spark.createDataFrame([(1, "whole"), (2, "text of two")], "doc_id long, text string")
    paged = spark.createDataFrame([(1, 3, "vision_ocr", 80, "page three")], "doc_id long, page int, source string, quality int, text string")
    assert sorted((r.doc_id, r.page, r.quality, r.text) for r in pages.page_chunks(docs, paged).collect()) == [(1, 3, 80, "page three"), (2, None, None, "text of two")]


def slow_best(words, want):
    """The best window, each scored by the definition."""
    best, found = 0.0, -1
    for at in range(len(words) - len(want) + 1):
        own = words[at : at + len(want)]
        if all(own):
            share = sum(a == b for a, b in zip(own, want, strict=True)) / len(want)
            if share >= 1:
                return at, 1.0
            if share > best:
                best, found = share, at
            elif share >= 0.6 and (ratio := difflib.SequenceMatcher(None, " ".join(want), " ".join(own)).ratio()) > best:
                best, found = ratio, at
    return (found, best) if found >= 0 and best >= 0.72 else (-1, 0.0)


def test_snippets_on_pages(spark):
    rng = random.Random(8)
    for _ in range(300):
        words = [rng.choice(["alpha", "beta", "gamma", "gamme", ""]) for _ in range(rng.randint(2, 25))]
        want = [rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(2, 6))]
        if len(words) >= len(want):
            assert search.best_window(words, want) == pytest.approx(slow_best(words, want))
    words = [{"text": t, "bbox": b} for t, b in (("The", [0.0, 0.0, 1.0, 1.0]), ("Total,", [1.0, 0.0, 2.0, 1.0]), ("amount", [2.0, 0.0, 3.0, 2.0]), ("due", [9.0, 0.0, 3.0, 1.0]))]
    anchors = spark.createDataFrame([(5, 1, words)], f"doc_id long, page int, words array<{pages.BOX}>")
    cited = spark.createDataFrame([(1, 5, 1, "total AMOUNT"), (2, 5, 1, "total"), (3, 5, 2, "total amount"), (4, 5, 1, "amount due"), (5, 5, 1, "other words here"), (6, 5, 1, None)], "ordinal int, doc_id long, page int, snippet string")
    got = {r.ordinal: (r.bbox, r.score) for r in search.match_citations(cited, anchors).collect()}
    assert got == {1: ([1.0, 0.0, 3.0, 2.0], 1.0), 2: (None, 0.0), 3: (None, 0.0), 4: ([2.0, 0.0, 3.0, 2.0], 1.0), 5: (None, 0.0), 6: (None, 0.0)}
    texts = spark.createDataFrame([(1, 1, "x the the the license text the end"), (2, 1, "the the"), (3, 1, None)], "doc_id long, page int, text string")
    snippets = spark.createDataFrame([(1, "The license"), (2, "the end."), (3, "end"), (4, "the the"), (5, "absent the")], "item_id int, text string")
    assert sorted((r.item_id, r.doc_id, r.start) for r in search.locate_snippets(snippets, texts).collect()) == [(1, 1, 3), (2, 1, 6), (4, 1, 1), (4, 2, 0)]


def test_nearest_and_numbering(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(90, 4)))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vectors.nearest(points.where("vec_id < 20"), points, 7, block_rows=16).collect()}
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for q in range(20):
        scores = np.round(unit @ unit[q], 6)
        order = [i for i in sorted(range(90), key=lambda i: (-scores[i], i)) if i != q][:7]
        assert [got[q, k + 1][0] for k in range(7)] == order
    rows = spark.createDataFrame([(int(k), i) for i, k in enumerate([5, 5, -9, 10**12, 7, 7, 7])], "id long, document_id long")
    assert [(r.id, r.document_id) for r in merge.numbered(rows, "id", ["document_id"]).orderBy("n").collect()] == [(-9, 2), (5, 0), (5, 1), (7, 4), (7, 5), (7, 6), (10**12, 3)]
    assert merge.numbered(rows.limit(0), "id", ["document_id"]).count() == 0

    def embed(text):
        if len(text) > 3:
            raise ValueError("too long")
        return [float(len(text)), 1.0]

    out = vectors.embed_or_split(spark.createDataFrame([("abcdefgh",), ("ab",), (None,)], "text string"), embed, 5).collect()
    assert out[1].embedding == [2.0, 1.0] and out[2].embedding == [0.0, 1.0] and out[0].embedding == pytest.approx([8 / 3, 1.0])


def test_expected_pages(spark):
    docs = spark.createDataFrame([(1, 2), (2, None), (3, 3), (4, 1)], "id long, page_count int")
    seen = spark.createDataFrame([(1, p, "vision_ocr") for p in (1, 7, 8)] + [(2, 0, "vision_ocr"), (2, 4, "vision_ocr"), (4, 1, "vision_ocr"), (4, 1, "vision_ocr")], "doc_id long, page int, source string")
    got = {r.id: (r.expected, r.done, r.missing, r.complete, r.percent) for r in pages.coverage(docs, seen, "vision_ocr").collect()}
    assert got == {1: (2, 1, 1, False, 50.0), 2: (None, 1, None, False, None), 3: (3, 0, 3, False, 0.0), 4: (1, 1, 0, True, 100.0)}
    sequence = planner.task_sequence(vision=True, sync=True, force=True)
    assert [t["task"] for t in sequence][:3] == ["sync", "evidence_index", "vision_ocr"] and sequence[2]["force"] and sequence[-1]["task"] == "suggestions_vision"
    assert [t["task"] for t in planner.task_sequence(vision=False)] == ["evidence_index", "embeddings_baseline", "similarity_index", "page_notes_baseline", "summary_hierarchical", "suggestions_baseline"]


SIDE = "doc_id long, title string, issue_date string, correspondent_id long, tags array<long>, note string, note_id long"


def test_writeback_decisions_and_jobs(spark):
    local = spark.createDataFrame([(1, "New", "2024-01-01", 3, [1], "Sum\nAI summary", None), (2, "Same", None, None, [], None, None)], SIDE)
    remote = spark.createDataFrame([(1, "Old", "2023-01-01", None, [2, 9], "Was\nAI summary", 7), (2, "Same", None, None, [], None, None)], SIDE).withColumn("modified", F.lit("m2"))
    found = writeback.items(local, remote)
    calls = writeback.payload_calls(found).orderBy("step").collect()
    assert [c.method for c in calls] == ["PATCH", "DELETE", "POST"] and calls[1].path.endswith("notes/?id=7")
    assert json.loads(calls[0].payload) == {"title": "New", "created": "2024-01-01", "correspondent": 3, "tags": [1]} and json.loads(calls[2].payload) == {"note": "Sum\nAI summary"}
    ask = lambda known, answers: writeback.resolve(found, spark.createDataFrame([(1, known, answers), (2, known, answers)], "doc_id long, known_modified string, resolutions map<string,string>"))
    state = lambda d: {r.doc_id: (r.status, r.use_local, r.use_remote) for r in d.collect()}
    every = ["title", "issue_date", "correspondent", "tags", "note"]
    assert state(ask(None, None)) == {1: ("completed", every, []), 2: ("no_changes", [], [])}
    assert state(ask("m1", None))[1] == ("conflicts", [], []) and {r.field: (r.remote, r.local) for r in writeback.conflicts(ask("m1", None)).collect()}["tags"] == ("2,9", "1")
    decided = ask("m1", {"title": "use_local", "tags": "use_remote", "note": "nonsense"})
    assert state(decided)[1] == ("completed", ["title"], ["tags"])
    assert [r.tags for r in writeback.take_remote(local, remote, decided, spark.createDataFrame([(9,)], "id long")).orderBy("doc_id").collect()] == [[9], []]
    assert json.loads(writeback.payload_calls(decided, "use_local").first().payload) == {"title": "New"}
    jobs = spark.createDataFrame([(1, "pending", None, True), (2, "pending", None, True), (3, "running", None, True)], "job_id long, status string, error string, dry_run boolean")
    errors = spark.createDataFrame([(2, "boom")], "job_id long, error string")
    ran = {r.job_id: (r.status, r.error) for r in writeback.execute_pending(jobs, errors).collect()}
    assert ran == {1: ("completed", None), 2: ("failed", "boom"), 3: ("running", None)}
    assert {r.status for r in writeback.execute_pending(jobs, errors, dry_run=True).where("processed").collect()} == {"completed"}
    assert {r.job_id: r.outcome for r in writeback.delete_jobs(jobs, spark.createDataFrame([(1,), (3,), (9,)], "job_id long")).collect()} == {1: "removed", 3: "refused", 9: "absent"}
    asked = spark.createDataFrame([(1, [1, 2]), (2, [2]), (3, [1])], "request_id long, doc_ids array<long>")
    there = spark.createDataFrame([(5, "running", "[1]"), (4, "completed", "[1,2]")], "job_id long, status string, doc_ids_json string")
    made = {r.request_id: (r.outcome, r.job_id, r.docs_changed, r.calls_count) for r in writeback.create_jobs(asked, there, found, writeback.payload_calls(found)).collect()}
    assert made == {1: ("created", None, 1, 3), 2: ("rejected", None, 0, 0), 3: ("existing", 5, 1, 3)}


class Upstream(BaseHTTPRequestHandler):
    calls: list = []

    def do_GET(self):
        rows = [{"id": i, "title": f"t{i}", "modified": "2024"} for i in range(1, 8)]
        self.calls.append(("GET", self.path, None, None))
        one = re.fullmatch(r"/docs/(\d+)/", self.path)
        page = int((re.search(r"[?&]page=(\d+)", self.path) or [0, 1])[1])
        body = next((r for r in rows if one and r["id"] == int(one[1])), None) if one else {"count": len(rows), "results": rows[(page - 1) * 3 : page * 3]}
        self.send_response(404 if body is None else 200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_PATCH(self):
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
        self.calls.append((self.command, self.path, body, self.headers["Idempotency-Key"]))
        self.send_response(500 if "/2/" in self.path else 200)
        self.end_headers()

    do_POST = do_DELETE = do_PATCH

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def upstream():
    server = HTTPServer(("127.0.0.1", 0), Upstream)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_rest_source_and_calls(spark, upstream):
    spark.dataSource.register(rest.PagedList)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("paged_list").option("url", f"{upstream}/docs").option("page_size", "3").load()
    assert sorted(r.id for r in rows.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert all("ordering=id" in c[1] for c in Upstream.calls)
    Upstream.calls.clear()
    assert [r.title for r in rows.where("id = 5").collect()] == ["t5"] and rows.where("id = 99").count() == 0
    assert {c[1] for c in Upstream.calls} == {"/docs/5/", "/docs/99/"}
    Upstream.calls.clear()
    calls = spark.createDataFrame([(1, 0, "PATCH", "/api/1/", '{"title":"x"}'), (1, 1, "POST", "/api/1/notes/", '{"note":"n"}'), (2, 0, "PATCH", "/api/2/", "{}"), (2, 1, "POST", "/api/2/notes/", "{}"), (3, 0, "DELETE", "/api/3/notes/?id=4", "{}")], "doc_id long, step int, method string, path string, payload string")
    assert [r.detail for r in rest.send_calls(calls.where("doc_id = 1"), upstream, "t").orderBy("step").collect()] == ["PATCH /api/1/", "POST /api/1/notes/"] and not Upstream.calls
    out = {(r.doc_id, r.step): (r.ok, r.detail) for r in rest.send_calls(calls, upstream, "t", dry_run=False).collect()}
    assert out[1, 0] == out[1, 1] == out[3, 0] == (True, "200") and not out[2, 0][0] and out[2, 1] == (False, "left out after a failed call")
    sent = {c[1]: (c[0], c[2]) for c in Upstream.calls}
    assert sent["/api/1/"] == ("PATCH", '{"title":"x"}') and sent["/api/1/notes/"] == ("POST", '{"note":"n"}') and "/api/2/notes/" not in sent
    assert len({c[3] for c in Upstream.calls}) == len(Upstream.calls)


def test_points_and_remote_values(spark):
    stored = spark.createDataFrame([(1, "a", 0, [1.0]), (1, "a", -1, [9.0]), (2, "b", 0, [2.0])], "doc_id long, source string, chunk int, embedding array<double>")
    new = spark.createDataFrame([(1, "a", 0, [5.0]), (3, "a", 0, [6.0])], stored.schema)
    assert sorted((r.doc_id, r.chunk, r.embedding[0]) for r in rest.upsert_points(stored, new).collect()) == [(1, -1, 9.0), (1, 0, 5.0), (2, 0, 2.0), (3, 0, 6.0)]
    assert rest.check_width(stored).first().uniform and rest.delete_points(stored, source="a", centroids=True).count() == 2
    assert rest.delete_points(stored, doc_ids=spark.createDataFrame([(2,)], "doc_id long")).count() == 2
    assert stored.where(rest.match_filter({"must": [{"key": "source", "match": {"value": "a"}}], "must_not": [{"key": "chunk", "match": {"value": 0}}]})).count() == 1
    far, near = spark.createDataFrame([(1, " x", ""), (2, None, "d")], "id long, title string, day string"), spark.createDataFrame([(1, "l", "m"), (3, "z", None)], "id long, title string, day string")
    assert sorted((r.id, r.title, r.day) for r in rest.coalesce_remote(far, near, ["title", "day"]).collect()) == [(1, " x", "m"), (2, None, "d"), (3, "z", None)]
    assert {r.o for r in spark.createDataFrame([("vision",), ("odd",), (None,)], "s string").select(vectors.source_offset(F.col("s")).alias("o")).collect()} == {2, 0}
    rows = spark.createDataFrame([(None, "2024-01-01"), ("2024-01-02", "2024-01-01"), ("2024-01-01", None), ("2024-01-01", "2024-01-02")], "a string, b string")
    assert [r.ok for r in rows.select(review.is_sync_ok(F.col("a"), F.col("b")).alias("ok")).collect()] == [False, True, True, False]
    assert spark.createDataFrame([("abcd", "abce")], "a string, b string").select(model_text.similarity_ratio(F.col("a"), F.col("b")).alias("r")).first().r == 0.75
    assert spark.createDataFrame([(5,)], "i long").select(model_text.point_uuid(F.col("i")).alias("u"), vectors.point_id(F.col("i"), F.lit(2), F.lit(3)).alias("p")).first().p == 5_002_000_003


def test_ingest_through_providers(spark, tmp_path):
    files = spark.createDataFrame([(1, bytearray(b"two words")), (2, bytearray(b""))], "doc_id long, content binary")
    layout = lambda content: [(1, 10.0, 20.0, [(5.0 - 5 * k, 0.0, 9.0, 2.0, w) for k, w in enumerate(content.decode().split())] + [(1.0, 1.0, 1.0, 1.0, "flat")])]
    read = ingest.read_words(files, layout)
    layer = {r.doc_id: r for r in ingest.text_layer(read).collect()}
    assert layer[1].text == "words two flat" and layer[1].words[1].bbox == [0.5, 0.0, 0.9, 0.1]
    anchored = {r.doc_id: (r.status, r.token_count) for r in ingest.anchors(read).collect()}
    assert anchored == {1: ("ok", 2), 2: ("no_text_layer", 0)}
    images = spark.createDataFrame([(1, p, bytearray(b"img")) for p in (1, 2, 3)], "doc_id long, page int, image binary")
    seen = ingest.read_vision(images, lambda prompt, image: prompt + image.decode(), "read: ", model="m", max_pages=2).collect()
    assert [(r.page, r.text, r.source, r.model_name) for r in sorted(seen)] == [(1, "read: img", "vision_ocr", "m"), (2, "read: img", "vision_ocr", "m")]
    (tmp_path / "chat.txt").write_text("own {q}\n")
    (tmp_path / "notes.txt").write_text("  \n")
    got = dict(ingest.prompts(spark, str(tmp_path), {"chat": "default", "notes": "default notes", "other": "x"}).collect())
    assert got["chat"].strip() == "own {q}" and got["other"] == "x"


def test_suggestions_context_and_display(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(suggest.fill_prompt("{a}-{b}-{a}", {"a": F.lit("x"), "b": F.lit(None).cast("string")})) == "x--x"
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert suggest.field_variants(docs, "{count} of {field}: {text}", "title", 9, lambda p: json.dumps([p, "b"])).first().variants == ["5 of title: text", "b"]
    edits = spark.createDataFrame([(1, "correspondent", "acme"), (2, "correspondent", "nobody"), (3, "correspondent", " "), (4, "note", " sum "), (5, "note", "")], "doc_id long, field string, value string")
    known = spark.createDataFrame([(7, "Acme Group"), (8, "ACME")], "id long, name string")
    assert {r.doc_id: (r.correspondent_id, r.pending_name) for r in suggest.apply_correspondents(edits, known).collect()} == {1: (8, None), 2: (None, "nobody"), 3: (None, None)}
    stored = spark.createDataFrame([(4, "a", "m1", None), (4, "b", "m2", "2024-02-03T04:05:06Z")], "doc_id long, source string, model_name string, processed_at string")
    notes = spark.createDataFrame([(4, 11, "old\nAI summary"), (4, 9, "mine")], "document_id long, id long, note string")
    assert [(r.note_id, r.action, r.note) for r in suggest.apply_notes(edits, notes, stored).collect()] == [(11, "replace", "sum\n\nModel:m2, Created:2024-02-03 04:05:06\nAI summary")]
    assert value(context.join_limited(F.array(F.lit("abc"), F.lit(" "), F.lit("defgh")), 8)) == "abc\n\ndef" and value(context.join_limited(F.array(F.lit("abc"), F.lit("x")), 4)) == "abc"
    facts = F.array(F.lit("Paid 10,00 EUR on 2024-01-05"), F.lit("Paid 10,00 EUR on 2024-01-05"), F.lit(""))
    s = value(context.section_summary(F.lit("1-2"), facts, F.array(F.lit("ACME")), F.array(F.lit("7 %")), "why"))
    assert s.key_facts == ["Paid 10,00 EUR on 2024-01-05"] and s.key_dates == ["2024-01-05"] and s.key_entities == ["ACME"] and "7 %" in s.key_numbers and s.confidence_notes == ["why"]
    sections = one.select(F.lit(1).alias("doc_id"), F.lit(1).alias("at"), context.section_summary(F.lit("1"), facts, F.array(F.lit("ACME")), F.array(F.lit("7 %")), "why").alias("s"))
    whole = context.document_summary(sections, "no_model").first().summary
    assert whole.summary == s.summary and whole.executive_summary == s.summary and whole.confidence_notes == ["no_model", "why"]
    assert display.next_order("a", False, "a") == ("a", True) and display.next_order("a", True, "b") == ("b", False)
    assert display.page_bounds(0, 3, 10) == (1, 0, 0) and display.page_bounds(25, 9, 10) == (3, 21, 25) and models.valid_status("x") == "all"
    log = spark.createDataFrame([(1, "running", None, 0), (1, None, "cp", 1), (1, "completed", None, 2)], "id long, status string, checkpoint_json string, version int")
    assert [tuple(r) for r in runlog.fold_log(log).collect()] == [(1, "completed", "cp")]
    begun = runlog.starts(spark.createDataFrame([(1, 2, "t", None, 0)], "id long, doc_id long, task string, source string, attempt int"), "now").first()
    assert (begun.status, begun.attempt) == ("running", 1)
    assert value(display.score_text(F.lit(0.5))) == "0.500" and value(display.score_text(F.lit(None).cast("double"))) == "n/a"
