import json
import random

from pyspark.sql import functions as F

from foliant.operators import answers

HIT = "question_id int, hit_rank int, doc_id long, page int, source string, quality int, score double, text string, doc_date string, bbox array<double>"


def slow_sources(hits, top_k, source, least, chronological):
    """Sources of one question, rule by rule."""
    hits = sorted(hits, key=lambda h: h["hit_rank"])[: max(3, 3 * top_k)]
    hits = [h | {"quality": 100 if h["quality"] is None else h["quality"]} for h in hits]
    hits = [h for h in hits if (source is None or h["source"] == source) and (least is None or h["quality"] >= least)]
    places = {}
    for h in hits:
        places.setdefault((h["doc_id"], h["page"], h["source"]), []).append(h)
    best = [max(p, key=lambda h: (round(h["score"] * (h["quality"] or 100) / 100, 6), -h["hit_rank"])) for p in list(places.values())[:top_k]]
    first = {id(b): p[0]["hit_rank"] for b, p in zip(best, places.values(), strict=False)}
    if chronological:
        best.sort(key=lambda h: (h["doc_date"] is None, h["doc_date"] or "", h["doc_id"], h["page"], first[id(h)]))
    return [(i, h["doc_id"], h["page"], h["source"], h["quality"], h["score"], h["text"][:500]) for i, h in enumerate(best, 1)]


def test_sources_of_many_questions_against_the_rules(spark):
    rng = random.Random(3)
    rows = [
        {"question_id": q, "hit_rank": r, "doc_id": rng.randrange(1, 4), "page": rng.randrange(1, 3), "source": rng.choice("ab"), "quality": rng.choice([None, 0, 30, 80]), "score": rng.choice([0.25, 0.5, 0.75]), "text": f"text {q} {r}", "doc_date": rng.choice([None, "2024-01-01", "2023-01-01"]), "bbox": None}
        for q in range(12)
        for r in range(1, rng.randrange(2, 25))
    ]
    hits = spark.createDataFrame([tuple(r.values()) for r in rows], HIT)
    for k, source, least, chronological in ((3, None, None, False), (5, "a", 30, True), (1, None, 0, True)):
        found = answers.sources_of(hits, top_k=k, source=source, min_quality=least, chronological=chronological)
        got = {}
        for r in found.orderBy("question_id", "id").collect():
            got.setdefault(r.question_id, []).append((r.id, r.doc_id, r.page, r.source, r.quality, r.score, r.snippet))
        want = {q: slow_sources([r for r in rows if r["question_id"] == q], k, source, least, chronological) for q in range(12)}
        assert got == {q: v for q, v in want.items() if v}


def words(text):
    return [(w, [float(i), 0.0, i + 0.5, 1.0]) for i, w in enumerate(text.split())]


def test_an_answer_with_all_kinds_of_evidence(spark):
    page = "zero one two three four five six seven eight nine"
    good, wrong = [0.0, 0.0, 2.0, 2.0], [2.0, 0.0, 1.0, 2.0]
    rows = [
        (1, 1, 10, 1, "t", 90, 0.9, "Two three, four FIVE six", None, None),  # found on its page
        (1, 2, 10, 1, "v", 90, 0.8, "no such words stand here", None, None),
        (1, 3, 10, 1, "w", 90, 0.7, "Two three, four FIVE six", None, good),  # same key as the first: the last one counts
        (1, 4, 11, 1, "t", 90, 0.6, "two three four five six", None, wrong),
        (1, 5, 12, 1, "t", 90, 0.5, "short", None, None),  # too short: does not take a page of the budget
        (1, 6, 0, 1, "t", 90, 0.4, "two three four five six", None, None),
        (1, 7, 13, 1, "t", 90, 0.3, "two three four five six", None, good),  # the fourth page
        (2, 1, 99, 1, "t", None, 0.3, "two three four five six", None, None),  # a page without words
        (2, 2, 10, 1, "t", None, 0.2, "one two three {history}", None, None),
        (9, 1, 10, 1, "t", 90, 0.9, "asked by nobody at all", None, None),
    ]
    hits = spark.createDataFrame(rows, HIT)
    anchors = spark.createDataFrame([(10, 1, words(page)), (11, 1, words(page)), (13, 1, words(page))], "doc_id long, page int, words array<struct<text:string, bbox:array<double>>>")
    questions = spark.createDataFrame([(1, " why? ", None, " c1 "), (2, "how", "User: a", None), (3, None, "", "")], "question_id int, question string, history string, conversation_id string")
    model = lambda p: f"see [2] and [7] and [99999999999] <{p.replace('[', '(')}>"
    found = answers.answered(questions, hits, anchors, model, template="{question}|{sources}|{history}", top_k=9)
    got = {r.question_id: r for r in found.collect()}
    assert set(got) == {1, 2, 3} and got[1].conversation_id == "c1" and len(got[2].conversation_id) == 32 and got[2].conversation_id != got[3].conversation_id
    assert got[1].answer.startswith("see [2] and [7] and [99999999999] <why?|(1] doc_id=10 page=1 source=t text=Two three, four FIVE six\n(2] ") and got[1].answer.endswith("|None>")
    assert got[3].answer == "see [2] and [7] and [99999999999] <|No sources available.|None>" and got[3].citations == []
    state = [(c.id, c.evidence_status, c.evidence_confidence, c.evidence_error, c.bbox, c.cited) for c in got[1].citations]
    assert state == [
        (1, "ok", 1.0, None, good, False), (2, "no_match", 0.0, None, None, True), (3, "ok", 1.0, None, good, False), (4, "error", 0.0, "invalid_bbox", wrong, False),
        (5, None, None, None, None, False), (6, "error", 0.0, "invalid_doc_or_page", None, False), (7, None, None, None, good, True),
    ]
    two = got[2].citations
    assert [(c.id, c.evidence_status) for c in two] == [(1, "no_match"), (2, "ok")] and two[1].bbox == [1.0, 0.0, 4.5, 1.0] and 0.72 <= two[1].evidence_confidence < 1
    assert answers.answered(questions.limit(0), hits, anchors, model, template="x").count() == 0
    assert [r.citations for r in answers.answered(questions, hits.limit(0), anchors, model, template="x").collect()] == [[], [], []]


def test_follow_ups_see_the_answer_and_short_citations(spark):
    row = spark.createDataFrame([(1, " q ", " a ", [(7, 1, "s" * 300)])], "question_id int, question string, answer string, citations array<struct<doc_id:long, page:int, snippet:string>>")
    seen = answers.with_follow_ups(row, lambda p: json.dumps({"questions": [p, " ", "b", "c", "d", "e", "f"]}), "{question}/{answer}/{citations}").first()
    first = json.loads(seen.follow_ups[0].split("/", 2)[2])
    assert seen.follow_ups[0].startswith("q/a/") and first == [{"doc_id": 7, "page": 1, "snippet": "s" * 240}] and seen.follow_ups[1:] == ["b", "c", "d", "e"]
    assert answers.with_follow_ups(row, lambda p: "nothing", "x").select(F.size("follow_ups")).first()[0] == 0
