"""Registered queries over flows: keyed queue state, versioned tables, resumed stages and answers with evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import answers, reset, search, vectors
from foliant.operators.cells import VectorCells
from foliant.operators.postings import Postings
from foliant.operators.stages import Summaries, resume_from
from foliant.plans import catalogue as C
from foliant.sources import adapters as A
from foliant.sources.versioned import VersionedTable
from foliant.storage import Scratch
from foliant.streaming import queue

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = True) -> Callable[[Query], Query]:
    """Register a query under its function's name, as in the first catalogue."""

    def add(f: Query) -> Query:
        C.query(sql, prelude)(f)
        QUERIES[f.__name__] = C.QUERIES.pop(f.__name__)
        if f.__name__ in C.ORACLE:
            ORACLE[f.__name__] = C.ORACLE.pop(f.__name__)
        return f

    return add


# ---- the queue ----


def _commands(events: DataFrame) -> DataFrame:
    """Every event as a command on its user's task."""
    kind = F.col("event_type")
    op = F.when(F.col("event_id") % 11 == 0, "cancel").when(kind == "view", "enqueue").when(kind == "click", "front").when(kind == "error", "delay").when(kind == "signup", "start").otherwise("done")
    ts = F.col("ts").cast("timestamp")
    return events.select(F.concat(F.col("user_id").cast("string"), F.lit(":full")).alias("task_key"), F.col("event_id").alias("seq"), F.unix_micros(ts).alias("at"), op.alias("op"), F.ceil(F.col("value") * 600).cast("long").alias("delay_s"), ts.alias("ts"))


@query("""WITH c AS (SELECT CAST(user_id AS VARCHAR) || ':full' AS task_key, epoch_us(ts) AS t, event_id AS seq, greatest(1, CAST(ceil(value * 600) AS BIGINT)) * 1000000 AS wait,
  CASE WHEN event_id % 11 = 0 THEN 'cancel' WHEN event_type = 'view' THEN 'enqueue' WHEN event_type = 'click' THEN 'front' WHEN event_type = 'error' THEN 'delay' WHEN event_type = 'signup' THEN 'start' ELSE 'done' END AS op FROM events),
l AS (SELECT task_key, list({'op': op, 't': t, 'w': wait} ORDER BY t, seq) || [{'op': 'look', 't': (SELECT max(t) FROM c), 'w': 0}] AS cs FROM c GROUP BY task_key),
f AS (SELECT task_key, list_reduce(cs, lambda s, c: CASE
  WHEN s.st = 'delayed' AND s.due <= c.t THEN
    CASE c.op WHEN 'look' THEN {'st': 'queued', 'p': s.due, 'due': 0, 'a': s.a, 'm': s.m, 'd': s.d + 1, 'k': s.k, 'f': s.f, 'x': s.x}
              WHEN 'front' THEN {'st': 'queued', 'p': -c.t, 'due': 0, 'a': s.a, 'm': s.m + 1, 'd': s.d + 1, 'k': s.k, 'f': s.f, 'x': s.x}
              WHEN 'start' THEN {'st': 'running', 'p': 0, 'due': 0, 'a': s.a, 'm': s.m, 'd': s.d + 1, 'k': s.k, 'f': s.f, 'x': s.x}
              WHEN 'cancel' THEN {'st': 'absent', 'p': 0, 'due': 0, 'a': s.a, 'm': s.m, 'd': s.d + 1, 'k': s.k, 'f': s.f, 'x': s.x + 1}
              ELSE {'st': 'queued', 'p': s.due, 'due': 0, 'a': s.a, 'm': s.m, 'd': s.d + 1, 'k': s.k + 1, 'f': s.f, 'x': s.x} END
  WHEN c.op = 'look' THEN s
  WHEN s.st = 'absent' AND c.op IN ('enqueue', 'front') THEN {'st': 'queued', 'p': CASE WHEN c.op = 'front' THEN -c.t ELSE c.t END, 'due': 0, 'a': s.a + 1, 'm': s.m, 'd': s.d, 'k': s.k, 'f': s.f, 'x': s.x}
  WHEN s.st = 'absent' AND c.op = 'delay' THEN {'st': 'delayed', 'p': 0, 'due': c.t + c.w, 'a': s.a + 1, 'm': s.m, 'd': s.d, 'k': s.k, 'f': s.f, 'x': s.x}
  WHEN s.st = 'queued' AND c.op = 'front' THEN {'st': 'queued', 'p': -c.t, 'due': 0, 'a': s.a, 'm': s.m + 1, 'd': s.d, 'k': s.k, 'f': s.f, 'x': s.x}
  WHEN s.st = 'queued' AND c.op = 'start' THEN {'st': 'running', 'p': 0, 'due': 0, 'a': s.a, 'm': s.m, 'd': s.d, 'k': s.k, 'f': s.f, 'x': s.x}
  WHEN s.st = 'running' AND c.op = 'done' THEN {'st': 'absent', 'p': 0, 'due': 0, 'a': s.a, 'm': s.m, 'd': s.d, 'k': s.k, 'f': s.f + 1, 'x': s.x}
  WHEN s.st IN ('queued', 'delayed') AND c.op = 'cancel' THEN {'st': 'absent', 'p': 0, 'due': 0, 'a': s.a, 'm': s.m, 'd': s.d, 'k': s.k, 'f': s.f, 'x': s.x + 1}
  ELSE {'st': s.st, 'p': s.p, 'due': s.due, 'a': s.a, 'm': s.m, 'd': s.d, 'k': s.k + 1, 'f': s.f, 'x': s.x} END,
  {'st': 'absent', 'p': 0::BIGINT, 'due': 0::BIGINT, 'a': 0::BIGINT, 'm': 0::BIGINT, 'd': 0::BIGINT, 'k': 0::BIGINT, 'f': 0::BIGINT, 'x': 0::BIGINT}) AS s FROM l)
SELECT task_key, s.st AS status, s.p AS "position", s.a AS added, s.m AS moved, s.d AS due, s.k AS skipped, s.f AS finished, s.x AS cancelled FROM f""", prelude=False)
def queue_stream(s, d):
    scratch = Scratch(s, "queue")
    path = f"{d}/events.parquet"
    stream = s.readStream.schema(s.read.parquet(path).schema).parquet(path + "*")  # a pattern may name one file
    out = f"{scratch.path}/changes"
    started = queue.run(s, queue.task_changes(_commands(stream)), out, f"{scratch.path}/mark")
    started.awaitTermination()
    last = A.table(s, d, "events").agg(F.unix_micros(F.max(F.col("ts").cast("timestamp")))).first()[0]
    return queue.queue_state(s.read.schema(queue.CHANGES).parquet(out), F.lit(last or 0))


# ---- versioned tables ----


@query("""WITH n AS (SELECT user_id, max_by(struct_pack(t := event_type, v := value, e := event_id), ts) AS x FROM events GROUP BY user_id)
SELECT user_id, x.t AS event_type, x.v AS value, x.e AS event_id FROM n WHERE x.t != 'error'""", prelude=False)
def versioned_newest(s, d):
    """Each user's newest event after four upserts of a week each; an error takes the user away."""
    rows = A.table(s, d, "events").select("user_id", "event_type", "value", "event_id", "ts")
    table = VersionedTable(s, f"{Scratch(s, 'newest').path}/t", ["user_id"], buckets=16, max_layers=2)
    week = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    for k in range(4):
        table.upsert(rows.where(week == k), order=F.col("ts"), gone=F.col("event_type") == "error", batch=k)
    return table.read().drop("ts")


# ---- stages that go on where they stopped ----


@query("""WITH c AS (SELECT id, doc_id, CASE WHEN id % 8 = 0 THEN '{"stage":"run","resume_from":' || checkpoint_json || '}' ELSE checkpoint_json END AS raw, CAST(CASE WHEN id % 3 = 0 THEN 40 ELSE 100 END AS BIGINT) AS total FROM runs),
p AS (SELECT id, total, CASE WHEN raw LIKE '{%' THEN coalesce(json_extract(raw, '$.resume_from'), CAST(raw AS JSON)) END AS j FROM c)
SELECT id, coalesce(CASE WHEN json_extract_string(j, '$.stage') = 'chunk' AND CAST(json_extract(j, '$.total') AS BIGINT) = total THEN greatest(0, least(CAST(json_extract(j, '$.current') AS BIGINT), total)) END, 0) AS resume_from FROM p""")
def stage_resume(s, d):
    """Where each run's stage goes on, with some checkpoints handed over by an earlier run."""
    c = A.task_runs(s, d)
    raw = F.when(F.col("id") % 8 == 0, F.concat(F.lit('{"stage":"run","resume_from":'), "checkpoint_json", F.lit("}"))).otherwise(F.col("checkpoint_json"))
    return c.select("id", resume_from(raw, "chunk", source="vision_ocr", total=F.when(F.col("id") % 3 == 0, 40).otherwise(100)).alias("resume_from"))


#: The sections of notes packed under 3 pages and 30 tokens, from pages to documents.
LEVELS = r"""WITH RECURSIVE pg AS (SELECT conv_id AS doc_id, turn AS page, CASE WHEN conv_id % 2 = 0 THEN 'vision_ocr' ELSE 'text_layer' END AS source, trim(left(trim(text, W), 40), W) AS t
  FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) >= 3)),
ln AS (SELECT *, greatest(1, CAST(floor(length(t) / 3.5) AS INTEGER)) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM pg WHERE t != ''),
f AS (SELECT doc_id, source, i, page AS lo, page, t, k AS tokens, 1 AS n, 1 AS sec FROM ln WHERE i = 1
  UNION ALL SELECT f.doc_id, ln.source, ln.i, CASE WHEN f.n < 3 AND f.tokens + ln.k <= 30 THEN f.lo ELSE ln.page END, ln.page, ln.t, CASE WHEN f.n < 3 AND f.tokens + ln.k <= 30 THEN f.tokens + ln.k ELSE ln.k END,
  CASE WHEN f.n < 3 AND f.tokens + ln.k <= 30 THEN f.n + 1 ELSE 1 END, CASE WHEN f.n < 3 AND f.tokens + ln.k <= 30 THEN f.sec ELSE f.sec + 1 END FROM f JOIN ln ON ln.doc_id = f.doc_id AND ln.i = f.i + 1),
se AS (SELECT doc_id, source, sec, min(lo) || '-' || max(page) AS section_key, trim(left(string_agg('Page ' || page || ': ' || t, chr(10) || chr(10) ORDER BY page), 70), W) AS t FROM f GROUP BY doc_id, source, sec)
SELECT doc_id, source, left(string_agg('Section ' || section_key || ': ' || t, chr(10) || chr(10) ORDER BY sec), 200) AS summary, CAST(NULL AS VARCHAR) AS confidence_note FROM se GROUP BY doc_id, source""".replace("W)", "' ' || chr(9) || chr(10) || chr(13))")


@query(LEVELS, prelude=False)
def summary_levels(s, d):
    """Notes, sections and summaries by a model that keeps the start of a text; the first run is stopped after a slice."""
    turns = A.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text")
    pages = turns.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "vision_ocr").otherwise("text_layer"))
    docs = turns.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"), F.lit("").alias("text"))
    run = Summaries(s, f"{Scratch(s, 'levels').path}/t", source="vision_ocr", large_pages=3, section_pages=3, section_tokens=30, buckets=4)
    looks = iter([False])
    models = (lambda t: t[:40], lambda t: t[:70].strip(), lambda t: t[:200])
    run.run(docs, pages, *models, stop=lambda: next(looks, True))
    run.run(docs, pages, *models)
    return run.summaries(docs, pages)


# ---- answers ----


@query(r"""WITH w AS (SELECT conv_id, turn, role, text, array_to_string(list_filter(regexp_split_to_array(text, '[\x09-\x0D\x20]+'), lambda x: x != '')[3:8], ' ') AS snippet FROM conversations),
q AS (SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY conv_id),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS id FROM w JOIN q USING (conv_id)), s AS (SELECT * FROM r WHERE id <= 5),
b AS (SELECT *, length(trim(snippet)) >= 20 AS looked, count(*) FILTER (WHERE length(trim(snippet)) >= 20) OVER (PARTITION BY conv_id ORDER BY id) AS pages FROM s),
e AS (SELECT *, looked AND pages <= 3 AS near, CASE WHEN conv_id <= 0 OR turn <= 0 THEN 'invalid_doc_or_page' WHEN turn % 4 = 2 THEN 'invalid_bbox' END AS error FROM b)
SELECT conv_id AS question_id, 'see [2]: ' || left(trim(question, ' ' || chr(9) || chr(10) || chr(13)), 50) AS answer, CAST(id AS INTEGER) AS id, CAST(turn AS INTEGER) AS page, CASE WHEN near THEN CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END END AS status,
  CASE WHEN near THEN CASE WHEN error IS NULL THEN 1.0 ELSE 0.0 END END::DOUBLE AS confidence, CASE WHEN near THEN error END AS error, id = 2 AS cited FROM e""", prelude=False)
def answers_with_evidence(s, d):
    """Every conversation's first question, answered from its turns; each source is found on its page or given with a box."""
    turns = A.table(s, d, "conversations")
    questions = turns.where("role = 'user'").groupBy(F.col("conv_id").alias("question_id")).agg(F.min_by("text", "turn").alias("question"), F.lit(None).cast("string").alias("history"), F.lit("").alias("conversation_id"))
    turn = F.col("turn").cast("int")
    words = F.filter(F.split("text", r"[\x09-\x0D\x20]+"), lambda x: x != "")
    at = lambda i, more: (i + more).cast("double")
    anchors = turns.select(F.col("conv_id").alias("doc_id"), turn.alias("page"), F.transform(words, lambda w, i: F.struct(w.alias("text"), F.array(at(i, 0.0), F.lit(0.0), at(i, 0.9), F.lit(1.0)).alias("bbox"))).alias("words"))
    box = F.when(turn % 4 == 1, F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))).when(turn % 4 == 2, F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0))))
    hits = turns.select(
        F.col("conv_id").alias("question_id"), turn.alias("hit_rank"), F.col("conv_id").alias("doc_id"), turn.alias("page"), F.when(turn % 2 == 0, "text_layer").otherwise("vision_ocr").alias("source"),
        F.when(turn % 5 != 0, 60).alias("quality"), (1 / (1 + turn)).alias("score"), F.array_join(F.slice(words, 3, 6), " ").alias("text"), F.lit(None).cast("string").alias("doc_date"), box.alias("bbox"),
    )
    found = answers.answered(questions, hits, anchors, lambda p: "see [2]: " + p[:50], template="{question}", top_k=5, min_quality=50)
    c = found.select("question_id", "answer", F.explode("citations").alias("c"))
    return c.select("question_id", "answer", "c.id", "c.page", F.col("c.evidence_status").alias("status"), F.col("c.evidence_confidence").alias("confidence"), F.col("c.evidence_error").alias("error"), "c.cited")


# ---- the index of words ----


@query(C.ORACLE["hybrid_search"], prelude=False)
def indexed_search(s, d):
    """hybrid_search over an index: only the buckets of the query's words are read."""
    index = Postings(s, f"{Scratch(s, 'postings').path}/i")
    index.build(search.pages_of(A.table(s, d, "documents")))
    return search.hybrid_search(index.top(C.QUERY, 60), C.QUERY, quality=C._quality(s, d), top_k=10, min_quality=50)


# ---- the index of vectors ----


def _cells(s: SparkSession, d: str) -> VectorCells:
    index = VectorCells(s, f"{Scratch(s, 'cells').path}/i")
    index.build(A.table(s, d, "embeddings"))
    return index


@query(C.ORACLE["similar_docs"], prelude=False)
def indexed_similar(s, d):
    """similar_docs over cells: a query's nearest cells first, then those that its tenth score leaves room for."""
    return _cells(s, d).nearest(A.table(s, d, "embeddings").where("vec_id % 20 = 0"), 10)


@query(C.ORACLE["duplicate_candidates"], prelude=False)
def indexed_duplicates(s, d):
    """duplicate_candidates over cells: cells out of reach of a score of 0.3 are not read."""
    return _cells(s, d).nearest(A.table(s, d, "embeddings").where("vec_id % 20 = 0"), 5, least=0.3).drop("rank")


# ---- vectors, layer by layer ----


def _audit(s: SparkSession, d: str) -> DataFrame:
    """Lines are the chunks of their orders; dear discounts have lost their vector."""
    lines = A.table(s, d, "lineitem")
    vector = F.when(F.col("l_discount") <= 0.08, F.array(F.col("l_quantity").cast("double"))).otherwise(F.array().cast("array<double>"))
    stored = lines.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "R", A.VISION).otherwise(A.BASELINE).alias("source"), (F.col("l_linenumber") - 1).alias("chunk"), vector.alias("embedding"))
    return vectors.audited(A.embeddings_done(s, d), stored, C._active(s, d).select(F.col("id").alias("doc_id"), "title"))


AUDIT = """WITH st AS (SELECT DISTINCT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'R' THEN 'vision_ocr' ELSE 'text_layer' END AS source, l_linenumber - 1 AS chunk FROM lineitem WHERE l_discount <= 0.08),
au AS (SELECT e.doc_id, a.title, e.embedding_source, e.chunk_count, CAST(e.chunk_count * CASE WHEN e.embedding_source = 'both' THEN 2 ELSE 1 END AS BIGINT) AS expected_vectors,
  (SELECT count(*) FROM st WHERE st.doc_id = e.doc_id AND st.chunk < e.chunk_count AND (e.embedding_source = 'both' OR st.source = 'text_layer')) AS found_vectors, e.embedded_at FROM emb e JOIN active a ON a.id = e.doc_id)"""


@query(f"{AUDIT} SELECT *, found_vectors = 0 AS fully_missing FROM au WHERE found_vectors < expected_vectors")
def vector_audit(s, d):
    return _audit(s, d).where("found_vectors < expected_vectors")


@query(f"""{AUDIT}, b AS (SELECT * FROM au WHERE found_vectors < expected_vectors)
SELECT (SELECT count(*) FROM au) AS scanned_docs, (SELECT count(*) FROM b) AS affected_docs, (SELECT count(*) FROM b WHERE found_vectors = 0) AS fully_missing_docs, (SELECT count(*) FROM b WHERE found_vectors > 0) AS partial_missing_docs,
  (SELECT count(*) FROM b) > 25 AS truncated, (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM b ORDER BY doc_id LIMIT 25)) AS items""")
def vector_audit_report(s, d):
    report = vectors.audit_report(_audit(s, d), limit=25)
    return report.select("scanned_docs", "affected_docs", "fully_missing_docs", "partial_missing_docs", "truncated", F.array_join(F.transform("items", lambda i: i["doc_id"].cast("string")), ",").alias("items"))


# ---- starting over ----


@query("""WITH g AS (SELECT id FROM docs WHERE starts_with(coalesce(deleted_at, ''), 'DELETED')),
x AS (SELECT 'page_texts' AS name, doc_id FROM pages_t UNION ALL SELECT 'suggestions', doc_id FROM sugg UNION ALL SELECT 'embeddings', doc_id FROM emb UNION ALL SELECT 'task_runs', doc_id FROM runs UNION ALL SELECT 'points', vec_id // 4 FROM embeddings)
SELECT name, count_if(doc_id IN (SELECT id FROM g)) AS removed, count_if(doc_id NOT IN (SELECT id FROM g)) AS kept FROM x GROUP BY name""")
def reset_counts(s, d):
    """What goes with the documents that the archive has deleted."""
    gone = A.documents(s, d).where("deleted_at IS NOT NULL").select(F.col("id").alias("doc_id"))
    points = A.table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("doc_id"))
    frames = {"page_texts": A.page_texts(s, d), "suggestions": A.suggestions(s, d), "embeddings": A.embeddings_done(s, d), "task_runs": A.task_runs(s, d), "points": points}
    return reset.cleared(frames, gone)[1]


@query("""WITH w AS (SELECT id FROM docs WHERE page_count IS NULL)
SELECT d.id AS doc_id, CASE WHEN a.id IS NULL THEN d.title ELSE upper(a.title) END AS title, a.id IS NOT NULL AS synced, CASE WHEN a.id IS NULL THEN 0 ELSE 8 END AS enqueued, CASE WHEN a.id IS NOT NULL THEN 'evidence_index,vision_ocr,embeddings_vision,similarity_index,page_notes_vision,summary_hierarchical,suggestions_baseline,suggestions_vision' END AS tasks
FROM w JOIN docs d USING (id) LEFT JOIN active a USING (id)""")
def reset_documents(s, d):
    """Documents of unknown length start over; those that the archive has deleted keep their row and get no tasks."""
    local = A.documents(s, d).select("id", "title")
    wanted = A.documents(s, d).where("page_count IS NULL").select(F.col("id").alias("doc_id"))
    merged, tasks, report = reset.restarted(wanted, local, C._active(s, d).select("id", F.upper("title").alias("title")), vision=True)
    order = F.array_sort(F.collect_list(F.struct("position", "task")))
    told = tasks.groupBy("doc_id").agg(F.array_join(F.transform(order, lambda t: t["task"]), ",").alias("tasks"))
    return report.join(merged.withColumnRenamed("id", "doc_id"), "doc_id").join(told, "doc_id", "left")
