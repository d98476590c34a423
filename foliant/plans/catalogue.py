"""Registered queries over the driver tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import corpus, merge, planner, review, runs, search, textops, vectors
from foliant.sources import adapters as A
from foliant.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = True) -> Callable[[Query], Query]:
    """Register a query under its function's name; SQL may use the adapter views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip().replace("count_if(", "count(*) FILTER (WHERE ")
            ORACLE[f.__name__] = (f"WITH {A.SQL.strip()}" + (f", {body[5:]}" if body.startswith("WITH ") else f" {body}")) if prelude else body
        return f

    return add


def _active(s: SparkSession, d: str) -> DataFrame:
    return A.documents(s, d).where(corpus.is_active(A.DELETED_PREFIX))


def _flags(s: SparkSession, d: str) -> DataFrame:
    return corpus.processing_flags(_active(s, d), A.embeddings_done(s, d), A.page_texts(s, d), A.suggestions(s, d), A.VISION)


def _points(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "embeddings")


# ---- corpus ----


@query("""SELECT count(*) AS total, count_if(has_embedding) AS embeddings, count_if(has_vision) AS vision, count_if(has_suggestion) AS suggestions, count_if(fully) AS fully,
  count_if(has_embedding) AS processed, greatest(0, count(*) - count_if(fully)) AS unprocessed FROM full_flags""")
def corpus_stats(s, d):
    return corpus.corpus_stats(_flags(s, d))


@query("""SELECT count(*) AS total, count_if(fully) AS processed, count_if(NOT fully) AS unprocessed, count_if(correspondent_id IS NULL) AS unassigned,
  count_if(NOT fully AND correspondent_id IS NULL) AS unassigned_unprocessed FROM full_flags""")
def dashboard_totals(s, d):
    return corpus.dashboard_totals(_flags(s, d))


@query("""WITH labels_t AS (SELECT unnest(['Unknown','1','2-3','4-6','7-10','11-20','21-50','51-99','100+']) AS label),
b AS (SELECT CASE WHEN page_count IS NULL OR page_count < 1 THEN 'Unknown' WHEN page_count = 1 THEN '1' WHEN page_count <= 3 THEN '2-3' WHEN page_count <= 6 THEN '4-6' WHEN page_count <= 10 THEN '7-10'
  WHEN page_count <= 20 THEN '11-20' WHEN page_count <= 50 THEN '21-50' WHEN page_count <= 99 THEN '51-99' ELSE '100+' END AS label FROM active)
SELECT label, count(b.label) AS n FROM labels_t LEFT JOIN b USING (label) GROUP BY label""")
def page_count_histogram(s, d):
    return corpus.page_count_histogram(_active(s, d))


TOP = """WITH g AS ({groups}), rest AS (SELECT '{rest}' AS name, count(*) AS n, count_if(NOT fully) AS unprocessed, true AS is_rest FROM full_flags {missing} HAVING count(*) > 0),
u AS (SELECT name, sum(n) AS n, sum(unprocessed) AS unprocessed, false AS is_rest FROM g GROUP BY name UNION ALL SELECT * FROM rest)
SELECT name, CAST(n AS BIGINT) AS n, CAST(unprocessed AS BIGINT) AS unprocessed FROM u {where} ORDER BY n DESC, is_rest, name {limit}"""


@query(TOP.format(groups="SELECT corr.name, count(*) AS n, count_if(NOT fully) AS unprocessed FROM full_flags f JOIN corr ON f.correspondent_id = corr.id GROUP BY corr.id, corr.name", rest="Unassigned correspondent", missing="WHERE correspondent_id IS NULL", where="", limit="LIMIT 10"))
def correspondents_top(s, d):
    return corpus.top_groups(_flags(s, d).withColumnRenamed("id", "doc_id"), "correspondent_id", A.correspondents(s, d), "Unassigned correspondent")


@query(TOP.format(groups="SELECT tags.name, count(*) AS n, count_if(NOT fully) AS unprocessed FROM full_flags f JOIN doc_tags t ON t.document_id = f.id JOIN tags ON t.tag_id = tags.id GROUP BY tags.id, tags.name", rest="No tags", missing="WHERE NOT EXISTS (SELECT 1 FROM doc_tags t WHERE t.document_id = full_flags.id)", where="", limit="LIMIT 10"))
def tags_top(s, d):
    flags = _flags(s, d).select(F.col("id").alias("doc_id"), "fully")
    facts = flags.join(A.document_tags(s, d).withColumnRenamed("document_id", "doc_id"), "doc_id")
    return corpus.top_groups(facts, "tag_id", A.tags(s, d), "No tags", total=flags)


@query(TOP.format(groups="SELECT document_type AS name, count(*) AS n, count_if(NOT fully) AS unprocessed FROM full_flags WHERE document_type IS NOT NULL GROUP BY document_type", rest="No document type", missing="WHERE document_type IS NULL", where="", limit=""))
def document_types(s, d):
    flags = _flags(s, d).withColumnRenamed("id", "doc_id")
    names = flags.select("document_type").where("document_type IS NOT NULL").distinct().select(F.col("document_type").alias("id"), F.col("document_type").alias("name"))
    return corpus.top_groups(flags, "document_type", names, "No document type", limit=None)


@query(TOP.format(groups="SELECT corr.name, count(*) AS n, count_if(NOT fully) AS unprocessed FROM full_flags f JOIN corr ON f.correspondent_id = corr.id GROUP BY corr.id, corr.name", rest="Unassigned correspondent", missing="WHERE correspondent_id IS NULL", where="WHERE unprocessed > 0", limit=""))
def unprocessed_by_correspondent(s, d):
    return corpus.top_groups(_flags(s, d).withColumnRenamed("id", "doc_id"), "correspondent_id", A.correspondents(s, d), "Unassigned correspondent", limit=None).where("unprocessed > 0")


MONTHS = """m AS (SELECT coalesce(nullif(substr(document_date, 1, 7), ''), nullif(substr(created, 1, 7), ''), 'Unknown') AS month, count(*) AS total, count_if(fully) AS processed, count_if(NOT fully) AS unprocessed
  FROM full_flags GROUP BY 1)"""


@query(f"WITH {MONTHS} SELECT * FROM m")
def monthly_processing(s, d):
    return corpus.monthly_processing(_flags(s, d))


@query(f"WITH {MONTHS} SELECT * FROM m WHERE month != 'Unknown' ORDER BY month DESC LIMIT 12")
def monthly_tail(s, d):
    return corpus.monthly_tail(corpus.monthly_processing(_flags(s, d)), 12)


@query("""WITH g AS (SELECT tags.name, count(*) AS n FROM doc_tags JOIN tags ON tag_id = tags.id GROUP BY tags.name), a AS (SELECT sum(n) AS total FROM g),
t AS (SELECT row_number() OVER (ORDER BY n DESC, name) AS rank, name, n FROM g), top AS (SELECT * FROM t WHERE rank <= 10),
u AS (SELECT * FROM top UNION ALL SELECT 11, 'Other', total - (SELECT sum(n) FROM top) FROM a WHERE total > (SELECT sum(n) FROM top))
SELECT CAST(rank AS INTEGER) AS rank, name, CAST(n AS BIGINT) AS n, round(100.0 * n / total, 4) AS percent, round(100.0 * sum(n) OVER (ORDER BY rank) / total, 4) AS running_percent FROM u, a""")
def tag_donut_shares(s, d):
    named = A.document_tags(s, d).join(A.tags(s, d), F.col("tag_id") == F.col("id")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return corpus.shares_with_other(named)


@query("SELECT id, correspondent_id, has_embedding, has_vision, has_suggestion, fully FROM full_flags")
def doc_flags(s, d):
    return _flags(s, d).select("id", "correspondent_id", "has_embedding", "has_vision", "has_suggestion", "fully")


@query("""WITH p AS (SELECT doc_id AS id, count(DISTINCT CASE WHEN source = 'vision_ocr' THEN page END) AS vision_pages, count(DISTINCT CASE WHEN source != 'vision_ocr' THEN page END) AS baseline_pages,
  max(CASE WHEN source = 'vision_ocr' THEN created_at END) AS vision_at FROM pages_t GROUP BY doc_id),
g AS (SELECT doc_id AS id, max(processed_at) AS suggested_at, string_agg(DISTINCT source, ',' ORDER BY source) AS suggestion_sources FROM sugg GROUP BY doc_id)
SELECT a.id, a.page_count, coalesce(vision_pages, 0) AS vision_pages, coalesce(baseline_pages, 0) AS baseline_pages, vision_at, suggested_at, suggestion_sources, embedded_at, embedding_source, chunk_count,
  CASE WHEN coalesce(page_count, 0) > 0 THEN coalesce(vision_pages, 0) >= page_count ELSE coalesce(vision_pages, 0) > 0 END AS vision_complete,
  CASE WHEN coalesce(page_count, 0) > 0 THEN round_even(100.0 * least(coalesce(vision_pages, 0), page_count) / page_count, 2) END AS coverage
FROM active a LEFT JOIN p USING (id) LEFT JOIN g USING (id) LEFT JOIN emb e ON e.doc_id = a.id""")
def detail_status(s, d):
    return corpus.detail_status(_active(s, d), A.page_texts(s, d), A.suggestions(s, d), A.embeddings_done(s, d), A.VISION)


@query("SELECT doc_id, source FROM documents WHERE lang = 'en' AND contains(lower(concat_ws(' ', CAST(doc_id AS VARCHAR), source, text)), 'license')", prelude=False)
def visible_documents(s, d):
    return corpus.visible_documents(A.table(s, d, "documents"), query="License", only_lang="en").select("doc_id", "source")


@query("SELECT id, title, page_count, (SELECT count(*) FROM active WHERE correspondent_id IS NULL) AS total_rows FROM active WHERE correspondent_id IS NULL ORDER BY page_count NULLS LAST, id LIMIT 50 OFFSET 20")
def list_missing_correspondent(s, d):
    rows = corpus.with_correspondent(_active(s, d), -1).select("id", "title", "page_count")
    return corpus.page_of(rows, [F.asc_nulls_last("page_count"), F.col("id")], limit=50, offset=20)


@query("SELECT id, title, (SELECT count(*) FROM full_flags WHERE NOT fully) AS total_rows FROM full_flags WHERE NOT fully ORDER BY created DESC NULLS LAST, id DESC LIMIT 100")
def list_filtered_page(s, d):
    rows = _flags(s, d).where("NOT fully").select("id", "title", "created")
    return corpus.page_of(rows, [F.desc_nulls_last("created"), F.desc("id")], limit=100, offset=0).drop("created")


@query("SELECT DISTINCT name FROM corr WHERE name != ''")
def metadata_names(s, d):
    return A.correspondents(s, d).select("name").where("name != ''").distinct().orderBy(F.lower("name"))


@query("SELECT count(*) AS n, round(sum(total), 2) AS value FROM active WHERE id NOT IN (SELECT doc_id FROM emb)")
def not_embedded(s, d):
    left = _active(s, d).join(A.embeddings_done(s, d).select(F.col("doc_id").alias("id")), "id", "left_anti")
    return left.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total"), 2).alias("value"))


@query("SELECT a.id, string_agg(DISTINCT tags.name, '|' ORDER BY tags.name) AS tag_names FROM active a JOIN doc_tags t ON t.document_id = a.id JOIN tags ON tags.id = t.tag_id GROUP BY a.id")
def document_tag_names(s, d):
    named = A.document_tags(s, d).join(A.tags(s, d), F.col("tag_id") == F.col("id")).groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("tag_names"))
    return _active(s, d).select("id").join(named, "id")


# ---- runs and queue ----


@query("SELECT doc_id, task, coalesce(trim(source), '') AS source, max(id) AS id, arg_max(status, id) AS status, arg_max(created_at, id) AS created_at FROM runs GROUP BY 1, 2, 3")
def latest_run_per_task(s, d):
    return runs.latest_runs(A.task_runs(s, d))


@query("""WITH plan AS (SELECT DISTINCT doc_id, task, coalesce(trim(source), '') AS source FROM runs UNION SELECT DISTINCT doc_id, 'similarity', '' FROM runs),
last AS (SELECT doc_id, task, coalesce(trim(source), '') AS source, max(id) AS run_id, arg_max(status, id) AS status FROM runs GROUP BY 1, 2, 3)
SELECT p.doc_id, p.task, p.source, run_id, CASE WHEN status IN ('running', 'retrying') THEN status WHEN status = 'failed' THEN 'failed' WHEN p.doc_id % 2 = 0 AND p.task IN ('similarity', 'view') THEN 'missing' ELSE 'done' END AS state
FROM plan p LEFT JOIN last USING (doc_id, task, source)""")
def fanout_status(s, d):
    log = A.task_runs(s, d)
    plan = log.select("doc_id", "task", runs.source_key().alias("source")).union(log.select("doc_id", F.lit("similarity"), F.lit(""))).distinct()
    return runs.fanout(plan, log, plan.where("doc_id % 2 = 0 AND task IN ('similarity', 'view')"))


@query("SELECT id, task, status, created_at FROM runs ORDER BY created_at DESC, id DESC LIMIT 6")
def recent_runs(s, d):
    return runs.recent(A.task_runs(s, d)).select("id", "task", "status", "created_at")


@query("SELECT id, doc_id, error_message FROM runs WHERE status = 'failed'")
def failed_runs(s, d):
    return A.task_runs(s, d).where("status = 'failed'").select("id", "doc_id", "error_message")


@query("SELECT id, task, status FROM runs WHERE task ILIKE '%time%' OR source ILIKE '%time%' OR status ILIKE '%time%' OR error_message ILIKE '%time%' OR checkpoint_json ILIKE '%time%'")
def run_search_text(s, d):
    return runs.matching_runs(A.task_runs(s, d), "Time").select("id", "task", "status")


@query("SELECT id, task, status, (SELECT count(*) FROM runs WHERE task = 'click') AS total_rows FROM runs WHERE task = 'click' ORDER BY id DESC LIMIT 40 OFFSET 10")
def run_page(s, d):
    return corpus.page_of(A.task_runs(s, d).where("task = 'click'").select("id", "task", "status"), [F.desc("id")], limit=40, offset=10)


ERRORS = """e AS (SELECT *, CASE WHEN contains(lower(error_message), 'timed out') OR contains(lower(error_message), 'timeout') THEN 'LLM_TIMEOUT' WHEN contains(lower(error_message), 'rate limit') THEN 'LLM_RATE_LIMIT'
  WHEN contains(lower(error_message), 'connect') THEN 'NETWORK_CONNECTION_ERROR' WHEN contains(lower(error_message), 'json') AND contains(lower(error_message), 'parse') THEN 'INVALID_MODEL_OUTPUT' ELSE 'WORKER_TASK_ERROR' END AS error_type
  FROM runs WHERE status = 'failed'),
plan AS (SELECT id, doc_id, error_type, attempt, CASE WHEN error_type IN ('LLM_TIMEOUT', 'LLM_RATE_LIMIT', 'NETWORK_CONNECTION_ERROR') AND attempt < 2 THEN 'retry' ELSE 'dead_letter' END AS action FROM e)"""


@query(f"WITH {ERRORS} SELECT error_type, CASE error_type WHEN 'LLM_TIMEOUT' THEN 'llm' WHEN 'LLM_RATE_LIMIT' THEN 'llm' WHEN 'NETWORK_CONNECTION_ERROR' THEN 'network' WHEN 'INVALID_MODEL_OUTPUT' THEN 'model_output' ELSE 'worker' END AS category, count(*) AS n FROM e GROUP BY 1, 2")
def error_catalog_join(s, d):
    return runs.with_error_type(A.task_runs(s, d)).groupBy("error_type", "category").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ERRORS} SELECT *, CASE WHEN action = 'retry' THEN CAST(least(300, 5 * pow(2, attempt)) AS INTEGER) END AS delay_s FROM plan")
def retry_plan(s, d):
    return runs.retry_plan(runs.with_error_type(A.task_runs(s, d)))


@query(f"WITH {ERRORS} SELECT id, doc_id, error_type FROM plan WHERE action = 'dead_letter' ORDER BY id DESC LIMIT 100")
def dead_letters(s, d):
    return runs.dead_letters(runs.retry_plan(runs.with_error_type(A.task_runs(s, d)))).select("id", "doc_id", "error_type")


@query("WITH x AS (SELECT id, created_at AS due_at FROM runs WHERE status = 'retrying') SELECT * FROM x WHERE due_at <= (SELECT max(due_at) FROM x) AND due_at <= '2024-01-20T00:00:00' ORDER BY due_at, id LIMIT 100")
def due_delayed_tasks(s, d):
    return runs.due_tasks(A.task_runs(s, d).where("status = 'retrying'").select("id", F.col("created_at").alias("due_at")), "2024-01-20T00:00:00")


@query("SELECT concat_ws(':', CAST(doc_id AS VARCHAR), task, nullif(trim(source), '')) AS task_key, min(id) AS first_id, count(*) AS requests FROM runs GROUP BY 1")
def queue_dedupe(s, d):
    return runs.dedupe_tasks(A.task_runs(s, d))


@query("SELECT status, count(*) AS n, count_if(status IN ('running', 'retrying') AND epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(CAST(created_at AS TIMESTAMP)) > 60) AS stale, max(created_at) AS newest FROM runs GROUP BY status")
def queue_stats(s, d):
    return runs.queue_stats(A.task_runs(s, d), "2024-01-20 00:00:00")


@query("""WITH n AS (SELECT doc_id, task, arg_max(checkpoint_json, id) AS raw, max(id) AS run_id FROM runs WHERE trim(coalesce(checkpoint_json, '')) != '' GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN starts_with(raw, '{') THEN raw END AS j FROM n)
SELECT doc_id, task, run_id, json_extract_string(j, '$.stage') AS stage, CAST(json_extract(j, '$.current') AS INTEGER) AS current, CAST(json_extract(j, '$.total') AS INTEGER) AS total,
  coalesce(greatest(0, least(CAST(json_extract(j, '$.current') AS INTEGER), CAST(json_extract(j, '$.total') AS INTEGER))), 0) AS resume_from FROM p""")
def checkpoint_resume(s, d):
    return runs.latest_checkpoint(A.task_runs(s, d))


@query("SELECT task, status, count(value) AS n, round(sum(value), 3) AS total, max(value) AS largest, round(avg(value), 4) AS mean FROM runs GROUP BY task, status")
def metrics_rollup(s, d):
    return runs.metrics_rollup(A.task_runs(s, d))


@query("""WITH f AS (SELECT doc_id, min(id) AS run_id, arg_min(task, id) AS task, arg_min(coalesce(checkpoint_json, ''), id) AS c FROM runs WHERE status IN ('running', 'retrying') GROUP BY doc_id)
SELECT doc_id, run_id, CASE WHEN starts_with(c, '{') THEN 'Chunk ' || json_extract_string(c, '$.current') || '/' || json_extract_string(c, '$.total') ELSE task END AS label FROM f""")
def running_labels(s, d):
    return runs.running_labels(A.task_runs(s, d))


@query("SELECT task, status, n, CAST(row_number() OVER (PARTITION BY task ORDER BY n DESC, status) AS INTEGER) AS rank, round(n / sum(n) OVER (PARTITION BY task), 6) AS share FROM (SELECT task, status, count(*) AS n FROM runs GROUP BY 1, 2)")
def task_status_shares(s, d):
    return runs.tasks_of_status(A.task_runs(s, d))


# ---- vectors ----

PAIRS = """sc AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id != b.vec_id WHERE a.vec_id % 20 = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sc)"""


def _vector(s: SparkSession, d: str, vec_id: int) -> list[float]:
    return list(_points(s, d).where(F.col("vec_id") == vec_id).first()["embedding"])


@query("SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10", prelude=False)
def knn_search(s, d):
    return vectors.knn(_points(s, d), _vector(s, d, 0), 10)


@query("WITH x AS (SELECT vec_id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings WHERE label != 3) SELECT * FROM x WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT 20", prelude=False)
def knn_threshold(s, d):
    return vectors.knn(_points(s, d).where("label != 3"), _vector(s, d, 0), 20, least=0.2)


@query("SELECT vec_id, label, round(1 / (2 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))), 6) AS score FROM embeddings WHERE vec_id != 0 ORDER BY score DESC, vec_id LIMIT 10", prelude=False)
def knn_inverse_distance(s, d):
    return vectors.knn(_points(s, d), _vector(s, d, 0), 10, mode="inverse", exclude=F.col("vec_id") == 0)


def _neighbours(s: SparkSession, d: str, k: int, least: float | None = None) -> DataFrame:
    return vectors.nearest(_points(s, d).where("vec_id % 20 = 0"), _points(s, d), k, least=least)


@query(f"WITH {PAIRS} SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 10", prelude=False)
def similar_docs(s, d):
    return _neighbours(s, d, 10)


@query(f"WITH {PAIRS} SELECT query_id, vec_id, score FROM rk WHERE rank <= 5 AND score >= 0.3", prelude=False)
def duplicate_candidates(s, d):
    return _neighbours(s, d, 5, 0.3).drop("rank")


@query(f"""WITH {PAIRS}, w AS (SELECT query_id, 'tag' AS kind, 'label ' || label AS name, round(sum(score), 6) AS weight FROM rk WHERE rank <= 10 GROUP BY 1, 2, 3),
c AS (SELECT query_id, 'correspondent' AS kind, CAST(label % 3 AS VARCHAR) AS name, round(sum(score), 6) AS weight FROM rk WHERE rank <= 10 GROUP BY 1, 2, 3),
u AS (SELECT * FROM w UNION ALL SELECT * FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY weight DESC, name) AS rank FROM u)
SELECT query_id, kind, name, weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= CASE kind WHEN 'tag' THEN 4 ELSE 1 END""", prelude=False)
def similar_metadata(s, d):
    points = _points(s, d)
    named = points.select("vec_id", F.explode(F.array(F.struct(F.lit("tag").alias("kind"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("name")), F.struct(F.lit("correspondent").alias("kind"), (F.col("label") % 3).cast("string").alias("name")))).alias("x")).select("vec_id", "x.*")
    return vectors.vote(_neighbours(s, d, 10).drop("rank"), named, keep={"tag": 4, "correspondent": 1})


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return _points(s, d).select((F.col("vec_id") / 4).cast("long").alias("doc_id"), (F.col("vec_id") % 4).alias("chunk"), "embedding")


@query("""WITH x AS (SELECT vec_id // 4 AS doc_id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT doc_id, i, count(*) AS n, round(sum(v) / count(*), 6) AS v FROM x GROUP BY 1, 2)
SELECT doc_id, max(n) AS n_chunks, round(sum(v * v), 4) AS squares, arg_min(v, i) AS first FROM m GROUP BY doc_id""", prelude=False)
def centroids(s, d):
    c = vectors.centroids(_chunks(s, d))
    return c.select("doc_id", "n_chunks", F.round(F.aggregate("centroid", F.lit(0.0), lambda a, v: a + v * v), 4).alias("squares"), F.get("centroid", F.lit(0)).alias("first"))


@query("""WITH st AS (SELECT vec_id // 4 AS doc_id, vec_id % 4 AS chunk FROM embeddings WHERE label NOT IN (1, 2)), ex AS (SELECT DISTINCT vec_id // 4 AS doc_id FROM embeddings),
w AS (SELECT doc_id, unnest(range(0, 4)) AS chunk FROM ex), p AS (SELECT w.doc_id, count(*) AS expected, count(st.chunk) AS found FROM w LEFT JOIN st USING (doc_id, chunk) GROUP BY w.doc_id)
SELECT *, CASE WHEN found = 0 THEN 'fully_missing' ELSE 'partially_missing' END AS state FROM p WHERE found < expected""", prelude=False)
def vector_integrity(s, d):
    expected = _chunks(s, d).select("doc_id").distinct().withColumn("chunk_count", F.lit(4))
    stored = _points(s, d).where("label NOT IN (1, 2)").select((F.col("vec_id") / 4).cast("long").alias("doc_id"), (F.col("vec_id") % 4).alias("chunk"), "embedding")
    return vectors.integrity(expected, stored)


# ---- search ----

QUERY = "license version the"
LEX = f"""pg AS (SELECT doc_id, source, page, substr(text, (page - 1) * 1500 + 1, 1500) AS text FROM (SELECT doc_id, source, text, unnest(range(1, CAST(ceil(length(text) / 1500.0) AS BIGINT) + 1)) AS page FROM documents WHERE length(text) > 0)),
tk AS (SELECT doc_id, page, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM pg),
hx AS (SELECT doc_id, page, md5(t) AS h FROM tk),
bk AS (SELECT doc_id, page, CAST('0x' || substr(h, 1, 4) AS INTEGER) % 64 AS b, sum(1 - 2 * (CAST('0x' || substr(h, 5, 1) AS INTEGER) % 2)) AS s FROM hx GROUP BY 1, 2, 3),
qv AS (SELECT b, s / sqrt(sum(s * s) OVER ()) AS w FROM (SELECT CAST('0x' || substr(md5(t), 1, 4) AS INTEGER) % 64 AS b, sum(1 - 2 * (CAST('0x' || substr(md5(t), 5, 1) AS INTEGER) % 2)) AS s FROM (SELECT unnest(['license', 'version', 'the']) AS t) GROUP BY 1)),
sc AS (SELECT doc_id, page, round(CASE WHEN sqrt(sum(s * s)) > 0 THEN coalesce(sum(s * w), 0) / sqrt(sum(s * s)) ELSE 0 END, 6) AS score FROM bk LEFT JOIN qv USING (b) GROUP BY 1, 2),
hits AS (SELECT pg.*, sc.score, CASE WHEN l.quality IS NULL THEN 100 ELSE 30 + 60 * l.quality END AS quality FROM pg JOIN sc USING (doc_id, page) LEFT JOIN labels l USING (doc_id))"""


def _hits(s: SparkSession, d: str) -> DataFrame:
    pages = search.pages_of(A.table(s, d, "documents"))
    scored = search.lexical_scores(pages, QUERY)
    return scored


def _quality(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "labels").select("doc_id", (30 + 60 * F.col("quality")).alias("quality"))


@query(f"""WITH {LEX}, cut AS (SELECT * FROM hits ORDER BY score DESC, doc_id, page LIMIT 60),
r AS (SELECT *, round(score * quality / 100.0 + (CAST(contains(lower(text), 'license') AS INTEGER) + CAST(contains(lower(text), 'version') AS INTEGER) + CAST(contains(lower(text), 'the') AS INTEGER)) / 3.0 * 0.35
  + CASE WHEN contains(lower(text), '{QUERY}') THEN 0.5 ELSE 0 END, 6) AS combined_score FROM cut WHERE quality >= 50)
SELECT doc_id, page, source, score, CAST(quality AS INTEGER) AS quality, combined_score, substr(text, 1, 240) AS snippet FROM r ORDER BY combined_score DESC, score DESC, doc_id, page LIMIT 10""", prelude=False)
def hybrid_search(s, d):
    return search.hybrid_search(_hits(s, d), QUERY, quality=_quality(s, d), top_k=10, min_quality=50)


@query(f"""WITH {LEX}, cut AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, page) AS hit_rank FROM hits), t AS (SELECT * FROM cut WHERE hit_rank <= 18),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, source ORDER BY round(score * CASE WHEN quality = 0 THEN 100 ELSE quality END / 100.0, 6) DESC, hit_rank) AS n, min(hit_rank) OVER (PARTITION BY doc_id, page, source) AS f FROM t WHERE quality >= 40)
SELECT CAST(row_number() OVER (ORDER BY f) AS INTEGER) AS id, doc_id, page, source, score FROM k WHERE n = 1 ORDER BY f LIMIT 6""", prelude=False)
def rag_sources(s, d):
    top = _hits(s, d).orderBy(F.desc("score"), "doc_id", "page").limit(18).join(_quality(s, d), "doc_id", "left")
    ranked = top.withColumn("hit_rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id", "page"))).withColumn("doc_date", F.lit(None).cast("string"))
    return search.select_sources(ranked, min_quality=40).select("id", "doc_id", "page", "source", "score")


@query("""WITH a AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS nr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, substr(trim(coalesce(text, '')), 1, 1600) AS q, substr(trim(coalesce(CASE WHEN nr = 'assistant' THEN answer ELSE '' END, '')), 1, 1600) AS a FROM a WHERE role = 'user'),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM p WHERE q != '' AND a != ''),
h AS (SELECT conv_id, string_agg('User: ' || q || chr(10) || 'Assistant: ' || a, chr(10) ORDER BY turn) AS history FROM r WHERE n <= 12 GROUP BY conv_id)
SELECT c.conv_id, coalesce(history, 'None') AS history FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN h USING (conv_id)""", prelude=False)
def chat_history_window(s, d):
    return search.chat_history(A.table(s, d, "conversations"))


@query(r"""WITH n AS (SELECT doc_id, ' ' || array_to_string(list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda t: regexp_replace(t, '[^\p{L}\p{M}\p{Nd}\p{Pc}]+', '', 'g')), lambda t: t != ''), ' ') || ' ' AS h FROM documents),
w AS (SELECT item_id, ' ' || array_to_string(list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda t: regexp_replace(t, '[^\p{L}\p{M}\p{Nd}\p{Pc}]+', '', 'g')), lambda t: t != ''), ' ') || ' ' AS k FROM benchmark)
SELECT item_id, doc_id, 1 AS page, CAST(length(substr(h, 1, strpos(h, k) - 1)) - length(replace(substr(h, 1, strpos(h, k) - 1), ' ', '')) AS INTEGER) AS start FROM n JOIN w ON contains(h, k) WHERE length(k) - length(replace(k, ' ', '')) >= 3""", prelude=False)
def evidence_places(s, d):
    return search.locate_snippets(A.table(s, d, "benchmark"), A.table(s, d, "documents").select("doc_id", F.lit(1).alias("page"), "text"))


@query("""WITH c AS (SELECT event_id AS ordinal, user_id AS doc_id, event_id % 4 AS page, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS snippet, event_id % 3 AS k FROM events),
pg AS (SELECT doc_id, page, min(ordinal) AS f FROM c GROUP BY 1, 2 ORDER BY f LIMIT 5)
SELECT ordinal, greatest(doc_id, 0) AS doc_id, greatest(page, 0) AS page,
  CASE WHEN doc_id <= 0 OR page <= 0 THEN 'error' WHEN k = 0 THEN 'ok' WHEN k = 1 THEN 'error' WHEN snippet = '' THEN 'error' ELSE 'no_match' END AS status,
  CASE WHEN doc_id <= 0 OR page <= 0 THEN 'invalid_doc_or_page' WHEN k = 0 THEN NULL WHEN k = 1 THEN 'invalid_bbox' WHEN snippet = '' THEN 'empty_snippet' END AS error,
  CASE WHEN doc_id > 0 AND page > 0 AND k = 0 THEN 1.0 ELSE 0.0 END AS confidence FROM c JOIN pg USING (doc_id, page)""", prelude=False)
def evidence_status(s, d):
    box = F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0))).when(F.col("event_id") % 3 == 1, F.array(F.lit(9.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)))
    cited = A.table(s, d, "events").select(F.col("event_id").alias("ordinal"), F.col("user_id").alias("doc_id"), (F.col("event_id") % 4).alias("page"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_type")).alias("snippet"), box.alias("bbox"))
    return search.evidence_status(cited, max_pages=9)


# ---- text ----


@query("SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.5)) END AS INTEGER) AS tokens, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.5)) END >= 3000 AS is_large FROM documents", prelude=False)
def token_estimate(s, d):
    return A.table(s, d, "documents").select("doc_id", textops.estimate_tokens(F.col("text")).alias("tokens"), textops.is_large(F.lit(None).cast("int"), F.col("text"), 12).alias("is_large"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || '[TRUNCATED]' ELSE text END AS text FROM documents", prelude=False)
def truncate_budget(s, d):
    return A.table(s, d, "documents").select("doc_id", textops.truncate_chars(F.col("text"), 500).alias("text"))


QUALITY = r"""c AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS c FROM documents),
w AS (SELECT doc_id, c, length(c) AS n, regexp_extract_all(c, '[A-Za-z0-9ÄÖÜäöüß]+') AS ws, length(c) - length(regexp_replace(c, '\p{L}', '', 'g')) AS letters, length(c) - length(regexp_replace(c, '\p{Nd}', '', 'g')) AS digits,
  length(c) - length(regexp_replace(c, '[\p{L}\p{N}]', '', 'g')) AS alnum, length(c) - length(regexp_replace(c, '[aeiouAEIOUäöüÄÖÜ]', '', 'g')) AS vowels FROM c),
run AS (SELECT doc_id, max(k) AS max_run FROM (SELECT doc_id, ch, i - rn AS g, count(*) AS k FROM (SELECT doc_id, ch, i, row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS rn FROM
  (SELECT doc_id, unnest(string_split(c, '')) AS ch, generate_subscripts(string_split(c, ''), 1) AS i FROM c)) GROUP BY 1, 2, 3) GROUP BY doc_id),
m AS (SELECT doc_id, n, letters, len(ws) AS k, CASE WHEN n = 0 THEN 1 ELSE 1 - alnum / n END AS non_alnum, CASE WHEN n = 0 THEN 0 ELSE letters / n END AS alpha, CASE WHEN n = 0 THEN 0 ELSE digits / n END AS digit, vowels / greatest(1, letters) AS vowel,
  CASE WHEN len(ws) = 0 THEN 0 ELSE len(list_distinct(list_transform(ws, lambda x: lower(x)))) / len(ws) END AS uniq,
  CASE WHEN len(ws) = 0 THEN 0 ELSE len(list_filter(ws, lambda x: regexp_matches(x, '[aeiouAEIOUäöüÄÖÜ]'))) / len(ws) END AS wordlike,
  CASE WHEN len(ws) = 0 THEN 0 ELSE len(list_filter(ws, lambda x: NOT regexp_matches(x, '[aeiouAEIOUäöüÄÖÜ]'))) / len(ws) END AS novowel,
  CASE WHEN len(ws) = 0 THEN 0 ELSE list_sum(list_transform(ws, lambda x: length(x))) / len(ws) END AS avg_len,
  CASE WHEN len(ws) = 0 THEN 0 ELSE len(list_filter(ws, lambda x: length(x) <= 2)) / len(ws) END AS short, coalesce(max_run, 0) AS max_run FROM w LEFT JOIN run USING (doc_id)),
q AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(0, 100 - 30 * CAST(n < 40 AS INTEGER) - 25 * CAST(non_alnum > 0.6 AS INTEGER) - 15 * CAST(alpha < 0.2 AS INTEGER) - 15 * CAST(vowel < 0.25 AND letters > 20 AS INTEGER) - 10 * CAST(digit > 0.6 AS INTEGER)
  - 10 * CAST(avg_len < 2.2 OR avg_len > 12 AS INTEGER) - 10 * CAST(short > 0.5 AND k > 10 AS INTEGER) - 10 * CAST(uniq < 0.3 AND k > 10 AS INTEGER) - 15 * CAST(wordlike < 0.6 AND k > 10 AS INTEGER) - 10 * CAST(novowel > 0.4 AND k > 10 AS INTEGER) - 10 * CAST(max_run >= 12 AS INTEGER)) END AS score FROM m)"""


@query(f"WITH {QUALITY} SELECT doc_id, CAST(score AS INTEGER) AS score, CAST(k AS INTEGER) AS word_count, round(uniq, 6) AS unique_ratio, round(vowel, 6) AS vowel_ratio, round(avg_len, 6) AS avg_word_len, CAST(max_run AS INTEGER) AS max_run FROM q", prelude=False)
def text_quality(s, d):
    q = textops.score_quality(A.table(s, d, "documents").select("doc_id", "text"))
    m = lambda k: F.col(f"quality.metrics.{k}")
    return q.select("doc_id", "quality.score", m("word_count").cast("int").alias("word_count"), F.round(m("unique_ratio"), 6).alias("unique_ratio"), F.round(m("vowel_ratio"), 6).alias("vowel_ratio"), F.round(m("avg_word_len"), 6).alias("avg_word_len"), m("max_run").cast("int").alias("max_run"))


@query(f"WITH {QUALITY} SELECT doc_id FROM q WHERE score < 60", prelude=False)
def low_quality_pages(s, d):
    return textops.score_quality(A.table(s, d, "documents").select("doc_id", "text")).where("quality.score < 60").select("doc_id")


@query(r"""WITH x AS (SELECT doc_id, text, length(text) AS n, regexp_extract_all(text, '\pL{2,}') AS ws, string_split_regex(text, '\r\n|\r|\n') AS ls FROM documents)
SELECT doc_id, round((n - length(regexp_replace(text, '\p{Nd}', '', 'g'))) / n, 6) AS digit_ratio, round((n - length(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g'))) / n, 6) AS punct_ratio,
  CAST(len(ls) AS DOUBLE) AS line_count, round(list_sum(list_transform(ls, lambda l: length(l))) / len(ls), 6) AS avg_line_len, round(len(regexp_extract_all(text, '[ \t]{3,}')) / greatest(1.0, n / 200.0), 6) AS multispace_ratio FROM x WHERE n > 0""", prelude=False)
def ocr_noise(s, d):
    m = A.table(s, d, "documents").where("length(text) > 0").select("doc_id", textops.noise(F.col("text")).alias("m"))
    return m.select("doc_id", *[F.round(f"m.{k}", 6).alias(k) for k in ("digit_ratio", "punct_ratio", "line_count", "avg_line_len", "multispace_ratio")])


@query()
def ocr_verdict(s, d):
    m = A.table(s, d, "documents").select("doc_id", textops.noise(F.col("text")).alias("m"))
    scored = m.withColumn("score", F.round(textops.badness(F.col("m")), 4))
    return scored.select("doc_id", "score", textops.verdict(F.col("score")).alias("verdict"))


@query("WITH k AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'old' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 3 != 0) SELECT d.doc_id, sha256(d.text) AS content_hash FROM documents d LEFT JOIN k USING (doc_id) WHERE k.h IS NULL OR k.h != sha256(d.text)", prelude=False)
def incremental_changed(s, d):
    docs = A.table(s, d, "documents").select("doc_id", "text")
    known = docs.where("doc_id % 3 != 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "old").otherwise(F.sha2("text", 256)).alias("content_hash"))
    return textops.changed_texts(docs, known).select("doc_id", "content_hash")


@query(r"SELECT page_id, contains(html, '<') AND contains(html, '>') AND regexp_matches(html, '<\s*/?\s*[a-zA-Z][^>]*>') AS is_html FROM pages", prelude=False)
def html_detect(s, d):
    return A.table(s, d, "pages").select("page_id", textops.looks_like_html(F.col("html")).alias("is_html"))


@query()
def html_to_text(s, d):
    return A.table(s, d, "pages").select("page_id", textops.html_to_text(F.col("html")).alias("text"))


@query()
def clean_text(s, d):
    docs = A.table(s, d, "documents").select(F.col("doc_id").alias("id"), textops.clean_text(F.col("text")).alias("text"))
    return docs.select("id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("content_hash"), textops.estimate_tokens(F.col("text")).alias("tokens"))


@query()
def chunk_heuristic(s, d):
    return textops.chunks(A.table(s, d, "documents").select("doc_id", "text")).select("doc_id", "chunk", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query()
def chunk_budget(s, d):
    parts = textops.chunks(A.table(s, d, "documents").select("doc_id", "text"), max_tokens=250)
    return parts.agg(F.count(F.lit(1)).alias("parts"), F.count_if(F.col("split_total") > 1).alias("from_split"), F.max(textops.estimate_tokens(F.col("text"))).alias("largest"))


@query("""WITH RECURSIVE ln AS (SELECT conv_id AS doc_id, turn AS page, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / 3.5) AS INTEGER)) END AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT doc_id, i, page AS lo, page AS hi, 1 AS n, t AS tokens, 1 AS sec FROM ln WHERE i = 1
  UNION ALL SELECT f.doc_id, ln.i, CASE WHEN f.n < 3 AND f.tokens + ln.t <= 400 THEN f.lo ELSE ln.page END, ln.page, CASE WHEN f.n < 3 AND f.tokens + ln.t <= 400 THEN f.n + 1 ELSE 1 END,
  CASE WHEN f.n < 3 AND f.tokens + ln.t <= 400 THEN f.tokens + ln.t ELSE ln.t END, CASE WHEN f.n < 3 AND f.tokens + ln.t <= 400 THEN f.sec ELSE f.sec + 1 END FROM f JOIN ln ON ln.doc_id = f.doc_id AND ln.i = f.i + 1)
SELECT doc_id, min(lo) || '-' || max(hi) AS section_key, CAST(max(n) AS INTEGER) AS n_notes, CAST(max(tokens) AS INTEGER) AS tokens FROM f GROUP BY doc_id, sec""", prelude=False)
def note_sections(s, d):
    notes = A.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text")
    return textops.note_sections(notes, max_pages=3, max_tokens=400)


@query("WITH p AS (SELECT doc_id, string_split(replace(text, chr(10), chr(12)), chr(12)) AS parts FROM documents), t AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: trim(x, ' ')), lambda x: x != '') AS p FROM p) SELECT doc_id, CAST(generate_subscripts(p, 1) AS INTEGER) AS page, unnest(p) AS text FROM t WHERE len(p) >= 2", prelude=False)
def page_split(s, d):
    return textops.pages_by_form_feed(A.table(s, d, "documents").select("doc_id", F.translate("text", "\n", "\f").alias("text")))


# ---- review and writeback ----


def _audit(s: SparkSession, d: str) -> DataFrame:
    action = F.when(F.col("event_type") == "purchase", "apply_to_document:title").when(F.col("event_type") == "signup", "mark_reviewed").otherwise("suggest")
    return A.table(s, d, "events").select((F.col("user_id") * 4 + 1).alias("doc_id"), action.alias("action"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))


AUDIT = """audit AS (SELECT user_id * 4 + 1 AS doc_id, CASE event_type WHEN 'purchase' THEN 'apply_to_document:title' WHEN 'signup' THEN 'mark_reviewed' ELSE 'suggest' END AS action, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM events),
rev AS (SELECT doc_id, max(created_at) AS reviewed_at FROM audit WHERE starts_with(action, 'apply_to_document:') OR action = 'mark_reviewed' GROUP BY doc_id)"""


@query(f"WITH {AUDIT} SELECT * FROM rev")
def latest_review(s, d):
    return review.latest_review(_audit(s, d))


@query(f"""WITH {AUDIT} SELECT a.id, CASE WHEN a.id % 9 = 0 THEN 'needs_review' WHEN reviewed_at IS NULL THEN 'unreviewed' WHEN CAST(replace(modified, 'Z', '') AS TIMESTAMP) > CAST(replace(reviewed_at, 'Z', '') AS TIMESTAMP) THEN 'needs_review' ELSE 'reviewed' END AS review_status
FROM active a LEFT JOIN rev ON rev.doc_id = a.id""")
def review_status(s, d):
    reviewed = review.latest_review(_audit(s, d)).withColumnRenamed("doc_id", "id")
    return _active(s, d).join(reviewed, "id", "left").select("id", review.review_status(F.col("id") % 9 == 0, F.col("reviewed_at"), F.col("modified")).alias("review_status"))


@query("SELECT id, CASE WHEN CAST(replace(modified, 'Z', '') AS TIMESTAMP) > CAST(replace(created, 'Z', '') AS TIMESTAMP) THEN 'stale' ELSE 'synced' END AS sync_status FROM active")
def sync_status(s, d):
    return _active(s, d).select("id", review.sync_status(F.col("created"), F.col("modified")).alias("sync_status"))


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = _active(s, d)
    note = F.when(F.col("id") % 4 == 0, F.concat(F.lit("total "), F.col("page_count").cast("string"), F.lit("\nAI summary")))
    local = docs.select(F.col("id").alias("doc_id"), "title", F.col("document_date").alias("issue_date"), "correspondent_id", F.array("id", F.lit(2).cast("long")).alias("tags"), note.alias("note"), F.lit(None).cast("long").alias("note_id"))
    remote = local.select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, F.upper("title")).otherwise(F.concat(F.lit(" "), "title")).alias("title"), F.when(F.col("doc_id") % 2 == 0, F.col("issue_date")).alias("issue_date"), F.when(F.col("doc_id") % 8 != 0, F.col("correspondent_id")).alias("correspondent_id"),
        F.when(F.col("doc_id") % 5 == 0, F.array("doc_id")).otherwise(F.array(F.lit(2).cast("long"), "doc_id")).alias("tags"), F.when(F.col("doc_id") % 12 == 0, "old\nAI summary").when(F.col("doc_id") % 16 == 0, F.col("note")).alias("note"), F.when(F.col("doc_id") % 12 == 0, F.col("doc_id") + 7).alias("note_id"),
    )
    return local, remote


DIFF = """df AS (SELECT id AS doc_id, title, id % 3 = 0 AND upper(title) != title AS d_title, id % 2 != 0 AND coalesce(document_date, '') != '' AS d_date, id % 8 = 0 AND correspondent_id IS NOT NULL AS d_corr, id % 5 = 0 AND id != 2 AS d_tags,
  CASE WHEN id % 4 = 0 THEN 'total ' || page_count || chr(10) || 'AI summary' END AS note, id % 12 = 0 AS has_old FROM active),
df2 AS (SELECT *, note IS NOT NULL AND (has_old OR doc_id % 16 != 0) AS d_note FROM df),
df3 AS (SELECT *, list_filter([CASE WHEN d_title THEN 'title' END, CASE WHEN d_date THEN 'issue_date' END, CASE WHEN d_corr THEN 'correspondent' END, CASE WHEN d_tags THEN 'tags' END], lambda x: x IS NOT NULL) AS patch,
  CASE WHEN note IS NULL THEN 'none' WHEN NOT d_note THEN 'unchanged' WHEN has_old THEN 'replace' ELSE 'add' END AS note_action FROM df2)"""


@query(f"WITH {DIFF} SELECT doc_id, array_to_string(CASE WHEN d_note THEN list_append(patch, 'note') ELSE patch END, ',') AS changed, note_action FROM df3")
def writeback_diff(s, d):
    return review.change_plan(*_sides(s, d)).select("doc_id", F.array_join("changed", ",").alias("changed"), "note_action")


@query(f"""WITH {DIFF}, c AS (SELECT doc_id, 1 AS o, 'PATCH' AS method, '/api/documents/' || doc_id || '/' AS path, array_to_string(patch, ',') AS fields FROM df3 WHERE len(patch) > 0
  UNION ALL SELECT doc_id, 2, 'DELETE', '/api/documents/' || doc_id || '/notes/?id=' || (doc_id + 7), '' FROM df3 WHERE d_note AND note_action = 'replace' UNION ALL SELECT doc_id, 3, 'POST', '/api/documents/' || doc_id || '/notes/', 'note' FROM df3 WHERE d_note)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS step, method, path, fields FROM c""")
def writeback_calls(s, d):
    return review.writeback_calls(review.change_plan(*_sides(s, d)))


@query(f"WITH {DIFF} SELECT count(*) AS docs_selected, count_if(len(patch) > 0 OR d_note) AS docs_changed, CAST(sum(CAST(len(patch) > 0 AS INTEGER) + CAST(d_note AS INTEGER) + CAST(d_note AND note_action = 'replace' AS INTEGER)) AS BIGINT) AS calls_count FROM df3")
def writeback_totals(s, d):
    plan = review.change_plan(*_sides(s, d))
    return review.writeback_totals(plan, review.writeback_calls(plan))


@query(f"WITH {DIFF} SELECT doc_id FROM df3 WHERE d_tags OR d_title OR (id_date_counts AND d_date) OR d_corr OR note_differs".replace("id_date_counts AND d_date", "false").replace("note_differs", "coalesce(note, '') != coalesce(CASE WHEN has_old THEN 'old' || chr(10) || 'AI summary' WHEN doc_id % 16 = 0 THEN note END, '')"))
def local_overrides(s, d):
    local, remote = _sides(s, d)
    return local.alias("l").join(remote.alias("r"), "doc_id").where(review.has_overrides()).select("doc_id")


@query("""WITH a AS (SELECT user_id AS doc_id, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS "at", 0 AS kind FROM events WHERE event_type = 'purchase' GROUP BY 1), b AS (SELECT DISTINCT o_custkey AS doc_id, NULL AS "at", 1 AS kind FROM orders WHERE o_orderstatus = 'P'), c AS (SELECT DISTINCT c_custkey AS doc_id, NULL AS "at", 2 AS kind FROM customer),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)) SELECT doc_id, kind, "at" FROM u WHERE n = 1""", prelude=False)
def writeback_candidates(s, d):
    audited = A.table(s, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("doc_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))
    return review.candidate_order(audited, A.table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("doc_id")), A.table(s, d, "customer").select(F.col("c_custkey").alias("doc_id")))


@query("""WITH k AS (SELECT lower(trim(name)) AS k, max(id) AS id FROM tags GROUP BY 1), w AS (SELECT min(n) AS name, lower(n) AS k FROM (SELECT trim(upper(p_brand || ' ' || p_type)) AS n FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT trim(' New ' || p_brand) FROM part) GROUP BY 2)
SELECT w.name, k.id, CASE WHEN k.id IS NULL THEN 'create' ELSE 'use' END AS action FROM w LEFT JOIN k USING (k)""")
def name_resolve(s, d):
    part = A.table(s, d, "part")
    wanted = part.where("p_partkey % 2 = 0").select(F.upper(F.concat_ws(" ", "p_brand", "p_type")).alias("name")).union(part.select(F.concat(F.lit(" New "), "p_brand")))
    return review.resolve_names(wanted, A.tags(s, d))


@query("""WITH x AS (SELECT p_partkey AS doc_id, [p_brand || ' ' || p_type, ' ' || p_brand || ' ' || p_type, '', lower(p_type), p_brand, p_name] AS names FROM part), e AS (SELECT doc_id, list_distinct_ordered AS n FROM (SELECT doc_id, list_filter(list_transform(names, lambda t: trim(t)), lambda t: t != '') AS l,
  [names[1], names[4], names[5], names[6]] AS list_distinct_ordered FROM x)), r AS (SELECT doc_id, generate_subscripts(n, 1) AS pos, unnest(n) AS name FROM e), k AS (SELECT DISTINCT lower(trim(name)) AS k FROM tags)
SELECT doc_id, coalesce(string_agg(CASE WHEN k IS NOT NULL THEN name END, '|' ORDER BY pos), '') AS existing, coalesce(string_agg(CASE WHEN k IS NULL THEN name END, '|' ORDER BY pos), '') AS new FROM r LEFT JOIN k ON k.k = lower(r.name) WHERE pos <= 4 GROUP BY doc_id""")
def tag_normalize(s, d):
    part = A.table(s, d, "part")
    both = F.concat_ws(" ", "p_brand", "p_type")
    given = part.select(F.col("p_partkey").alias("doc_id"), F.array(both, F.concat(F.lit(" "), both), F.lit(""), F.lower("p_type"), "p_brand", "p_name").alias("names"))
    return review.normalize_tags(given, A.tags(s, d))


@query("""WITH w AS (SELECT DISTINCT p_type AS name FROM part), k AS (SELECT id, lower(trim(name)) AS k FROM tags), m AS (SELECT w.name, k.id, CASE WHEN k.k = lower(w.name) THEN 0 ELSE 1 END AS tier, length(k.k) AS size FROM w JOIN k ON contains(k.k, lower(w.name)))
SELECT name, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, size, id) AS n FROM m) WHERE n = 1""")
def name_fuzzy_match(s, d):
    return merge.best_name_match(A.table(s, d, "part").select(F.col("p_type").alias("name")).distinct(), A.tags(s, d))


# ---- merge ----


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END AS name, 'part' AS kind FROM part UNION ALL SELECT p_partkey + 10000000, p_name, 'part' FROM part WHERE p_partkey % 10 = 0", prelude=False)
def upsert_merge(s, d):
    base = A.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("part").alias("kind"))
    new = base.where("id % 4 = 0").withColumn("name", F.upper("name")).withColumn("o", F.lit(1)).unionByName(base.where("id % 4 = 0").withColumn("o", F.lit(2))).unionByName(base.where("id % 10 = 0").withColumn("id", F.col("id") + 10_000_000).withColumn("o", F.lit(1)))
    return merge.upsert(base, new, ["id"], F.col("o"))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)", prelude=False)
def prune_missing(s, d):
    base = A.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return merge.prune(base, A.table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id")), "id")


@query("SELECT id, CASE WHEN deleted_at IS NULL AND id % 6 = 0 THEN 'DELETED upstream @ now' ELSE deleted_at END AS deleted_at FROM docs")
def soft_delete_missing(s, d):
    docs = A.documents(s, d).select("id", "deleted_at")
    return merge.mark_missing(docs, docs.where("id % 6 != 0"), "id", "DELETED upstream @ now", incremental=False)


@query("""WITH ex AS (SELECT conv_id AS document_id, conv_id * 10 + turn AS id, text AS note FROM conversations), inc AS (SELECT conv_id AS document_id, CASE WHEN turn = 1 AND conv_id % 5 = 0 THEN 'bad' ELSE CAST(conv_id * 10 + turn + CASE WHEN conv_id % 7 = 0 THEN 10 ELSE 0 END AS VARCHAR) END AS raw, 'x ' || text AS note FROM conversations WHERE turn < 2 AND conv_id % 2 = 0),
f AS (SELECT document_id, TRY_CAST(raw AS BIGINT) AS id, note FROM inc WHERE TRY_CAST(raw AS BIGINT) IS NOT NULL), g AS (SELECT document_id, bool_or(TRY_CAST(raw AS BIGINT) IS NULL) AS bad FROM inc GROUP BY 1),
k AS (SELECT ex.* FROM ex LEFT JOIN g USING (document_id) WHERE (bad IS NULL OR bad) AND NOT EXISTS (SELECT 1 FROM f WHERE f.document_id = ex.document_id AND f.id = ex.id)),
low AS (SELECT least(0, coalesce(min(id), 0)) AS low FROM ex), c AS (SELECT document_id, low - row_number() OVER (ORDER BY k.id, document_id) AS id, note FROM k, low WHERE k.id IN (SELECT id FROM f))
SELECT * FROM k WHERE id NOT IN (SELECT id FROM f) UNION ALL SELECT * FROM c UNION ALL SELECT * FROM f""", prelude=False)
def note_merge(s, d):
    conv = A.table(s, d, "conversations")
    existing = conv.select(F.col("conv_id").alias("document_id"), (F.col("conv_id") * 10 + F.col("turn")).alias("id"), F.col("text").alias("note"))
    raw = F.when((F.col("turn") == 1) & (F.col("conv_id") % 5 == 0), "bad").otherwise((F.col("conv_id") * 10 + F.col("turn") + F.when(F.col("conv_id") % 7 == 0, 10).otherwise(0)).cast("string"))
    incoming = conv.where("turn < 2 AND conv_id % 2 = 0").select(F.col("conv_id").alias("document_id"), raw.alias("raw_id"), F.concat(F.lit("x "), "text").alias("note"), F.col("turn").alias("ordinal"))
    return merge.merge_notes(existing, incoming)


# ---- planner ----

OPTIONS = planner.PlanOptions()


def _facts(s: SparkSession, d: str) -> DataFrame:
    pages = A.page_texts(s, d)
    anchors = pages.where("page < 4").select("doc_id", "page", F.when(F.col("doc_id") % 19 == 0, "error").when(F.col("doc_id") % 23 == 0, "no_text_layer").otherwise("ok").alias("status"), (F.col("doc_id") % 3).alias("token_count"))
    notes = pages.where("source = 'vision_ocr'").select("doc_id", "page", "source", F.when(F.col("doc_id") % 8 == 0, "error").otherwise("ok").alias("status"), F.col("created_at").alias("processed_at"))
    summaries = A.suggestions(s, d).groupBy("doc_id").agg(F.max("processed_at").alias("summary_at"))
    similarity = A.embeddings_done(s, d).where("chunk_count > 1").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("embedded_at")).otherwise("1990-01-01T00:00:00Z").alias("similarity_at"))
    docs = _active(s, d).select("id", F.when(F.col("page_count") < 60, F.col("page_count") % 4).otherwise(F.col("page_count")).alias("page_count"), F.lit(0).alias("tokens"))
    return planner.document_facts(docs, embedded=A.embeddings_done(s, d), page_texts=pages, suggested=A.suggestions(s, d), anchors=anchors, notes=notes, summaries=summaries, similarity=similarity, options=OPTIONS)


def _plan(s: SparkSession, d: str) -> DataFrame:
    return planner.evaluate(_facts(s, d), OPTIONS)


PLAN = """pd AS (SELECT id, CASE WHEN page_count < 60 THEN page_count % 4 ELSE page_count END AS page_count FROM active),
ex AS (SELECT p.*, page BETWEEN 1 AND CASE WHEN coalesce(page_count, 0) > 0 THEN page_count ELSE 1000000 END AS inside FROM pages_t p LEFT JOIN pd ON pd.id = p.doc_id),
an AS (SELECT doc_id AS id, count(DISTINCT CASE WHEN doc_id % 19 != 0 AND inside THEN page END) AS anchor_pages, doc_id % 19 != 0 AND doc_id % 23 != 0 AND doc_id % 3 > 0 AS text_layer, doc_id % 19 = 0 AS anchor_error FROM ex WHERE page < 4 GROUP BY doc_id),
vi AS (SELECT doc_id AS id, count(DISTINCT CASE WHEN inside THEN page END) AS vp, max(created_at) AS vision_at FROM ex WHERE source = 'vision_ocr' GROUP BY doc_id),
sg AS (SELECT doc_id AS id, bool_or(source = 'text_layer') AS sb, bool_or(source = 'vision_ocr') AS sv, max(processed_at) AS summary_at FROM sugg GROUP BY doc_id),
f AS (SELECT pd.id, pd.page_count, coalesce(pd.page_count, 0) AS e, anchor_pages, coalesce(text_layer, false) AS tl, coalesce(anchor_error, false) AS ae, coalesce(vp, 0) AS vp, vision_at, coalesce(sb, false) AS sb, coalesce(sv, false) AS sv, summary_at, embedding_source, embedded_at,
  CASE WHEN chunk_count > 1 THEN CASE WHEN pd.id % 2 = 0 THEN embedded_at ELSE '1990-01-01T00:00:00Z' END END AS sim_at,
  CASE WHEN pd.id % 8 != 0 THEN coalesce(vp, 0) ELSE 0 END AS np, CASE WHEN pd.id % 8 != 0 THEN vision_at END AS notes_at
  FROM pd LEFT JOIN an USING (id) LEFT JOIN vi USING (id) LEFT JOIN sg USING (id) LEFT JOIN emb ON emb.doc_id = pd.id),
g AS (SELECT *, CASE WHEN e > 0 THEN coalesce(anchor_pages, 0) >= e ELSE coalesce(anchor_pages, 0) > 0 END AS he, CASE WHEN e > 0 THEN vp >= e ELSE vp > 0 END AS vc, e >= 20 AS large FROM f),
h AS (SELECT *, anchor_pages IS NOT NULL AND he AND NOT tl AS nt, coalesce(embedding_source, '') NOT IN ('vision', 'both') AS nev FROM g),
p AS (SELECT id, page_count, large, nt, NOT nt AND (NOT he OR ae) AS needs_evidence_index, NOT vc OR vision_at IS NULL AS needs_vision, nev AS needs_embeddings, nev OR (embedding_source IS NOT NULL AND (sim_at IS NULL OR sim_at < embedded_at)) AS needs_similarity,
  large AND ((CASE WHEN e > 0 THEN np < e ELSE np = 0 END) OR notes_at IS NULL OR coalesce(notes_at < vision_at, false)) AS needs_page_notes, large AND (summary_at IS NULL OR coalesce(summary_at < notes_at, false)) AS needs_summary, NOT sb AS needs_suggestions_baseline, NOT sv AS needs_suggestions_vision FROM h),
pl AS (SELECT *, list_filter([CASE WHEN needs_evidence_index THEN 'evidence_index' END, CASE WHEN needs_vision THEN 'vision_ocr' END, CASE WHEN needs_embeddings THEN 'embeddings_vision' END, CASE WHEN needs_similarity THEN 'similarity_index' END, CASE WHEN needs_page_notes THEN 'page_notes_vision' END,
  CASE WHEN needs_summary THEN 'summary_hierarchical' END, CASE WHEN needs_suggestions_baseline THEN 'suggestions_baseline' END, CASE WHEN needs_suggestions_vision THEN 'suggestions_vision' END], lambda x: x IS NOT NULL) AS tasks FROM p)"""


@query(f"WITH {PLAN} SELECT id, large AS large_doc, nt AS evidence_no_text_layer, array_to_string(tasks, ',') AS tasks FROM pl")
def pipeline_plan(s, d):
    return _plan(s, d).select("id", "large_doc", "evidence_no_text_layer", F.array_join("tasks", ",").alias("tasks"))


@query(f"""WITH {PLAN} SELECT count(*) AS docs, count_if(len(tasks) > 0) AS missing_docs, CAST(sum(len(tasks)) AS BIGINT) AS tasks, count_if(needs_evidence_index) AS missing_evidence_index, count_if(needs_vision) AS missing_vision, count_if(needs_embeddings) AS missing_embeddings,
  CAST(0 AS BIGINT) AS missing_embeddings_baseline, count_if(needs_embeddings) AS missing_embeddings_vision, count_if(needs_similarity) AS missing_similarity, count_if(needs_page_notes) AS missing_page_notes, count_if(needs_summary) AS missing_summary, count_if(needs_suggestions_baseline) AS missing_suggestions_baseline, count_if(needs_suggestions_vision) AS missing_suggestions_vision FROM pl""")
def process_missing_counts(s, d):
    return planner.process_missing(_plan(s, d))


@query(f"WITH {PLAN} SELECT id, page_count, array_to_string(tasks, ',') AS tasks FROM pl WHERE len(tasks) > 0 ORDER BY page_count NULLS LAST, id LIMIT 20")
def process_missing_preview(s, d):
    return planner.preview(_plan(s, d))


@query(f"""WITH {PLAN}, r AS (SELECT id, CAST(2 * len(list_filter(tasks, lambda t: contains(t, 'page_notes') OR contains(t, 'summary_hierarchical') OR contains(t, 'suggestions_vision') OR contains(t, 'vision_ocr') OR contains(t, 'embeddings_vision'))) + CASE WHEN large AND (needs_page_notes OR needs_summary) THEN 3 ELSE 0 END AS INTEGER) AS priority, CAST(len(tasks) AS INTEGER) AS n_tasks FROM pl WHERE len(tasks) > 0)
SELECT *, priority >= 3 AS is_high FROM r ORDER BY priority DESC, n_tasks DESC, id LIMIT 20""")
def preview_priority(s, d):
    return planner.preview_priority(_plan(s, d))


@query(f"""WITH {PLAN}, x AS (SELECT id, unnest([{{'step': 'evidence', 'required': NOT nt, 'done': NOT needs_evidence_index}}, {{'step': 'vision_ocr', 'required': true, 'done': NOT needs_vision}}, {{'step': 'embeddings', 'required': true, 'done': NOT needs_embeddings}}, {{'step': 'similarity', 'required': true, 'done': NOT needs_similarity}},
  {{'step': 'page_notes', 'required': large, 'done': NOT needs_page_notes}}, {{'step': 'suggestions', 'required': true, 'done': NOT (needs_suggestions_baseline OR needs_suggestions_vision)}}]) AS x FROM pl) SELECT id, x.step AS step, x.required AS required, x.done AS done FROM x""")
def pipeline_status(s, d):
    return planner.pipeline_status(_plan(s, d))


# ---- event windows (the batch form of the streams) ----


def _events(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2", prelude=False)
def events_tumbling(s, d):
    return stream.windowed_counts(_events(s, d), "6 hours")


@query("SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2", prelude=False)
def events_sliding(s, d):
    return stream.windowed_counts(_events(s, d), "12 hours", "6 hours")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM r GROUP BY user_id, k""", prelude=False)
def events_session(s, d):
    return stream.sessions(_events(s, d))


# ---- model text ----


@query(r"""SELECT conv_id, turn, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n_collapsed FROM conversations""", prelude=False)
def collapsed_turns(s, d):
    from foliant.functions.model_text import collapse

    return A.table(s, d, "conversations").select("conv_id", "turn", F.length(collapse(F.col("text"))).cast("long").alias("n_collapsed"))


@query(r"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '<\|[^>]+\|>', '', 'g'), '\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN length(t) > 120 THEN rtrim(substr(t, 1, 117)) || '...' ELSE t END AS summary FROM t""", prelude=False)
def summary_lines(s, d):
    from foliant.functions.model_text import summary_value

    return A.table(s, d, "conversations").select("conv_id", "turn", summary_value(F.col("text"), 120).alias("summary"))


@query()
def page_notes(s, d):
    from foliant.functions.model_text import parse_notes

    notes = A.table(s, d, "documents").select("doc_id", parse_notes(F.col("text")).alias("n"))
    return notes.select("doc_id", F.size("n.facts").alias("facts"), F.size("n.key_numbers").alias("numbers"), F.get("n.uncertainties", F.lit(0)).alias("note"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events", prelude=False)
def json_from_text(s, d):
    from foliant.functions.model_text import json_object

    noisy = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n``` done"))
    return A.table(s, d, "events").select("event_id", F.get_json_object(json_object(noisy), "$.k").alias("k"))
