"""Registered queries over states and read models: writeback, run log, pages, context, suggestions, lists and display."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import display
from foliant.operators import context, models, pages, planner, review, runlog, suggest, vectors, writeback
from foliant.plans import catalogue as C
from foliant.sources import adapters as A

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


# ---- writeback ----


def _remote(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    local, remote = C._sides(s, d)
    return local, remote.join(C._active(s, d).select(F.col("id").alias("doc_id"), "modified"), "doc_id")


def _items(s: SparkSession, d: str) -> DataFrame:
    return writeback.items(*_remote(s, d))


def _requests(s: SparkSession, d: str) -> DataFrame:
    k = F.col("id")
    known = F.when(k % 3 == 1, F.col("modified")).when(k % 3 == 2, "earlier")
    answers = F.when(k % 4 == 0, F.create_map(F.lit("title"), F.lit("use_remote"), F.lit("tags"), F.lit("skip"))).when(k % 4 == 1, F.create_map(F.lit("title"), F.lit("bogus")))
    return C._active(s, d).select(k.alias("doc_id"), known.alias("known_modified"), answers.alias("resolutions"))


def _decided(s: SparkSession, d: str) -> DataFrame:
    return writeback.resolve(_items(s, d), _requests(s, d))


DIFF = C.DIFF + """,
df4 AS (SELECT df3.*, a.document_date, a.correspondent_id, a.modified, CASE WHEN d_note THEN list_append(patch, 'note') ELSE patch END AS changed, doc_id % 3 = 2 AS moved,
  CASE WHEN doc_id % 3 = 0 THEN upper(a.title) ELSE ' ' || a.title END AS r_title, CASE WHEN doc_id % 2 = 0 THEN a.document_date END AS r_date, CASE WHEN doc_id % 8 != 0 THEN a.correspondent_id END AS r_corr,
  CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id AS VARCHAR) ELSE least(doc_id, 2) || ',' || greatest(doc_id, 2) END AS r_tags, CASE WHEN has_old THEN 'old' || chr(10) || 'AI summary' WHEN doc_id % 16 = 0 THEN note END AS r_note,
  CASE WHEN doc_id = 2 THEN '2' ELSE least(doc_id, 2) || ',' || greatest(doc_id, 2) END AS l_tags FROM df3 JOIN active a ON a.id = df3.doc_id),
act AS (SELECT doc_id, f, CASE WHEN doc_id % 4 = 0 AND f = 'title' THEN 'use_remote' WHEN doc_id % 4 = 0 AND f = 'tags' THEN 'skip' WHEN moved THEN 'skip' ELSE 'use_local' END AS a, i FROM (SELECT doc_id, moved, unnest(changed) AS f, generate_subscripts(changed, 1) AS i FROM df4)),
dec AS (SELECT df4.*, CASE WHEN len(changed) = 0 THEN 'no_changes' WHEN moved AND doc_id % 4 IN (2, 3) THEN 'conflicts' ELSE 'completed' END AS status FROM df4),
cl AS (SELECT doc_id, 1 AS o, 'PATCH' AS method, '/api/documents/' || doc_id || '/' AS path, '{' || array_to_string(list_filter([CASE WHEN d_title THEN '"title":' || to_json(trim(title)) END, CASE WHEN d_date THEN '"created":' || to_json(document_date) END, CASE WHEN d_corr THEN '"correspondent":' || correspondent_id END, CASE WHEN d_tags THEN '"tags":[' || l_tags || ']' END], lambda x: x IS NOT NULL), ',') || '}' AS payload FROM df4 WHERE len(patch) > 0
  UNION ALL SELECT doc_id, 2, 'DELETE', '/api/documents/' || doc_id || '/notes/?id=' || (doc_id + 7), '{}' FROM df4 WHERE d_note AND has_old UNION ALL SELECT doc_id, 3, 'POST', '/api/documents/' || doc_id || '/notes/', '{"note":' || to_json(note) || '}' FROM df4 WHERE d_note)"""


@query(f"WITH {DIFF} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS step, method, path, payload FROM cl")
def writeback_payloads(s, d):
    return writeback.payload_calls(_items(s, d))


@query(f"""WITH {DIFF} SELECT doc_id, status, coalesce((SELECT string_agg(f, ',' ORDER BY i) FROM act WHERE act.doc_id = dec.doc_id AND a = 'use_local' AND status = 'completed'), '') AS use_local,
  coalesce((SELECT string_agg(f, ',' ORDER BY i) FROM act WHERE act.doc_id = dec.doc_id AND a = 'use_remote' AND status = 'completed'), '') AS use_remote FROM dec""")
def writeback_resolved(s, d):
    return _decided(s, d).select("doc_id", "status", F.array_join("use_local", ",").alias("use_local"), F.array_join("use_remote", ",").alias("use_remote"))


@query(f"""WITH {DIFF}, x AS (SELECT doc_id, changed, unnest([{{'field': 'title', 'remote': r_title, 'local': nullif(trim(title), '')}}, {{'field': 'issue_date', 'remote': r_date, 'local': nullif(document_date, '')}}, {{'field': 'correspondent', 'remote': CAST(r_corr AS VARCHAR), 'local': CAST(correspondent_id AS VARCHAR)}},
  {{'field': 'tags', 'remote': r_tags, 'local': l_tags}}, {{'field': 'note', 'remote': r_note, 'local': note}}]) AS x FROM dec WHERE status = 'conflicts') SELECT doc_id, x.field AS field, x.remote AS remote, x."local" AS "local" FROM x WHERE list_contains(changed, x.field)""")
def writeback_conflicts(s, d):
    return writeback.conflicts(_decided(s, d))


@query(f"WITH {DIFF} SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND d_title THEN nullif(trim(r_title), '') ELSE title END AS title, document_date AS issue_date, correspondent_id, CASE WHEN doc_id = 2 THEN '2,2' ELSE doc_id || ',2' END AS tags, note FROM dec")
def writeback_use_remote(s, d):
    local, remote = _remote(s, d)
    return writeback.take_remote(local, remote, _decided(s, d)).select("doc_id", "title", "issue_date", "correspondent_id", F.array_join("tags", ",").alias("tags"), "note")


@query(f"WITH {DIFF}, p AS (SELECT doc_id, row_number() OVER (ORDER BY modified DESC, doc_id) - 1 AS position, changed, count(*) OVER () AS total_rows FROM df4) SELECT doc_id, position, total_rows, array_to_string(changed, ',') AS changed FROM p WHERE position >= 50 AND position < 100 AND len(changed) > 0")
def writeback_preview_page(s, d):
    ordered = C._active(s, d).select(F.col("id").alias("doc_id"), F.lit(0).alias("kind"), F.col("modified").alias("at"))
    page = writeback.preview_page(_items(s, d), writeback.candidate_positions(ordered), page=2, page_size=50, only_changed=True)
    return page.select("doc_id", "position", "total_rows", F.array_join("changed", ",").alias("changed"))


def _job_requests(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    asked = C._active(s, d).groupBy(F.floor(F.col("id") / 5).cast("long").alias("request_id")).agg(F.array_sort(F.collect_list("id")).alias("doc_ids"))
    status = F.when(F.col("request_id") % 3 == 0, "pending").when(F.col("request_id") % 3 == 1, "running").otherwise("completed")
    jobs = asked.where("request_id % 7 = 0").select((F.col("request_id") + 1000).alias("job_id"), status.alias("status"), F.to_json("doc_ids").alias("doc_ids_json"))
    return asked, jobs


@query(f"""WITH {DIFF}, rq AS (SELECT doc_id // 5 AS request_id, count(*) AS docs_selected, count_if(len(changed) > 0) AS docs_changed, CAST(sum(CAST(len(patch) > 0 AS INTEGER) + CAST(d_note AS INTEGER) + CAST(d_note AND has_old AS INTEGER)) AS BIGINT) AS calls_count FROM df4 GROUP BY 1),
j AS (SELECT *, CASE WHEN request_id % 7 = 0 AND request_id % 3 != 2 THEN request_id + 1000 END AS job_id FROM rq)
SELECT request_id, CASE WHEN job_id IS NOT NULL THEN 'existing' WHEN docs_changed = 0 THEN 'rejected' ELSE 'created' END AS outcome, job_id, CAST(docs_selected AS INTEGER) AS docs_selected, docs_changed, calls_count FROM j""")
def writeback_job_requests(s, d):
    asked, jobs = _job_requests(s, d)
    found = _items(s, d)
    return writeback.create_jobs(asked, jobs, found, writeback.payload_calls(found))


def _jobs(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    status = F.when(k % 4 == 0, "pending").when(k % 4 == 1, "running").when(k % 4 == 2, "completed").otherwise("failed")
    return A.table(s, d, "customer").select(k.alias("job_id"), status.alias("status"), F.when(k % 4 == 3, "late").alias("error"), F.lit(True).alias("dry_run"))


JOBS = "jb AS (SELECT c_custkey AS job_id, CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN c_custkey % 4 = 3 THEN 'late' END AS error FROM customer)"
RUN = f"""{JOBS}, pk AS (SELECT job_id FROM jb WHERE status = 'pending' ORDER BY job_id LIMIT 20),
ran AS (SELECT jb.job_id, CASE WHEN pk.job_id IS NULL THEN status WHEN jb.job_id % 8 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN pk.job_id IS NULL THEN error WHEN jb.job_id % 8 = 0 THEN 'boom' END AS error, pk.job_id IS NULL AS dry_run, pk.job_id IS NOT NULL AS processed FROM jb LEFT JOIN pk USING (job_id))"""


def _ran(s: SparkSession, d: str) -> DataFrame:
    jobs = _jobs(s, d)
    return writeback.execute_pending(jobs, jobs.where("job_id % 8 = 0").select("job_id", F.lit("boom").alias("error")), limit=20)


@query(f"WITH {RUN} SELECT * FROM ran")
def writeback_jobs_run(s, d):
    return _ran(s, d)


@query(f"WITH {RUN} SELECT count_if(processed) AS processed, count_if(processed AND status = 'completed') AS completed, count_if(processed AND status = 'failed') AS failed FROM ran")
def writeback_job_totals(s, d):
    return writeback.job_totals(_ran(s, d))


@query(f"WITH {JOBS} SELECT job_id, status FROM jb WHERE status IN ('completed', 'failed') ORDER BY job_id DESC LIMIT 500")
def writeback_job_history(s, d):
    return writeback.job_list(_jobs(s, d), 900, finished=True).select("job_id", "status")


@query(f"WITH {JOBS}, w AS (SELECT c_custkey AS job_id FROM customer UNION SELECT c_custkey + 100 FROM customer) SELECT w.job_id, CASE WHEN status IS NULL THEN 'absent' WHEN status = 'running' THEN 'refused' ELSE 'removed' END AS outcome FROM w LEFT JOIN jb USING (job_id)")
def writeback_job_delete(s, d):
    jobs = _jobs(s, d)
    return writeback.delete_jobs(jobs, jobs.select("job_id").union(jobs.select(F.col("job_id") + 100)))


@query(f"WITH {DIFF} SELECT doc_id, 'apply_to_document:writeback' AS action, 'writeback' AS source, modified AS created_at FROM df4 WHERE doc_id IN (SELECT doc_id FROM cl) OR len(changed) = 0")
def writeback_audit(s, d):
    found = _items(s, d)
    return writeback.audit_rows(writeback.payload_calls(found), _remote(s, d)[1], "2024-06-01T00:00:00Z", found)


def _pending(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers' clerks of urgent orders wait as correspondents, those of high ones as tags."""
    orders = A.table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Clerk"), F.col("o_custkey").cast("string")).alias("clerk"), "o_orderpriority")
    clerk, high = F.col("clerk"), orders.where("o_orderpriority = '2-HIGH'")
    return orders.where("o_orderpriority = '1-URGENT'").select("doc_id", F.concat(F.lit(" "), clerk).alias("name")), high.select("doc_id", F.array(F.lower(clerk), F.lit(""), F.concat(F.lit("Z"), clerk), clerk).alias("names"))


PENDING = DIFF + """,
pn AS (SELECT df4.*, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Clerk' || o_custkey END AS pc, CASE WHEN o_orderpriority = '2-HIGH' THEN ['Clerk' || o_custkey, 'clerk' || o_custkey, 'ZClerk' || o_custkey] ELSE [] END AS pt FROM df4 JOIN orders ON o_orderkey = doc_id)"""


@query(f"""WITH {PENDING} SELECT doc_id, array_to_string(list_filter([CASE WHEN d_title THEN 'title' END, CASE WHEN d_date THEN 'issue_date' END, CASE WHEN d_corr OR pc IS NOT NULL THEN 'correspondent' END, CASE WHEN d_tags OR len(pt) > 0 THEN 'tags' END, CASE WHEN d_note THEN 'note' END], lambda x: x IS NOT NULL), ',') AS changed,
  '{{' || array_to_string(list_filter([CASE WHEN d_title THEN '"title":' || to_json(trim(title)) END, CASE WHEN d_date THEN '"created":' || to_json(document_date) END, CASE WHEN d_corr OR pc IS NOT NULL THEN '"correspondent":' || coalesce(CAST(correspondent_id AS VARCHAR), 'null') END, CASE WHEN d_tags OR len(pt) > 0 THEN '"tags":[' || l_tags || ']' END,
  CASE WHEN d_corr OR pc IS NOT NULL THEN '"pending_correspondent_name":' || coalesce(to_json(pc), 'null') END, CASE WHEN d_tags OR len(pt) > 0 THEN '"pending_tag_names":' || to_json(pt) END], lambda x: x IS NOT NULL), ',') || '}}' AS payload FROM pn WHERE len(patch) > 0 OR pc IS NOT NULL OR len(pt) > 0""")
def writeback_pending_names(s, d):
    found = writeback.with_pending(_items(s, d), *_pending(s, d))
    calls = writeback.payload_calls(found).where("method = 'PATCH'").select("doc_id", "payload")
    return found.join(calls, "doc_id").select("doc_id", F.array_join("changed", ",").alias("changed"), "payload")


@query(f"""WITH {PENDING}, id AS (SELECT 'clerk' || o_custkey AS k, max(o_orderkey) AS id FROM orders GROUP BY 1)
SELECT doc_id, coalesce((SELECT id FROM id WHERE k = lower(pc)), correspondent_id) AS correspondent_id, CASE WHEN len(pt) > 0 THEN (SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT CAST(x AS BIGINT) AS x FROM (SELECT unnest(string_split(l_tags, ',')) AS x UNION ALL SELECT CAST((SELECT id FROM id WHERE k = lower(pt[1])) AS VARCHAR)))) ELSE l_tags END AS tags,
  CASE WHEN len(pt) > 0 THEN pt[3] ELSE '' END AS waiting FROM pn""")
def writeback_created_names(s, d):
    found = writeback.with_pending(_items(s, d), *_pending(s, d))
    known = A.table(s, d, "orders").select(F.concat(F.lit("Clerk"), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderkey").alias("id"))
    out = writeback.with_created(found, known, known)
    return out.select("doc_id", "correspondent_id", F.array_join("tags", ",").alias("tags"), F.concat_ws("|", "pending_correspondent", F.array_join("pending_tags", "|")).alias("waiting"))


@query(f"WITH {DIFF} SELECT doc_id FROM df4 WHERE NOT d_tags")
def pending_after_patch(s, d):
    pending = C._active(s, d).select(F.col("id").alias("doc_id"))
    return writeback.settle_pending(pending, writeback.payload_calls(_items(s, d)), "tags")


@query("SELECT a.id, CASE WHEN name IS NOT NULL THEN name || ' (#' || correspondent_id || ')' WHEN correspondent_id IS NOT NULL THEN '#' || correspondent_id ELSE '-' END AS correspondent, coalesce(nullif(title, ''), '-') AS title, coalesce(nullif(document_date, ''), '-') AS issue_date FROM active a LEFT JOIN corr ON corr.id = correspondent_id AND corr.id % 2 = 0")
def writeback_display(s, d):
    names = A.correspondents(s, d).where("id % 2 = 0").select(F.col("id").alias("correspondent_id"), "name")
    rows = C._active(s, d).join(names, "correspondent_id", "left")
    shown = writeback.display_value
    return rows.select("id", shown("correspondent", F.col("correspondent_id"), name=F.col("name")).alias("correspondent"), shown("title", F.col("title")).alias("title"), shown("issue_date", F.col("document_date")).alias("issue_date"))


# ---- run log and queue ----


@query("""SELECT doc_id AS id, arg_max(status, id) AS status, arg_max(checkpoint_json, id) FILTER (WHERE checkpoint_json IS NOT NULL) AS checkpoint_json, arg_max(error_message, id) FILTER (WHERE error_message IS NOT NULL) AS error_message FROM runs GROUP BY doc_id""")
def run_log_state(s, d):
    log = A.task_runs(s, d).select(F.col("doc_id").alias("id"), "status", "checkpoint_json", "error_message", F.col("id").alias("version"))
    return runlog.fold_log(log)


def _queue(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    entry = F.when(k % 3 == 0, F.concat(F.lit('{"doc_id": '), k.cast("string"), F.lit(', "task": "sync"}'))).when(k % 3 == 1, k.cast("string")).otherwise(F.col("c_name"))
    return A.table(s, d, "customer").select(k.cast("long").alias("position"), entry.alias("entry"))


QUEUE = "qu AS (SELECT CAST(c_custkey AS BIGINT) AS position, CASE c_custkey % 3 WHEN 0 THEN '{\"doc_id\": ' || c_custkey || ', \"task\": \"sync\"}' WHEN 1 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS entry FROM customer)"


@query(f"WITH {QUEUE} SELECT CASE WHEN position = 40 THEN 3 WHEN position >= 3 AND position < 40 THEN position + 1 ELSE position END AS position, entry FROM qu")
def queue_moved(s, d):
    return runlog.move_item(_queue(s, d), 40, 3)


@query(f"WITH {QUEUE} SELECT CASE WHEN position > 7 THEN position - 1 ELSE position END AS position, entry FROM qu WHERE position != 7")
def queue_removed(s, d):
    return runlog.remove_item(_queue(s, d), 7)


@query(f"WITH {QUEUE} SELECT position, CASE position % 3 WHEN 2 THEN NULL ELSE position END AS doc_id, CASE position % 3 WHEN 0 THEN 'sync' WHEN 1 THEN 'full' END AS task, CASE WHEN position % 3 = 2 THEN entry END AS raw FROM qu WHERE position < 50")
def queue_peek(s, d):
    return runlog.peek(_queue(s, d), 50)


@query("""WITH x AS (SELECT event_id, event_id % 2 AS length, event_id % 5 AS in_progress, event_id % 3 = 0 AS has_lock, CASE WHEN event_id % 7 > 0 THEN 1000 - event_id % 200 END AS heartbeat_at, CASE WHEN event_id % 11 > 0 THEN 1000 - event_id % 150 END AS running_since FROM events)
SELECT event_id, CASE WHEN in_progress > 0 AND length = 0 AND NOT has_lock AND (heartbeat_at IS NULL OR 1000 - heartbeat_at > 60) AND (running_since IS NULL OR 1000 - running_since > 60) THEN 0 ELSE in_progress END AS in_progress FROM x""", prelude=False)
def queue_healed(s, d):
    k = F.col("event_id")
    stats = A.table(s, d, "events").select(k, (k % 2).alias("length"), (k % 5).alias("in_progress"), (k % 3 == 0).alias("has_lock"), F.when(k % 7 > 0, 1000 - k % 200).alias("heartbeat_at"), F.when(k % 11 > 0, 1000 - k % 150).alias("running_since"))
    return runlog.healed(stats, 1000).select("event_id", "in_progress")


@query("""WITH p AS (SELECT id AS doc_id, page_count * 3 AS page_count, unnest(range(1, page_count * 3 + 1)) AS page FROM active WHERE page_count > 0), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS k FROM p WHERE page % 4 != 0)
SELECT doc_id, CAST(CASE WHEN page_count >= 300 THEN k // 5 WHEN page_count >= 120 THEN k // 10 ELSE 0 END AS INTEGER) AS batch, CAST(min(page) AS INTEGER) AS first, CAST(max(page) AS INTEGER) AS last, count(*) AS n FROM k GROUP BY 1, 2""")
def vision_batches(s, d):
    docs = C._active(s, d).where("page_count > 0").select(F.col("id").alias("doc_id"), (F.col("page_count") * 3).alias("page_count"))
    todo = docs.withColumn("page", F.explode(F.sequence(F.lit(1), F.col("page_count")))).where("page % 4 != 0")
    return runlog.batches(todo)


@query("""SELECT doc_id, md5(text) AS content_hash, CASE WHEN doc_id % 4 = 3 THEN false WHEN doc_id % 4 = 2 THEN false WHEN doc_id % 4 = 1 THEN false ELSE true END AS skip, CASE WHEN length(text) >= 12000 THEN 4 WHEN length(text) >= 6000 THEN 6 WHEN length(text) >= 2500 THEN 8 ELSE 16 END AS batch,
  CASE doc_id % 3 WHEN 0 THEN 'vision' WHEN 1 THEN 'both' ELSE 'vision' END AS source FROM documents""", prelude=False)
def embedding_skip(s, d):
    chunks = F.floor(F.length("text") / 10).cast("int")
    now = A.table(s, d, "documents").select("doc_id", F.md5("text").alias("content_hash"), F.lit("m1").alias("model"), chunks.alias("chunk_count"))
    k = F.col("doc_id") % 4
    stored = now.where(k != 3).select("doc_id", F.when(k == 1, "other").otherwise(F.col("content_hash")).alias("content_hash"), F.when(k == 2, "m0").otherwise("m1").alias("model"), "chunk_count")
    old = F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 3 == 1, "baseline").otherwise("vision")
    return runlog.unchanged_embedding(now, stored).select("doc_id", "content_hash", "skip", runlog.embed_batch_size(F.col("chunk_count")).alias("batch"), runlog.merged_source(old, F.lit("vision")).alias("source"))


@query("""WITH x AS (SELECT event_id AS name, event_id % 90 AS done, event_id % 60 AS total, 1000 - event_id % 7 AS started_at FROM events)
SELECT name, CASE WHEN total > 0 THEN round(100.0 * least(done, total) / total, 1) ELSE 0 END AS percent, CASE WHEN done > 0 AND started_at < 1000 THEN CAST(floor((1000 - started_at) / done * greatest(0, total - done)) AS BIGINT) END AS eta_seconds FROM x""", prelude=False)
def progress_states(s, d):
    k = F.col("event_id")
    state = A.table(s, d, "events").select(k.alias("name"), (k % 90).alias("done"), (k % 60).alias("total"), (1000 - k % 7).alias("started_at"))
    return runlog.progress(state, 1000).select("name", "percent", "eta_seconds")


# ---- pages ----


@query("SELECT doc_id, page, source FROM pages_t")
def page_text_layers(s, d):
    rows = A.page_texts(s, d).select("doc_id", "page", "source")
    return pages.layers(rows.where("source = 'text_layer'"), rows.where("source = 'vision_ocr'"))


@query("""WITH x AS (SELECT a.id, CASE WHEN page_count > 0 THEN page_count END AS expected, p.page FROM active a LEFT JOIN (SELECT DISTINCT doc_id, page FROM pages_t WHERE source = 'vision_ocr' AND page > 0) p ON p.doc_id = a.id),
g AS (SELECT id, expected, count_if(page IS NOT NULL AND (expected IS NULL OR page <= expected)) AS done, max(page) AS max_page FROM x GROUP BY 1, 2)
SELECT id, expected, done, CAST(greatest(0, expected - done) AS BIGINT) AS missing, coalesce(done >= expected, false) AS complete, round_even(done / expected * 100.0, 2) AS percent, max_page FROM (SELECT id, expected, done, max_page FROM g) WHERE expected IS NOT NULL
UNION ALL SELECT id, NULL, done, NULL, false, NULL, max_page FROM g WHERE expected IS NULL""")
def vision_coverage(s, d):
    return pages.coverage(C._active(s, d), A.page_texts(s, d), "vision_ocr")


@query(r"""WITH x AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN text END AS raw, CASE WHEN doc_id % 3 != 0 THEN regexp_replace(text, '\s+', ' ', 'g') END AS clean, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.5)) END AS tokens,
  regexp_replace(text, '\s+', ' ', 'g') AS good FROM documents)
SELECT count(*) AS processed, count_if(raw IS NULL OR clean IS NULL OR tokens != CASE WHEN length(good) = 0 THEN 0 ELSE greatest(1, floor(length(good) / 3.5)) END) AS updated FROM x""".replace("count_if(", "count(*) FILTER (WHERE "), prelude=False)
def reclean_totals(s, d):
    clean = lambda c: F.regexp_replace(c, r"\s+", " ")
    k, text = F.col("doc_id"), F.col("text")
    tokens = pages.estimate_tokens(text)
    stored = A.table(s, d, "documents").select(k, text, F.when(k % 2 == 0, text).alias("raw_text"), F.when(k % 3 != 0, clean(text)).alias("clean_text"), tokens.alias("token_estimate_raw"), tokens.alias("token_estimate_clean"))
    return pages.reclean_totals(pages.reclean(stored, clean))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'stored ' || doc_id ELSE NULL END AS text FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'plain ' || doc_id FROM documents WHERE doc_id % 3 != 0", prelude=False)
def page_text_pick(s, d):
    k = F.col("doc_id")
    clean = F.when(k % 3 == 0, F.concat(F.lit("stored "), k.cast("string"))).when(k % 3 == 1, "  ")
    return A.table(s, d, "documents").select("doc_id", pages.text_of(clean, F.concat(F.lit(" plain  "), k.cast("string"), F.lit("\n"))).alias("text"))


@query("""WITH c AS (SELECT vec_id // 4 AS doc_id, CAST(vec_id % 4 AS BIGINT) AS chunk, label FROM embeddings UNION ALL SELECT DISTINCT vec_id // 4, -1, 0 FROM embeddings), p AS (SELECT * FROM c WHERE NOT (chunk >= 0 AND doc_id % 3 = 0) AND doc_id % 2 = 0)
SELECT doc_id, chunk FROM p WHERE chunk >= 0 OR doc_id NOT IN (SELECT doc_id FROM p WHERE chunk >= 0)""", prelude=False)
def stored_vectors(s, d):
    chunks = C._chunks(s, d).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "embedding")
    central = chunks.where("chunk = 0").withColumn("chunk", F.lit(-1).cast("long"))
    points = chunks.where("doc_id % 3 != 0").unionByName(central)
    return pages.stored_vectors(points, chunks.where("doc_id % 2 = 0").select("doc_id")).select("doc_id", "chunk")


@query()
def chunk_semantic(s, d):
    docs = A.table(s, d, "documents").select("doc_id", "text")
    rows = pages.page_chunks(docs, docs.limit(0).select("doc_id", F.lit(1).alias("page"), F.lit("").alias("source"), F.lit(1).alias("quality"), "text"), mode="semantic", least=0.3)
    return rows.select("doc_id", "chunk", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def _boxed(s: SparkSession, d: str) -> DataFrame:
    """Turns as pages whose words stand in lines of ten."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    boxed = F.transform(words, lambda w, i: F.struct(w.alias("text"), F.array((i % 10).cast("double"), F.floor(i / 10).cast("double"), (i % 10 + 0.9).cast("double"), (F.floor(i / 10) + 0.9).cast("double")).alias("bbox")))
    return A.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), boxed.alias("words"))


@query()
def chunk_word_boxes(s, d):
    return pages.word_chunks(_boxed(s, d), max_chars=120, overlap=30).select("doc_id", "page", "chunk", "text", F.array_join(F.transform("bbox", lambda v: v.cast("string")), ",").alias("bbox"))


@query("""WITH w AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page, len(list_filter(string_split(text, ' '), lambda w: w != '')) AS n FROM conversations)
SELECT doc_id, page, 0.0 AS x0, 0.0 AS y0, round(least(n - 1, 9) + 0.9, 3) AS x1, round((n - 1) // 10 + 0.9, 3) AS y1 FROM w WHERE n > 0""", prelude=False)
def page_box_hull(s, d):
    box = pages.hull(F.transform("words", lambda w: w["bbox"]))
    rows = _boxed(s, d).select("doc_id", "page", box.alias("b")).where("b IS NOT NULL")
    return rows.select("doc_id", "page", *[F.round(F.get("b", F.lit(i)), 3).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query()
def citation_boxes(s, d):
    from foliant.operators import search

    anchors = _boxed(s, d)
    cited = A.table(s, d, "conversations").where("length(text) > 60").select((F.col("conv_id") * 100 + F.col("turn")).alias("ordinal"), F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.upper(F.substring("text", 20, 30)).alias("snippet"))
    found = search.match_citations(cited, anchors)
    return found.select("ordinal", "doc_id", "page", F.array_join(F.transform("bbox", lambda v: v.cast("string")), ",").alias("bbox"), F.round("score", 6).alias("score"))


# ---- context ----


@query(r"""WITH t AS (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations) SELECT conv_id, trim(left(string_agg(t, chr(10) || chr(10) ORDER BY turn), 400), ' ' || chr(9) || chr(10) || chr(13)) AS context FROM t WHERE t != '' GROUP BY conv_id""", prelude=False)
def context_limited(s, d):
    rows = A.table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return rows.where(F.exists("t", lambda t: F.trim(t) != "")).select("conv_id", context.join_limited(F.col("t"), 400).alias("context"))


NOTES = r"""nt AS (SELECT conv_id AS doc_id, turn AS page, trim(replace(replace(text, chr(10), ' '), '"', ''), ' ') AS t, turn % 3 AS k FROM conversations WHERE turn % 5 != 4),
bl AS (SELECT doc_id, page, 'Page ' || page || ': ' || CASE k WHEN 0 THEN t WHEN 1 THEN 'facts: ' || t || '; second' || chr(10) || 'entities: x' ELSE t END AS b FROM nt WHERE t != ''),
nc AS (SELECT doc_id, trim(left(string_agg(b, chr(10) || chr(10) ORDER BY page), 500), ' ' || chr(10)) AS context FROM bl GROUP BY doc_id)"""


def _notes(s: SparkSession, d: str) -> DataFrame:
    t = F.trim(F.translate("text", '\n"', " "))
    as_text, as_lists = F.to_json(F.struct(t.alias("text"))), F.to_json(F.struct(F.array(t, F.lit(" "), F.lit("second")).alias("facts"), F.array(F.lit("x")).alias("entities")))
    raw = F.when(F.col("turn") % 3 == 0, as_text).when(F.col("turn") % 3 == 1, as_lists).otherwise(t)
    rows = A.table(s, d, "conversations").where(t != "")
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.lit("vision_ocr").alias("source"), F.when(F.col("turn") % 5 == 4, "error").otherwise("ok").alias("status"), raw.alias("notes_text"))


@query(f"WITH {NOTES} SELECT * FROM nc", prelude=False)
def context_notes(s, d):
    return context.notes_context(_notes(s, d), "vision_ocr", 500)


@query(f"""WITH {NOTES}, f AS (SELECT conv_id AS doc_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1)
SELECT f.doc_id, CASE f.doc_id % 4 WHEN 0 THEN 'Executive summary: short' || chr(10) || chr(10) || 'Summary: doc ' || f.doc_id || chr(10) || chr(10) || 'Key facts: a; b' ELSE CASE WHEN f.doc_id % 3 = 0 OR context IS NULL THEN f.text ELSE context END END AS context FROM f LEFT JOIN nc USING (doc_id)""", prelude=False)
def context_chain(s, d):
    full = A.table(s, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min_by("text", "turn").alias("text"))
    k = F.col("doc_id")
    payload = F.when(k % 4 == 0, F.concat(F.lit('{"executive_summary": " short", "summary": "doc '), k.cast("string"), F.lit('", "key_facts": ["a", " ", "b"], "source": "vision_ocr"}'))).when(k % 4 == 1, '{"summary": "other layer", "source": "text_layer"}').when(k % 4 == 2, '{"confidence_notes": ["global_summary_error: x"]}').otherwise("not json")
    noted = context.notes_context(_notes(s, d), "vision_ocr", 500).where("doc_id % 3 != 0").withColumnRenamed("context", "noted")
    return full.join(noted, "doc_id", "left").select("doc_id", context.choose(context.summary_context(payload, "vision_ocr"), F.col("noted"), F.col("text")).alias("context"))


@query("SELECT doc_id, CASE WHEN length(text) > 350 THEN substr(text, 1, 350) || chr(10) || '[TRUNCATED]' ELSE text END AS text FROM documents", prelude=False)
def truncate_tokens(s, d):
    return A.table(s, d, "documents").select("doc_id", context.truncate_tokens(F.col("text"), 100).alias("text"))


@query("""WITH x AS (SELECT conv_id AS doc_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations), f AS (SELECT doc_id, list(CASE WHEN length(t) > 320 THEN rtrim(left(t, 317)) || '...' ELSE t END ORDER BY turn) AS l FROM x WHERE t != '' GROUP BY doc_id)
SELECT doc_id, len(list_slice(list_distinct(l), 1, 8)) AS n_facts FROM f""", prelude=False)
def section_fallbacks(s, d):
    rows = A.table(s, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    none = F.array().cast("array<string>")
    made = rows.select("doc_id", context.section_summary(F.lit("1-9"), F.col("t"), none, none, "no_model").alias("s"))
    return made.where(F.size("s.key_facts") > 0).select("doc_id", F.size("s.key_facts").cast("long").alias("n_facts"))


# ---- suggestions ----


def _edits(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    field = F.when(k % 3 == 0, "title").when(k % 3 == 1, "date").otherwise("note")
    value = F.when(k % 15 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit(" new "), k.cast("string")))
    return A.table(s, d, "orders").where("o_orderstatus = 'O'").select(k.alias("doc_id"), field.alias("field"), value.alias("value"), F.when(k % 2 == 0, "vision_ocr").alias("source"))


@query("""SELECT d.id, CASE WHEN e.o_orderkey IS NULL OR id % 3 != 0 THEN title WHEN id % 15 = 0 THEN NULL ELSE 'new ' || id END AS title, CASE WHEN e.o_orderkey IS NULL OR id % 3 != 1 THEN document_date WHEN id % 15 = 0 THEN NULL ELSE 'new ' || id END AS document_date
FROM active d LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') e ON e.o_orderkey = d.id""")
def suggestion_apply(s, d):
    return suggest.apply_scalars(C._active(s, d).select("id", "title", "document_date"), _edits(s, d))


@query("SELECT o_orderkey AS doc_id, 'apply_to_document:' || CASE o_orderkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'date' ELSE 'note' END AS action, CASE WHEN o_orderkey % 2 = 0 THEN 'vision_ocr' ELSE 'manual' END AS source, 'now' AS created_at FROM orders WHERE o_orderstatus = 'O'")
def suggestion_audit(s, d):
    return suggest.edit_audit(_edits(s, d), "now")


@query("""WITH w AS (SELECT p_partkey AS doc_id, unnest(['  ' || p_type, lower(p_brand || ' ' || p_type), 'Zeta ' || p_brand, 'zeta ' || p_brand, '']) AS name FROM part), c AS (SELECT doc_id, trim(name) AS name, lower(trim(name)) AS k FROM w WHERE trim(name) != ''),
t AS (SELECT lower(trim(name)) AS k, min(id) AS id FROM tags GROUP BY 1), r AS (SELECT c.*, t.id FROM c LEFT JOIN t USING (k)), p AS (SELECT doc_id, k, min(name) AS name FROM r WHERE id IS NULL GROUP BY 1, 2)
SELECT r.doc_id, (SELECT string_agg(DISTINCT x.id, ',' ORDER BY x.id) FROM r x WHERE x.doc_id = r.doc_id) AS tag_ids, coalesce((SELECT string_agg(name, '|' ORDER BY k) FROM p WHERE p.doc_id = r.doc_id), '') AS pending_names FROM (SELECT DISTINCT doc_id FROM r) r""")
def suggestion_tags(s, d):
    both = F.concat_ws(" ", "p_brand", "p_type")
    edits = A.table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.array(F.concat(F.lit("  "), "p_type"), F.lower(both), F.concat(F.lit("Zeta "), "p_brand"), F.concat(F.lit("zeta "), "p_brand"), F.lit("")).alias("names"))
    return suggest.apply_tags(edits, A.tags(s, d)).select("doc_id", F.array_join("tag_ids", ",").alias("tag_ids"), F.array_join("pending_names", "|").alias("pending_names"))


def _stored(s: SparkSession, d: str) -> DataFrame:
    rows = A.suggestions(s, d)
    return rows.select("doc_id", "source", F.concat(F.lit("m-"), (F.col("doc_id") % 4).cast("string")).alias("model_name"), F.when(F.col("doc_id") % 6 != 0, F.col("processed_at")).alias("processed_at"), F.concat(F.lit('{"title": "T'), F.col("doc_id").cast("string"), F.lit('", "parsed": {"title": "P"}}')).alias("payload"))


STORED = "st AS (SELECT doc_id, source, 'm-' || doc_id % 4 AS model_name, CASE WHEN doc_id % 6 != 0 THEN processed_at END AS processed_at FROM sugg)"


@query(f"WITH {STORED} SELECT doc_id, source, model_name, processed_at FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY processed_at DESC NULLS LAST, source) AS n FROM st) WHERE n = 1")
def suggestion_meta(s, d):
    return suggest.latest_meta(_stored(s, d))


@query("SELECT doc_id, source, 'title' AS field, CASE WHEN doc_id % 2 = 0 THEN 'N' || doc_id END AS new_title, CASE WHEN doc_id % 2 = 0 THEN 'N' || doc_id END AS new_parsed, '\"T' || doc_id || '\"' AS old_value FROM sugg WHERE doc_id % 3 = 0")
def suggestion_override(s, d):
    stored = _stored(s, d)
    edits = stored.where("doc_id % 3 = 0").select("doc_id", "source", F.lit("title").alias("field"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"N'), F.col("doc_id").cast("string"), F.lit('"'))).alias("value"))
    out = suggest.override_field(stored, edits)
    return out.select("doc_id", "source", "field", F.get_json_object("payload", "$.title").alias("new_title"), F.get_json_object("payload", "$.parsed.title").alias("new_parsed"), "old_value")


@query("SELECT doc_id, count(*) AS n_sources, min(source) AS first_source FROM sugg GROUP BY doc_id")
def suggestion_map(s, d):
    rows = suggest.by_source(_stored(s, d))
    return rows.select("doc_id", F.size("suggestions").cast("long").alias("n_sources"), F.get(F.map_keys("suggestions"), F.lit(0)).alias("first_source"))


@query("SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 AND source = 'vision_ocr' THEN 'fresh' ELSE 'stored' END AS origin FROM sugg UNION ALL SELECT DISTINCT doc_id, 'vision_ocr', 'fresh' FROM sugg WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM sugg WHERE source = 'vision_ocr')")
def suggestion_refresh(s, d):
    stored = _stored(s, d)
    fresh = stored.where("doc_id % 3 = 0").select("doc_id").distinct().select("doc_id", F.lit("vision_ocr").alias("source"), F.lit("{}").alias("payload"))
    return suggest.refreshed(stored, fresh).select("doc_id", "source", "origin")


@query("SELECT doc_id, arg_max(model_name, created_at || model_name) AS model_name FROM pages_t WHERE source = 'vision_ocr' GROUP BY doc_id")
def vision_models(s, d):
    return suggest.layer_model(A.page_texts(s, d).withColumnRenamed("created_at", "processed_at"), "vision_ocr")


@query("""SELECT id, trim(title) || chr(10) || chr(10) || CASE WHEN id % 11 != 0 THEN 'Model:' || document_type || CASE WHEN created IS NULL THEN '' ELSE ', ' END ELSE '' END || CASE WHEN created IS NULL THEN '' ELSE 'Created:' || replace(substr(created, 1, 19), 'T', ' ') END || CASE WHEN id % 11 = 0 AND created IS NULL THEN '' ELSE chr(10) END || 'AI summary' AS note FROM active""")
def summary_notes(s, d):
    return C._active(s, d).select("id", suggest.summary_note(F.col("title"), F.col("document_type"), F.col("created")).alias("note"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || '?|b' WHEN 1 THEN event_type || '|second' WHEN 2 THEN 'only' ELSE '' END AS questions FROM events""", prelude=False)
def followup_questions(s, d):
    k, t = F.col("event_id") % 4, F.col("event_type")
    answer = F.when(k == 0, F.concat(F.lit('[" '), t, F.lit('?", "", "b"]'))).when(k == 1, F.concat(F.lit('{"questions": [], "followups": ["'), t, F.lit('", "second"]}'))).when(k == 2, '{"questions": [" only "]}').otherwise("none at all")
    return A.table(s, d, "events").select("event_id", F.array_join(suggest.follow_ups(answer), "|").alias("questions"))


# ---- read models ----


def _list(s: SparkSession, d: str) -> DataFrame:
    local, remote = _remote(s, d)
    return models.list_model(local, remote, correspondents=A.correspondents(s, d), flags=C._flags(s, d), reviewed=review.latest_review(C._audit(s, d)), suggested=A.suggestions(s, d))


LIST = DIFF + f""", {C.AUDIT}, ov AS (SELECT df4.*, d_tags OR d_title OR d_corr OR coalesce(note, '') != coalesce(r_note, '') AS over FROM df4),
ls AS (SELECT o.doc_id, CASE WHEN over THEN title ELSE r_title END AS title, CASE WHEN over THEN correspondent_id ELSE r_corr END AS correspondent_id, over AS local_overrides, f.has_embedding AS has_embeddings, f.has_vision AS has_vision_pages, f.has_suggestion AS has_suggestions,
  CASE WHEN over THEN 'needs_review' WHEN reviewed_at IS NULL THEN 'unreviewed' WHEN CAST(replace(modified, 'Z', '') AS TIMESTAMP) > CAST(replace(reviewed_at, 'Z', '') AS TIMESTAMP) THEN 'needs_review' ELSE 'reviewed' END AS review_status
  FROM ov o JOIN (SELECT id, has_embedding, has_vision, has_suggestion FROM flags) f ON f.id = o.doc_id LEFT JOIN rev ON rev.doc_id = o.doc_id)"""
LIST_COLUMNS = ["doc_id", "title", "correspondent_id", "local_overrides", "has_embeddings", "has_vision_pages", "has_suggestions", "review_status"]


@query(f"WITH {LIST} SELECT * FROM ls")
def document_list(s, d):
    return _list(s, d).select(*LIST_COLUMNS)


@query(f"""WITH {LIST}, k AS (SELECT * FROM ls WHERE review_status = 'unreviewed') SELECT doc_id, title, (SELECT count(*) FROM k) AS count, CASE WHEN (SELECT count(*) FROM k) > 60 THEN 'filtered' END AS "next", 'filtered' AS previous FROM k ORDER BY doc_id LIMIT 30 OFFSET 30""")
def document_list_page(s, d):
    return models.filtered_page(_list(s, d), "unreviewed", [F.col("doc_id")], page=2, page_size=30).select("doc_id", "title", "count", "next", "previous")


@query(f"WITH {LIST} SELECT review_status, count(*) AS n FROM ls GROUP BY 1")
def review_filter(s, d):
    rows = _list(s, d)
    kept = rows.where(F.lit(models.valid_status("nonsense") == "all"))
    return kept.groupBy("review_status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LIST}, v AS (SELECT doc_id, count(DISTINCT page) AS n FROM pages_t WHERE source = 'vision_ocr' GROUP BY 1), n AS (SELECT doc_id, count(DISTINCT CASE WHEN source = 'text_layer' THEN page END) AS b, count(DISTINCT CASE WHEN source = 'vision_ocr' THEN page END) AS v FROM pages_t WHERE doc_id % 8 != 0 GROUP BY 1),
g AS (SELECT doc_id, bool_or(source = 'text_layer') AS b, bool_or(source = 'vision_ocr') AS v FROM sugg GROUP BY 1), t AS (SELECT document_id AS doc_id, count(*) AS n FROM doc_tags GROUP BY 1), x AS (SELECT a.*, CASE WHEN page_count > 0 THEN page_count END AS e FROM active a)
SELECT x.id, corr.name AS correspondent_name, coalesce(CAST(t.n AS INTEGER), 0) AS n_tags, emb.doc_id IS NOT NULL AS has_embeddings, coalesce(chunk_count, 0) AS embedding_chunk_count, coalesce(chunk_count > 0 AND embedding_source IN ('vision', 'both'), false) AS has_embedding_for_preferred_source,
  coalesce(g.b, false) AS has_suggestions_baseline, coalesce(g.v, false) AS has_suggestions_vision, coalesce(v.n, 0) AS vision_pages_done, CASE WHEN e IS NOT NULL THEN coalesce(v.n, 0) >= e ELSE coalesce(v.n, 0) > 0 END AS has_complete_vision_pages,
  coalesce(n.b, 0) AS page_notes_baseline_done, coalesce(n.v, 0) AS page_notes_vision_done, coalesce(page_count, 0) >= 20 AS is_large_document, ls.review_status, CASE WHEN x.id % 2 = 0 THEN 'stale' ELSE 'synced' END AS sync_status
FROM x LEFT JOIN corr ON corr.id = x.correspondent_id LEFT JOIN t ON t.doc_id = x.id LEFT JOIN emb ON emb.doc_id = x.id LEFT JOIN g ON g.doc_id = x.id LEFT JOIN v ON v.doc_id = x.id LEFT JOIN n ON n.doc_id = x.id JOIN ls ON ls.doc_id = x.id""".replace("CASE WHEN x.id % 2 = 0 THEN 'stale' ELSE 'synced' END", "'synced'"))
def document_detail(s, d):
    local, remote = _remote(s, d)
    over = local.alias("l").join(remote.alias("r"), "doc_id").where(review.has_overrides()).select("doc_id")
    notes = A.page_texts(s, d).select("doc_id", "page", "source", F.when(F.col("doc_id") % 8 == 0, "error").otherwise("ok").alias("status"))
    out = models.detail_model(C._active(s, d), remote=remote, correspondents=A.correspondents(s, d), tags=A.document_tags(s, d), embedded=A.embeddings_done(s, d), suggested=A.suggestions(s, d), page_texts=A.page_texts(s, d), notes=notes, reviewed=review.latest_review(C._audit(s, d)), overrides=over)
    return out.select("id", "correspondent_name", F.size("tags").alias("n_tags"), "has_embeddings", "embedding_chunk_count", "has_embedding_for_preferred_source", "has_suggestions_baseline", "has_suggestions_vision", "vision_pages_done", "has_complete_vision_pages", "page_notes_baseline_done", "page_notes_vision_done", "is_large_document", "review_status", "sync_status")


@query("""WITH h AS (SELECT vec_id AS doc_id, label FROM embeddings WHERE label < 4) SELECT h.doc_id, a.title, a.document_date, corr.name AS correspondent FROM h LEFT JOIN active a ON a.id = h.doc_id LEFT JOIN corr ON corr.id = a.correspondent_id""")
def hit_titles(s, d):
    hits = C._points(s, d).where("label < 4").select(F.col("vec_id").alias("doc_id"))
    return models.with_titles(hits, C._active(s, d), A.correspondents(s, d)).select("doc_id", "document.title", "document.document_date", "document.correspondent")


@query(f"WITH {C.PAIRS} SELECT query_id, vec_id AS doc_id, score, a.title FROM rk LEFT JOIN active a ON a.id = rk.vec_id WHERE rank <= 3")
def similar_titles(s, d):
    near = C._neighbours(s, d, 3).select("query_id", F.col("vec_id").alias("doc_id"), "score")
    return models.with_titles(near, C._active(s, d), A.correspondents(s, d)).select("query_id", "doc_id", "score", "document.title")


@query("SELECT emb.doc_id, title, chunk_count FROM emb JOIN docs ON docs.id = emb.doc_id")
def embedded_titles(s, d):
    return models.embedded_titles(A.embeddings_done(s, d), A.documents(s, d)).select("doc_id", "title", "chunk_count")


@query("SELECT doc_id, page, source, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY page, source, model_name) - 1) // 2 + 1 AS INTEGER) AS list_page FROM pages_t")
def page_text_paging(s, d):
    return models.page_numbers(A.page_texts(s, d), "doc_id", [F.col("page"), F.col("source"), F.col("model_name")], 2).select("doc_id", "page", "source", "list_page")


@query("""SELECT f.id FROM flags f WHERE (has_embedding OR has_suggestion OR has_vision) AND EXISTS (SELECT 1 FROM (SELECT doc_id, max(model_name) AS m FROM pages_t GROUP BY 1) p WHERE p.doc_id = f.id AND contains(lower(m), 'el-o'))""")
def analysed_documents(s, d):
    from foliant.operators import corpus

    named = A.page_texts(s, d).groupBy(F.col("doc_id").alias("id")).agg(F.max("model_name").alias("model_name"))
    return corpus.analysed(C._flags(s, d).join(named, "id", "left"), "analyzed", " EL-O ").select("id")


# ---- planner ----

BOTH = (
    C.PLAN.replace("coalesce(embedding_source, '') NOT IN ('vision', 'both') AS nev FROM g", "coalesce(embedding_source, '') NOT IN ('vision', 'both') AS nev, coalesce(embedding_source, '') NOT IN ('baseline', 'both') AS neb FROM g")
    .replace("nev AS needs_embeddings, nev OR (", "nev OR neb AS needs_embeddings, neb, nev, nev OR neb OR (")
    .replace("CASE WHEN needs_embeddings THEN 'embeddings_vision' END", "CASE WHEN neb THEN 'embeddings_baseline' END, CASE WHEN nev THEN 'embeddings_vision' END")
)


@query(f"WITH {BOTH} SELECT id, array_to_string(tasks, ',') AS tasks FROM pl")
def pipeline_plan_both(s, d):
    return planner.evaluate(C._facts(s, d), planner.PlanOptions(embeddings_mode="both")).select("id", F.array_join("tasks", ",").alias("tasks"))


@query(f"WITH {C.PLAN} SELECT id, array_to_string(list_filter(tasks, lambda t: t NOT IN ('similarity_index', 'suggestions_vision', 'evidence_index')), ',') AS tasks FROM pl")
def pipeline_plan_partial(s, d):
    options = planner.PlanOptions(similarity=False, suggestions_vision=False, evidence=False)
    return planner.evaluate(C._facts(s, d), options).select("id", F.array_join("tasks", ",").alias("tasks"))


@query(f"WITH {C.PLAN} SELECT id AS doc_id, CAST(generate_subscripts(tasks, 1) - 1 AS INTEGER) AS position, unnest(tasks) AS task FROM pl")
def pipeline_continue(s, d):
    return planner.continued(C._plan(s, d))


@query("""WITH st AS (SELECT vec_id // 4 AS doc_id, vec_id % 4 AS chunk FROM embeddings WHERE label NOT IN (1, 2)), ex AS (SELECT DISTINCT vec_id // 4 AS doc_id FROM embeddings), w AS (SELECT doc_id, unnest(range(0, 4)) AS chunk FROM ex),
p AS (SELECT w.doc_id, count(*) AS expected, count(st.chunk) AS found FROM w LEFT JOIN st USING (doc_id, chunk) GROUP BY w.doc_id)
SELECT count(*) FILTER (WHERE found = 0) AS fully_missing, count(*) FILTER (WHERE found > 0) AS partially_missing, CAST(coalesce(sum(expected - found), 0) AS BIGINT) AS missing_vectors FROM p WHERE found < expected""", prelude=False)
def vector_totals(s, d):
    return vectors.integrity_totals(C.QUERIES["vector_integrity"](s, d))


# ---- display ----


@query("""SELECT id, array_to_string(list_filter([CASE WHEN NOT has_embedding THEN 'Embeddings' END, CASE WHEN NOT has_vision THEN 'Vision OCR' END, CASE WHEN NOT has_suggestion THEN 'Suggestions (text)' END, CASE WHEN has_vision AND id % 2 = 0 THEN 'Suggestions (vision)' END, CASE WHEN id % 3 = 0 THEN 'Local cache' END], lambda x: x IS NOT NULL), ',') AS badges FROM flags""")
def missing_badges(s, d):
    c = F.col
    return C._flags(s, d).select("id", F.array_join(display.missing_badges(c("has_embedding"), c("has_vision"), c("has_suggestion"), c("id") % 2 != 0, c("id") % 3 != 0), ",").alias("badges"))


@query("""WITH x AS (SELECT event_id, event_id * 37 % 200000 AS s FROM events) SELECT event_id, CASE WHEN s < 10 THEN 'just now' WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS age,
  CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s // 3600 || 'h ' || s // 60 % 60 || 'm' END AS runtime, CASE WHEN event_id % 9 = 0 THEN '-' WHEN s < 60 THEN s || 's' ELSE s // 60 || 'm ' || s % 60 || 's' END AS due FROM x""", prelude=False)
def durations(s, d):
    sec = F.col("event_id") * 37 % 200_000
    return A.table(s, d, "events").select("event_id", display.relative_age(sec).alias("age"), display.runtime(sec).alias("runtime"), display.due_in(F.when(F.col("event_id") % 9 != 0, sec)).alias("due"))


@query(r"""WITH x AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, text FROM conversations) SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN '-' WHEN length(t) > 100 THEN substr(t, 1, 97) || '...' ELSE t END AS message, CASE WHEN length(t) <= 14 THEN t ELSE left(t, 8) || '...' || right(t, 4) END AS short FROM x""", prelude=False)
def compact_messages(s, d):
    text = F.col("text")
    return A.table(s, d, "conversations").select("conv_id", "turn", display.compact(text).alias("message"), display.short_id(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), "^ +| +$", "")).alias("short"))


@query("""SELECT event_id, 'see <sup><a href="/doc/' || user_id || '">[1]</a></sup> and ' || CASE WHEN event_id % 2 = 0 THEN '<sup><a href="/b">[12]</a></sup>' ELSE '[12]' END || ' not [3]' AS answer FROM events""", prelude=False)
def citation_links(s, d):
    first = F.concat(F.lit("/doc/"), F.col("user_id").cast("string"))
    links = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit(1), first, F.lit(12), F.lit("/b"))).otherwise(F.create_map(F.lit(1), first))
    return A.table(s, d, "events").select("event_id", display.link_citations(F.lit("see [1] and [12] not [3]"), links).alias("answer"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' ' || event_id || ' ' WHEN 1 THEN event_type WHEN 2 THEN '-3' END AS t FROM events)
SELECT event_id, TRY_CAST(trim(t) AS BIGINT) AS as_int, TRY_CAST(trim(t) AS DOUBLE) AS as_float, CASE WHEN TRY_CAST(trim(t) AS BIGINT) > 0 THEN TRY_CAST(trim(t) AS BIGINT) END AS doc_id, CASE WHEN event_id % 4 = 0 THEN event_id END AS note_id, greatest(0.5, least(1.0, event_id / 1000.0)) AS similarity FROM x""", prelude=False)
def typed_values(s, d):
    k = F.col("event_id")
    t = F.when(k % 4 == 0, F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).when(k % 4 == 1, F.col("event_type")).when(k % 4 == 2, "-3")
    path = F.when(k % 4 == 0, F.concat(F.lit("/api/documents/5/notes/?id="), k.cast("string"))).otherwise("/api/documents/5/notes/?id=x")
    return A.table(s, d, "events").select(k, display.as_int(t).alias("as_int"), display.as_float(t).alias("as_float"), display.as_doc_id(t).alias("doc_id"), display.note_id_of(path).alias("note_id"), display.clamp(k / 1000.0, 0.5, 1.0).alias("similarity"))
