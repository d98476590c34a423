"""The life of a change that is written back: items, conflicts, calls with payloads, jobs and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.ranks import ranked
from foliant.operators.review import FIELDS, change_plan, tag_set

ACTIONS = ("skip", "use_remote", "use_local")
OPEN = ("pending", "running")


def scalar(c: Column) -> Column:
    """A value as trimmed text; null is ''."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def items(local: DataFrame, remote: DataFrame, *, marker: str = "AI summary") -> DataFrame:
    """change_plan() with what stands on the other side, a struct `original`, and the remote `modified`."""
    plan = change_plan(local, remote, marker=marker)
    other = remote.select("doc_id", F.struct("title", "issue_date", "correspondent_id", tag_set(F.col("tags")).alias("tags"), "note", F.col("note_id").alias("id")).alias("original"), *[c for c in remote.columns if c == "modified"])
    return plan.join(other, "doc_id")


def with_pending(found: DataFrame, correspondents: DataFrame, tags: DataFrame) -> DataFrame:
    """`found` with the names that still have to be created upstream: pending_correspondent and pending_tags.

    `correspondents` has doc_id and name, `tags` doc_id and names.  A name that waits is
    a change of its field, whatever the ids; tag names are kept once, in any case's order.
    """
    name = correspondents.groupBy("doc_id").agg(F.max(F.nullif(F.trim("name"), F.lit(""))).alias("pending_correspondent"))
    one = tags.select("doc_id", F.explode("names").alias("n")).select("doc_id", F.trim("n").alias("n")).where("n != ''").distinct()
    names = one.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("n").alias("k"), "n"))), lambda x: x["n"]).alias("pending_tags"))
    j = found.join(name, "doc_id", "left").join(names, "doc_id", "left").withColumn("pending_tags", F.coalesce("pending_tags", F.array().cast("array<string>")))
    waits = {"correspondent": F.col("pending_correspondent").isNotNull(), "tags": F.size("pending_tags") > 0}
    changed = F.filter(F.array(*[F.when(F.array_contains("changed", f) | waits.get(f, F.lit(False)), F.lit(f)) for f in FIELDS]), lambda f: f.isNotNull())
    return j.withColumn("changed", changed)


def with_created(found: DataFrame, correspondents: DataFrame, tags: DataFrame) -> DataFrame:
    """with_pending() rows after their names were created: ids (name, id) in place of names, which no longer wait.

    Names meet in any case; a name without an id keeps waiting.
    """
    key = lambda c: F.lower(F.trim(c))
    ids = lambda known, name: known.groupBy(key("name").alias("_k")).agg(F.max("id").alias(name))
    own = found.withColumn("_k", key("pending_correspondent")).join(ids(correspondents, "_corr"), "_k", "left").drop("_k")
    each = found.select("doc_id", F.explode("pending_tags").alias("n")).withColumn("_k", key("n")).join(ids(tags, "_tag"), "_k", "left")
    met = each.groupBy("doc_id").agg(F.collect_list("_tag").alias("_tags"), F.transform(F.array_sort(F.collect_list(F.when(F.col("_tag").isNull(), F.struct("_k", "n")))), lambda x: x["n"]).alias("_left"))
    j = own.join(met, "doc_id", "left")
    none = F.array()
    return j.withColumns({
        "correspondent_id": F.coalesce("_corr", "correspondent_id"), "pending_correspondent": F.when(F.col("_corr").isNull(), F.col("pending_correspondent")),
        "tags": tag_set(F.concat("tags", F.coalesce("_tags", none.cast("array<bigint>")))), "pending_tags": F.coalesce("_left", none.cast("array<string>")),
    }).drop("_corr", "_tags", "_left")


def _pair(name: str, value: Column) -> Column:
    """`"name":value` as JSON; nulls are written."""
    whole = F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def payload_calls(chosen: DataFrame, fields: str = "changed") -> DataFrame:
    """(doc_id, step, method, path, payload): one PATCH of the chosen fields, DELETE of a replaced note, POST of the new one.

    A note that is empty after trimming makes no call.  Payloads are JSON; those of
    with_pending() rows name what is to be created beside the ids.
    """
    has = lambda f: F.array_contains(fields, f)
    pairs = (("title", _pair("title", F.col("title"))), ("issue_date", _pair("created", F.col("issue_date"))), ("correspondent", _pair("correspondent", F.col("correspondent_id"))), ("tags", _pair("tags", F.col("tags"))))
    if "pending_tags" in chosen.columns:
        pairs += (("correspondent", _pair("pending_correspondent_name", F.col("pending_correspondent"))), ("tags", _pair("pending_tag_names", F.col("pending_tags"))))
    parts = F.filter(F.array(*[F.when(has(f), p) for f, p in pairs]), lambda p: p.isNotNull())
    base, text = F.concat(F.lit("/api/documents/"), F.col("doc_id").cast("string"), F.lit("/")), scalar(F.col("note"))
    noted = has("note") & (text != "")
    call = lambda method, path, payload: F.struct(F.lit(method).alias("method"), path.alias("path"), payload.alias("payload"))
    calls = F.array(
        F.when(F.size(parts) > 0, call("PATCH", base, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))),
        F.when(noted & (F.col("note_action") == "replace") & F.col("note_id").isNotNull(), call("DELETE", F.concat(base, F.lit("notes/?id="), F.col("note_id").cast("string")), F.lit("{}"))),
        F.when(noted, call("POST", F.concat(base, F.lit("notes/")), F.concat(F.lit("{"), _pair("note", text), F.lit("}")))),
    )
    return chosen.select("doc_id", F.posexplode(F.filter(calls, lambda c: c.isNotNull())).alias("step", "c")).select("doc_id", "step", "c.*")


def resolve(found: DataFrame, requests: DataFrame) -> DataFrame:
    """`found` (items with modified) joined with `requests` (doc_id, known_modified, resolutions map) and decided.

    Adds status ('no_changes', 'conflicts' or 'completed'), use_local and use_remote
    (field lists).  A remote copy that has moved on since known_modified needs an
    answer for each field: without any the status is 'conflicts'; fields without a
    valid one are skipped then, and written otherwise.
    """
    joined = found.join(requests, "doc_id")
    known, now = scalar(F.col("known_modified")), scalar(F.col("modified"))
    moved = (known != "") & (now != "") & (known != now)
    answers = F.coalesce(F.col("resolutions"), F.create_map().cast("map<string,string>"))
    action = lambda f: F.coalesce(F.when(F.try_element_at(answers, f).isin(*ACTIONS), F.try_element_at(answers, f)), F.when(moved, "skip").otherwise("use_local"))
    picked = lambda want: F.filter("changed", lambda f: action(f) == want)
    none = F.array().cast("array<string>")
    status = F.when(F.size("changed") == 0, "no_changes").when(moved & (F.size(answers) == 0), "conflicts").otherwise("completed")
    done = status == "completed"
    return joined.withColumns({"status": status, "use_local": F.when(done, picked("use_local")).otherwise(none), "use_remote": F.when(done, picked("use_remote")).otherwise(none)})


def conflicts(decided: DataFrame) -> DataFrame:
    """(doc_id, field, remote, local) for each changed field of a document in conflict."""
    value = lambda side, c: F.col(f"{side}{c}").cast("string")
    names = {"title": "title", "issue_date": "issue_date", "correspondent": "correspondent_id", "tags": "tags", "note": "note"}
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.array_join(f"original.{c}", ",").alias("remote") if f == "tags" else value("original.", c).alias("remote"), F.array_join(c, ",").alias("local") if f == "tags" else value("", c).alias("local")) for f, c in names.items()])
    rows = decided.where("status = 'conflicts'").select("doc_id", "changed", F.explode(fields).alias("x"))
    return rows.where(F.array_contains("changed", F.col("x.field"))).select("doc_id", "x.*")


def take_remote(local: DataFrame, remote: DataFrame, decided: DataFrame, known_tags: DataFrame | None = None) -> DataFrame:
    """`local` with the fields that a decision takes from `remote`; of tags only known ones."""
    theirs = remote.select("doc_id", *[F.col(c).alias(f"r_{c}") for c in ("title", "issue_date", "correspondent_id", "tags", "note")])
    if known_tags is not None:
        tagged = theirs.select("doc_id", F.explode_outer("r_tags").alias("id")).join(known_tags.select("id"), "id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set("id")).alias("r_tags"))
        theirs = theirs.drop("r_tags").join(tagged, "doc_id", "left").withColumn("r_tags", F.coalesce("r_tags", F.array().cast("array<bigint>")))
    chosen = decided.select("doc_id", F.col("use_remote").alias("taken"))
    j = local.join(chosen, "doc_id", "left").join(theirs, "doc_id", "left")
    columns = {"title": "title", "issue_date": "issue_date", "correspondent": "correspondent_id", "tags": "tags", "note": "note"}
    pick = {c: F.when(F.coalesce(F.array_contains("taken", f), F.lit(False)), F.nullif(F.trim(f"r_{c}"), F.lit("")) if f in ("title", "issue_date") else F.col(f"r_{c}")).otherwise(F.col(c)) for f, c in columns.items()}
    return j.select(*[pick[c].alias(c) if c in pick else F.col(c) for c in local.columns])


def preview_page(found: DataFrame, candidates: DataFrame, *, page: int, page_size: int, only_changed: bool) -> DataFrame:
    """One page of items with total_rows, the number of candidates.

    `candidates` (doc_id, position from 0) are paged first and unchanged ones dropped
    after that, so a page may hold fewer rows than its size.
    """
    size, first = max(1, page_size), (max(1, page) - 1) * max(1, page_size)
    total = candidates.agg(F.count(F.lit(1)).alias("total_rows"))
    own = candidates.where((F.col("position") >= first) & (F.col("position") < first + size))
    rows = own.join(found, "doc_id").crossJoin(F.broadcast(total))  # one row of totals
    return rows.where(F.size("changed") > 0) if only_changed else rows


def create_jobs(requests: DataFrame, jobs: DataFrame, found: DataFrame, calls: DataFrame) -> DataFrame:
    """(request_id, outcome, job_id, docs_selected, docs_changed, calls_count) of requested jobs.

    `requests` has request_id and doc_ids.  A request for the documents of a pending or
    running job gets that job, the newest of several; one without changes is rejected.
    """
    key = F.to_json("doc_ids").alias("key")
    there = jobs.where(F.col("status").isin(*OPEN)).groupBy(F.col("doc_ids_json").alias("key")).agg(F.max("job_id").alias("job_id"))
    rows = requests.select("request_id", "doc_ids", key)
    per = calls.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_calls"))
    changed = found.select("doc_id", (F.size("changed") > 0).cast("int").alias("is_changed")).join(per, "doc_id", "left")
    counts = rows.select("request_id", F.explode("doc_ids").alias("doc_id")).join(changed, "doc_id").groupBy("request_id").agg(F.sum("is_changed").alias("docs_changed"), F.sum(F.coalesce("n_calls", F.lit(0))).alias("calls_count"))
    j = rows.join(there, "key", "left").join(counts, "request_id", "left")
    n = F.coalesce("docs_changed", F.lit(0))
    outcome = F.when(F.col("job_id").isNotNull(), "existing").when(n == 0, "rejected").otherwise("created")
    return j.select("request_id", outcome.alias("outcome"), "job_id", F.size("doc_ids").alias("docs_selected"), n.cast("long").alias("docs_changed"), F.coalesce("calls_count", F.lit(0)).cast("long").alias("calls_count"))


def execute_pending(jobs: DataFrame, errors: DataFrame, *, limit: int = 0, dry_run: bool = False) -> DataFrame:
    """`jobs` after a run of the pending ones, oldest first, `limit` of them (0: all).

    `errors` (job_id, error) says which jobs' calls failed; a dry run sends nothing and
    so cannot fail.
    """
    own = jobs.where("status = 'pending'").select("job_id")
    picked = (own.orderBy("job_id").limit(limit) if limit > 0 else own).withColumn("picked", F.lit(True))
    failed = errors.select("job_id", F.col("error").alias("new_error"))
    j = jobs.join(picked, "job_id", "left").join(failed, "job_id", "left")
    bad = F.lit(not dry_run) & F.col("new_error").isNotNull()
    after = {"status": F.when(F.col("picked"), F.when(bad, "failed").otherwise("completed")).otherwise(F.col("status")), "error": F.when(F.col("picked"), F.when(bad, F.col("new_error"))).otherwise(F.col("error")), "dry_run": F.when(F.col("picked"), F.lit(dry_run)).otherwise(F.col("dry_run"))}
    return j.select(*[after.get(c, F.col(c)).alias(c) for c in jobs.columns], F.coalesce("picked", F.lit(False)).alias("processed"))


def job_totals(executed: DataFrame) -> DataFrame:
    own = executed.where("processed")
    return own.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))


def job_list(jobs: DataFrame, limit: int, *, finished: bool = False) -> DataFrame:
    """Newest jobs first, 1 to 500 of them; with `finished` only completed and failed ones."""
    rows = jobs.where(F.col("status").isin("completed", "failed")) if finished else jobs
    return rows.orderBy(F.desc("job_id")).limit(max(1, min(limit, 500)))


def delete_jobs(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(job_id, outcome): removed, refused for a running job, absent for an unknown one."""
    j = wanted.select("job_id").distinct().join(jobs.select("job_id", "status"), "job_id", "left")
    return j.select("job_id", F.when(F.col("status").isNull(), "absent").when(F.col("status") == "running", "refused").otherwise("removed").alias("outcome"))


def audit_rows(calls: DataFrame, remote: DataFrame, now: str, found: DataFrame | None = None) -> DataFrame:
    """One audit row for each document with a call, stamped with the remote modification time or `now`.

    With `found`, the items that were chosen, those without a change get a row too: they
    count as reviewed.
    """
    stamp = F.coalesce(F.nullif(F.trim("modified"), F.lit("")), F.lit(now))
    docs = calls.select("doc_id")
    if found is not None:
        docs = docs.union(found.where(F.size("changed") == 0).select("doc_id"))
    return docs.distinct().join(remote.select("doc_id", "modified"), "doc_id", "left").select("doc_id", F.lit("apply_to_document:writeback").alias("action"), F.lit("writeback").alias("source"), stamp.alias("created_at"))


def settle_pending(pending: DataFrame, calls: DataFrame, field: str) -> DataFrame:
    """`pending` rows (doc_id, ...) without documents whose PATCH carried `field`."""
    sent = calls.where((F.col("method") == "PATCH") & F.col("payload").contains(f'"{field}":')).select("doc_id").distinct()
    return pending.join(sent, "doc_id", "left_anti")


def display_value(field: str, value: Column, *, name: Column | None = None) -> Column:
    """How a preview shows a value: names before ids, '-' for nothing."""
    if field == "correspondent":
        number = F.concat(F.lit("#"), value.cast("string"))
        named = F.nullif(scalar(name if name is not None else F.lit(None)), F.lit(""))
        return F.coalesce(F.when(named.isNotNull() & value.isNotNull(), F.concat(named, F.lit(" ("), number, F.lit(")"))), named, number, F.lit("-"))
    if field == "tags":
        return F.coalesce(F.nullif(F.array_join(F.transform(value, lambda v: v.cast("string")), ", "), F.lit("")), F.lit("-"))
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("-"))


def candidate_positions(ordered: DataFrame) -> DataFrame:
    """(doc_id, position from 0) of candidate_order() rows, kind by kind, the newest first and those without a stamp last."""
    placed = ranked(ordered.select("kind", "at", "doc_id"), [], [F.col("kind"), F.desc_nulls_last("at"), F.col("doc_id")], "position")
    return placed.select("doc_id", (F.col("position") - 1).alias("position"))


assert set(FIELDS) == {"title", "issue_date", "correspondent", "tags", "note"}
