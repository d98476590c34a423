"""Review state, field-level change plans and writeback calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("title", "issue_date", "correspondent", "tags", "note")


def parse_time(text: Column) -> Column:
    """ISO time or null; without an offset it counts as UTC."""
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))


def review_status(overrides: Column, reviewed_at: Column, modified: Column) -> Column:
    reviewed, changed = parse_time(reviewed_at), parse_time(modified)
    return F.when(overrides, "needs_review").when(reviewed.isNull(), "unreviewed").when(changed > reviewed, "needs_review").otherwise("reviewed")


def sync_status(local: Column, remote: Column) -> Column:
    return F.when(parse_time(remote) > parse_time(local), "stale").otherwise("synced")


def is_sync_ok(local: Column, remote: Column) -> Column:
    """Missing remote time is fine, missing local time isn't."""
    return F.when(parse_time(remote).isNull(), True).when(parse_time(local).isNull(), False).otherwise(parse_time(local) >= parse_time(remote))


def latest_review(audit: DataFrame) -> DataFrame:
    """Newest review stamp of each document, as the greatest string."""
    reviewed = audit.where(F.col("action").startswith("apply_to_document:") | (F.col("action") == "mark_reviewed"))
    return reviewed.groupBy("doc_id").agg(F.max("created_at").alias("reviewed_at"))


def _plain(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def tag_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<bigint>"))))


def has_overrides(local: str = "l", remote: str = "r") -> Column:
    """Whether local fields differ from remote ones; a blank remote date doesn't count."""
    a, b = (lambda c: F.col(f"{local}.{c}")), (lambda c: F.col(f"{remote}.{c}"))
    date = (_plain(b("issue_date")) != "") & (_plain(a("issue_date")) != _plain(b("issue_date")))
    return (tag_set(a("tags")) != tag_set(b("tags"))) | ~F.trim(a("title")).eqNullSafe(F.trim(b("title"))) | date | ~a("correspondent_id").eqNullSafe(b("correspondent_id")) | (_plain(a("note")) != _plain(b("note")))


def canonical_note(text: Column, marker: str) -> Column:
    """Summary of a note: marker and white space at the ends and doubled inside go."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), rf"\s*{marker}\s*$", "")
    return F.trim(F.regexp_replace(body, r"\s+", " "))


def change_plan(local: DataFrame, remote: DataFrame, *, marker: str = "AI summary") -> DataFrame:
    """(doc_id, changed, note_action, proposals...) of documents on both sides.

    Either frame has doc_id, title, issue_date, correspondent_id, tags, note, note_id.
    Here a blank remote date does count as a difference.
    """
    j = local.alias("l").join(remote.alias("r"), "doc_id")
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    mine, theirs = canonical_note(l("note"), marker), canonical_note(r("note"), marker)
    differs = {
        "title": _plain(l("title")) != _plain(r("title")), "issue_date": _plain(l("issue_date")) != _plain(r("issue_date")),
        "correspondent": ~F.nullif(l("correspondent_id"), F.lit(0)).eqNullSafe(F.nullif(r("correspondent_id"), F.lit(0))), "tags": tag_set(l("tags")) != tag_set(r("tags")), "note": (mine != "") & (mine != theirs),
    }
    changed = F.filter(F.array(*[F.when(differs[f], F.lit(f)) for f in FIELDS]), lambda f: f.isNotNull())
    action = F.when(mine == "", "none").when(mine == theirs, "unchanged").when(_plain(r("note")) != "", "replace").otherwise("add")
    return j.select(
        "doc_id", changed.alias("changed"), action.alias("note_action"), F.nullif(_plain(l("title")), F.lit("")).alias("title"), F.nullif(_plain(l("issue_date")), F.lit("")).alias("issue_date"),
        l("correspondent_id").alias("correspondent_id"), tag_set(l("tags")).alias("tags"), l("note").alias("note"), r("note_id").alias("note_id"),
    )


def writeback_calls(plan: DataFrame) -> DataFrame:
    """(doc_id, step, method, path, fields): PATCH of fields, DELETE of a replaced note, POST of the new one."""
    patch = F.filter("changed", lambda f: f != "note")
    noted = F.array_contains("changed", "note") & (_plain(F.col("note")) != "")
    base = F.concat(F.lit("/api/documents/"), F.col("doc_id").cast("string"), F.lit("/"))
    call = lambda method, path, fields: F.struct(F.lit(method).alias("method"), path.alias("path"), fields.alias("fields"))
    calls = F.array(
        F.when(F.size(patch) > 0, call("PATCH", base, F.array_join(patch, ","))),
        F.when(noted & (F.col("note_action") == "replace") & F.col("note_id").isNotNull(), call("DELETE", F.concat(base, F.lit("notes/?id="), F.col("note_id").cast("string")), F.lit(""))),
        F.when(noted, call("POST", F.concat(base, F.lit("notes/")), F.lit("note"))),
    )
    return plan.select("doc_id", F.posexplode(F.filter(calls, lambda c: c.isNotNull())).alias("step", "c")).select("doc_id", "step", "c.*")


def writeback_totals(plan: DataFrame, calls: DataFrame) -> DataFrame:
    n = plan.agg(F.count(F.lit(1)).alias("docs_selected"), F.count_if(F.size("changed") > 0).alias("docs_changed"))
    return n.crossJoin(calls.agg(F.count(F.lit(1)).alias("calls_count")))


def candidate_order(audited: DataFrame, pending_tags: DataFrame, pending_correspondents: DataFrame) -> DataFrame:
    """Documents to write back, each once: audited by newest stamp, then pending tags, then correspondents."""
    a = audited.groupBy("doc_id").agg(F.max("created_at").alias("at")).withColumn("kind", F.lit(0))
    others = [f.select("doc_id").distinct().withColumn("at", F.lit(None).cast("string")).withColumn("kind", F.lit(k)) for k, f in ((1, pending_tags), (2, pending_correspondents))]
    every = a.unionByName(others[0]).unionByName(others[1])
    first = every.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("kind"))).where("n = 1")
    return first.select("doc_id", "kind", "at").orderBy("kind", F.desc_nulls_last("at"), "doc_id")


def resolve_names(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(name, id, action): ids by case-insensitive name, the greatest id winning; others are to be created."""
    key = lambda c: F.lower(F.trim(c))
    ids = known.groupBy(key("name").alias("k")).agg(F.max("id").alias("id"))
    asked = wanted.select(F.trim("name").alias("name"), key("name").alias("k")).where("k != ''").groupBy("k").agg(F.min("name").alias("name"))
    return asked.join(ids, "k", "left").select("name", "id", F.when(F.col("id").isNull(), "create").otherwise("use").alias("action"))


def normalize_tags(suggestions: DataFrame, known: DataFrame, limit: int = 4) -> DataFrame:
    """(doc_id, existing, new): the first distinct suggested names, split by whether they exist.

    `known` may be of any size: names meet by an equi-join.
    """
    clean = F.slice(F.array_distinct(F.filter(F.transform("names", lambda t: F.trim(t)), lambda t: t != "")), 1, limit)
    rows = suggestions.select("doc_id", F.posexplode_outer(clean).alias("at", "name"))
    keys = known.select(F.lower(F.trim("name")).alias("k")).distinct().withColumn("is_known", F.lit(True))
    found = rows.withColumn("k", F.lower("name")).join(keys, "k", "left")
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c & F.col("name").isNotNull(), F.struct("at", "name")))), lambda x: x["name"])
    is_known = F.coalesce("is_known", F.lit(False))
    return found.groupBy("doc_id").agg(F.array_join(pick(is_known), "|").alias("existing"), F.array_join(pick(~is_known), "|").alias("new"))
