"""Suggestions: applied to documents, overridden by hand, read back and asked for."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.model_text import string_list
from foliant.operators.merge import best_name_match


def apply_scalars(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """`docs` with the titles and dates of `edits` (doc_id, field, value); values are trimmed, null stays null."""
    per = edits.where(F.col("field").isin("title", "date")).groupBy(F.col("doc_id").alias("id")).agg(*[F.max_by(F.struct(F.trim("value").alias("v")), F.col("field") == f).alias(f"e_{f}") for f in ("title", "date")], *[F.bool_or(F.col("field") == f).alias(f"has_{f}") for f in ("title", "date")])
    j = docs.join(per, "id", "left")
    names = {"title": "title", "document_date": "date"}
    return j.select(*[F.when(F.col(f"has_{names[c]}"), F.col(f"e_{names[c]}.v")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in docs.columns])


def apply_correspondents(edits: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, correspondent_id, pending_name): the best known name, else the name waits to be created."""
    asked = edits.where("field = 'correspondent'").select("doc_id", F.nullif(F.trim("value"), F.lit("")).alias("name"))
    found = best_name_match(asked.select("name").where("name IS NOT NULL").distinct(), known)
    return asked.join(found, "name", "left").select("doc_id", F.col("id").alias("correspondent_id"), F.when(F.col("id").isNull(), F.col("name")).alias("pending_name"))


def apply_tags(edits: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, tag_ids, pending_names) of edits (doc_id, names): known tags by name in any case, and the others.

    Where no name is known tag_ids is null, and the document keeps its tags.  Other names
    are kept once each in any case, in the order of their lower-case form; without any,
    no name is left to wait.
    """
    names = edits.select("doc_id", F.explode_outer(F.filter(F.transform("names", lambda n: F.trim(n)), lambda n: n != "")).alias("name"))
    keys = known.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min("id").alias("id"))
    rows = names.withColumn("k", F.lower("name")).join(keys, "k", "left")
    fresh = rows.where("id IS NULL AND name IS NOT NULL").groupBy("doc_id", "k").agg(F.min("name").alias("name"))
    pending = fresh.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("pending_names"))
    found = F.array_sort(F.collect_set("id"))
    ids = rows.groupBy("doc_id").agg(F.when(F.count("id") > 0, found).alias("tag_ids"))
    return ids.join(pending, "doc_id", "left").select("doc_id", "tag_ids", F.coalesce("pending_names", F.array().cast("array<string>")).alias("pending_names"))


def settle_tags(current: DataFrame, waiting: DataFrame, applied: DataFrame) -> DataFrame:
    """(doc_id, tag_ids, pending_names, updated) of every document after apply_tags().

    `current` has doc_id and tag_ids, `waiting` the names (doc_id, names) that wait
    already.  An edited document's names replace those, or take them away where there
    are none; others keep both.  updated says whether tags or waiting names are new.
    """
    none = F.array().cast("array<string>")
    sort = lambda c: F.transform(F.array_sort(F.transform(F.coalesce(c, none), lambda n: F.struct(F.lower(n).alias("k"), n.alias("n")))), lambda x: x["n"])
    new = applied.select("doc_id", F.col("tag_ids").alias("_ids"), F.col("pending_names").alias("_names"), F.lit(True).alias("_edited"))
    j = current.select("doc_id", "tag_ids").join(waiting.select("doc_id", F.col("names").alias("_old")), "doc_id", "left").join(new, "doc_id", "left")
    edited = F.coalesce("_edited", F.lit(False))
    names = F.when(edited, F.col("_names")).otherwise(F.coalesce("_old", none))
    updated = edited & (F.col("_ids").isNotNull() | (sort(F.col("_old")) != sort(F.col("_names"))))
    return j.select("doc_id", F.coalesce("_ids", "tag_ids").alias("tag_ids"), names.alias("pending_names"), updated.alias("updated"))


def latest_meta(stored: DataFrame) -> DataFrame:
    """(doc_id, source, model_name, processed_at) of each document's newest suggestion; undated ones come last, then the lesser source."""
    order = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("processed_at"), "source")
    return stored.select("doc_id", "source", "model_name", "processed_at").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def layer_model(pages: DataFrame, source: str) -> DataFrame:
    """(doc_id, model_name): the model of the newest page of a layer that names one."""
    rows = pages.where((F.col("source") == source) & (F.trim(F.coalesce("model_name", F.lit(""))) != ""))
    return rows.groupBy("doc_id").agg(F.max_by("model_name", F.struct(F.coalesce("processed_at", F.lit("")), "model_name")).alias("model_name"))


def created_line(stamp: Column) -> Column:
    """A stamp as 'YYYY-MM-DD HH:MM:SS' in its own zone; another text is cut to 19 characters; '' is null."""
    raw = F.trim(F.coalesce(stamp, F.lit("")))
    flat = F.regexp_replace(raw, "T", " ")
    return F.when(raw == "", None).when(raw.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(raw, F.lit(" 00:00:00"))).when(raw.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d$"), F.concat(flat, F.lit(":00"))).otherwise(F.left(flat, F.lit(19)))


def summary_note(summary: Column, model: Column, processed_at: Column, marker: str = "AI summary") -> Column:
    """The note that carries a summary: text, a line about its making, and the marker."""
    meta = F.concat_ws(", ", F.concat(F.lit("Model:"), F.nullif(model, F.lit(""))), F.concat(F.lit("Created:"), created_line(processed_at)))
    return F.concat_ws("\n", F.concat(F.trim(summary), F.lit("\n")), F.nullif(meta, F.lit("")), F.lit(marker))


#: Fixed value: how summary notes began before they ended with a marker.
OLD_MARKER = "AI_SUMMARY v1 -"


def apply_notes(edits: DataFrame, notes: DataFrame, stored: DataFrame, marker: str = "AI summary") -> DataFrame:
    """(doc_id, note_id, note, action): the summary note of each edit, in place of the document's first one or added.

    A summary note ends with the marker, or begins with the one of old.  Blank edits change nothing.
    """
    asked = edits.where("field = 'note'").select("doc_id", F.trim(F.coalesce("value", F.lit(""))).alias("value")).where("value != ''")
    own = notes.where(F.col("note").endswith(f"\n{marker}") | F.col("note").startswith(OLD_MARKER)).groupBy(F.col("document_id").alias("doc_id")).agg(F.min("id").alias("note_id"))
    j = asked.join(latest_meta(stored).drop("source"), "doc_id", "left").join(own, "doc_id", "left")
    return j.select("doc_id", "note_id", summary_note(F.col("value"), F.col("model_name"), F.col("processed_at"), marker).alias("note"), F.when(F.col("note_id").isNull(), "add").otherwise("replace").alias("action"))


def edit_audit(edits: DataFrame, now: str) -> DataFrame:
    """An audit row for each edit that changes something; a blank note changes nothing."""
    blank = (F.col("field") == "note") & (F.trim(F.coalesce("value", F.lit(""))) == "")
    return edits.where(~blank).select("doc_id", F.concat(F.lit("apply_to_document:"), "field").alias("action"), F.coalesce("source", F.lit("manual")).alias("source"), F.lit(now).alias("created_at"))


def _overridden(payload: str | None, field: str, value: str | None) -> dict[str, str | None]:
    try:
        found = json.loads(payload or "")
    except ValueError:
        found = {}
    found = found if isinstance(found, dict) else {}
    new = json.loads(value) if value is not None else None
    old = found.get(field)
    if isinstance(found.get("parsed"), dict):
        found["parsed"][field] = new
    found[field] = new
    return {"payload": json.dumps(found, ensure_ascii=False), "old_value": None if old is None else json.dumps(old, ensure_ascii=False), "new_value": None if new is None else json.dumps(new, ensure_ascii=False)}


def override_field(stored: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, source, field, payload, old_value, new_value): stored suggestions with one field set by hand.

    Values are JSON.  Edits of suggestions that are not stored give no row.
    """

    @F.pandas_udf("payload string, old_value string, new_value string")
    def change(payload: pd.Series, field: pd.Series, value: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_overridden(*row) for row in zip(payload, field, value.where(value.notna(), None), strict=True)], columns=["payload", "old_value", "new_value"])

    j = stored.join(edits.select("doc_id", "source", "field", "value"), ["doc_id", "source"])
    return j.select("doc_id", "source", "field", change("payload", "field", "value").alias("x")).select("doc_id", "source", "field", "x.*")


def by_source(stored: DataFrame) -> DataFrame:
    """(doc_id, suggestions): a map from source to payload, in the order of sources."""
    return stored.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "payload")))).alias("suggestions"))


def refreshed(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored suggestions (doc_id, source, payload) with fresh ones in place of those of their source, and their origin."""
    kept = stored.select("doc_id", "source", "payload").join(fresh.select("doc_id", "source"), ["doc_id", "source"], "left_anti").withColumn("origin", F.lit("stored"))
    return kept.unionByName(fresh.select("doc_id", "source", "payload").withColumn("origin", F.lit("fresh")))


def follow_ups(answer: Column, limit: int = 5) -> Column:
    """Questions of a model's answer: a JSON list, or the first list that an object has under a known name."""
    text = F.trim(F.coalesce(answer, F.lit("")))
    names = ("questions", "followups", "suggestions")
    found = F.when(text.startswith("{"), F.from_json(text, ", ".join(f"{n} array<string>" for n in names)))
    full = lambda c: F.when(F.size(c) > 0, c)
    listed = F.coalesce(*[full(found[n]) for n in names], F.array().cast("array<string>"))
    given = string_list(text)
    picked = F.when(F.size(given) > 0, given).otherwise(F.filter(F.transform(listed, lambda q: F.trim(q)), lambda q: q != ""))
    return F.slice(picked, 1, limit)


def fill_prompt(template: str, values: dict[str, Column]) -> Column:
    """`template` with each {name} replaced; null values read as ''."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def ask(prompts: DataFrame, answer: Callable[[str], str]) -> DataFrame:
    """`prompts` plus `answer` by a model that the caller brings, one Arrow batch after another."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(answer)

    return prompts.withColumn("answer", run("prompt"))


def field_variants(docs: DataFrame, template: str, field: str, count: int, answer: Callable[[str], str]) -> DataFrame:
    """(doc_id, variants): 1 to 5 other values of a field, from a model that the caller brings."""
    n = max(1, min(count, 5))
    prompts = docs.select("doc_id", fill_prompt(template, {"field": F.lit(field), "count": F.lit(n), "text": F.col("text")}).alias("prompt"))
    return ask(prompts, answer).select("doc_id", follow_ups(F.col("answer"), n).alias("variants"))
