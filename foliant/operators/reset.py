"""Clearing what was derived from documents, cleaning texts again and starting over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.pages import reclean, reclean_totals
from foliant.operators.planner import task_sequence
from foliant.operators.textops import clean_text

#: What is derived from a document.  Its run log goes too, but not where everything is cleared.
DERIVED = ("suggestions", "page_texts", "embeddings", "ocr_scores", "page_notes", "section_summaries", "page_anchors")
RUNS = "task_runs"


def cleared(frames: dict[str, DataFrame], doc_ids: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """`frames` without what was derived from documents, and (name, removed, kept) of every frame.

    With doc_ids the derived rows, points and runs of these documents go; without, all
    derived rows and points of all documents, and the run log stays.  Frames have doc_id;
    other names than the derived ones, points and the run log are left alone.
    """
    left, counts = {}, []
    wanted = None if doc_ids is None else doc_ids.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("_gone", F.lit(True))
    for name, frame in frames.items():
        touched = name in DERIVED or name == "points" or (name == RUNS and wanted is not None)
        if not touched:
            left[name], marked = frame, frame.select(F.lit(False).alias("_gone"))
        elif wanted is None:
            left[name], marked = frame.limit(0), frame.select(F.lit(True).alias("_gone"))
        else:
            left[name], marked = frame.join(wanted, "doc_id", "left_anti"), frame.select("doc_id").join(wanted, "doc_id", "left").select("_gone")
        gone = F.coalesce("_gone", F.lit(False))
        counts.append(marked.agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept")).select(F.lit(name).alias("name"), "removed", "kept"))
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return left, total


def restarted(doc_ids: DataFrame, documents: DataFrame, remote: DataFrame, *, vision: bool, enqueue: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as the archive has them now, the forced tasks of those, and a report, for documents that start over.

    `documents` and `remote` have id and the same columns; `remote` wins.  The tasks
    (doc_id, position, task, source, force) go to the front of the queue in this order.
    The report has doc_id, synced and enqueued; an id that the archive does not know keeps
    its local row, is not synced and gets no tasks.
    """
    wanted = doc_ids.select("doc_id").where("doc_id IS NOT NULL").distinct()
    fresh = remote.join(wanted, remote["id"] == wanted["doc_id"], "left_semi").select(documents.columns)
    merged = documents.join(fresh.select("id"), "id", "left_anti").select(documents.columns).unionByName(fresh)
    steps = task_sequence(vision=vision, force=True) if enqueue else []
    kind = "array<struct<position:int,task:string,source:string,force:boolean>>"
    rows = [F.struct(F.lit(i).alias("position"), F.lit(t["task"]).alias("task"), F.lit(t.get("source")).cast("string").alias("source"), F.lit(t.get("force", False)).alias("force")) for i, t in enumerate(steps)]
    tasks = fresh.select(F.col("id").alias("doc_id"), F.explode(F.array(*rows).cast(kind)).alias("t")).select("doc_id", "t.*")
    there = fresh.select(F.col("id").alias("doc_id"), F.lit(True).alias("_there"))
    synced = F.coalesce("_there", F.lit(False))
    report = wanted.join(there, "doc_id", "left").select("doc_id", synced.alias("synced"), F.when(synced, len(steps)).otherwise(0).alias("enqueued"))
    return merged, tasks, report


def cleanup_tasks(documents: DataFrame, doc_ids: DataFrame | None = None, *, source: str | None = None, clear_first: bool = False) -> DataFrame:
    """(doc_id, task, source, clear_first): a cleaning task for each document named, or for all."""
    wanted = documents.select(F.col("id").alias("doc_id")) if doc_ids is None else doc_ids.select("doc_id")
    return wanted.select("doc_id", F.lit("cleanup_texts").alias("task"), F.lit(source).cast("string").alias("source"), F.lit(clear_first).alias("clear_first"))


def cleanup(pages: DataFrame, doc_ids: DataFrame | None = None, *, source: str | None = None, clear_first: bool = False, clean: Callable[[Column], Column] = clean_text) -> tuple[DataFrame, DataFrame]:
    """Page texts cleaned again, and one row: docs, processed, updated.

    Only pages of `doc_ids` (all without) and of `source` (any without) are cleaned, and
    only these come back.  `clear_first` forgets what was cleaned, so every page with a
    text counts as updated.  docs is the number of ids given, else of documents with pages.
    """
    rows = pages if source is None else pages.where(F.col("source") == source)
    if doc_ids is not None:
        rows = rows.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    if clear_first:
        rows = rows.withColumn("clean_text", F.lit(None).cast("string")).withColumn("token_estimate_clean", F.lit(None).cast("int"))
    done = reclean(rows, clean)
    docs = doc_ids.agg(F.count(F.lit(1)).alias("docs")) if doc_ids is not None else pages.agg(F.count_distinct("doc_id").alias("docs"))
    return done.drop("changed"), docs.crossJoin(reclean_totals(done))  # one row each
