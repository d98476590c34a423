"""Work of a model on pages, sections and documents that can stop and go on.

The results of a stage lie in a versioned table under the item's key with the hash of what the
model was given.  A run works on items without a good result for their present input, in slices,
and each slice is one version: what a stopped or killed run has finished stays, and the next one
calls the model for the rest only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from foliant.operators.context import note_text
from foliant.operators.textops import _strip, is_large, note_sections
from foliant.sources.versioned import VersionedTable
from foliant.storage import Scratch

Model = Callable[[str], str]
#: Results that a later run keeps; any other is tried again.
FINAL = ("ok", "skipped")
CHECKPOINT = "stage string, source string, current string, total long"


def resume_from(checkpoint: Column, stage: str, *, source: str | None = None, total: Column | None = None) -> Column:
    """How many items of a stage a checkpoint (JSON) says are done.

    An object under `resume_from` counts in place of the checkpoint itself.  0 where it is no
    object, of another stage, of another source (a blank one fits all) or of another total
    (none or 0 fits all); else `current`, from 0 to the total.
    """
    raw = F.trim(F.coalesce(checkpoint, F.lit("")))
    outer = F.when(raw.startswith("{"), F.from_json(raw, f"{CHECKPOINT}, resume_from struct<{CHECKPOINT.replace(' ', ':').replace(',:', ', ')}>"))
    inner = outer["resume_from"]
    field = lambda name: F.when(inner.isNotNull(), inner[name]).otherwise(outer[name])
    plain = lambda name: F.trim(F.coalesce(field(name), F.lit("")))
    fits = plain("stage") == stage
    if source:
        fits = fits & plain("source").isin("", source)
    done = F.greatest(F.coalesce(field("current").try_cast("double").cast("long"), F.lit(0)), F.lit(0))
    if total is not None:
        given = F.coalesce(field("total"), F.lit(0))
        fits = fits & ((given <= 0) | (given == total))
        done = F.least(done, total)
    return F.when(F.coalesce(fits, F.lit(False)), done).otherwise(F.lit(0)).cast("long")


class Stage:
    """One stage under `path`, for items with `keys` and a column `input`.

    Items are unique by their keys, which are never null.  A slice has about `slice_rows`
    items; the number of slices follows the open items and not the size of a slice.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], *, slice_rows: int = 50_000, buckets: int = 64) -> None:
        self.table = VersionedTable(spark, path, keys, buckets=buckets)
        self.spark, self.keys, self.slice_rows = spark, keys, slice_rows

    def _stored(self) -> DataFrame | None:
        return self.table.read() if self.table.versions() else None

    def pending(self, items: DataFrame) -> DataFrame:
        """Items without a final result for their present input."""
        wanted = items.select(*self.keys, "input").withColumn("input_hash", F.sha2(F.coalesce("input", F.lit("")), 256))
        stored = self._stored()
        if stored is None:
            return wanted
        return wanted.join(stored.where(F.col("status").isin(*FINAL)).select(*self.keys, "input_hash"), [*self.keys, "input_hash"], "left_anti")

    def run(self, items: DataFrame, model: Model, *, stop: Callable[[], bool] = lambda: False) -> bool:
        """Call `model` for every pending item; False if `stop` said so before a slice.

        A blank input is skipped without a call.  An error of the model is kept with the
        item, 1,000 characters of it, and the next run tries it again.
        """
        open_items = self.pending(items)
        slices = -(-open_items.count() // self.slice_rows)
        if not slices:
            return True
        # One folder for each slice, so that what leads to the items is computed once.
        scratch = Scratch(self.spark, "stage")
        folder = f"{scratch.path}/items"
        cut = F.pmod(F.xxhash64(F.lit("slice"), *self.keys), F.lit(slices)).cast("int")
        open_items.withColumn("_slice", cut).repartition("_slice").write.partitionBy("_slice").parquet(folder)
        saved = self.spark.read.schema(StructType([*open_items.schema, StructField("_slice", IntegerType())])).parquet(folder)
        try:
            for k in range(slices):
                if stop():
                    return False
                part = saved.where(F.col("_slice") == k).drop("_slice").repartition(*self.keys)
                self.table.upsert(self._answers(part, model))
        finally:
            scratch.drop("items")
        return True

    def _answers(self, part: DataFrame, model: Model) -> DataFrame:
        def answer(text: str | None) -> tuple[str, str | None, str | None]:
            if not (text or "").strip():
                return "skipped", None, "empty_input"
            try:
                return "ok", model(text), None
            except Exception as error:  # whatever the caller's model raises is a result of this item
                return "error", None, str(error)[:1000]

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = pd.DataFrame([answer(t) for t in batch["input"]], columns=["status", "result", "error"], index=batch.index)
                yield pd.concat([batch.drop(columns="input"), found], axis=1)

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in part.drop("input").schema)
        return part.mapInPandas(call, f"{fields}, status string, result string, error string")

    def results(self, items: DataFrame) -> DataFrame:
        """(keys, status, result, error) of items whose stored result is of their present input; old results do not show."""
        stored = self._stored()
        if stored is None:
            return items.select(*self.keys, *[F.lit(None).cast("string").alias(c) for c in ("status", "result", "error")]).limit(0)
        wanted = items.select(*self.keys, F.sha2(F.coalesce("input", F.lit("")), 256).alias("input_hash"))
        return stored.join(wanted, [*self.keys, "input_hash"], "left_semi").select(*self.keys, "status", "result", "error")

    def progress(self, items: DataFrame) -> DataFrame:
        """One row: total, done, errors, open."""
        state = items.select(*self.keys).join(self.results(items), self.keys, "left")
        done = F.count_if(F.col("status").isin(*FINAL))
        return state.agg(F.count(F.lit(1)).alias("total"), done.alias("done"), F.count_if(F.col("status") == "error").alias("errors"), (F.count(F.lit(1)) - done).alias("open"))


class Summaries:
    """Page notes, section summaries and document summaries of large documents, one stage on another.

    `docs` has doc_id, page_count and text, `pages` has doc_id, page, source and text, unique
    by the first three.  Under `path` lies one stage for each level.
    """

    def __init__(self, spark: SparkSession, path: str, *, source: str, fallback: str = "text_layer", large_pages: int = 20, section_pages: int = 25, section_tokens: int = 6000, slice_rows: int = 50_000, buckets: int = 64) -> None:
        stage = lambda name, *rest: Stage(spark, f"{path}/{name}", ["doc_id", "source", *rest], slice_rows=slice_rows, buckets=buckets)
        self.notes, self.sections, self.documents = stage("notes", "page"), stage("sections", "section_key"), stage("documents")
        self.source, self.fallback, self.large_pages = source, fallback, large_pages
        self.section_pages, self.section_tokens = section_pages, section_tokens

    def page_items(self, docs: DataFrame, pages: DataFrame) -> DataFrame:
        """Pages of large documents, of the source and of its fallback."""
        large = docs.where(is_large(F.col("page_count"), F.col("text"), self.large_pages)).select("doc_id")
        return pages.where(F.col("source").isin(self.source, self.fallback)).join(large, "doc_id", "left_semi").select("doc_id", "source", "page", _strip(F.coalesce("text", F.lit(""))).alias("input"))

    def good_notes(self, items: DataFrame) -> DataFrame:
        """(doc_id, source, page, text): good notes of the source, of the fallback where a document has none of it."""
        found = self.notes.results(items).where("status = 'ok'").select("doc_id", "source", "page", note_text(F.col("result")).alias("text")).where("text != ''")
        best = found.groupBy("doc_id").agg(F.max_by("source", F.col("source") == self.source).alias("source"))
        return found.join(best, ["doc_id", "source"], "left_semi")

    def section_items(self, notes: DataFrame) -> DataFrame:
        """Notes packed into sections, each note behind its page number."""
        cut = note_sections(notes, max_pages=self.section_pages, max_tokens=self.section_tokens)
        ends = F.split("section_key", "-")
        bounds = cut.select("doc_id", "section_key", ends[0].cast("int").alias("lo"), ends[1].cast("int").alias("hi"))
        inside = notes.join(bounds, "doc_id").where("page BETWEEN lo AND hi")
        line = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(": "), F.col("text"))
        return inside.groupBy("doc_id", "source", "section_key").agg(_joined("page", line))

    def _sections(self, items: DataFrame) -> DataFrame:
        """section_items of the notes there are, saved: the next levels read both more than once."""
        scratch = Scratch(items.sparkSession, "sections")
        return scratch.save(self.section_items(scratch.save(self.good_notes(items), "notes")), "sections")

    def document_items(self, sections: DataFrame, results: DataFrame) -> DataFrame:
        """Good section summaries of a document in page order; a document without one is not summarised."""
        good = results.where("status = 'ok'").select("doc_id", "source", "section_key", _strip(F.coalesce("result", F.lit(""))).alias("text")).where("text != ''")
        first = F.split("section_key", "-")[0].cast("int")
        line = F.concat(F.lit("Section "), F.col("section_key"), F.lit(": "), F.col("text"))
        return good.groupBy("doc_id", "source").agg(_joined(first, line))

    def run(self, docs: DataFrame, pages: DataFrame, note: Model, section: Model, document: Model, *, stop: Callable[[], bool] = lambda: False) -> bool:
        """All three levels, each over what the one before it has; False where `stop` ended it.

        A source's own notes come first; fallback pages are read only for documents that
        have no good note of it, as the archive does.
        """
        items = self.page_items(docs, pages)
        own = items.where(F.col("source") == self.source)
        if not self.notes.run(own, note, stop=stop):
            return False
        if self.fallback != self.source:
            there = self.notes.results(own).where("status = 'ok'").select("doc_id")
            if not self.notes.run(items.where(F.col("source") == self.fallback).join(there, "doc_id", "left_anti"), note, stop=stop):
                return False
        sections = self._sections(items)
        if not self.sections.run(sections, section, stop=stop):
            return False
        return self.documents.run(self.document_items(sections, self.sections.results(sections)), document, stop=stop)

    def summaries(self, docs: DataFrame, pages: DataFrame) -> DataFrame:
        """(doc_id, source, summary, confidence_note): a model's error leaves an empty summary and says so in the note."""
        sections = self._sections(self.page_items(docs, pages))
        found = self.documents.results(self.document_items(sections, self.sections.results(sections)))
        note = F.when(F.col("status") == "error", F.concat(F.lit("global_summary_error:"), F.left("error", F.lit(200))))
        return found.select("doc_id", "source", F.coalesce("result", F.lit("")).alias("summary"), note.alias("confidence_note"))


def _joined(order: Column | str, line: Column) -> Column:
    """Lines of a group in order, with blank lines between them."""
    at = F.col(order) if isinstance(order, str) else order
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), line.alias("line")))), lambda x: x["line"]), "\n\n").alias("input")
