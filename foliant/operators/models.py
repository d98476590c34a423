"""Read models: what a list of documents and a single document show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.review import has_overrides, review_status, sync_status

STATUSES = ("all", "unreviewed", "needs_review", "reviewed")


def valid_status(status: str) -> str:
    return status if status in STATUSES else "all"


def list_model(local: DataFrame, remote: DataFrame, *, correspondents: DataFrame, flags: DataFrame, reviewed: DataFrame, suggested: DataFrame) -> DataFrame:
    """Remote rows with what is known of them here; local values show where they differ.

    `local` and `remote` are the sides of a change plan, `remote` with modified.
    """
    both = remote.alias("r").join(local.alias("l"), "doc_id", "left")
    here = F.col("l.tags").isNotNull()
    over = here & has_overrides()
    pick = lambda c: F.when(over, F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")).alias(c)
    rows = both.select("doc_id", pick("title"), pick("correspondent_id"), over.alias("local_overrides"), F.col("r.modified").alias("modified"))
    names = correspondents.select(F.col("id").alias("correspondent_id"), F.col("name").alias("correspondent_name"))
    marks = flags.select(F.col("id").alias("doc_id"), F.col("has_embedding").alias("has_embeddings"), F.col("has_vision").alias("has_vision_pages"))
    given = suggested.groupBy("doc_id").agg(F.lit(True).alias("has_suggestions"), F.bool_or(F.col("source") == "text_layer").alias("has_suggestions_baseline"), F.bool_or(F.col("source") == "vision_ocr").alias("has_suggestions_vision"))
    out = rows.join(names, "correspondent_id", "left").join(marks, "doc_id", "left").join(given, "doc_id", "left").join(reviewed, "doc_id", "left")
    no = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("has_embeddings", "has_vision_pages", "has_suggestions", "has_suggestions_baseline", "has_suggestions_vision")}
    return out.withColumns(no).withColumn("review_status", review_status(F.col("local_overrides"), F.col("reviewed_at"), F.col("modified")))


def filtered_page(rows: DataFrame, status: str, order: list[Column], *, page: int, page_size: int) -> DataFrame:
    """One page of the rows of a review status, with the count and whether there are pages on either side.

    An unknown status reads as 'all'.
    """
    status, size = valid_status(status), max(1, page_size)
    first = (max(1, page) - 1) * size
    kept = rows if status == "all" else rows.where(F.col("review_status") == status)
    total = kept.agg(F.count(F.lit(1)).alias("count"))
    marks = total.select("count", F.when(F.col("count") > first + size, "filtered").alias("next"), F.lit("filtered" if first > 0 else None).cast("string").alias("previous"))
    return kept.orderBy(*order).offset(first).limit(size).crossJoin(F.broadcast(marks))  # one row of marks


def detail_model(docs: DataFrame, *, remote: DataFrame, correspondents: DataFrame, tags: DataFrame, embedded: DataFrame, suggested: DataFrame, page_texts: DataFrame, notes: DataFrame, reviewed: DataFrame, overrides: DataFrame, prefer_vision: bool = True, large_pages: int = 20) -> DataFrame:
    """All that one document's page shows, for every document; children are reduced by key before they are joined."""
    key = F.col("doc_id").alias("id")
    vision = page_texts.where("source = 'vision_ocr'").select(key, "page").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("vision_pages_done"))
    done = lambda s: F.count_if(F.col("source") == s)
    noted = notes.where("status = 'ok'").select(key, "source", "page").distinct().groupBy("id").agg(done("text_layer").alias("page_notes_baseline_done"), done("vision_ocr").alias("page_notes_vision_done"))
    given = suggested.groupBy(key).agg(*[F.bool_or(F.col("source") == s).alias(f"has_{n}") for s, n in (("text_layer", "suggestions_baseline"), ("vision_ocr", "suggestions_vision"), ("hier_summary", "hierarchical_summary"))])
    tagged = tags.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_set("tag_id")).alias("tags"))
    out = docs
    for child in (
        correspondents.select(F.col("id").alias("correspondent_id"), F.col("name").alias("correspondent_name")), embedded.select(key, "embedding_source", F.col("chunk_count").alias("embedding_chunk_count")), given, vision, noted, tagged,
        reviewed.select(key, "reviewed_at"), overrides.select(key, F.lit(True).alias("local_overrides")), remote.select(key, F.col("modified").alias("remote_modified")),
    ):
        out = out.join(child, "correspondent_id" if "correspondent_name" in child.columns else "id", "left")
    zero, no = (lambda c: F.coalesce(c, F.lit(0))), (lambda c: F.coalesce(c, F.lit(False)))
    expected = F.when(F.col("page_count") > 0, F.col("page_count"))
    full = lambda c: F.when(expected.isNotNull(), F.col(c) >= expected).otherwise(F.col(c) > 0)
    want = "vision" if prefer_vision else "baseline"
    out = out.withColumns({c: zero(c) for c in ("vision_pages_done", "page_notes_baseline_done", "page_notes_vision_done", "embedding_chunk_count")} | {c: no(c) for c in ("has_suggestions_baseline", "has_suggestions_vision", "has_hierarchical_summary", "local_overrides")})
    return out.withColumns(
        {
            "tags": F.coalesce("tags", F.array().cast("array<bigint>")), "has_embeddings": F.col("embedding_source").isNotNull(),
            "has_embedding_for_preferred_source": no((F.col("embedding_chunk_count") > 0) & F.col("embedding_source").isin(want, "both")), "has_vision_pages": F.col("vision_pages_done") > 0, "vision_pages_expected": expected, "has_complete_vision_pages": full("vision_pages_done"),
            "has_complete_page_notes_baseline": full("page_notes_baseline_done"), "has_complete_page_notes_vision": full("page_notes_vision_done"), "is_large_document": zero(F.col("page_count")) >= large_pages,
            "sync_status": sync_status(F.col("modified"), F.col("remote_modified")), "review_status": review_status(F.col("local_overrides"), F.col("reviewed_at"), F.col("remote_modified")), "preferred_source": F.lit("vision_ocr" if prefer_vision else "text_layer"),
        }
    )


def with_titles(hits: DataFrame, docs: DataFrame, correspondents: DataFrame) -> DataFrame:
    """Hits (doc_id, ...) plus `document`, a struct of title, date and correspondent; null where it is unknown."""
    named = docs.join(correspondents.select(F.col("id").alias("correspondent_id"), "name"), "correspondent_id", "left")
    known = named.select(F.col("id").alias("doc_id"), F.struct("title", "document_date", F.col("name").alias("correspondent")).alias("document"))
    return hits.join(known, "doc_id", "left")


def embedded_titles(embedded: DataFrame, docs: DataFrame) -> DataFrame:
    return embedded.join(docs.select(F.col("id").alias("doc_id"), "title"), "doc_id")


def page_numbers(rows: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """`rows` with the page of a list that shows `size` rows of each group at once."""
    return rows.withColumn("list_page", (F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / max(1, size)) + 1).cast("int"))
