"""Corpus dashboards: processing flags, totals, histograms and top groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_BUCKETS = ((1, 1, "1"), (2, 3, "2-3"), (4, 6, "4-6"), (7, 10, "7-10"), (11, 20, "11-20"), (21, 50, "21-50"), (51, 99, "51-99"))


def is_active(deleted_prefix: str, column: str = "deleted_at") -> Column:
    return F.col(column).isNull() | ~F.col(column).startswith(deleted_prefix)


def processing_flags(docs: DataFrame, embedded: DataFrame, page_texts: DataFrame, suggested: DataFrame, vision: str) -> DataFrame:
    """`docs` with has_embedding, has_vision, has_suggestion and fully.

    Children are reduced to distinct keys first, so no join multiplies rows.
    """
    marks = (("has_embedding", embedded), ("has_vision", page_texts.where(F.col("source") == vision)), ("has_suggestion", suggested))
    for name, child in marks:
        keys = child.select(F.col("doc_id").alias("id")).distinct().withColumn(name, F.lit(True))
        docs = docs.join(keys, "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return docs.withColumn("fully", F.col("has_embedding") & F.col("has_vision") & F.col("has_suggestion"))


def corpus_stats(flags: DataFrame) -> DataFrame:
    """One row of totals; `processed` counts embedded documents, not fully processed ones."""
    n = lambda c: F.count_if(c).alias(c)
    return flags.agg(F.count(F.lit(1)).alias("total"), F.count_if("has_embedding").alias("embeddings"), F.count_if("has_vision").alias("vision"), F.count_if("has_suggestion").alias("suggestions"), n("fully")).select(
        "*", F.col("embeddings").alias("processed"), F.greatest(F.lit(0), F.col("total") - F.col("fully")).cast("long").alias("unprocessed")
    )


def dashboard_totals(flags: DataFrame) -> DataFrame:
    open_ = ~F.col("fully")
    return flags.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("fully").alias("processed"), F.count_if(open_).alias("unprocessed"),
        F.count_if(F.col("correspondent_id").isNull()).alias("unassigned"), F.count_if(open_ & F.col("correspondent_id").isNull()).alias("unassigned_unprocessed"),
    )


def page_count_histogram(docs: DataFrame) -> DataFrame:
    """(label, n) for every label, empty ones included."""
    pages = F.col("page_count")
    inside = [F.count_if(pages.between(lo, hi)).alias(label) for lo, hi, label in PAGE_BUCKETS]
    wide = docs.agg(F.count_if(pages.isNull() | (pages < 1)).alias("Unknown"), *inside, F.count_if(pages >= 100).alias("100+"))
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"`{c}`").alias("n")) for c in wide.columns])).alias("x")).select("x.*")


def top_groups(facts: DataFrame, key: str, names: DataFrame, rest: str, *, limit: int | None = 10, total: DataFrame | None = None) -> DataFrame:
    """Documents and unprocessed documents of the largest groups.

    `facts` has doc_id, key and fully; `names` has id and name; `total` holds all
    documents (doc_id, fully) if facts is a bridge that misses some.  Documents in no
    group form the row `rest`, which comes after groups of its size.
    """
    grouped = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("fully")).alias("unprocessed"))
    named = grouped.join(names, grouped[key] == names["id"]).groupBy("name").agg(F.sum("n").alias("n"), F.sum("unprocessed").alias("unprocessed")).withColumn("is_rest", F.lit(False))
    if total is None:
        left = facts.where(F.col(key).isNull())
    else:
        left = total.join(facts.select("doc_id").distinct(), "doc_id", "left_anti")
    other = left.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("fully")).alias("unprocessed")).where("n > 0").select(F.lit(rest).alias("name"), "n", "unprocessed", F.lit(True).alias("is_rest"))
    out = named.unionByName(other).orderBy(F.desc("n"), "is_rest", "name")
    return (out.limit(limit) if limit else out).select("name", "n", "unprocessed")


def month_of(document_date: str = "document_date", created: str = "created") -> Column:
    part = lambda c: F.nullif(F.substring(c, 1, 7), F.lit(""))
    return F.coalesce(part(document_date), part(created), F.lit("Unknown"))


def monthly_processing(flags: DataFrame) -> DataFrame:
    return flags.groupBy(month_of().alias("month")).agg(F.count(F.lit(1)).alias("total"), F.count_if("fully").alias("processed"), F.count_if(~F.col("fully")).alias("unprocessed")).orderBy(F.col("month") == "Unknown", "month")


def monthly_tail(months: DataFrame, n: int) -> DataFrame:
    """The last n dated months, oldest first."""
    return months.where("month != 'Unknown'").orderBy(F.desc("month")).limit(n).orderBy("month")


def shares_with_other(groups: DataFrame, n: int = 10) -> DataFrame:
    """The n largest groups and 'Other', with percent (half up) and running percent.

    `groups` is a list of names with counts that has been reduced to names already.
    """
    top = groups.orderBy(F.desc("n"), "name").limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "name")))
    all_ = groups.agg(F.sum("n").alias("all"))
    other = top.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("top")).crossJoin(all_).select(F.lit("Other").alias("name"), (F.col("all") - F.col("top")).alias("n"), F.lit(n + 1).alias("rank")).where("n > 0")
    rows = top.select("name", "n", "rank").unionByName(other).crossJoin(all_)
    running = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda x: F.when(F.col("all") == 0, 0.0).otherwise(F.round(100.0 * x / F.col("all"), 4))
    return rows.select("rank", "name", "n", share(F.col("n")).alias("percent"), share(F.sum("n").over(running)).alias("running_percent"))


def detail_status(docs: DataFrame, page_texts: DataFrame, suggested: DataFrame, embedded: DataFrame, vision: str) -> DataFrame:
    """Per document: pages of either layer, newest stamps and sources, from pre-aggregated children."""
    # Distinct pages first: two distinct counts in one aggregate would multiply its rows.
    once = page_texts.groupBy(F.col("doc_id").alias("id"), (F.col("source") == vision).alias("seen"), "page").agg(F.max("created_at").alias("at"))
    pages = once.groupBy("id").agg(F.count_if("seen").alias("vision_pages"), F.count_if(~F.col("seen")).alias("baseline_pages"), F.max(F.when(F.col("seen"), F.col("at"))).alias("vision_at"))
    given = suggested.groupBy(F.col("doc_id").alias("id")).agg(F.max("processed_at").alias("suggested_at"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("suggestion_sources"))
    vectors = embedded.select(F.col("doc_id").alias("id"), "embedded_at", "embedding_source", "chunk_count")
    out = docs.select("id", "page_count").join(pages, "id", "left").join(given, "id", "left").join(vectors, "id", "left")
    expected = F.coalesce("page_count", F.lit(0))
    done = F.coalesce("vision_pages", F.lit(0))
    return out.withColumn("vision_pages", done).withColumn("baseline_pages", F.coalesce("baseline_pages", F.lit(0))).withColumn("vision_complete", F.when(expected > 0, done >= expected).otherwise(done > 0)).withColumn(
        "coverage", F.when(expected > 0, F.bround(100.0 * F.least(done, expected) / expected, 2)).otherwise(F.lit(None).cast("double"))
    )


def analysed(docs: DataFrame, which: str = "all", model: str = "") -> DataFrame:
    """Documents with any of has_embedding, has_suggestion and has_vision ("analyzed"), without ("open"), or all; and of a model's name."""
    some = F.col("has_embedding") | F.col("has_suggestion") | F.col("has_vision")
    out = docs if which == "all" else docs.where(some if which == "analyzed" else ~some)
    needle = model.strip().lower()
    return out.where(F.lower(F.coalesce("model_name", F.lit(""))).contains(needle)) if needle else out


def visible_documents(docs: DataFrame, *, query: str = "", only_lang: str | None = None) -> DataFrame:
    """Case-insensitive contains over id, source and content; a blank query keeps all."""
    text = F.lower(F.concat_ws(" ", F.col("doc_id").cast("string"), "source", "text"))
    out = docs.where(F.col("lang") == only_lang) if only_lang else docs
    return out.where(text.contains(query.strip().lower())) if query.strip() else out


def page_of(rows: DataFrame, order: list[Column], *, limit: int, offset: int) -> DataFrame:
    """A page with the number of all rows; limit is clamped to 1..1000, offset to 0 or more."""
    total = rows.agg(F.count(F.lit(1)).alias("total_rows"))
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(1000, max(1, limit))).crossJoin(F.broadcast(total))


def with_correspondent(docs: DataFrame, correspondent_id: int) -> DataFrame:
    """Equality on the correspondent; -1 stands for none."""
    return docs.where(F.col("correspondent_id").isNull() if correspondent_id == -1 else F.col("correspondent_id") == correspondent_id)
