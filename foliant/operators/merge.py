"""Upserts, pruning, soft deletes and note merging of keyed frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.ranks import ranked


def upsert(base: DataFrame, new: DataFrame, keys: list[str], ordinal: Column | None = None) -> DataFrame:
    """`base` with the rows of `new` in place of those with equal keys.

    Of rows of `new` with equal keys the first by `ordinal` counts.
    """
    if ordinal is not None:
        first = Window.partitionBy(*keys).orderBy(ordinal)
        new = new.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*base.columns))


def prune(base: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """Rows whose key is still valid; with no valid keys nothing stays."""
    return base.join(valid.select(key).distinct(), key, "left_semi")


def mark_missing(base: DataFrame, seen: DataFrame, key: str, mark: str, *, incremental: bool) -> DataFrame:
    """Soft-delete rows that a full sync has not seen; an incremental one marks nothing."""
    if incremental:
        return base
    there = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    out = base.join(there, key, "left")
    gone = F.col("_seen").isNull() & F.col("deleted_at").isNull()
    return out.withColumn("deleted_at", F.when(gone, mark).otherwise(F.col("deleted_at"))).select(*base.columns)


def merge_notes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Notes (document_id, id, note) after a sync of the documents in `incoming`.

    `incoming` has document_id, raw_id, note and ordinal.  Ids that are no numbers are
    skipped and keep a document's stale notes; the first of repeated ids counts.  An
    existing note of another document that holds an incoming id moves to a new
    negative id, in the order of ids.
    """
    given = incoming.withColumn("id", F.expr("try_cast(raw_id AS bigint)"))
    guard = given.groupBy("document_id").agg(F.bool_or(F.col("id").isNull()).alias("malformed"))
    first = Window.partitionBy("document_id", "id").orderBy("ordinal")
    fresh = given.where("id IS NOT NULL").withColumn("_n", F.row_number().over(first)).where("_n = 1").select("document_id", "id", "note")
    own = existing.join(fresh.select("document_id", "id"), ["document_id", "id"], "left_anti").join(guard, "document_id", "left")
    kept = own.where("malformed IS NULL OR malformed").select("document_id", "id", "note")
    clash = kept.join(fresh.select("id").distinct(), "id", "left_semi")
    lowest = existing.agg(F.least(F.lit(0), F.coalesce(F.min("id"), F.lit(0))).alias("low"))
    moved = numbered(clash, "id", ["document_id"]).crossJoin(F.broadcast(lowest)).select("document_id", (F.col("low") - F.col("n")).alias("id"), "note")
    return kept.join(fresh.select("id").distinct(), "id", "left_anti").select("document_id", "id", "note").unionByName(moved).unionByName(fresh)


def numbered(rows: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """`rows` plus `n` from 1 in the order of a key, then of `ties`, without a window over all rows."""
    return ranked(rows, [], [F.col(c) for c in (key, *ties)], "n")


def next_local_id(notes: DataFrame) -> DataFrame:
    low = F.min("id")
    return notes.agg(F.when(low.isNull() | (low >= 0), -1).otherwise(low - 1).cast("long").alias("next_id"))


def delete_for(frames: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """Child frames without the rows of some documents."""
    return {name: f.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti") for name, f in frames.items()}


def best_name_match(wanted: DataFrame, known: DataFrame, *, gram: int = 3) -> DataFrame:
    """(name, id): an exact case-insensitive match, else the shortest known name that contains the wanted one.

    A contained name shares its first `gram` characters with some window of the other,
    so windows equi-join before the texts are compared; shorter names match exactly only.
    Of known names with one text the least id is taken first.  Windows that no wanted
    name begins with go before the join, and the join is never a broadcast: Spark sizes
    windows by the names that they were made from, and would send all of them to the driver.
    """
    w = wanted.select("name", F.lower(F.trim("name")).alias("w")).where("w != ''").distinct()
    k = known.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min("id").alias("id"))
    keyed = w.withColumn("g", F.left("w", F.lit(gram)))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("k") - gram + 1)), lambda i: F.substring(F.col("k"), i, F.lit(gram)))
    spots = k.select("id", "k", F.explode(F.array_distinct(windows)).alias("g")).join(keyed.select("g").distinct(), "g", "left_semi")
    inside = keyed.join(spots.hint("merge"), "g").where(F.col("k").contains(F.col("w")))
    # A name under `gram` characters is a window of its own, and so meets only its equals.
    tier = F.when(F.col("k") == F.col("w"), 0).otherwise(1)
    best = inside.groupBy("name").agg(F.min(F.struct(tier.alias("tier"), F.length("k").alias("size"), "id")).alias("x"))
    return best.select("name", "x.id")
