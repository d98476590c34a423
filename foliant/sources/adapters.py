"""The archive's tables as views of the driver's star schema.

Derived columns are plain functions of the keys, so that every branch of an
operator (deleted, unassigned, undated, of unknown length) has rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELETED_PREFIX = "DELETED upstream"
BASELINE, VISION = "text_layer", "vision_ocr"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(column: str, n: int) -> Column:
    return F.col(column) % n == 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational documents: one for each order."""
    key = "o_orderkey"
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        F.col(key).alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderstatus"), F.lit(" "), F.col(key).cast("string")).alias("title"),
        F.when(~_every("o_custkey", 10), F.col("o_custkey")).alias("correspondent_id"),
        F.when(~_every(key, 11), F.col("o_orderpriority")).alias("document_type"),
        F.when(_every(key, 7), F.lit("")).when(~_every(key, 5), day).alias("document_date"),
        F.when(~_every(key, 35), F.concat(day, F.lit("T08:00:00Z"))).alias("created"),
        F.concat(F.date_format(F.date_add("o_orderdate", (F.col(key) % 40).cast("int")), "yyyy-MM-dd"), F.lit("T08:00:00Z")).alias("modified"),
        F.when(~_every(key, 13), (F.col(key) % 120).cast("int")).alias("page_count"),
        F.when(_every(key, 17), F.lit(f"{DELETED_PREFIX} @ 2024-01-01")).alias("deleted_at"),
        F.col("o_totalprice").alias("total"),
    )


def correspondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def document_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge (document_id, tag_id): the parts of all lines."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("tag_id")).distinct()


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_type").alias("name"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, source, created_at, processed_at): one for each line."""
    stamp = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T10:00:00Z"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("page"),
        F.when(F.col("l_returnflag") == "R", VISION).otherwise(BASELINE).alias("source"),
        stamp.alias("created_at"),
        F.concat(F.lit("model-"), F.col("l_linestatus")).alias("model_name"),
    )


def embeddings_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, embedded_at, embedding_source, chunk_count) of embedded documents."""
    lines = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'")
    stamp = F.concat(F.date_format(F.max("l_shipdate"), "yyyy-MM-dd"), F.lit("T11:00:00Z"))
    source = F.when(F.max("l_returnflag") == F.min("l_returnflag"), "baseline").otherwise("both")
    return lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(stamp.alias("embedded_at"), source.alias("embedding_source"), F.count(F.lit(1)).cast("int").alias("chunk_count"))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, processed_at) of stored suggestions."""
    lines = table(spark, sf_dir, "lineitem").where("l_discount > 0.05")
    source = F.when(F.col("l_returnflag") == "R", VISION).otherwise(BASELINE)
    stamp = F.concat(F.date_format(F.max("l_shipdate"), "yyyy-MM-dd"), F.lit("T12:00:00Z"))
    return lines.groupBy(F.col("l_orderkey").alias("doc_id"), source.alias("source")).agg(stamp.alias("processed_at"))


def task_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log: one run for each event."""
    n = F.get_json_object("props", "$.k").cast("int")
    message = F.when(F.col("event_id") % 5 == 0, "Request timed out after 60 s").when(F.col("event_id") % 5 == 1, "connection refused").when(F.col("event_id") % 5 == 2, "429 Rate limit").when(F.col("event_id") % 5 == 3, "could not parse JSON").otherwise("boom")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("doc_id"),
        F.col("event_type").alias("task"),
        F.when(F.col("event_id") % 3 == 0, F.lit("")).when(F.col("event_id") % 3 == 1, F.lit(VISION)).alias("source"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 9 == 0, "running").when(F.col("event_id") % 9 == 1, "retrying").otherwise("completed").alias("status"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.when(F.col("event_type") == "error", message).alias("error_message"),
        F.coalesce(n, F.lit(0)).alias("attempt"),
        F.round("value", 4).alias("value"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"stage":"chunk","current":'), n.cast("string"), F.lit(',"total":100}'))).when(F.col("event_id") % 4 == 1, F.lit("not json")).alias("checkpoint_json"),
    )


#: The same views for DuckDB.
SQL = f"""
docs AS (SELECT o_orderkey AS id, concat('Order ', o_orderstatus, ' ', o_orderkey) AS title,
  CASE WHEN o_custkey % 10 != 0 THEN o_custkey END AS correspondent_id,
  CASE WHEN o_orderkey % 11 != 0 THEN o_orderpriority END AS document_type,
  CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 5 != 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS document_date,
  CASE WHEN o_orderkey % 35 != 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T08:00:00Z' END AS created,
  strftime(o_orderdate + CAST(o_orderkey % 40 AS INTEGER) * INTERVAL 1 DAY, '%Y-%m-%d') || 'T08:00:00Z' AS modified,
  CASE WHEN o_orderkey % 13 != 0 THEN CAST(o_orderkey % 120 AS INTEGER) END AS page_count,
  CASE WHEN o_orderkey % 17 = 0 THEN '{DELETED_PREFIX} @ 2024-01-01' END AS deleted_at, o_totalprice AS total FROM orders),
active AS (SELECT * FROM docs WHERE deleted_at IS NULL OR NOT starts_with(deleted_at, '{DELETED_PREFIX}')),
corr AS (SELECT c_custkey AS id, c_name AS name FROM customer),
doc_tags AS (SELECT DISTINCT l_orderkey AS document_id, l_partkey AS tag_id FROM lineitem),
tags AS (SELECT p_partkey AS id, p_brand || ' ' || p_type AS name FROM part),
pages_t AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, CASE WHEN l_returnflag = 'R' THEN '{VISION}' ELSE '{BASELINE}' END AS source,
  strftime(l_shipdate, '%Y-%m-%d') || 'T10:00:00Z' AS created_at, 'model-' || l_linestatus AS model_name FROM lineitem),
emb AS (SELECT l_orderkey AS doc_id, strftime(max(l_shipdate), '%Y-%m-%d') || 'T11:00:00Z' AS embedded_at,
  CASE WHEN max(l_returnflag) = min(l_returnflag) THEN 'baseline' ELSE 'both' END AS embedding_source, CAST(count(*) AS INTEGER) AS chunk_count
  FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey),
sugg AS (SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'R' THEN '{VISION}' ELSE '{BASELINE}' END AS source,
  strftime(max(l_shipdate), '%Y-%m-%d') || 'T12:00:00Z' AS processed_at FROM lineitem WHERE l_discount > 0.05 GROUP BY 1, 2),
flags AS (SELECT a.*, EXISTS (SELECT 1 FROM emb WHERE emb.doc_id = a.id) AS has_embedding,
  EXISTS (SELECT 1 FROM pages_t p WHERE p.doc_id = a.id AND p.source = '{VISION}') AS has_vision,
  EXISTS (SELECT 1 FROM sugg s WHERE s.doc_id = a.id) AS has_suggestion FROM active a),
full_flags AS (SELECT *, has_embedding AND has_vision AND has_suggestion AS fully FROM flags),
runs AS (SELECT event_id AS id, user_id AS doc_id, event_type AS task,
  CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '{VISION}' END AS source,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 9 = 0 THEN 'running' WHEN event_id % 9 = 1 THEN 'retrying' ELSE 'completed' END AS status,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at,
  CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'Request timed out after 60 s' WHEN 1 THEN 'connection refused' WHEN 2 THEN '429 Rate limit' WHEN 3 THEN 'could not parse JSON' ELSE 'boom' END END AS error_message,
  coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS attempt, round(value, 4) AS value,
  CASE event_id % 4 WHEN 0 THEN '{{"stage":"chunk","current":' || json_extract_string(props, '$.k') || ',"total":100}}' WHEN 1 THEN 'not json' END AS checkpoint_json
  FROM events)
"""
