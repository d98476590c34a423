"""Run log, queue and retry operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Error codes in the order of their rules, with category and whether a retry helps.
ERROR_TYPES = (
    ("EMBED_CONTEXT_OVERFLOW", "embedding", False),
    ("LLM_TIMEOUT", "llm", True),
    ("LLM_RATE_LIMIT", "llm", True),
    ("QDRANT_UPSERT_FAIL", "vector_store", True),
    ("VECTOR_CHUNKS_MISSING", "vector_store", False),
    ("NETWORK_CONNECTION_ERROR", "network", True),
    ("INVALID_MODEL_OUTPUT", "model_output", False),
    ("WORKER_TASK_ERROR", "worker", False),
)


def source_key(column: str = "source") -> Column:
    return F.coalesce(F.trim(column), F.lit(""))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each (doc_id, task, source); a null source equals a blank one."""
    fields = F.struct("id", "status", "created_at")
    return runs.groupBy("doc_id", "task", source_key().alias("source")).agg(F.max(fields).alias("x")).select("doc_id", "task", "source", "x.*")


def fanout_status(status: Column, missing: Column) -> Column:
    return F.when(status.isin("running", "retrying"), status).when(status == "failed", "failed").when(missing, "missing").otherwise("done")


def fanout(planned: DataFrame, runs: DataFrame, missing: DataFrame) -> DataFrame:
    """Planned tasks (doc_id, task, source) with the newest run's status and a missing flag."""
    keys = ["doc_id", "task", "source"]
    plan = planned.withColumn("source", source_key())
    gaps = missing.select("doc_id", "task", source_key().alias("source")).distinct().withColumn("missing", F.lit(True))
    out = plan.join(latest_runs(runs).withColumnRenamed("id", "run_id"), keys, "left").join(gaps, keys, "left")
    return out.select(*keys, "run_id", fanout_status(F.col("status"), F.coalesce("missing", F.lit(False))).alias("state"))


def latest_checkpoint(runs: DataFrame, *, by_source: bool = False) -> DataFrame:
    """The newest checkpoint of each (doc_id, task) or (doc_id, task, source); one that is no JSON object gives nulls."""
    keys = ["doc_id", "task"] + ["source"] * by_source
    runs = runs.withColumn("source", source_key()) if by_source else runs
    newest = runs.where(F.trim(F.coalesce("checkpoint_json", F.lit(""))) != "").groupBy(*keys).agg(F.max_by("checkpoint_json", "id").alias("raw"), F.max("id").alias("run_id"))
    parsed = F.when(F.col("raw").startswith("{"), F.from_json("raw", "stage string, current int, total int"))
    out = newest.select(*keys, "run_id", parsed.alias("c"))
    resume = F.greatest(F.lit(0), F.least(F.col("c.current"), F.col("c.total")))
    return out.select(*keys, "run_id", F.col("c.stage").alias("stage"), F.col("c.current").alias("current"), F.col("c.total").alias("total"), F.coalesce(resume, F.lit(0)).alias("resume_from"))


def classify_error(message: Column, class_name: Column | None = None) -> Column:
    """Error code by the first rule that holds; messages compare in lower case."""
    m, c = F.lower(F.coalesce(message, F.lit(""))), F.lower(F.coalesce(class_name if class_name is not None else F.lit(""), F.lit("")))
    has = m.contains
    return (
        F.when(has("exceed_context_size_error") | has("context size"), "EMBED_CONTEXT_OVERFLOW")
        .when(has("timeout") | has("timed out"), "LLM_TIMEOUT")
        .when(c.contains("ratelimit") | has("rate limit"), "LLM_RATE_LIMIT")
        .when(has("qdrant") & (has("upsert failed") | has("status error")), "QDRANT_UPSERT_FAIL")
        .when(has("similarity_index_rebuild_failed") | has("chunk vectors missing"), "VECTOR_CHUNKS_MISSING")
        .when(has("connect"), "NETWORK_CONNECTION_ERROR")
        .when(has("json") & has("parse"), "INVALID_MODEL_OUTPUT")
        .otherwise("WORKER_TASK_ERROR")
    )


def error_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ERROR_TYPES), "error_type string, category string, retryable boolean").orderBy("error_type")


def with_error_type(runs: DataFrame) -> DataFrame:
    """Failed runs joined to the catalogue, which has a fixed number of rows."""
    failed = runs.where("status = 'failed'").withColumn("error_type", classify_error(F.col("error_message")))
    return failed.join(F.broadcast(error_catalogue(runs.sparkSession)), "error_type", "left")


def retry_plan(failed: DataFrame, max_retries: int = 2) -> DataFrame:
    """Delay of the next attempt, or dead letter."""
    again = F.col("retryable") & (F.col("attempt") < max_retries)
    delay = F.when(again, F.least(F.lit(300), F.lit(5) * F.pow(F.lit(2), F.least("attempt", F.lit(10)))).cast("int"))
    return failed.select("id", "doc_id", "error_type", "attempt", F.when(again, "retry").otherwise("dead_letter").alias("action"), delay.alias("delay_s"))


def dead_letters(plan: DataFrame, limit: int = 100) -> DataFrame:
    return plan.where("action = 'dead_letter'").orderBy(F.desc("id")).limit(limit)


def requeue(dead: DataFrame) -> DataFrame:
    return dead.select("id", "doc_id", F.lit(0).alias("attempt"))


def due_tasks(delayed: DataFrame, now: str, limit: int = 100) -> DataFrame:
    """Delayed tasks that are due, earliest first; due_at is an ISO string."""
    return delayed.where(F.col("due_at") <= now).orderBy("due_at", "id").limit(limit)


def task_key() -> Column:
    """doc:task[:source][:field]; blank parts are left out."""
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(":", F.col("doc_id").cast("string"), "task", part("source"))


def dedupe_tasks(tasks: DataFrame, ordinal: str = "id") -> DataFrame:
    """The first task of each key, by a column that orders them."""
    return tasks.withColumn("task_key", task_key()).groupBy("task_key").agg(F.min(ordinal).alias("first_id"), F.count(F.lit(1)).alias("requests"))


def queue_stats(runs: DataFrame, now: str, stale_s: int = 60) -> DataFrame:
    """Runs by status; running ones older than `stale_s` count as stale."""
    age = F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(F.try_to_timestamp("created_at"))
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin("running", "retrying") & (age > stale_s)).alias("stale"), F.max("created_at").alias("newest"))


def metrics_rollup(runs: DataFrame) -> DataFrame:
    """Counter and timer figures by label set."""
    return runs.groupBy("task", "status").agg(F.count("value").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.max("value").alias("largest"), F.round(F.avg("value"), 4).alias("mean"))


def matching_runs(runs: DataFrame, query: str) -> DataFrame:
    """Case-insensitive LIKE %query% over the text columns; % and _ in a query are wildcards."""
    if not query.strip():
        return runs
    columns = ("task", "source", "status", "error_message", "checkpoint_json")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{query.strip()}%"), F.lit(False))
    return runs.where(hit)


def running_labels(runs: DataFrame) -> DataFrame:
    """Label of the first running or retrying run of each document."""
    live = runs.where(F.col("status").isin("running", "retrying"))
    first = live.groupBy("doc_id").agg(F.min_by(F.struct("task", "checkpoint_json"), "id").alias("x"), F.min("id").alias("run_id"))
    c = F.when(F.col("x.checkpoint_json").startswith("{"), F.from_json("x.checkpoint_json", "stage string, current int, total int"))
    label = F.when(c.isNotNull(), F.concat(F.initcap(c["stage"]), F.lit(" "), c["current"].cast("string"), F.lit("/"), c["total"].cast("string"))).otherwise(F.col("x.task"))
    return first.select("doc_id", "run_id", label.alias("label"))


def eta_seconds(processed: Column, total: Column, elapsed: Column) -> Column:
    rate = processed / F.greatest(F.lit(1), elapsed)
    return F.when(processed > 0, F.greatest(F.lit(0.0), (total - processed) / rate).cast("long"))


def recent(runs: DataFrame, n: int = 6) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def tasks_of_status(runs: DataFrame) -> DataFrame:
    """Share of each task's runs by rank of its status counts."""
    counts = runs.groupBy("task", "status").agg(F.count(F.lit(1)).alias("n"))
    by_task = Window.partitionBy("task")
    return counts.select("task", "status", "n", F.row_number().over(by_task.orderBy(F.desc("n"), "status")).alias("rank"), F.round(F.col("n") / F.sum("n").over(by_task), 6).alias("share"))
