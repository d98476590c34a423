"""Readers and sinks: a paged REST list source, binary files and upstream calls."""

from __future__ import annotations

import datetime
import hashlib
import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual
from pyspark.sql.types import StructType

from foliant.sources.versioned import VersionedTable
from foliant.storage import Scratch, file_system


def _get(url: str, token: str) -> dict:
    request = urllib.request.Request(url, headers={"Authorization": f"Token {token}"} if token else {})
    with urllib.request.urlopen(request, timeout=60) as answer:
        return json.load(answer)


class PagedList(DataSource):
    """spark.read.format("paged_list"): one partition for each page of a REST list.

    Options: url, token, page_size, ordering (id by default, so that pages do not shift
    under writes), schema as DDL.  Equality and range filters on document_date, modified,
    correspondent and tags go to the server; an equal id reads that row alone.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_list"

    def schema(self) -> str:
        return self.options.get("schema", "id long, title string, modified string")

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options), schema.fieldNames())


class PagedReader(DataSourceReader):
    NAMES = {"correspondent": "correspondent__id", "tags": "tags__id"}

    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.options, self.names, self.query, self.row = options, names, {"ordering": options.get("ordering", "id")}, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else ""
            if isinstance(f, EqualTo) and name == "id":
                self.row = f.value
            elif isinstance(f, EqualTo) and name in self.NAMES:
                self.query[self.NAMES[name]] = str(f.value)
            elif isinstance(f, GreaterThanOrEqual) and name in ("modified", "document_date"):
                self.query[f"{name}__gte"] = str(f.value)
            elif isinstance(f, LessThanOrEqual) and name == "document_date":
                self.query[f"{name}__lte"] = str(f.value)
            else:
                yield f

    def _url(self, page: int) -> str:
        size = self.options.get("page_size", "100")
        return f"{self.options['url']}?{urllib.parse.urlencode({**self.query, 'page': page, 'page_size': size})}"

    def partitions(self) -> list[InputPartition]:
        if self.row is not None:
            return [InputPartition(0)]
        count = int(_get(self._url(1), self.options.get("token", "")).get("count", 0))
        size = int(self.options.get("page_size", "100"))
        return [InputPartition(p) for p in range(1, max(1, -(-count // size)) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.row is not None:
            try:
                row = _get(f"{self.options['url'].rstrip('/')}/{self.row}/", self.options.get("token", ""))
            except urllib.error.HTTPError as error:
                if error.code != 404:
                    raise
                return
            yield tuple(row.get(n) for n in self.names)
            return
        for row in _get(self._url(partition.value), self.options.get("token", "")).get("results", []):
            yield tuple(row.get(n) for n in self.names)


class ModifiedStream(DataSource):
    """spark.readStream.format("modified_list"): rows of a REST list as they are modified.

    The offset is the place (modified, id) of the newest row read.  A micro-batch has the
    rows after it, up to the newest at its start; a row that is modified meanwhile moves
    on and comes with the next batch, so none is lost, and none comes twice as it was.
    Options: url, token, page_size, schema as DDL with id and modified, partitions: equal
    parts of a batch's time that are read side by side.
    """

    @classmethod
    def name(cls) -> str:
        return "modified_list"

    def schema(self) -> str:
        return self.options.get("schema", "id long, title string, modified string")

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ModifiedReader(dict(self.options), schema.fieldNames())


class TimeRange(InputPartition):
    """Rows after one place and up to another; both are (modified, id)."""

    def __init__(self, after: tuple[str, int], to: tuple[str, int]) -> None:
        self.after, self.to = after, to


class ModifiedReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.options, self.names, self.newest = options, names, None

    def _page(self, **query: str | int) -> dict:
        size = self.options.get("page_size", "100")
        return _get(f"{self.options['url']}?{urllib.parse.urlencode({'page_size': size, **query})}", self.options.get("token", ""))

    def initialOffset(self) -> dict:
        return {"modified": "", "id": -1}

    def latestOffset(self) -> dict:
        rows = self._page(ordering="-modified,-id", page=1, page_size=1).get("results", [])
        if rows and (self.newest is None or (rows[0]["modified"], rows[0]["id"]) > (self.newest["modified"], self.newest["id"])):
            self.newest = {"modified": rows[0]["modified"], "id": rows[0]["id"]}
        return self.newest or self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, to = (start["modified"], start["id"]), (end["modified"], end["id"])
        if after >= to:
            return []
        n = int(self.options.get("partitions", "4"))
        first = after[0]
        if not first:  # the first batch begins with the oldest row
            rows = self._page(ordering="modified,id", page=1, page_size=1).get("results", [])
            first = rows[0]["modified"] if rows else to[0]
        cuts = [after, *[(c, -1) for c in _between(first, to[0], n)], to]
        return [TimeRange(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def read(self, partition: TimeRange) -> Iterator[tuple]:
        """Page by page from the last row seen, so that rows which leave the range shift no page."""
        at, page = partition.after, 1
        while True:
            asked = {"modified__gte": at[0]} if at[0] else {}
            rows = self._page(ordering="modified,id", page=page, modified__lte=partition.to[0], **asked).get("results", [])
            fresh = [r for r in rows if at < (r["modified"], r["id"]) <= partition.to]
            for row in fresh:
                yield tuple(row.get(n) for n in self.names)
            if len(rows) < int(self.options.get("page_size", "100")):
                return
            if fresh:
                at, page = (fresh[-1]["modified"], fresh[-1]["id"]), 1
            else:  # a whole page of rows that were read with the same time: its next page
                page += 1

    def commit(self, end: dict) -> None:
        pass


def _between(first: str, last: str, n: int) -> list[str]:
    """n - 1 times that cut a range of ISO times in equal parts; none where these cannot be told."""
    try:
        a, b = (datetime.datetime.fromisoformat(t) for t in (first, last))
        found = [(a + (b - a) * k / n).isoformat() for k in range(1, n)]
        return sorted({t for t in found if first < t < last})
    except (ValueError, TypeError):
        return []


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def fetch_many(ids: DataFrame, remote: DataFrame) -> DataFrame:
    """Rows of `remote` for distinct positive ids."""
    return remote.join(ids.where(F.col("id") > 0).select("id").distinct(), "id", "left_semi")


def fetch_missing(wanted: DataFrame, local: DataFrame, url: str, token: str, schema: str, *, partitions: int = 8) -> DataFrame:
    """(id, state, detail, row) of every wanted id that `local` does not have, each asked for once.

    state is `found` (row has the fields of `schema`), `missing` where the server does not
    know it, `invalid` where the answer is of another id or no object, or `failed` where it
    could not be read.  The executors ask, row by row, over `partitions` connections at a time.
    """
    names = StructType.fromDDL(schema).fieldNames()
    absent = wanted.select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL").distinct().join(local.select(F.col("id").cast("long").alias("id")), "id", "left_anti")

    def fetch(number: int) -> tuple[str, str | None, str | None]:
        try:
            row = _get(f"{url.rstrip('/')}/{number}/", token)
        except urllib.error.HTTPError as error:
            return ("missing" if error.code == 404 else "failed"), str(error)[:1000], None
        except (OSError, ValueError) as error:
            return "failed", str(error)[:1000], None
        if not isinstance(row, dict) or row.get("id") != number:
            return "invalid", "the answer is of another document", None
        return "found", None, json.dumps({n: row.get(n) for n in names})

    def ask(batches):
        for batch in batches:
            numbers = batch.column("id").to_pylist()
            states, details, rows = zip(*map(fetch, numbers), strict=True) if numbers else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *[pa.array(c, pa.string()) for c in (states, details, rows)]], ["id", "state", "detail", "row"])

    said = absent.repartition(partitions, "id").mapInArrow(ask, "id long, state string, detail string, row string")
    return said.withColumn("row", F.from_json("row", schema))


def sync_missing(wanted: DataFrame, table: VersionedTable, url: str, token: str, schema: str) -> DataFrame:
    """Put wanted documents that the table does not have into it; (id, state) of each wanted id.

    state is `local`, `synced`, or why it is not there.  Answers are saved before they are
    merged, so no row is asked for twice in one call; a call that was killed asks again.
    """
    spark = wanted.sparkSession
    local = table.read() if table.versions() else spark.createDataFrame([], schema)
    answers = Scratch(spark, "missing").save(fetch_missing(wanted, local, url, token, schema), "answers")
    found = answers.where("state = 'found'").select("row.*")
    if not found.isEmpty():
        table.upsert(found)
    state = F.when(F.col("state") == "found", "synced").otherwise(F.coalesce("state", F.lit("local")))
    ids = wanted.select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL").distinct()
    return ids.join(answers.select("id", "state"), "id", "left").select("id", state.alias("state"))


def coalesce_remote(remote: DataFrame, local: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of documents with the remote value, or the local one where that is blank."""
    r, l = remote.alias("r"), local.alias("l")  # noqa: E741
    pick = [F.coalesce(F.nullif(F.col(f"r.{c}").cast("string"), F.lit("")), F.col(f"l.{c}").cast("string")).alias(c) for c in columns]
    return r.join(l, "id", "full").select("id", *pick)


def _has_note(url: str, token: str, payload: str) -> bool:
    """Does the server show a document's note already?"""
    there = _get(url, token)
    there = there.get("results", there.get("notes", [])) if isinstance(there, dict) else there
    return any(str(n.get("note") or "").strip() == str(json.loads(payload).get("note") or "").strip() for n in there)


def send_calls(calls: DataFrame, url: str, token: str, *, dry_run: bool = True, look: bool = False) -> DataFrame:
    """(doc_id, step, ok, detail) after PATCH, POST and DELETE calls with their JSON payloads; a dry run sends nothing.

    The calls of a document go out in order, and after one that fails the rest of it is
    left out.  Each call carries a key of its content, by which a server can tell a call
    that a repeated task sends again; with `look` a note is posted only where the server
    does not show it, which needs no help of the server's.
    """

    def send(batches):
        failed = set()  # documents of this part whose calls have failed
        for batch in batches:
            out = []
            for doc, step, method, path, payload in zip(batch["doc_id"], batch["step"], batch["method"], batch["path"], batch["payload"], strict=True):
                if doc in failed:
                    out.append((doc, step, False, "left out after a failed call"))
                    continue
                if dry_run:
                    out.append((doc, step, True, f"{method} {path}"))
                    continue
                try:
                    if look and method == "POST" and path.endswith("/notes/") and _has_note(url.rstrip("/") + path, token, payload):
                        out.append((doc, step, True, "there already"))
                        continue
                    key = hashlib.sha256(json.dumps([int(doc), int(step), method, path, payload]).encode()).hexdigest()
                    headers = {"Authorization": f"Token {token}", "Content-Type": "application/json", "Idempotency-Key": key}
                    request = urllib.request.Request(url.rstrip("/") + path, data=None if method == "DELETE" else (payload or "{}").encode(), method=method, headers=headers)
                    with urllib.request.urlopen(request, timeout=60) as answer:
                        out.append((doc, step, True, str(answer.status)))
                except OSError as error:
                    failed.add(doc)
                    out.append((doc, step, False, str(error)))
            yield batch[["doc_id", "step"]].assign(ok=[o[2] for o in out], detail=[o[3] for o in out])

    ordered = calls.repartition("doc_id").sortWithinPartitions("doc_id", "step")
    return ordered.select("doc_id", "step", "method", "path", "payload").mapInPandas(send, "doc_id long, step int, ok boolean, detail string")


def call_key() -> Column:
    """What makes a call the same one: its document, place, method, path and payload."""
    return F.sha2(F.to_json(F.struct("doc_id", "step", "method", "path", "payload"), {"ignoreNullFields": "false"}), 256)


def send_once(calls: DataFrame, sent: str, url: str, token: str) -> DataFrame:
    """send_calls() of what the log at `sent` does not have yet; returns the log's rows of `calls`.

    The log has key, doc_id, step, ok and detail of every call, and its rows appear when a
    whole run has ended.  Calls that went through are not sent again.  A run that was cut
    down has left none in the log, and its tasks may have sent some: repeating a PATCH or
    DELETE changes nothing more, and a note is posted only where the server does not show
    it already, so no note comes twice.  Calls that failed are tried again.
    """
    spark = calls.sparkSession
    keyed = calls.withColumn("key", call_key())
    fs, target = file_system(spark, sent)
    schema = "key string, doc_id long, step int, ok boolean, detail string"
    log = spark.read.schema(schema).parquet(sent) if fs.exists(target) else spark.createDataFrame([], schema)
    # A document's later calls follow from its first one that has not gone through.
    done = keyed.join(log.where("ok").select("key").distinct().withColumn("_sent", F.lit(True)), "key", "left")
    first = done.where("_sent IS NULL").groupBy("doc_id").agg(F.min("step").alias("_from"))
    open_calls = done.join(first, "doc_id").where("_sent IS NULL AND step >= _from")
    results = send_calls(open_calls, url, token, dry_run=False, look=True)
    open_keys = open_calls.select("key", F.col("doc_id").alias("_doc"), F.col("step").alias("_step"))
    rows = results.join(open_keys, (F.col("doc_id") == F.col("_doc")) & (F.col("step") == F.col("_step"))).select("key", "doc_id", "step", "ok", "detail")
    rows.write.mode("append").parquet(sent)
    mine = spark.read.schema(schema).parquet(sent).join(keyed.select("key").distinct(), "key", "left_semi")
    return mine.groupBy("key", "doc_id", "step").agg(F.max("ok").alias("ok"), F.max_by("detail", "ok").alias("detail"))


def sending(sent: str, url: str, token: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a stream of calls that are sent once, whatever batches are run again."""

    def send(batch: DataFrame, number: int) -> None:
        send_once(batch, sent, url, token)

    return send


def upsert_points(stored: DataFrame, points: DataFrame) -> DataFrame:
    """Stored points with new ones in place of those of their document, source and chunk."""
    keys = ["doc_id", "source", "chunk"]
    return stored.join(points.select(*keys), keys, "left_anti").unionByName(points.select(*stored.columns))


def write_points(points: DataFrame, path: str) -> None:
    """Write a whole set of points to a new folder, chunks and centroids apart."""
    points.withColumn("kind", F.when(F.col("chunk") < 0, "centroid").otherwise("chunk")).write.mode("overwrite").partitionBy("kind").parquet(path)


def check_width(points: DataFrame) -> DataFrame:
    """One row: the least and greatest vector width and whether they agree."""
    size = F.size("embedding")
    return points.agg(F.min(size).alias("least"), F.max(size).alias("greatest")).withColumn("uniform", F.col("least") == F.col("greatest"))


def delete_points(points: DataFrame, *, doc_ids: DataFrame | None = None, source: str | None = None, centroids: bool | None = None) -> DataFrame:
    """Points without those that match every given condition."""
    hit = F.lit(True)
    if source is not None:
        hit = hit & F.col("source").eqNullSafe(source)
    if centroids is not None:
        hit = hit & ((F.col("chunk") < 0) == centroids)
    if doc_ids is None:
        return points.where(~hit)
    marked = points.join(doc_ids.select("doc_id").distinct().withColumn("_d", F.lit(True)), "doc_id", "left")
    return marked.where(~(hit & F.coalesce("_d", F.lit(False)))).select(*points.columns)


def match_filter(conditions: dict[str, list[dict]]) -> Column:
    """Predicate of {must: [{key, match}], must_not: [...]}; must_not lets absent keys pass."""
    out = F.lit(True)
    for c in conditions.get("must", []):
        out = out & F.col(c["key"]).eqNullSafe(F.lit(c["match"]["value"]))
    for c in conditions.get("must_not", []):
        out = out & ~F.col(c["key"]).eqNullSafe(F.lit(c["match"]["value"]))
    return out
