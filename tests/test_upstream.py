import json
import threading
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from foliant.sources import rest


class Archive(BaseHTTPRequestHandler):
    """A list that can be read by modification time, and notes that can be posted."""

    rows: dict[int, str] = {}
    notes: dict[int, list[str]] = {}
    posts: list = []
    lost: set = set()  # paths whose next answer is lost after the work is done
    asked: list = []  # single rows that were asked for
    broken: set = set()  # of these, the ones that the server fails on
    other: set = set()  # and the ones for which it gives another row

    def do_GET(self):
        url = urllib.parse.urlparse(self.path)
        if url.path.endswith("/notes/"):
            return self._say([{"id": 1, "note": n} for n in self.notes.get(int(url.path.split("/")[-3]), [])])
        if url.path.endswith("/") and (last := url.path.split("/")[-2]).isdigit():
            self.asked.append(i := int(last))
            code = 500 if i in self.broken else 200 if i in self.rows else 404
            return self._say({"id": i + (i in self.other), "title": f"t{i}", "modified": self.rows.get(i)}, code)
        q = dict(urllib.parse.parse_qsl(url.query))
        rows = sorted((m, i) for i, m in self.rows.items() if q.get("modified__gte", "") <= m and (not q.get("modified__lte") or m <= q["modified__lte"]))
        rows = rows[::-1] if q["ordering"].startswith("-") else rows
        size, page = int(q["page_size"]), int(q["page"])
        return self._say({"count": len(rows), "results": [{"id": i, "title": f"t{i}", "modified": m} for m, i in rows[(page - 1) * size : page * size]]})

    def do_POST(self):
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
        self.posts.append((self.command, self.path, body))
        if self.command == "POST":
            self.notes.setdefault(int(self.path.split("/")[-3]), []).append(json.loads(body)["note"])
        if self.path in self.lost:
            self.lost.discard(self.path)
            self.close_connection = True
            return self.connection.close()
        return self._say({})

    do_PATCH = do_DELETE = do_POST

    def _say(self, body, code=200):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def archive():
    Archive.rows, Archive.notes, Archive.posts, Archive.lost = {}, {}, [], set()
    server = HTTPServer(("127.0.0.1", 0), Archive)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def stamp(minute):
    return f"2024-05-01T{minute // 60:02d}:{minute % 60:02d}:00+00:00"


def test_stream_of_modified_rows(spark, archive, tmp_path):
    spark.dataSource.register(rest.ModifiedStream)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run():
        stream = spark.readStream.format("modified_list").option("url", f"{archive}/docs").option("page_size", "3").option("partitions", "3").load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(120)
        return Counter((r.id, r.modified) for r in spark.read.schema("id long, title string, modified string").parquet(out).collect())

    Archive.rows = {i: stamp(i * 3) for i in range(20)} | {100 + i: stamp(30) for i in range(8)}  # more of one time than a page holds
    wanted = Counter(Archive.rows.items())
    assert run() == wanted
    assert run() == wanted  # nothing new
    Archive.rows |= {4: stamp(61), 5: stamp(61), 200: stamp(62)}
    wanted.update({(4, stamp(61)): 1, (5, stamp(61)): 1, (200, stamp(62)): 1})
    assert run() == wanted


def test_rows_that_move_on_while_a_batch_is_read(archive):
    Archive.rows = {i: stamp(i) for i in range(12)}
    reader = rest.ModifiedReader({"url": f"{archive}/docs", "page_size": "3", "partitions": "1"}, ["id", "modified"])
    start, end = reader.initialOffset(), reader.latestOffset()
    rows = reader.read(reader.partitions(start, end)[0])
    first = [next(rows) for _ in range(4)]
    Archive.rows |= {1: stamp(50), 6: stamp(51)}  # one that was read and one that was not
    got = first + list(rows)
    later = reader.latestOffset()
    got2 = [r for p in reader.partitions(end, later) for r in reader.read(p)]
    assert [i for i, _ in got] == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11] and [i for i, _ in got2] == [1, 6]
    assert reader.partitions(later, later) == []


def test_calls_are_sent_once(spark, archive, tmp_path):
    calls = spark.createDataFrame(
        [(d, s, m, f"/api/documents/{d}/{p}", b) for d in (1, 2, 3) for s, m, p, b in ((0, "PATCH", "", '{"title":"x"}'), (1, "POST", "notes/", f'{{"note":"n{d}"}}'))],
        "doc_id long, step int, method string, path string, payload string",
    )
    sent = str(tmp_path / "sent")
    Archive.lost = {"/api/documents/2/notes/", "/api/documents/3/"}
    first = {(r.doc_id, r.step): r.ok for r in rest.send_once(calls, sent, archive, "t").collect()}
    assert first == {(1, 0): True, (1, 1): True, (2, 0): True, (2, 1): False, (3, 0): False, (3, 1): False}
    again = {(r.doc_id, r.step): (r.ok, r.detail) for r in rest.send_once(calls, sent, archive, "t").collect()}
    assert all(ok for ok, _ in again.values()) and again[2, 1][1] == "there already"
    assert Archive.notes == {1: ["n1"], 2: ["n2"], 3: ["n3"]}
    n = len(Archive.posts)
    assert rest.send_once(calls, sent, archive, "t").where("ok").count() == 6 and len(Archive.posts) == n
    rest.sending(sent, archive, "t")(calls.withColumn("payload", F.when(F.col("step") == 0, '{"title":"y"}').otherwise(F.col("payload"))), 1)
    assert [p for p in Archive.posts[n:] if p[0] != "PATCH"] == [] and len(Archive.posts) == n + 3


def test_a_killed_run_posts_no_note_twice(spark, archive, tmp_path, monkeypatch):
    calls = spark.createDataFrame([(7, 0, "POST", "/api/documents/7/notes/", '{"note":"once"}')], "doc_id long, step int, method string, path string, payload string")
    sent = str(tmp_path / "sent")
    list(rest.send_calls(calls, archive, "t", dry_run=False, look=True).collect())  # sent, and the run is lost before its log appears
    assert rest.send_once(calls, sent, archive, "t").first().detail == "there already"
    assert Archive.notes == {7: ["once"]}
