"""Hard negatives by exact inner-product search in an STR-packed R-tree.

Rows are sorted by label and first coordinate and cut into groups of equal size; within a group
the other coordinates are tiled by sort-tile-recursive packing into pages, each with its minimum
bounding box.  A box bounds the inner product with an anchor coordinate by coordinate.  Anchors
are sent to the groups whose box can hold a row they look for, in blocks of anchors that lie
together, and search a group's tree best first: a box is left out when its interval misses all
score windows or its upper end is strictly below the k-th score found.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.ranks import ranked
from foliant.storage import Scratch

EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
FANOUT = 16
PAGE = "g long, label_lo long, label_hi long, lo binary, hi binary, ids binary, places binary, labels binary, vectors binary, group_labels array<long>, group_lo binary, group_hi binary"
FOUND = "anchor long, w int, rank_score long, id long, place long"


def whole_parts(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of list rows as doubles, rows filled up with 0 to `width`."""
    lists = vectors.cast(pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        out[row, at] = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * 256.0)
    return np.nan_to_num(out)


def valid_points(rows: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """(id, label, x): rows with an id, a label and a vector of finite components."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))


def tiles(points: np.ndarray, at: np.ndarray, coordinates: list[int], page: int) -> list[np.ndarray]:
    """Sort-tile-recursive packing: pages of about `page` rows out of the rows `at`."""
    pages = -(-len(at) // page)
    if pages <= 1 or not coordinates:
        at = at if pages <= 1 else at[np.argsort(points[at, 0], kind="stable")]
        return [at[k : k + page] for k in range(0, len(at), page)]
    slabs = max(2, round(pages ** (1 / min(len(coordinates), 4))))
    order = at[np.argsort(points[at, coordinates[0]], kind="stable")]
    size = -(-pages // slabs) * page
    return [tile for k in range(0, len(order), size) for tile in tiles(points, order[k : k + size], coordinates[1:], page)]


def pack(rows: DataFrame, width: int, *, page_rows: int) -> DataFrame:
    """Pages of every group g of `rows` (g, id, label, x, place); a group's first page has the group's box."""

    def build(table: pa.Table) -> pa.Table:
        x = whole_parts(table["x"].combine_chunks(), width)
        own = {c: table[c].to_numpy() for c in ("id", "label", "place")}
        out = []
        spread = [int(c) for c in np.argsort(-x.std(0), kind="stable")] if width else []
        for label in np.unique(own["label"]):
            out += tiles(x, np.flatnonzero(own["label"] == label), spread, page_rows)
        pages = []
        for k, at in enumerate(out):
            first = {"group_labels": np.unique(own["label"]).tolist(), "group_lo": x.min(0).tobytes(), "group_hi": x.max(0).tobytes()} if k == 0 else {}
            pages.append({
                "g": table["g"][0].as_py(), "label_lo": int(own["label"][at].min()), "label_hi": int(own["label"][at].max()), "lo": x[at].min(0).tobytes(), "hi": x[at].max(0).tobytes(),
                "ids": own["id"][at].tobytes(), "places": own["place"][at].tobytes(), "labels": own["label"][at].tobytes(), "vectors": x[at].tobytes(), **first,
            })
        return pa.Table.from_pylist(pages, schema=_PAGE_SCHEMA)

    return rows.groupBy("g").applyInArrow(build, PAGE)


_PAGE_SCHEMA = pa.schema([*[(c, pa.int64()) for c in ("g", "label_lo", "label_hi")], *[(c, pa.binary()) for c in ("lo", "hi", "ids", "places", "labels", "vectors")], ("group_labels", pa.list_(pa.int64())), ("group_lo", pa.binary()), ("group_hi", pa.binary())])


def interval(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of q with each box, never too narrow."""
    if not q.shape[-1]:
        return np.zeros((len(q), len(lo))), np.zeros((len(q), len(lo)))
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        least, greatest = plus @ lo.T + minus @ hi.T, plus @ hi.T + minus @ lo.T
        if q.shape[-1] * np.abs(q).max(initial=0) * max(np.abs(lo).max(initial=0), np.abs(hi).max(initial=0)) >= EXACT:  # sums are rounded: no bound
            return np.full_like(least, -np.inf), np.full_like(greatest, np.inf)
    return least, greatest


def products(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products; what a long cannot hold counts as the nearest long."""
    if not vectors.size or vectors.shape[1] * np.abs(q).max() * np.abs(vectors).max() < EXACT:
        return (vectors @ q).astype(np.int64)
    other = [int(v) for v in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, other, strict=True)), LEAST), MOST) for row in vectors], np.int64)


@dataclass
class Tree:
    """Levels of boxes over pages in packing order; the last level is the root alone."""

    pages: list[dict]
    levels: list[tuple[np.ndarray, np.ndarray]]


def tree(pages: list[dict], width: int) -> Tree:
    box = lambda name: np.array([np.frombuffer(p[name]) for p in pages]).reshape(len(pages), width)
    levels = [(box("lo"), box("hi"))]
    while len(levels[-1][0]) > 1:
        lo, hi = levels[-1]
        at = np.arange(0, len(lo), FANOUT)
        levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))
    leaves = [{"ids": np.frombuffer(p["ids"], np.int64), "places": np.frombuffer(p["places"], np.int64), "labels": np.frombuffer(p["labels"], np.int64), "vectors": np.frombuffer(p["vectors"]).reshape(-1, width)} for p in pages]
    return Tree(leaves, levels)


def best_first(root: Tree, q: np.ndarray, windows: list[tuple[int, int]], k: int, allowed: tuple[int, bool], own: int) -> list[list[tuple[int, int, int]]]:
    """For each window of scores its first k rows (score, id, place), the highest score first, then the least id.

    `allowed` is a label and whether rows must have it or must not; the row at the place
    `own` takes no part.
    """
    label, same = allowed
    best: list[list[tuple[int, int, int]]] = [[] for _ in windows]
    floor = [lo for lo, _ in windows]  # a lower score cannot enter the window's rows
    top = len(root.levels) - 1
    heap = [(-float("inf"), top, 0)]
    while heap:
        upper, level, node = heapq.heappop(heap)
        if all(-upper < f for f in floor):
            break
        if level == 0:
            page = root.pages[node]
            use = ((page["labels"] == label) == same) & (page["places"] != own)
            if not use.any():
                continue
            score = products(page["vectors"], q)
            for w, (_, hi) in enumerate(windows):
                at = np.flatnonzero(use & (score >= floor[w]) & (score <= hi))
                if not len(at):
                    continue
                if len(at) > 4 * k:  # rows below the page's own k-th score
                    at = at[score[at] >= np.partition(score[at], -k)[-k]]
                rows = [(-int(score[i]), int(page["ids"][i]), int(page["places"][i])) for i in at]
                best[w] = sorted(best[w] + rows)[:k]
                if len(best[w]) == k:
                    floor[w] = max(floor[w], -best[w][-1][0])
            continue
        lo, hi = root.levels[level - 1]
        first, last = node * FANOUT, min((node + 1) * FANOUT, len(lo))
        least, greatest = interval(q[None], lo[first:last], hi[first:last])
        for i, (a, b) in enumerate(zip(least[0].tolist(), greatest[0].tolist(), strict=True)):
            if any(b >= f and a <= h for f, (_, h) in zip(floor, windows, strict=True)):
                heapq.heappush(heap, (-b, level - 1, first + i))
    return [[(-s, i, p) for s, i, p in rows] for rows in best]


def _directory(pages: DataFrame, width: int, groups: int, limit: int) -> tuple[list[dict], int]:
    """Boxes of runs of `per` groups each, `limit` of them at most, for the driver to broadcast."""
    per = max(1, -(-groups // limit))
    roots = pages.where("group_lo IS NOT NULL").select((F.col("g") - F.col("g") % per).alias("g"), "group_labels", "group_lo", "group_hi")
    if per == 1:
        return [r.asDict() for r in roots.collect()], per

    def merge(table: pa.Table) -> pa.Table:
        lo, hi = (np.array([np.frombuffer(v.as_py()) for v in table[c]]).reshape(table.num_rows, width) for c in ("group_lo", "group_hi"))
        labels = sorted({x for v in table["group_labels"].to_pylist() for x in v})
        return pa.table({"g": [table["g"][0].as_py()], "group_labels": pa.array([labels], pa.list_(pa.int64())), "group_lo": pa.array([lo.min(0).tobytes()], pa.binary()), "group_hi": pa.array([hi.max(0).tobytes()], pa.binary())})

    merged = roots.groupBy("g").applyInArrow(merge, "g long, group_labels array<long>, group_lo binary, group_hi binary")
    return [r.asDict() for r in merged.collect()], per


def search(pages: DataFrame, anchors: DataFrame, directory: tuple[list[dict], int], width: int, groups: int, *, k: int, same: bool) -> DataFrame:
    """(anchor, w, score, id, place, nth): each anchor's first k rows in each of its score windows.

    `anchors` has place, block, label, x and windows, an array of (w, lo, hi); `same`
    asks for rows of the anchor's label, otherwise of any other label.
    """
    boxes, per = directory
    shared = anchors.sparkSession.sparkContext.broadcast(boxes)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = (np.array([np.frombuffer(b[c]) for b in shared.value]).reshape(len(shared.value), width) for c in ("group_lo", "group_hi"))
        for batch in batches:
            least, greatest = interval(whole_parts(batch["x"], width), lo, hi)
            goes = []
            for i, (label, windows) in enumerate(zip(batch["label"].to_pylist(), batch["windows"].to_pylist(), strict=True)):
                holds = [label in b["group_labels"] if same else b["group_labels"] != [label] for b in shared.value]
                meets = np.zeros(len(lo), bool)
                for w in windows:
                    meets |= (greatest[i] >= w["lo"]) & (least[i] <= w["hi"])
                goes.append([b["g"] for b, h, m in zip(shared.value, holds, meets, strict=True) if h and m])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(goes, pa.list_(pa.int64()))], names=[*batch.schema.names, "runs"])

    kinds = "place long, block long, label long, x array<double>, windows array<struct<w:int,lo:long,hi:long>>"
    routed = anchors.select("place", "block", "label", "x", "windows").mapInArrow(route, kinds + ", runs array<long>")
    routed = routed.withColumn("run", F.explode("runs")).withColumn("g", F.explode(F.sequence("run", F.least(F.col("run") + per, F.lit(groups)) - 1))).drop("runs", "run")
    n_blocks = anchors.agg(F.max("block")).first()[0] or 0
    dealt = pages.drop("group_labels", "group_lo", "group_hi").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks).cast("long"))))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            root = tree(right.select([c for c in right.column_names if c != "block"]).to_pylist(), width)
            q = whole_parts(left["x"].combine_chunks(), width)
            for i, (place, label, windows) in enumerate(zip(left["place"].to_pylist(), left["label"].to_pylist(), left["windows"].to_pylist(), strict=True)):
                found = best_first(root, q[i], [(w["lo"], w["hi"]) for w in windows], k, (label, same), place)
                out += [(place, w["w"], *row) for w, rows in zip(windows, found, strict=True) for row in rows]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[2:]]], names=["anchor", "w", "rank_score", "id", "place"])

    found = routed.groupBy("g", "block").cogroup(dealt.groupBy("g", "block")).applyInArrow(probe, FOUND)
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("rank_score"), "id", "place")  # k rows a group at most
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).withColumnRenamed("rank_score", "score")


def mine_hard_negatives(
    points: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, group_rows: int = 8192, page_rows: int = 256, block_rows: int = 65_536, directory: int = 4096,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of valid_points() rows.

    An anchor's positives are its first rows of the same label by score; for each of
    them the negatives are the first rows of other labels with low * p <= 100 * n <=
    high * p.  Equal scores go by the smaller id.  Rows of equal id are rows of their
    own, each an anchor where the id is one.  Shorter vectors are filled up with 0.  A
    negative positive score has no window.  An empty table gives no rows.
    """
    scratch = Scratch(points.sparkSession, "rtree")
    rows = scratch.save(points.withColumn("c0", F.coalesce(F.try_element_at("x", F.lit(1)), F.lit(0.0))), "rows")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
    width, groups = total["width"] or 0, max(1, -(-total["n"] // group_rows))
    placed = ranked(rows, [], [F.col("label"), F.col("c0"), F.col("id")], "place", scratch=scratch)
    pages = scratch.save(pack(placed.select(((F.col("place") - 1) / group_rows).cast("long").alias("g"), "id", "label", "x", "place"), width, page_rows=page_rows), "pages")
    found_in = _directory(pages, width, groups, directory)
    anchors = scratch.save(placed.where(is_anchor).select("id", "label", "x", "place", ((F.col("place") - 1) / block_rows).cast("long").alias("block")), "anchors")

    everything = F.array(F.struct(F.lit(0).alias("w"), F.lit(LEAST).cast("long").alias("lo"), F.lit(MOST).cast("long").alias("hi")))
    near = search(pages, anchors.withColumn("windows", everything), found_in, width, groups, k=positives, same=True)
    near = scratch.save(near.select(F.col("anchor").alias("place"), F.col("nth").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Whole numbers n with low * p <= 100 * n <= high * p; decimals, as the products may pass 64 bits.
    p = F.col("positive_score").cast("decimal(20,0)")
    window = F.struct(F.col("w"), F.ceil(p * low / 100).cast("long").alias("lo"), F.floor(p * high / 100).cast("long").alias("hi"))
    windows = near.where("positive_score >= 0").groupBy("place").agg(F.collect_list(window).alias("windows"))  # `positives` of them
    asking = scratch.save(anchors.join(windows, "place"), "windows")
    hard = search(pages, asking, found_in, width, groups, k=negatives, same=False)
    hard = hard.select(F.col("anchor").alias("place"), "w", F.col("nth").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = hard.join(near, ["place", "w"]).join(anchors.select("place", F.col("id").alias("anchor_id")), "place")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
