"""Removal of repeated byte strings across documents with difference-cover suffix arrays.

A string of `length` bytes is charged to its minimizer, the least of its hashed
20-byte grams, so equal strings meet wherever their minimizer goes.  First the
minimizers that occur in one document only are ruled out, by packed sorted hashes
instead of rows.  Neighbouring strings with one minimizer form a piece; equal pieces
are settled by their least document.  Where a minimizer stands in different pieces,
the pieces go to suffix arrays: triples at two of three positions are sorted and
named, the names are ranked by recursion, the remaining suffixes are merged in, and
prefixes of adjacent suffixes are compared.  The strings of a minimizer with very many
pieces are first grouped by their bytes, with partial minima before the shuffle.

Texts stay in one table of chunks, bucketed by chunk, so that nothing but hashes,
places and the bytes of unsettled pieces is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from foliant.llm import words as W
from foliant.llm.scratch import Scratch

GRAM = 20
LAST = (1 << 63) - 1
ARRAY_BYTES = 1 << 19
CHUNK_BYTES = 1 << 20
HOT_PIECES = 4096
#: Bits of a row's number within its chunk.
ROW_BITS = 20
_BLOCK = 1 << 16


# ---- difference cover -------------------------------------------------------


def prefix_ranks(s: np.ndarray, depth: int, width: int = 1) -> np.ndarray:
    """Rank of every suffix of `s`; suffixes with equal prefixes are neighbours.

    A symbol stands for `width` characters and prefixes of `depth` characters count.
    Values are positive and below 2**21.
    """
    n = len(s) + -len(s) % 3
    if n >= 3 << 20:
        raise ValueError("too many bytes in one suffix array: lower ARRAY_BYTES")
    x = np.zeros(n + 3, np.int64)
    x[: len(s)] = s
    bits = int(x.max()).bit_length()
    cover = np.concatenate([np.arange(1, n, 3), np.arange(2, n, 3)])
    key = (x[cover] << (2 * bits)) | (x[cover + 1] << bits) | x[cover + 2]
    if 3 * bits <= 22:
        seen = np.zeros(1 << (3 * bits), bool)
        seen[key] = True
        name = (np.cumsum(seen, dtype=np.int64) - 1)[key]
    else:
        name = np.unique(key, return_inverse=True)[1]
    if width * 3 < depth and int(name.max()) + 1 < len(name):
        name = prefix_ranks(name + 1, depth, width * 3)[: len(cover)]
    rank = np.zeros(n + 3, np.int64)
    rank[cover] = name + 1
    wide = int(rank.max()).bit_length()

    def pair(i: np.ndarray) -> np.ndarray:
        return (x[i] << wide) | rank[i + 1]

    def triple(i: np.ndarray) -> np.ndarray:
        return (((x[i] << bits) | x[i + 1]) << wide) | rank[i + 2]

    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(pair(zero))]
    sample = cover[np.argsort(rank[cover])]
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    place = np.empty(n, np.int64)
    place[zero] = np.arange(len(zero)) + np.searchsorted(np.sort(pair(one)), pair(zero)) + np.searchsorted(np.sort(triple(two)), triple(zero))
    place[sample] = np.arange(len(sample))
    place[one] += np.searchsorted(pair(zero), pair(one), "right")
    place[two] += np.searchsorted(np.sort(triple(zero)), triple(two), "right")
    out = np.empty(n, np.int64)
    out[np.argsort(place)] = np.arange(n)
    return out[: len(s)]


def repeated_windows(texts: list[bytes], order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window + 1) of the runs of windows that also start in a text of lower order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\0".join(texts) + b"\0" * length, np.uint8)
    edge = np.zeros(len(data), bool)
    edge[begin + sizes] = True
    s = data[: int(begin[-1] + sizes[-1]) + 1].astype(np.int64) + 2
    s[edge[: len(s)]] = 1
    used = np.zeros(258, np.int64)
    used[s] = 1
    s = np.cumsum(used)[s]  # a dense alphabet: triples of few symbols are named without a sort
    count = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), count)
    start = np.arange(len(owner)) + np.repeat(begin - np.cumsum(count) + count, count)
    sort = np.argsort(prefix_ranks(s, length)[start])
    window = np.lib.stride_tricks.sliding_window_view(data, length)
    at = start[sort]
    same = np.zeros(len(at), bool)
    for k in range(1, len(at), 1 << 16):
        to = min(k + (1 << 16), len(at))
        same[k:to] = (window[at[k:to]] == window[at[k - 1 : to - 1]]).all(1)
    head = np.flatnonzero(~same)
    least = np.minimum.reduceat(order[owner[sort]], head)
    gone = np.empty(len(at), bool)
    gone[sort] = order[owner[sort]] > np.repeat(least, np.diff(np.append(head, len(at))))
    fresh = np.concatenate([[True], owner[1:] != owner[:-1]])
    last = np.append(fresh[1:], True)
    first = np.flatnonzero(gone & (fresh | ~np.concatenate([[False], gone[:-1]])))
    final = np.flatnonzero(gone & (last | ~np.append(gone[1:], False)))
    return owner[first], start[first] - begin[owner[first]], start[final] - begin[owner[first]] + 1


def runs(flags: np.ndarray) -> np.ndarray:
    """(first, last + 1) of the runs of true values."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)])


# ---- chunks of documents ----------------------------------------------------


def _pack(part: W.Slice, order: np.ndarray, null: np.ndarray) -> bytes:
    head = struct.pack("<I", part.rows) + b"".join(np.asarray(x, "<i8").tobytes() for x in (order, null, part.offsets))
    return zstandard.ZstdCompressor(level=1).compress(head + part.data.tobytes())


def _unpack(payload: bytes) -> tuple[W.Slice, np.ndarray, np.ndarray]:
    """The texts of a chunk, their doc_ids (LAST for null) and whether doc_id, and text, are null (1, 2)."""
    raw = zstandard.ZstdDecompressor().decompress(payload)
    (n,) = struct.unpack_from("<I", raw)
    columns, at = [], 4
    for size in (n, n, n + 1):
        columns.append(np.frombuffer(raw, "<i8", size, at))
        at += 8 * size
    return W.Slice(0, np.frombuffer(raw, np.uint8, offset=at), columns[2]), columns[0], columns[1]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of whole texts; the caller's other columns travel as an Arrow stream."""
    chunk = TaskContext.get().partitionId() << ROW_BITS
    for batch in batches:
        ids = batch["doc_id"].cast(pa.int64())
        null = ids.is_null().to_numpy(zero_copy_only=False) + 2 * batch["text"].is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(LAST).to_numpy()
        rest = batch["rest"] if "rest" in batch.schema.names else None
        for part in W.slices(batch["text"], CHUNK_BYTES):
            own = slice(part.first_row, part.first_row + part.rows)
            others = None
            if rest is not None:
                others = pa.BufferOutputStream()
                table = pa.record_batch([rest.slice(part.first_row, part.rows)], names=["rest"])
                with pa.ipc.new_stream(others, table.schema) as out:
                    out.write_batch(table)
                others = others.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([len(part.data)], pa.int64()), pa.array([_pack(part, ids[own], null[own])], pa.binary()), pa.array([others], pa.binary())], names=["chunk", "n_bytes", "payload", "rest"])
            chunk += 1


def least_places(gram: np.ndarray, span: int) -> np.ndarray:
    """Place of the least of each `span` neighbours, the first of equal ones; in blocks, so any length will do."""
    total = len(gram) - span + 1
    out = np.empty(max(total, 0), np.int64)
    bits = np.uint64((_BLOCK + span).bit_length())
    for at in range(0, total, _BLOCK):
        own = gram[at : min(at + _BLOCK, total) + span - 1]
        least, size = ((own >> bits) << bits) | np.arange(len(own), dtype=np.uint64), 1
        while size * 2 <= span:
            least, size = np.minimum(least[:-size], least[size:]), size * 2
        if size < span:
            least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
        out[at : at + len(least)] = at + (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return out


class Minimizers:
    """Windows of a slice and the place of each one's minimizer."""

    def __init__(self, part: W.Slice, length: int) -> None:
        self.prefix = W.prefix_hash(part.data)
        n = len(part.data)
        sizes = np.maximum(np.diff(part.offsets) - length + 1, 0)
        self.window = np.arange(int(sizes.sum())) + np.repeat(part.offsets[:-1] - np.cumsum(sizes) + sizes, sizes)
        self.row = np.repeat(np.arange(part.rows), sizes)
        if not len(self.window):
            self.place = self.window
            return
        gram = np.arange(n - GRAM + 1)
        self.gram = W.range_hash(self.prefix, gram, gram + GRAM)
        self.place = least_places(self.gram, length - GRAM + 1)[self.window]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct 48-bit hashes of the minimizers, whether two rows hold each, and all places."""
        if not len(self.window):
            return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
        first = np.flatnonzero(np.diff(self.place, prepend=-1))
        key, row = self.gram[self.place[first]] >> np.uint64(16), self.row[first]
        sort = np.lexsort((row, key))
        key, row = key[sort], row[sort]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[head], np.minimum.reduceat(row, head) != np.maximum.reduceat(row, head), first


def _squeeze(values: np.ndarray) -> bytes:
    delta = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(delta.view(np.uint8).reshape(-1, 8).T.tobytes())


def _stretch(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(planes.T.copy().view("<u8").ravel(), dtype=np.uint64)


def _anchor_rows(buckets: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch["chunk"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                key, several, _ = Minimizers(_unpack(payload)[0], length).anchors()
                if not len(key):
                    continue
                cut = np.searchsorted(key, (np.arange(1, buckets).astype(object) * (1 << 48) // buckets).astype(np.uint64))
                rows = [(chunk, b, _squeeze(k), np.packbits(s).tobytes()) for b, (k, s) in enumerate(zip(np.split(key, cut), np.split(several, cut), strict=True)) if len(k)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "bucket", "keys", "several"])

    return W.give_back(run)


def _repeated_anchors(table: pa.Table) -> pa.Table:
    keys = [_stretch(k) for k in table["keys"].to_pylist()]
    several = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(k)).astype(bool) for k, s in zip(keys, table["several"].to_pylist(), strict=True)]
    value, inverse, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    hit = times > 1
    hit[inverse[np.concatenate(several)]] = True
    masks = [np.packbits(m).tobytes() for m in np.split(hit[inverse], np.cumsum([len(k) for k in keys])[:-1])]
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "mask": pa.array(masks, pa.binary())})


def _candidates(buckets: int, length: int):
    """Pieces that may repeat, as packed numbers; of equal pieces in a chunk only the least document's stay open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload, masks in zip(*(batch[c].to_pylist() for c in ("chunk", "payload", "masks")), strict=True):
                part, order, _ = _unpack(payload)
                found = Minimizers(part, length)
                key, _, first = found.anchors()
                if not len(first):
                    continue
                cut = np.searchsorted(key, (np.arange(1, buckets).astype(object) * (1 << 48) // buckets).astype(np.uint64))
                bounds = np.concatenate([[0], cut, [len(key)]])
                hit = np.zeros(len(key), bool)
                for mask in masks or []:
                    lo, hi = bounds[mask["bucket"]], bounds[mask["bucket"] + 1]
                    hit[lo:hi] = np.unpackbits(np.frombuffer(mask["mask"], np.uint8), count=hi - lo)
                # A piece is a run of windows of one row with one minimizer.
                ends = np.append(first[1:], len(found.window))
                start, row, n, anchor = found.window[first], found.row[first], ends - first, found.place[first]
                open_ = hit[np.searchsorted(key, found.gram[anchor] >> np.uint64(16))]
                if not open_.any():
                    continue
                start, row, n, anchor = start[open_], row[open_], n[open_], anchor[open_]
                piece = W.range_hash(found.prefix, start, start + n + length - 1)
                sort = np.lexsort((order[row], piece))
                head = np.concatenate([[True], piece[sort][1:] != piece[sort][:-1]])
                least = order[row][sort][head][np.cumsum(head) - 1]
                later = np.zeros(len(sort), bool)
                later[sort] = order[row][sort] > least
                at = start - part.offsets[row]
                numbers = np.column_stack([row, at, n, anchor - start, later]).astype("<i4")
                packed = zstandard.ZstdCompressor(level=1).compress(numbers.T.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([packed], pa.binary())], names=["chunk", "pieces"])

    return W.give_back(run)


def _numbers(packed: bytes) -> np.ndarray:
    """row, at, n, anchor and later of the pieces of a chunk."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<i4").reshape(5, -1).astype(np.int64)


def _open_pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload, pieces in zip(*(batch[c].to_pylist() for c in ("chunk", "payload", "pieces")), strict=True):
                part, order, _ = _unpack(payload)
                row, at, n, offset, later = _numbers(pieces)
                row, at, n, offset = (x[later == 0] for x in (row, at, n, offset))
                start = part.offsets[row] + at
                prefix = W.prefix_hash(part.data)
                key = W.range_hash(prefix, start + offset, start + offset + GRAM).view(np.int64)
                piece = W.range_hash(prefix, start, start + n + length - 1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(piece), pa.array(order[row]), pa.array((chunk << ROW_BITS) | row), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["gram", "piece", "place", "row", "at", "n"],
                )

    return W.give_back(run)


def _gone_pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pieces in zip(*(batch[c].to_pylist() for c in ("chunk", "pieces")), strict=True):
                row, at, n, _, later = _numbers(pieces)
                gone = later == 1
                # Runs of pieces that touch are one span.
                row, lo, hi = row[gone], at[gone], (at + n + length - 1)[gone]
                head = np.ones(len(row), bool)
                head[1:] = (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])
                first, last = np.flatnonzero(head), np.append(np.flatnonzero(head)[1:], len(row)) - 1
                yield pa.RecordBatch.from_arrays([pa.array((chunk << ROW_BITS) | row[first]), pa.array(lo[first].astype(np.int32)), pa.array(hi[last].astype(np.int32))] if len(row) else [pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32())], names=["row", "lo", "hi"])

    return W.give_back(run)


def _bytes_of_pieces(buckets: int, length: int, windows: bool):
    """The bytes of open pieces, or with `windows` the single strings of hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["own"]
            cuts = lists.offsets.to_numpy()
            fields = {c: lists.values.field(c).to_numpy() for c in ("row", "at", "n", "gram")}
            for i, payload in enumerate(batch["payload"].to_pylist()):
                part, order, _ = _unpack(payload)
                row, at, n, gram = (fields[c][cuts[i] : cuts[i + 1]] for c in ("row", "at", "n", "gram"))
                local = row & ((1 << ROW_BITS) - 1)
                at, n = at.astype(np.int64), n.astype(np.int64)
                if windows:
                    at = np.arange(int(n.sum())) + np.repeat(at - np.cumsum(n) + n, n)
                    row, local, gram = (np.repeat(x, n) for x in (row, local, gram))
                    n = np.ones(len(at), np.int64)
                start = part.offsets[local] + at
                data = part.data.tobytes()
                texts = [data[a:b] for a, b in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(gram % buckets), pa.array(order[local]), pa.array(row), pa.array(at.astype(np.int32)), pa.array(texts, pa.binary())], names=["bucket", "place", "row", "at", "text"])

    return W.give_back(run)


def _suffix_arrays(length: int):
    def run(table: pa.Table) -> pa.Table:
        texts, place = table["text"].to_pylist(), table["place"].to_numpy()
        row, at = table["row"].to_numpy(), table["at"].to_numpy()
        own, lo, hi = repeated_windows(texts, place, length)
        return pa.table([pa.array(row[own]), pa.array((at[own] + lo).astype(np.int32)), pa.array((at[own] + hi + length - 1).astype(np.int32))], names=["row", "lo", "hi"])

    return run


def _cut_out(text_at: int | None, kind: pa.DataType | None):
    """Figures of every text of a chunk after its cuts, and the caller's rows with the text that is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch["cuts"]
            ends = cuts.offsets.to_numpy()
            lists = {c: cuts.values.field(c).to_numpy() for c in ("row", "lo", "hi")}
            for i, (payload, rest) in enumerate(zip(batch["payload"].to_pylist(), batch["rest"].to_pylist(), strict=True)):
                part, order, null = _unpack(payload)
                row, lo, hi = (lists[c][ends[i] : ends[i + 1]] for c in ("row", "lo", "hi"))
                base = part.offsets[row & ((1 << ROW_BITS) - 1)]
                marks = np.bincount(base + lo, minlength=len(part.data) + 1) - np.bincount(base + hi, minlength=len(part.data) + 1)
                removed = np.cumsum(marks[:-1]) > 0
                figures, texts = [], []
                for k in range(part.rows):
                    own = slice(part.offsets[k], part.offsets[k + 1])
                    gone, whole = removed[own], part.data[own]
                    n = int(gone.sum())
                    left = whole[~gone].tobytes() if n else whole.tobytes()
                    figures.append((None if null[k] & 1 else int(order[k]), len(whole), n, len(runs(gone)) if n else 0, hashlib.sha256(left).hexdigest()))
                    if rest is not None:
                        texts.append(None if null[k] & 2 else left.decode("utf-8", "ignore").encode() if n else left)
                columns = [pa.array(c, t) for c, t in zip(zip(*figures, strict=True), (*[pa.int64()] * 4, pa.string()), strict=True)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if rest is not None:
                    with pa.ipc.open_stream(rest) as source:
                        others = source.read_next_batch()["rest"].flatten()[1:]
                    others.insert(text_at, pa.array(texts, pa.binary()).cast(pa.string()))
                    columns.append(pa.StructArray.from_arrays([x.cast(f.type) for x, f in zip(others, kind, strict=True)], fields=list(kind)))
                    names.append("document")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return W.give_back(run)


def remove_repeats(docs: DataFrame, *, length: int = 50, with_rows: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of `docs`.

    Every byte goes that is covered by a string of `length` bytes which also starts
    in a row with a smaller doc_id.  Rows of equal doc_id don't count as smaller; a
    null doc_id comes after all others.  Null texts are empty, texts of any length are
    taken whole, repeated rows are handled each, and an empty table gives no rows.
    With `with_rows` a struct `document` has all columns of the row, whatever their
    names, with the text that is left, without halves of characters that a cut leaves;
    a null text stays null there.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must exceed {GRAM}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [F.struct(F.lit(0).alias("_"), *[docs[c] for c in docs.columns if c != "text"]).alias("rest")] if with_rows else []
    chunks = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), *rest).mapInArrow(_chunks, "chunk long, n_bytes long, payload binary, rest binary")
    chunks = scratch.bucketed(chunks, "chunks", "chunk", tasks)
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(16, total // (8 << 20))
    anchors = chunks.select("chunk", "payload").mapInArrow(_anchor_rows(buckets, length), "chunk long, bucket int, keys binary, several binary")
    masks = anchors.groupBy("bucket").applyInArrow(_repeated_anchors, "chunk long, bucket int, mask binary")
    masks = masks.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "mask")).alias("masks"))
    cand = chunks.select("chunk", "payload").join(masks, "chunk").mapInArrow(_candidates(buckets, length), "chunk long, pieces binary")
    cand = scratch.bucketed(cand, "candidates", "chunk", tasks)

    open_ = chunks.select("chunk", "payload").join(cand, "chunk").mapInArrow(_open_pieces(length), "gram long, piece long, place long, row long, at int, n int")
    # Chunks hand over one open piece each, so a group holds a row for each chunk at most.
    same, near = Window.partitionBy("gram", "piece"), Window.partitionBy("gram")
    settled = open_.repartition("gram").select(
        "gram", "row", "at", "n", "place", F.min("place").over(same).alias("least"), (F.min("piece").over(near) != F.max("piece").over(near)).alias("mixed"), F.count(F.lit(1)).over(near).alias("size")
    )
    settled = settled.where("place > least OR mixed").select("row", "at", "n", (F.col("place") > F.col("least")).alias("gone"), F.when(F.col("place") == F.col("least"), F.col("gram")).alias("gram"), (F.col("size") > HOT_PIECES).alias("hot"))
    settled = scratch.save(settled, "settled")

    chunk_of = F.shiftright("row", ROW_BITS).alias("chunk")
    owners = settled.where("NOT gone")
    counted = owners.agg(F.sum(F.when(~F.col("hot"), F.col("n") + length)), F.max("hot")).first()
    arrays = max(16, (counted[0] or 0) // ARRAY_BYTES)

    def bytes_of(hot: bool) -> DataFrame:
        wanted = owners.where(F.col("hot") == hot).groupBy(chunk_of).agg(F.collect_list(F.struct("row", "at", "n", "gram")).alias("own"))
        return chunks.select("chunk", "payload").join(wanted, "chunk").mapInArrow(_bytes_of_pieces(arrays, length, hot), "bucket long, place long, row long, at int, text binary")

    found = bytes_of(False).groupBy("bucket").applyInArrow(_suffix_arrays(length), "row long, lo int, hi int")
    if counted[1]:
        strings = bytes_of(True)
        least = strings.groupBy("text").agg(F.min("place").alias("least"))
        later = strings.join(least, "text").where("place > least")
        found = found.unionByName(later.select("row", F.col("at").alias("lo"), (F.col("at") + length).alias("hi")))
    known = settled.where("gone").select("row", F.col("at").alias("lo"), (F.col("at") + F.col("n") + (length - 1)).alias("hi"))
    inside = cand.mapInArrow(_gone_pieces(length), "row long, lo int, hi int")
    spans = scratch.save(inside.unionByName(known).unionByName(found), "spans")
    scratch.drop("settled")
    scratch.drop("candidates")
    cuts = spans.groupBy(chunk_of).agg(F.collect_list(F.struct("row", "lo", "hi")).alias("cuts"))
    joined = chunks.select("chunk", "payload", "rest").join(cuts, "chunk", "left").select("payload", "rest", F.coalesce("cuts", F.array().cast("array<struct<row:bigint,lo:int,hi:int>>")).alias("cuts"))
    figures = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if not with_rows:
        return joined.mapInArrow(_cut_out(None, None), figures)
    kind = docs.select("*").limit(0).toArrow().schema
    return joined.mapInArrow(_cut_out(docs.columns.index("text"), pa.struct(list(kind))), StructType([*figures.fields, StructField("document", docs.schema)]))
