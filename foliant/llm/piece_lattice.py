"""SentencePiece encoding by a relational lattice, and decoding.

Each distinct unit of text becomes a lattice: its bounded-length substrings are
exploded and equi-joined to the piece table, the edges are grouped by unit, and a
higher-order aggregate folds them into the best segmentation.  The piece file is a
merge model: scores are ranks, and the model's segmentation is not the one with the
best sum of them.  It is the best one under another order: compare two segmentations
by the merges that build their pieces, best rank first, and the first merge that only
one of them has decides.  Under that order the best path can be folded edge by edge in
rank order: an edge enters where it joins exactly two pieces of the path so far.  The
state is the path itself, a bit for each border.

A unit is a run of spaces with the letters, or the other characters, that follow it; no
piece crosses the border of two units (checked when a model is loaded), so the
segmentation of a text is that of its units in order.  Units of more than 62 characters
are first cut between characters that are neighbours in no piece, which changes nothing;
what is still longer (rows of one sign, long identifiers) is merged whole by `merge_run`
in the same order.  A character without a piece is written as its UTF-8 bytes, which
makes decoding exact for every text; U+2581, the model's mark for a space, is such a
character.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import words as W
from foliant.llm.scratch import Scratch, most_frequent

LIMIT = 62
MISSING = 0xFFFF
SLICE_CHARS = 1 << 18
DISTINCT = 300_000
ROWS = 1024
SPACE, LETTER, NEWLINE = 1, 2, 3


# ---- the model --------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Pieces with spaces as spaces: text -> (rank, id); ranks start at 1, one character has 0."""

    known: dict[str, tuple[int, int]]
    byte_ids: tuple[int, ...]
    longest: int
    pairs: np.ndarray  # sorted codes of characters that are neighbours in a piece


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    letter = regex.compile(r"\p{L}")
    out = np.array([letter.match(chr(c)) is not None for c in range(0x110000)], np.uint8) * np.uint8(LETTER)
    out[32], out[10] = SPACE, NEWLINE
    return out


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return W.mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _borders(points: np.ndarray) -> np.ndarray:
    """Whether a unit starts at each code point, from the classes alone."""
    kind = _classes()[points]
    start = np.ones(len(points), bool)
    before, now = kind[:-1], kind[1:]
    start[1:] = (now == NEWLINE) | (before == NEWLINE) | ((now != before) & (before != SPACE))
    return start


def _pair_codes(points: np.ndarray) -> np.ndarray:
    return (points[:-1].astype(np.uint64) << np.uint64(21)) | points[1:]


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    found, in_bytes = [], [0] * 256
    for i in range(library.get_piece_size()):
        name = library.id_to_piece(i)
        if library.is_byte(i):
            in_bytes[int(name[3:5], 16)] = i
        elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
            found.append((name.replace("▁", " "), library.get_score(i), i))
    order = {s: k + 1 for k, s in enumerate(sorted({s for _, s, _ in found}, reverse=True))}
    known = {p: (order[s] if len(p) > 1 else 0, i) for p, s, i in found}
    crossing = [p for p in known if _borders(code_points(p)).sum() != 1]
    if crossing or library.get_piece_size() >= MISSING or len(order) >= 1 << 17:
        raise ValueError(f"pieces cross the units of text: {crossing[:5]}")
    pairs = np.unique(np.concatenate([_pair_codes(code_points(p)) for p in known]))
    return Model(known, tuple(in_bytes), max(map(len, known)), pairs)


def merge_run(run: str, model: Model) -> list[int]:
    """Ids of a run of any length: neighbours are merged in rank order, from the left where ranks are equal."""
    end, prev = list(range(1, len(run) + 1)), list(range(-1, len(run) - 1))
    alive, queue = [True] * len(run), []

    def offer(a: int, b: int) -> None:
        if 0 <= a and b < len(run) and end[b] - a <= model.longest and (hit := model.known.get(run[a : end[b]])):
            heapq.heappush(queue, (hit[0], a, b, end[b]))

    for i in range(len(run) - 1):
        offer(i, i + 1)
    while queue:
        _, a, b, to = heapq.heappop(queue)
        if not (alive[a] and alive[b] and end[a] == b and end[b] == to):
            continue
        alive[b], end[a] = False, to
        if to < len(run):
            prev[to] = a
            offer(a, to)
        offer(prev[a], a)
    out = []
    at = 0
    while at < len(run):
        piece = run[at : end[at]]
        out += [model.known[piece][1]] if piece in model.known else [model.byte_ids[x] for x in piece.encode("utf-8", "surrogatepass")]
        at = end[at]
    return out


# ---- units ------------------------------------------------------------------


@dataclass
class Units:
    """Units of some texts, each text behind the space that encoding puts in front of it."""

    text: str
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray  # number of the text
    key: np.ndarray  # 64-bit hash

    def __getitem__(self, k: int) -> str:
        return self.text[self.start[k] : self.end[k]]


def units_of(texts: list[str], model: Model) -> Units:
    text = "".join([" " + t for t in texts])
    points = code_points(text)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    border = _borders(points)
    border[begin[:-1]] = True
    start = np.flatnonzero(border)
    end = np.append(start[1:], len(points))
    long = np.flatnonzero(end - start > LIMIT)
    if len(long):
        for k in long.tolist():
            codes = _pair_codes(points[start[k] : end[k]])
            at = np.minimum(np.searchsorted(model.pairs, codes), len(model.pairs) - 1)
            border[start[k] + 1 + np.flatnonzero(model.pairs[at] != codes)] = True
        start = np.flatnonzero(border)
        end = np.append(start[1:], len(points))
    return Units(text, start, end, np.searchsorted(begin, start, "right") - 1, _range_keys(points, start, end))


def _range_keys(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    forward, back = W.powers(len(points) + 1)
    prefix = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_values()[points] * forward[: len(points)], out=prefix[1:])
    return W.mix((prefix[end] - prefix[start]) * back[start])


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about SLICE_CHARS characters, ROWS at most, with the number of the first."""
    for begin in range(0, len(column), ROWS):
        texts = column.slice(begin, ROWS).to_pylist()
        first = size = 0
        for k, text in enumerate(texts):
            if size and size + len(text) > SLICE_CHARS:
                yield begin + first, texts[first:k]
                first, size = k, 0
            size += len(text) + 1
        yield begin + first, texts[first:]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(unit, n): a row for each distinct unit of a part of the input of bounded variety."""
        model = load(path)
        keys, counts, names = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, object)]

        def merge() -> None:
            key, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            counts[:] = [np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)]
            names[:] = [np.concatenate(names)[first]]
            keys[:] = [key]

        def out() -> pa.RecordBatch:
            merge()
            batch = pa.RecordBatch.from_arrays([pa.array(names[0], pa.string()), pa.array(counts[0])], names=["unit", "n"])
            keys[:], counts[:], names[:] = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, object)]
            return batch

        for batch in batches:
            for _, texts in _slices(batch["text"]):
                units = units_of(texts, model)
                short = np.flatnonzero(units.end - units.start <= LIMIT)
                key, first, n = np.unique(units.key[short], return_index=True, return_counts=True)
                own = np.empty(len(key), object)
                own[:] = [units[k] for k in short[first].tolist()]
                keys.append(key)
                counts.append(n)
                names.append(own)
                if sum(map(len, keys)) > 2 * DISTINCT:
                    merge()
                    if len(keys[0]) > DISTINCT:
                        yield out()
        yield out()

    return W.give_back(run)


# ---- the lattice ------------------------------------------------------------


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def _field(e: Column, at: int, bits: int) -> Column:
    return F.shiftright(e, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def lattice_fold(units: DataFrame, path: str) -> DataFrame:
    """`units` (unit of at most 62 characters, distinct and partitioned by unit; n) plus its lattice and best path.

    An edge is one number: rank (upper bits), end (6), 63 - start (6), id (16), so
    sorting edges puts them in the order of merging.  `edges` are those of several
    characters, `single` those of one, and bit k of `path` tells whether the path has a
    border at character k.
    """
    model = load(path)
    # The piece table belongs to the model: its size does not depend on the data.
    lookup = units.sparkSession.createDataFrame([(p, (rank << 28) | i) for p, (rank, i) in model.known.items()], "known string, code long")
    lookup = F.broadcast(lookup.select(F.xxhash64("known").alias("known_key"), "known", "code"))
    size = F.length("unit")
    tails = units.sortWithinPartitions("unit").select("unit", "n", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    tails = tails.select("unit", "n", "start", F.substring("unit", F.col("start") + 1, F.lit(model.longest)).alias("tail"))
    spans = tails.select("unit", "n", "start", "tail", F.explode(F.sequence(F.lit(1), F.length("tail"))).alias("len"))
    spans = spans.select("unit", "n", "start", "len", F.substring("tail", F.lit(1), F.col("len")).alias("piece"))
    # Equal strings have equal hashes: joined by the number, compared as strings.
    joined = spans.join(lookup, (F.xxhash64("piece") == F.col("known_key")) & (F.col("piece") == F.col("known")), "left")
    # A character without a piece keeps an edge that stands for its bytes.
    edges = joined.where("code IS NOT NULL OR len = 1")
    place = ((F.col("start") + F.col("len")) * (1 << 22) + (63 - F.col("start")) * (1 << 16)).cast("long")
    edge = F.coalesce("code", F.lit(MISSING).cast("long")).bitwiseOR(place)
    long = F.sort_array(F.collect_list(F.when(F.col("len") > 1, edge)))
    grouped = edges.groupBy("unit", "n").agg(long.alias("edges"), F.collect_list(F.when(F.col("len") == 1, edge)).alias("single"))

    def fold(path: Column, e: Column) -> Column:
        """Let an edge into the path where it joins two pieces of it."""
        start, end = 63 - _field(e, 16, 6), _field(e, 22, 6)
        inside = path.bitwiseAND(_bit(end) - _bit(start + 1))
        ends = _bit(start).bitwiseOR(_bit(end))
        return F.when((F.bit_count(inside) == 1) & (path.bitwiseAND(ends) == ends), path - inside).otherwise(path)

    # Bits 0 to size, without the bit above them: at 62 characters that is the sign, and taking 1 from it overflows.
    borders = (_bit(size) - 1).bitwiseOR(_bit(size))
    return grouped.select("unit", "n", "edges", "single", F.aggregate("edges", borders, fold).alias("path"))


def _packed(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hash and uint16 ids of each unit: the edges that the best path takes, in order."""
        in_bytes = load(path).byte_ids
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch["unit"].to_pylist()
            points = code_points("".join(names))
            cut = np.concatenate([[0], np.cumsum([len(x) for x in names])])
            key = _range_keys(points, cut[:-1], cut[1:])
            owner, edge = [], []
            for column in ("edges", "single"):
                lists = batch[column]
                offsets = lists.offsets.to_numpy()
                owner.append(np.repeat(np.arange(len(names)), np.diff(offsets)))
                edge.append(lists.values.to_numpy()[offsets[0] : offsets[-1]])
            owner, edge = np.concatenate(owner), np.concatenate(edge)
            start, end, best = 63 - ((edge >> 16) & 63), (edge >> 22) & 63, batch["path"].to_numpy()[owner]
            one = np.int64(1)
            taken = (best & ((one << (end + 1)) - (one << start))) == (one << start) | (one << end)
            owner, start, ids = owner[taken], start[taken], edge[taken] & MISSING
            order = np.argsort(owner * 64 + start, kind="stable")
            owner, start, ids = owner[order], start[order], ids[order]
            bare = np.flatnonzero(ids == MISSING)
            if len(bare):
                spelled = [[in_bytes[x] for x in names[o][k].encode("utf-8", "surrogatepass")] for o, k in zip(owner[bare].tolist(), start[bare].tolist(), strict=True)]
                times = np.ones(len(ids), np.int64)
                times[bare] = [len(x) for x in spelled]
                ids, owner = np.repeat(ids, times), np.repeat(owner, times)
                ids[ids == MISSING] = [x for own in spelled for x in own]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(names)))]) * 2
            packed = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u2").tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch["n"], packed], names=["key", "n", "ids"])

    return W.give_back(run)


# ---- texts ------------------------------------------------------------------


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


@dataclass
class Known:
    """Units by hash, in order, with their ids."""

    key: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, ids: pa.BinaryArray) -> Known:
        """From hashes and packed ids, by their buffers: no object for each of them."""
        order = np.argsort(key)
        if (np.diff(key[order]) == 0).any():
            raise RuntimeError("two units share a hash")
        if not len(ids):
            return cls(key, np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u2"))
        _, offsets, data = ids.buffers()
        offsets = np.frombuffer(offsets, np.int32)[ids.offset : ids.offset + len(ids) + 1]
        begin = ((offsets[:-1] - offsets[0]) // 2).astype(np.int32)
        return cls(key[order], begin[order], (np.diff(offsets) // 2).astype(np.int32)[order], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view("<u2"))

    def place(self, key: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is not known."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)


PARTS = "part long, ids binary, sizes binary, crc binary, rare array<long>"


def _first_pass(path: str, frequent, id_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each slice of texts: ids with a mark at each rare unit, and the hashes of the rare units in order."""
        model, known, packer = load(path), Known(*frequent.value), zstandard.ZstdCompressor(level=3)
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, texts in _slices(batch["text"]):
                units = units_of(texts, model)
                at = known.place(units.key)
                begin, size = known.begin[at] if len(known.key) else at, known.size[at] if len(known.key) else at
                runs = np.flatnonzero(units.end - units.start > LIMIT).tolist()
                own = [np.array(merge_run(units[k], model), "<u2") for k in runs]
                pool = np.concatenate([known.ids, [MISSING], *own]).astype("<u2")
                rare = at < 0
                begin, size = np.where(rare, len(known.ids), begin), np.where(rare, 1, size)
                n = np.array([len(x) for x in own], np.int64)
                begin[runs], size[runs], rare[runs] = len(known.ids) + 1 + np.cumsum(n) - n, n, False
                ids = pool[_ranges(begin, size)]
                per_text = np.bincount(units.owner, size, len(texts)).astype("<i8")
                crc = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts], "<i8")
                wanted = units.key[rare].view(np.int64)
                row = [pa.array([part]), pa.array([packer.compress(ids.tobytes())]), pa.array([packer.compress(per_text.tobytes())]), pa.array([packer.compress(crc.tobytes())]), pa.array([wanted], pa.list_(pa.int64()))]
                docs = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch["doc_id"].slice(first, len(texts)).cast(id_kind))
                yield pa.RecordBatch.from_arrays([*row, docs], names=["part", "ids", "sizes", "crc", "rare", "docs"])
                part += 1

    return W.give_back(run)


def _fill(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, with the rare units' ids in their places."""
        unpack = zstandard.ZstdDecompressor().decompress
        table = piece_bytes(path) if decoded else []
        for row in _rows(batches):
            ids, sizes = _filled(row, unpack)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            each = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            columns = [row["docs"].values, pa.array(np.frombuffer(unpack(row["crc"].as_py()), "<i8")), pa.array([x.tobytes() for x in each], pa.binary())]
            if decoded:
                columns += _decoded(each, table)
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_crc32", "ids", "n_pieces", "ids_crc32", "decoded"][: len(columns)])

    return W.give_back(run)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch[c][k] for c in ("ids", "sizes", "crc", "rare", "docs", "found")}


def _filled(row: dict, unpack) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a slice of texts, and their number for each text."""
    ids, sizes = np.frombuffer(unpack(row["ids"].as_py()), "<u2"), np.frombuffer(unpack(row["sizes"].as_py()), "<i8")
    if not len(row["rare"]):
        return ids, sizes
    wanted, found = row["rare"].values.to_numpy(), row["found"].values
    known = Known.of(found.field("key").to_numpy(), found.field("ids"))
    at = known.place(wanted)
    holes = np.flatnonzero(ids == MISSING)
    length = np.ones(len(ids), np.int64)
    length[holes] = known.size[at]
    begin = np.arange(len(ids)) + len(known.ids)
    begin[holes] = known.begin[at]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.concatenate([known.ids, ids])[_ranges(begin, length)].astype("<u2"), np.bincount(owner, length, len(sizes)).astype(np.int64)


def encode(docs: DataFrame, path: str, *, head: int = 1 << 19, decoded: bool = False) -> DataFrame:
    """(doc_id, text_crc32, ids binary) for each row: ids are little-endian uint16, those of the model's own encoding.

    The encodings of the `head` most frequent units, a bounded table, go to every
    executor; all other units are joined by hash, to slices of texts that a table
    bucketed by slice keeps in place.  A null text is encoded as ''; an empty text has no
    ids but those of the space in front of it; repeated rows are encoded each; an empty
    table gives no rows.  Columns other than doc_id and text are not looked at.  With
    `decoded` the columns of with_decoded() come from the same task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pieces")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Several parts a task: the edges of one are sorted and folded in memory.
    counted = docs.select("text").mapInArrow(_count(path), "unit string, n long").repartition(4 * tasks, "unit").groupBy("unit").agg(F.sum("n").alias("n"))
    known = scratch.save(lattice_fold(counted, path).mapInArrow(_packed(path), "key long, n long, ids binary"), "known")
    top = most_frequent(known, "n", head).select("key", "ids").toArrow().combine_chunks()
    own = Known.of(top["key"].to_numpy().view(np.uint64), top["ids"].combine_chunks().cast(pa.binary()) if top.num_rows else pa.array([], pa.binary()))
    frequent = spark.sparkContext.broadcast((own.key, own.begin, own.size, own.ids))

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    arrow_kind = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    partial = scratch.bucketed(docs.mapInArrow(_first_pass(path, frequent, arrow_kind), f"{PARTS}, docs array<{id_kind}>"), "partial", "part", tasks)
    wanted = partial.select("part", F.explode(F.array_distinct("rare")).alias("key"))
    found = wanted.join(known.select("key", "ids"), "key").groupBy("part").agg(F.collect_list(F.struct("key", "ids")).alias("found"))
    joined = partial.join(found, "part", "left").select("ids", "sizes", "crc", "rare", "docs", "found")
    return joined.mapInArrow(_fill(path, decoded), f"doc_id {id_kind}, text_crc32 long, ids binary" + ", n_pieces long, ids_crc32 long, decoded string" * decoded)


def piece_bytes(path: str) -> list[bytes]:
    """The bytes that each id stands for."""
    model = load(path)
    out = [b""] * (max(max(model.byte_ids), max(i for _, i in model.known.values())) + 1)
    for byte, i in enumerate(model.byte_ids):
        out[i] = bytes([byte])
    for piece, (_, i) in model.known.items():
        out[i] = piece.encode()
    return out


def decode(ids: np.ndarray, table: list[bytes]) -> bytes:
    """Bytes of a text from its ids; the space put in front is taken off."""
    return b"".join(map(table.__getitem__, ids.tolist()))[1:]


def _decoded(ids: list[np.ndarray], table: list[bytes]) -> list[pa.Array]:
    """n_pieces, ids_crc32 (of uint32 ids) and the decoded text of each text."""
    texts = [decode(i, table) for i in ids]
    return [pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]


def with_decoded(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` plus n_pieces, ids_crc32 (of uint32 ids) and the decoded text; an empty table gives no rows."""
    names = encoded.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_bytes(path)
        for batch in batches:
            extra = _decoded([np.frombuffer(b, "<u2") for b in batch["ids"].to_pylist()], table)
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, "n_pieces", "ids_crc32", "decoded"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(apply, f"{kinds}, n_pieces long, ids_crc32 long, decoded string")
