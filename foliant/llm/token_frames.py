"""Token ids in files of independent zstandard frames with a trailing seek table.

File layout, little-endian: frames of whole documents' ids (unsigned 16 or 32 bit),
each a complete zstandard frame; then a skippable frame that lists the documents
(doc_id int64, ids uint32, frame uint32) compressed; then a skippable frame with
the seek table in the seekable-format layout: for each frame compressed size,
decompressed size and a checksum (low 32 bits of xxh64 of the content), followed by
the number of frames, a descriptor byte and a magic number.  A reader takes the
tail of a file and then only the frames it needs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SKIPPABLE_INDEX = 0x184D2A5D
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
FRAME_IDS = 1 << 17
FILE_IDS = 1 << 24
END_ID = 1
FILES = "file string, first_doc long, last_doc long, n_docs long, n_ids long, n_frames int"


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class WordCache:
    """Ids of a tokenizer that never joins text across ASCII white space.

    White space separates words of such a tokenizer and is dropped, so the ids of a
    text are those of its words one after another.  Known words are kept; beyond
    `limit` the later half goes, because frequent words are met first.  A mark behind a
    letter or digit at a word's end is a token of its own, so such a word is put
    together from its parts.
    """

    MARKS = frozenset(b".,;:!?|")

    def __init__(self, path: str, limit: int = 700_000) -> None:
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.index: dict[bytes, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        keep = self.limit // 2
        self.index = dict(islice(self.index.items(), keep))
        self.flat, self.starts, self.sizes = self.flat[: self.starts[keep]].copy(), self.starts[:keep].copy(), self.sizes[:keep].copy()

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.index)
        self.index.update(zip(words, range(first, first + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def _stem(self, word: bytes) -> bytes | None:
        """The word without a mark at its end, if what is before it is a letter or digit."""
        if len(word) > 1 and word[-1] in self.MARKS and (word[-2:-1].isalnum() or (len(word) > 2 and word[-3] == 0xC3 and word[-2] not in (0x97, 0xB7))):
            return word[:-1]
        return None

    def _encode_words(self, words: list[bytes]) -> None:
        """Encode words with the tokenizer; words of letters only go many to a call."""
        texts = [w.decode("utf-8", "replace") for w in words]
        letters = [k for k, t in enumerate(texts) if t.isalpha()]
        found: list[np.ndarray | None] = [None] * len(words)
        for at in range(0, len(letters), 1000):
            own = letters[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[k] for k in own])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(own):  # else a normal form was no single word: one by one below
                for k, part in zip(own, np.split(ids, ends[:-1]), strict=True):
                    found[k] = part
        rest = [k for k, f in enumerate(found) if f is None]
        for at in range(0, len(rest), 1000):
            own = rest[at : at + 1000]
            for k, e in zip(own, self.tokenizer.encode_batch_fast([texts[k] for k in own], add_special_tokens=False), strict=True):
                found[k] = np.array(e.ids, np.uint32)
        if words:
            self._add(words, np.concatenate(found), np.array([len(f) for f in found], np.int64))

    def _learn(self, new: list[bytes]) -> None:
        stems = {w: s for w in new if (s := self._stem(w)) is not None}
        plain = dict.fromkeys([w for w in new if w not in stems])
        plain |= dict.fromkeys([x for w, s in stems.items() for x in (s, w[-1:]) if x not in self.index])
        self._encode_words([w for w in plain if w not in self.index])
        if stems:
            a = np.array([self.index[s] for s in stems.values()])
            b = np.array([self.index[w[-1:]] for w in stems])
            at = np.column_stack([a, b]).ravel()
            self._add(list(stems), self.flat[_ranges(self.starts[at], self.sizes[at])], self.sizes[a] + self.sizes[b])

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, END_ID after each text, and the number of ids of each text."""
        if len(self.index) > self.limit:
            self._forget()
        # The tokenizer lowers letters itself, but only after it has looked for special tokens.
        split = [(t or b"").split() if b"<|" in (t or b"") else (t or b"").lower().split() for t in texts]
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys([words[i] for i in missing])))
            at[missing] = [self.index[words[i]] for i in missing]
        sizes = self.sizes[at]
        text_of = np.repeat(np.arange(len(split)), [len(w) for w in split])
        per_text = np.bincount(text_of, weights=sizes, minlength=len(split)).astype(np.int64) + 1
        out = np.full(int(per_text.sum()), END_ID, np.uint32)
        ends = np.zeros(len(out), bool)
        ends[np.cumsum(per_text) - 1] = True
        out[~ends] = self.flat[_ranges(self.starts[at], sizes)]
        return out, per_text


@lru_cache(maxsize=1)
def word_cache(path: str) -> WordCache:
    """The cache of this Python process, kept from task to task."""
    return WordCache(path)


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class FrameWriter:
    """Collects documents into the bytes of one file; its size is bounded by FILE_IDS and one document."""

    def __init__(self, width: int) -> None:
        self.width, self.compressor = width, zstandard.ZstdCompressor(level=1)
        self.body, self.seek, self.docs = bytearray(), [], []
        self.open: list[np.ndarray] = []
        self.pending = self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((-(1 << 63) if doc_id is None else doc_id, len(ids), len(self.seek)))
        self.open.append(ids)
        self.pending += len(ids)
        self.n_ids += len(ids)
        if self.pending >= FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        if self.open:
            raw = np.concatenate(self.open).astype(f"<u{self.width}").tobytes()
            packed = self.compressor.compress(raw)
            self.body += packed
            self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.open, self.pending = [], 0

    def finish(self) -> bytes:
        self.flush()
        table = np.array(self.docs, dtype=[("doc", "<i8"), ("n", "<u4"), ("frame", "<u4")])
        index = struct.pack("<BQ", self.width, len(table)) + self.compressor.compress(table.tobytes())
        seek = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEK_MAGIC)
        return bytes(self.body) + skippable(SKIPPABLE_INDEX, index + struct.pack("<I", len(index) + 12)) + skippable(SKIPPABLE_SEEK, seek)


@dataclass
class FrameReader:
    """Random access to one file through `source`, an object with seek() and read()."""

    source: pa.NativeFile
    size: int

    def __post_init__(self) -> None:
        frames, _, magic = struct.unpack("<IBI", self._read(self.size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end of the file")
        seek_size = frames * 12 + 17
        self.table = np.frombuffer(self._read(self.size - seek_size + 8, frames * 12), "<u4").reshape(-1, 3).astype(np.int64)
        (index_size,) = struct.unpack("<I", self._read(self.size - seek_size - 4, 4))
        raw = self._read(self.size - seek_size - index_size + 8, index_size - 12)
        self.width, rows = struct.unpack("<BQ", raw[:9])
        kind = [("doc", "<i8"), ("n", "<u4"), ("frame", "<u4")]
        self.docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[9:]), dtype=kind)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        if len(self.docs) != rows:
            raise ValueError("the document index is damaged")

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> np.ndarray:
        """The ids of frame k, after its size and checksum have been verified."""
        raw = zstandard.ZstdDecompressor().decompress(self._read(int(self.offsets[k]), int(self.table[k, 0])))
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} does not match its checksum")
        return np.frombuffer(raw, f"<u{self.width}")

    def frame_documents(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        ids, at = self.frame(k), 0
        for doc, n, _ in self.docs[self.docs["frame"] == k].tolist():
            yield (None if doc == -(1 << 63) else doc), ids[at : at + n]
            at += n

    def document(self, doc_id: int) -> np.ndarray:
        """Ids of one document; only its frame is read."""
        (place,) = np.flatnonzero(self.docs["doc"] == doc_id)[:1]
        return next(ids for d, ids in self.frame_documents(int(self.docs["frame"][place])) if d == doc_id)


def _put(uri: str, name: str, content: bytes, attempt: int) -> None:
    """Write under an attempt's own name, then move: a repeated task leaves one whole file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/.{name}.{attempt}") as out:
        out.write(content)
    fs.move(f"{path}/.{name}.{attempt}", f"{path}/{name}")


def write(docs: DataFrame, folder: str, tokenizer: str, *, width: int = 2, partitions: int | None = None) -> DataFrame:
    """Encode `docs` (doc_id, text) and write the files; returns one row per file.

    Files hold documents in ascending doc_id order (nulls first, then by text) and
    are named in that order.  `width` is the bytes of an id.  A null text has only
    the end id, repeated rows are written each, and an empty table writes no file.
    `folder` is a URI that every executor reaches.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("_row")]
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        cache, writer, files = word_cache(tokenizer), FrameWriter(width), 0

        def close() -> pa.RecordBatch:
            nonlocal writer, files
            name = f"tokens-{part:07d}-{files:05d}.ids.zst"
            _put(folder, name, writer.finish(), attempt)
            known = [d for d, _, _ in writer.docs]
            row = {"file": name, "first_doc": known[0], "last_doc": known[-1], "n_docs": len(known), "n_ids": writer.n_ids, "n_frames": len(writer.seek)}
            writer, files = FrameWriter(width), files + 1
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("file", pa.string()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_frames", pa.int32())]))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                ids, sizes = cache.encode(piece["text"].cast(pa.binary()).to_pylist())
                for doc, own in zip(piece["doc_id"].to_pylist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    writer.add(doc, own)
                    if writer.n_ids >= FILE_IDS:
                        yield close()
        if writer.docs:
            yield close()

    return dealt.mapInArrow(encode, FILES)


def read_documents(files: DataFrame, folder: str) -> DataFrame:
    """(file, position, doc_id, start, n_tokens, ids_crc32) of every document in the files.

    `files` is what file_starts() gives, and `start` the number of ids ahead of the
    document in its file and in the files before.  Frames are the
    unit of work: a task reads only the frames dealt to it, 16 of a file together.  No
    files give no rows.
    """
    frames = files.select("file", "start", F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1)).alias("frame"))
    frames = frames.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", F.expr("frame div 16"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        kind = pa.schema([("file", pa.string()), ("position", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            wanted: dict[tuple[str, int], list[int]] = {}
            for file, start, frame in zip(*(batch[c].to_pylist() for c in ("file", "start", "frame")), strict=True):
                wanted.setdefault((file, start), []).append(frame)
            for (file, start), own in wanted.items():
                with fs.open_input_file(f"{path}/{file}") as source:
                    reader = FrameReader(source, source.size())
                    ahead = np.concatenate([[0], np.cumsum(reader.docs["n"].astype(np.int64))])
                    rows = []
                    for k in own:
                        first = int(np.searchsorted(reader.docs["frame"], k))
                        for i, (doc, ids) in enumerate(reader.frame_documents(k), first):
                            rows.append((file, i, doc, start + int(ahead[i]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return frames.mapInArrow(decode, "file string, position long, doc_id long, start long, n_tokens long, ids_crc32 long")


def file_starts(files: DataFrame) -> DataFrame:
    """`files` plus start, the ids ahead of each file.  One row per file of about FILE_IDS ids."""
    from pyspark.sql import Window

    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)))
