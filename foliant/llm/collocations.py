"""Phrase collocations counted over a prefix-free parse of the corpus.

Every text is a sequence of words with breaks between pieces.  A chunk ends where the hash of its
last two words meets a rule, and the next one starts with these two words, so equal passages are
cut alike and every phrase of up to three words lies whole in a chunk.  Spark groups the chunks
into a dictionary with parse frequencies, and phrases are counted inside distinct chunks, weighted;
what lies wholly in the two words that a chunk shares with the next counts there alone.

Only phrases that can reach the least count are spelled out: a first pass adds all phrases up by a
hash, whose sums are never too low, and keeps a table of bits of those that reach it; the second
pass counts phrases with a bit exactly, by their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import words as W
from foliant.operators.ranks import ranked
from foliant.storage import Scratch

LONGEST = 3  # words of a phrase; chunks share one word less
SHARED = LONGEST - 1
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"] + list(range(10, 14))] = True
SEPARATOR = BREAK.copy()
SEPARATOR[[9, 32]] = True
RADIX = np.uint64(0x9FB21C651E98DF25)
#: Phrases are added up by the upper 40 bits of their hash, with their weight, cut at the least count, below.
HASH_BITS, HASH_SHIFT, WEIGHT_BITS, WEIGHT_MOST = 40, np.uint64(24), np.uint64(8), np.uint64(255)
PARSED = "lang string, chunk binary"
COUNTED = "lang string, k int, phrase binary, f long"


@dataclass
class Stream:
    """Words of a slice and their bytes, each word with one byte behind it that says what follows."""

    found: W.Words
    data: np.ndarray
    starts: np.ndarray  # in data; one more than there are words
    breaks: np.ndarray  # does a break, or the row's start, lie before the word?


def _ended(column: pa.Array) -> pa.Array:
    """The texts with a break behind each, so that the last word has a byte behind it too."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    return pc.binary_join_element_wise(column, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))


def _stream(part: W.Slice) -> Stream:
    found = W.words(part, lower=True, separators=SEPARATOR)
    data = W.LOWER[part.data]
    seen = np.concatenate([[0], np.cumsum(BREAK[part.data])])
    breaks = np.ones(len(found.start), bool)
    breaks[1:] = (found.row[1:] != found.row[:-1]) | (seen[found.start[1:]] != seen[found.end[:-1]])
    keep = ~SEPARATOR[part.data]
    keep[found.end] = True
    data[found.end] = np.where(np.append(breaks[1:], True), 10, 32)[: len(found.end)]
    return Stream(found, data[keep], np.concatenate([[0], np.cumsum(found.end - found.start + 1)]), breaks)


def _slices(column: pa.Array, limit: int) -> Iterator[W.Slice]:
    """Runs of whole texts of about `limit` bytes; a longer text is cut at breaks, which no phrase crosses."""
    for part in W.slices(_ended(column).cast(pa.large_string()), limit):
        if len(part.data) <= 2 * limit:
            yield part
            continue
        at, cuts = 0, np.flatnonzero(BREAK[part.data]) + 1  # a slice of this size is one text
        while at < len(part.data):
            to = int(cuts[min(np.searchsorted(cuts, at + limit), len(cuts) - 1)])
            yield W.Slice(part.first_row, part.data[at:to], np.array([0, to - at]))
            at = to


def chunks(part: W.Slice, period: int) -> tuple[np.ndarray, pa.Array]:
    """Row and bytes of every chunk of a slice: words with a space or, at breaks, a line feed between them.

    The last chunk of a text ends with a line feed, the others end with a word.
    """
    own = _stream(part)
    row, key, n = own.found.row, own.found.key, len(own.found.row)
    if not n:
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    last = np.append(row[1:] != row[:-1], True)
    ends = np.zeros(n, bool)
    ends[1:] = (row[1:] == row[:-1]) & (W.mix(key[:-1] * RADIX + key[1:]) % np.uint64(period) == 0)
    ends &= ~last
    start = np.flatnonzero(np.append(ends[1:], False) | np.insert(last[:-1], 0, True))  # the word before an end, or a text's first
    cores = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(own.starts[start], own.starts[-1])), pa.py_buffer(own.data)])
    following = np.append(start[1:], n)
    shared = np.flatnonzero(np.append(row[start[1:]] == row[start[:-1]], False))
    first, size = own.starts[following[shared]], own.starts[following[shared] + SHARED] - own.starts[following[shared]] - 1
    offsets = np.zeros(len(start) + 1, np.int64)
    offsets[shared + 1] = size
    offsets = np.cumsum(offsets)
    at = np.arange(offsets[-1]) + np.repeat(first - offsets[shared], size)
    tails = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(own.data[at])])
    return row[start], pc.binary_join_element_wise(cores, tails, pa.scalar(b"", pa.large_binary()))


def parse(docs: DataFrame, *, period: int = 32, slice_bytes: int = 1 << 20) -> DataFrame:
    """(lang, chunk, n): the dictionary of `docs` (lang, text) with parse frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = 0
            for part in _slices(batch["text"], slice_bytes):
                base = part.first_row
                rows, found = chunks(part, period)
                yield pa.RecordBatch.from_arrays([batch["lang"].take(pa.array(rows + base)), found.cast(pa.binary())], names=["lang", "chunk"])

    return docs.select("lang", "text").mapInArrow(W.give_back(run), PARSED).groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Grams:
    """Phrases of a slice of the dictionary by their first word: may one of k words start here, and its hash."""

    own: Stream
    weight: np.ndarray
    starts: list[np.ndarray]
    hashes: list[np.ndarray]


def _grams(batch: pa.RecordBatch, slice_bytes: int) -> Iterator[tuple[str, Grams]]:
    """The slices of each language of a batch."""
    for lang in batch["lang"].unique():
        rows = batch.filter(pc.equal(batch["lang"], lang))
        salt = np.uint64(xxhash.xxh3_64_intdigest(lang.as_py()))
        n = rows["n"].to_numpy()
        open_ended = ~pc.ends_with(rows["chunk"], pattern="\n").to_numpy(zero_copy_only=False)
        for part in W.slices(_ended(rows["chunk"]).cast(pa.large_string()), slice_bytes):
            own = _stream(part)
            row, size = own.found.row, len(own.found.row)
            if not size:
                continue
            after = np.searchsorted(row, row, "right")
            start = ~open_ended[part.first_row + row] | (np.arange(size) < after - SHARED)
            starts, hashes = [start], [own.found.key * RADIX]
            for k in range(1, LONGEST):
                longer = np.zeros(size, bool)
                longer[: size - k] = starts[-1][: size - k] & ~own.breaks[k:]
                total = hashes[-1].copy()
                total[: size - k] = (total[: size - k] + own.found.key[k:]) * RADIX
                starts.append(longer)
                hashes.append(total)
            yield lang.as_py(), Grams(own, n[part.first_row + row], starts, [W.mix(h + salt) for h in hashes])


def _added(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and their summed weights, of values hash << WEIGHT_BITS | weight."""
    packed = np.sort(packed)
    key = packed >> WEIGHT_BITS
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(packed & WEIGHT_MOST, first) if len(first) else first.astype(np.uint64)


def _planes(key: np.ndarray, weight: np.ndarray) -> bytes:
    """Sorted hashes as steps, byte by byte, so that the upper bytes of small steps compress to nothing."""
    return np.diff(key, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() + np.minimum(weight, WEIGHT_MOST).astype(np.uint8).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(9, -1)
    key = np.cumsum(np.ascontiguousarray(planes[:8].T).view(np.uint64).ravel(), dtype=np.uint64)
    return (key << WEIGHT_BITS) | planes[8].astype(np.uint64)


def _frequent(spark: SparkSession, dictionary: DataFrame, least: int, slot_bits: int, ranges: int, slice_bytes: int, hold: int) -> np.ndarray:
    """A table of 2**slot_bits bits: those of the phrases whose hashes add up to `least` or more.

    Tasks send sums of hashes, in `ranges` ranges of them, so a range's task has an
    equal share of the distinct phrases, however frequent one of them is.
    """
    reach = min(least, int(WEIGHT_MOST))  # lower than a count that does not fit: lets more through
    range_shift, per = np.uint64(HASH_BITS - ranges.bit_length() + 1), (1 << slot_bits) // ranges

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            key, weight = _added(np.concatenate(held))
            cuts = np.searchsorted(key >> range_shift, np.arange(ranges + 1, dtype=np.uint64))
            there = np.flatnonzero(np.diff(cuts))
            sums = [pack.compress(_planes(key[cuts[r] : cuts[r + 1]], weight[cuts[r] : cuts[r + 1]])) for r in there]
            return pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(sums, pa.binary())], names=["range", "sums"])

        for batch in batches:
            for _, g in _grams(batch, slice_bytes):
                weight = np.minimum(g.weight, reach).astype(np.uint64)
                for start, h in zip(g.starts, g.hashes, strict=True):
                    held.append(((h[start] >> HASH_SHIFT) << WEIGHT_BITS) | weight[start])
                    n += len(held[-1])
                if n >= hold:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def total(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        own, weight = _added(np.concatenate([_unplaned(unpack.decompress(x)) for batch in batches for x in batch["sums"].to_pylist()]))
        bits = np.zeros(per, bool)
        bits[((own[weight >= reach] >> np.uint64(HASH_BITS - slot_bits)) % np.uint64(per)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["range", "bits"])

    sums = dictionary.select("lang", "chunk", "n").mapInArrow(W.give_back(send), "range long, sums binary").groupBy("range").applyInArrow(total, "range long, bits binary")
    bits = np.zeros((ranges, per // 8), np.uint8)
    for r in sums.collect():  # 2**slot_bits bits, at most 2**30
        bits[r["range"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.ravel()


def phrase_counts(dictionary: DataFrame, least: int, *, max_slot_bits: int = 30, range_bytes: int = 1 << 23, slice_bytes: int = 1 << 20, hold: int = 1 << 22, hold_bytes: int = 1 << 26) -> DataFrame:
    """(lang, k, phrase, f): every phrase of k words, 1 to 3, with f >= least; k = 0 has the number of words.

    The filter of the first pass has a bit for each 8 bytes of the dictionary, but
    2**max_slot_bits at most: with more phrases than these tell apart it lets more through
    to the exact count, and the result is the same.
    """
    spark = dictionary.sparkSession
    size = dictionary.agg(F.sum(F.octet_length("chunk"))).first()[0] or 0
    ranges = 1 << max(6, int(size // range_bytes).bit_length())
    slot_bits = max(min(max(16, int(size // 8).bit_length()), max_slot_bits), ranges.bit_length() + 2)
    shift = np.uint64(64 - slot_bits)
    shared = spark.sparkContext.broadcast(_frequent(spark, dictionary, least, slot_bits, ranges, slice_bytes, hold))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        held: list[pa.Table] = []
        held_bytes = 0

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held).group_by(["lang", "k", "phrase"], use_threads=False).aggregate([("f", "sum")])
            yield from table.select(["lang", "k", "phrase", "f_sum"]).rename_columns(["lang", "k", "phrase", "f"]).to_batches(50_000)

        for batch in batches:
            for lang, g in _grams(batch, slice_bytes):
                held.append(_table(lang, 0, pa.array([b""], pa.binary()), np.array([g.weight[g.starts[0]].sum()])))
                parts = None
                for k in range(LONGEST):
                    slot = g.hashes[k] >> shift
                    passes = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7))).astype(np.uint8)) & 1 == 1
                    # A phrase is no more frequent than those it begins and ends with.
                    both = g.starts[k] & passes if parts is None else g.starts[k] & passes & parts & np.append(parts[1:], False)
                    parts = passes if parts is None else passes & parts & np.append(parts[1:], False)
                    for offset in range(k + 1):
                        held.append(_spelled(lang, g, both, k + 1, offset))
                        held_bytes += held[-1].nbytes
            if held_bytes >= hold_bytes:
                yield from flush()
                held, held_bytes = [], 0
        if held:
            yield from flush()

    counted = dictionary.select("lang", "chunk", "n").mapInArrow(W.give_back(count), COUNTED)
    counted = counted.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0))
    return counted.withColumn("phrase", F.col("phrase").cast("string"))


def _table(lang: str, k: int, phrases: pa.Array, f: np.ndarray) -> pa.Table:
    return pa.table({"lang": pa.array([lang] * len(f), pa.string()) if len(f) < 2 else pa.array([lang], pa.string()).take(pa.array(np.zeros(len(f), np.int64))), "k": pa.array(np.full(len(f), k, np.int32)), "phrase": phrases, "f": pa.array(f, pa.int64())})


def _spelled(lang: str, g: Grams, wanted: np.ndarray, k: int, shift: int) -> pa.Table:
    """Distinct phrases of k words whose first word's number is `shift` modulo k, with their weights.

    Such phrases lie end to end in the stream, so they are read where they are.
    """
    n = max(0, (len(wanted) - shift) // k)
    if not n:
        return _table(lang, k, pa.array([], pa.binary()), np.zeros(0, np.int64))
    offsets = g.own.starts[shift : shift + n * k + 1 : k]
    phrases = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(g.own.data)])
    use = wanted[shift : shift + n * k : k]
    coded = phrases.filter(pa.array(use)).dictionary_encode()
    f = np.bincount(coded.indices.to_numpy(), g.weight[shift : shift + n * k : k][use], minlength=len(coded.dictionary)).astype(np.int64)
    # The byte behind a phrase is a space or a line feed: without it the same phrase may come twice, and is added up later.
    return _table(lang, k, pc.binary_slice(coded.dictionary.cast(pa.binary()), 0, -1), f)


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10, first: int = 2000, inside_percent: int = 50, period: int = 32) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `first` phrases of two or three words.

    a is the phrase's count, l and r those of its parts at the cut that scores lowest,
    n the language's words, and score floor(10**6 * a * a / (l * r)).  A phrase that a
    longer one holds with at least `inside_percent` of its count is left out.  Null
    languages are `und`, null texts empty; repeated rows count each; equal scores go by
    count, then by the phrase's bytes, so ties have one order.  Other columns of `docs`
    are not looked at; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    dictionary = scratch.save(parse(rows, period=period), "dictionary")
    counts = scratch.save(phrase_counts(dictionary, least), "counts")
    scratch.drop("dictionary")
    found = scratch.save(scored(counts, inside_percent), "scored")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    top = ranked(found, ["lang"], order, "rank", scratch=scratch).where(F.col("rank") <= first)
    total = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return top.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def scored(counts: DataFrame, inside_percent: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrase_counts() rows, without those inside a longer phrase."""
    words = F.split("phrase", " ")
    several = counts.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), words.alias("w"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda c: F.struct(c.alias("cut"), part(F.lit(1), c).alias("head"), part(c + 1, F.col("k") - c).alias("tail"))))
    cuts = several.select("lang", "phrase", "a", cut.alias("x")).select("lang", "phrase", "a", "x.*")
    parts = counts.where("k BETWEEN 1 AND 2")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(_score().alias("score"), "cut", "l", "r")).alias("x"))
    inner = F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda s: part(s, F.lit(2))))
    longer = several.where("k = 3").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {inside_percent} * a")
    return kept.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def _score() -> Column:
    """floor(10**6 * a * a / (l * r)) in decimals of 38 digits: exact for counts up to 10**15."""
    d = lambda c: f"CAST({c} AS DECIMAL(16,0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * ({d('a')} * {d('a')})) DIV ({d('l')} * {d('r')})")
