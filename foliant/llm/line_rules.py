"""Quality rules from how often a line occurs across the documents of a host.

Lines are normalised (A-Z to lower case, digits to 0, white space collapsed) and
hashed; a line is frequent when more documents of its host hold it than a limit that
is the same for small and large hosts.  Frequent lines are removed, and documents that
lose most of their words are rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch

NORMAL = bytes.maketrans(bytes(range(65, 91)) + b"0123456789", bytes(range(97, 123)) + b"0" * 10)
NOT_CHARS = bytes([9, 10, 11, 12, 13, 32, *range(0x80, 0xC0)])
SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<hash:long,words:int>>"


def repeat_words(words: list[bytes], n: int = 3) -> int:
    """Words inside n-word windows that occur at least twice in the list."""
    windows = list(zip(*(words[k:] for k in range(n)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    total = until = 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            total += i + n - max(i, until)
            until = i + n
    return total


def measure(text: bytes | None) -> tuple:
    """The base figures of a text and (hash, words) of each distinct normalised line."""
    text = text or b""
    words = text.split()
    seen: set[bytes] = set()
    repeated = 0
    lines: dict[int, int] = {}
    for line in text.split(b"\n"):
        own = line.translate(NORMAL).split()
        if not own:
            continue
        repeated += line in seen
        seen.add(line)
        key = xxhash.xxh3_64_intdigest(b" ".join(own)) - (1 << 63)
        lines[key] = lines.get(key, 0) + len(own)
    chars = len(text.translate(None, NOT_CHARS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), chars, symbols, repeated, repeat_words(words), [{"hash": h, "words": n} for h, n in lines.items()]


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int32())]))
    for batch in batches:
        keep = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_text"]
        labels = [name for name in batch.schema.names if name != "_text"]
        columns = list(zip(*map(measure, batch["_text"].cast(pa.binary()).to_pylist()), strict=True)) if batch.num_rows else [[]] * 6
        arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], kind)]
        yield pa.RecordBatch.from_arrays(keep + arrays, names=[*labels, *names, "lines"])


def assess(docs: DataFrame, *, host: str = "source", max_documents: int = 3, min_left: float = 0.3) -> DataFrame:
    """One row per row of `docs` (doc_id, text and a host column).

    Gives doc_id, text_hash, the base figures, base_failed, n_removed_words,
    removed_lines (hashes) and kept.  A line is frequent when more than max_documents
    documents of the host hold it; every row is a document of its own, copies too, and
    counts once however often it repeats the line.  A document is depleted when less
    than `min_left` of its words remain.  A null host is a host of its own; null and
    empty texts have no words and fail the base rule; an empty table gives no rows.
    Other columns of `docs` are not looked at, so their names cannot clash.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(
        "doc_id", F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("_host"), F.xxhash64("text").alias("text_hash"),
        F.monotonically_increasing_id().alias("_row"), F.col("text").alias("_text"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    measured = rows.mapInArrow(_measures, f"doc_id {kinds['doc_id']}, _host string, text_hash long, _row long, {MEASURES}")
    measured = scratch.save(measured, "measured")

    # A row lists each of its lines once, so rows count documents, with partial sums before the shuffle.
    lines = measured.select("_row", "_host", F.explode("lines").alias("x")).select("_row", "_host", "x.hash", "x.words")
    frequent = lines.groupBy("_host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_documents).select("_host", "hash")
    hits = lines.join(frequent, ["_host", "hash"]).groupBy("_row").agg(F.sum("words").alias("gone"), F.collect_list("hash").alias("removed_lines"))

    out = measured.drop("lines", "_host").join(hits, "_row", "left")
    gone = F.coalesce("gone", F.lit(0)).cast("long")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - gone >= min_left * F.col("n_words")
    return out.select(
        "doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), gone.alias("n_removed_words"), F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"), (~failed & left).alias("kept"),
    )


def without_lines(docs: DataFrame, assessed: DataFrame) -> DataFrame:
    """The kept rows of `docs` with their frequent lines cut out of `text`.

    Rows meet by doc_id and text, so rows that repeat both are given back once for
    each of them.  All columns of `docs` come back, whatever their names.
    """
    verdict = assessed.where("kept").groupBy("doc_id", "text_hash").agg(F.first("removed_lines").alias("removed")).select(F.struct("doc_id", "text_hash", "removed").alias("v"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("d"), docs["doc_id"].alias("own_id"), F.xxhash64(docs["text"]).alias("own_hash"))
    joined = rows.join(verdict, F.col("own_id").eqNullSafe(F.col("v.doc_id")) & (F.col("own_hash") == F.col("v.text_hash")))
    names, at = docs.columns, docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = lambda line: xxhash.xxh3_64_intdigest(b" ".join(line.translate(NORMAL).split())) - (1 << 63)
        for batch in batches:
            texts = []
            own = batch["d"].flatten()
            for text, removed in zip(own[at].cast(pa.binary()).to_pylist(), batch["removed"].to_pylist(), strict=True):
                gone = set(removed)
                texts.append(text if not gone or text is None else b"\n".join(x for x in text.split(b"\n") if key(x) not in gone))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else own[i] for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select("d", "v.removed").mapInArrow(cut, docs.schema)
