"""A training corpus from documents: five stages, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.decontaminate import contaminated
from foliant.llm.hyperminhash import near_duplicates
from foliant.llm.piece_lattice import encode
from foliant.llm.scratch import Scratch, read
from foliant.llm.suffix_dedup import remove_repeats
from foliant.llm.toxic_segments import score, train

TOXIC_FROM = 0.3


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and `row`, a struct of all columns, so that no column's name can clash."""
    return docs.select(docs["doc_id"], docs["text"], F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below TOXIC_FROM; the model learns from the labels table.

    Where the labels teach it nothing, all rows stay.  Null and empty texts stay,
    repeated rows are scored each, and an empty table gives no rows.
    """
    model = train(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    if not model.learned:
        return docs
    return score(_rows(docs), model).where(F.col("_score") < TOXIC_FROM).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least doc_id; repeated rows once.

    Documents without words are in no group: all stay, but repeated rows among them.
    An empty table gives no rows.
    """
    found = near_duplicates(docs).select("key", "kept")
    # Of a repeated row one is kept, so a key goes wholly, stays wholly, or is thinned.
    by_key = found.groupBy("key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("NOT kept OR n > 1").withColumnRenamed("key", "found_key")
    rows = _rows(docs).select(F.xxhash64("doc_id", "text").alias("key"), "row")
    joined = rows.join(by_key, F.col("key") == F.col("found_key"), "left").where("kept IS NULL OR kept")
    once = joined.where("n IS NULL").select("row.*")
    return once.unionByName(joined.where("n > 1").dropDuplicates(["key"]).select("row.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that an earlier document has; all rows stay.

    Where a cut splits a character, its other bytes go too.  n_chars follows the text;
    null texts stay null, and an empty table gives no rows.
    """
    out = remove_repeats(docs, with_rows=True).select("document.*")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no benchmark item aligns with.

    Null and empty texts hold no item and stay; copies of a contaminated row all go;
    an empty table gives no rows, and an empty benchmark lets all rows stay.
    """
    rows = _rows(docs).select(F.xxhash64("doc_id", "text").alias("key"), "row")
    found = contaminated(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and checksum of the pieces, and whether decoding gives the text back.

    A null text is encoded as the empty one; repeated rows come back each; an empty
    table gives no rows.
    """
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = encode(docs.select("doc_id", "text"), model, decoded=True)
    exact = F.crc32(F.col("decoded").cast("binary")) == F.col("text_crc32")
    return found.select("doc_id", "n_pieces", "ids_crc32", exact.alias("decoded_exactly"))


STAGES = [
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Stages learn, sketch and align: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs
