"""Pages of binary documents by providers that the caller brings: word boxes, anchors, vision texts and prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "array<struct<text:string,bbox:array<double>>>"
#: A page of a provider: number from 1, width, height and (x0, y0, x1, y1, text) of each word.
Page = tuple[int, float, float, list[tuple[float, float, float, float, str]]]


def read_words(files: DataFrame, pages_of: Callable[[bytes], list[Page]]) -> DataFrame:
    """(doc_id, page, width, height, words) of binary files (doc_id, content), one file at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                rows = [(doc_id, page, width, height, [{"text": w[4], "bbox": list(w[:4])} for w in words]) for page, width, height, words in pages_of(bytes(content))]
                yield pd.DataFrame(rows, columns=["doc_id", "page", "width", "height", "words"])

    return files.select("doc_id", "content").mapInPandas(run, f"doc_id long, page int, width double, height double, words {WORDS}")


def text_layer(pages: DataFrame) -> DataFrame:
    """(doc_id, page, source, text, words): boxes as shares of the page, words by line and place."""
    scaled = F.transform("words", lambda w: F.struct(w["text"].alias("text"), F.array(w["bbox"][0] / F.col("width"), w["bbox"][1] / F.col("height"), w["bbox"][2] / F.col("width"), w["bbox"][3] / F.col("height")).alias("bbox")))
    ordered = F.transform(F.array_sort(F.transform(scaled, lambda w: F.struct(F.round(w["bbox"][1], 1).alias("line"), w["bbox"][0].alias("x"), w.alias("w")))), lambda k: k["w"])
    return pages.select("doc_id", "page", F.lit("text_layer").alias("source"), ordered.alias("words")).select("doc_id", "page", "source", F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"), "words")


def anchors(pages: DataFrame) -> DataFrame:
    """(doc_id, page, status, token_count, words): words with a text and a real box, in absolute places."""
    good = F.filter("words", lambda w: (F.trim(w["text"]) != "") & (w["bbox"][2] > w["bbox"][0]) & (w["bbox"][3] > w["bbox"][1]))
    rows = pages.select("doc_id", "page", F.transform(good, lambda w: F.struct(F.trim(w["text"]).alias("text"), w["bbox"].alias("bbox"))).alias("words"))
    return rows.select("doc_id", "page", F.when(F.size("words") > 0, "ok").otherwise("no_text_layer").alias("status"), F.size("words").alias("token_count"), "words")


def read_vision(images: DataFrame, read: Callable[[str, bytes], str], prompt: str, *, model: str, max_pages: int = 0) -> DataFrame:
    """(doc_id, page, source, text, model_name) of page images (doc_id, page, image); a limit stops each document there."""
    wanted = images.where(F.col("page") <= max_pages) if max_pages > 0 else images

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id", "page"]].assign(text=[read(prompt, bytes(x)) for x in batch["image"]])

    return wanted.select("doc_id", "page", "image").mapInPandas(run, "doc_id long, page int, text string").select("doc_id", "page", F.lit("vision_ocr").alias("source"), "text", F.lit(model).alias("model_name"))


def prompts(spark: SparkSession, folder: str, defaults: dict[str, str]) -> DataFrame:
    """(name, template): the files of a folder, and the defaults for names without a file or with a blank one."""
    found = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("name"), F.nullif(F.trim("value"), F.lit("")).alias("own"))
    base = spark.createDataFrame(list(defaults.items()), "name string, template string")
    return base.join(found, "name", "full").select("name", F.coalesce("own", "template").alias("template")).where("template IS NOT NULL")
