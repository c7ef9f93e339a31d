"""Where lines, words and labelled ledgers come from.

Recognisers and page readers are adapters: a callable from file bytes to words. They run on batches of files; the words
of a text layer or a recogniser then take the same path."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "doc_id string, page_no int, line_no int, text string, top int, bottom int, left int, right int, confidence double"
WORDS = "doc_id string, page_no int, text string, left int, top int, width int, height int, confidence double"
LABELLED = "narration string, credit decimal(18,2), debit decimal(18,2), label string, ledger string, contra boolean"
#: What digits-only recognition may print.
NUMERIC = "0123456789.,-/"

#: From a file's name and bytes to rows of (page_no, text, left, top, width, height, confidence).
Reader = Callable[[str, bytes], list[tuple[int, str, int, int, int, int, float]]]


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINES).parquet(path)


def words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORDS).parquet(path)


def labelled_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A labelled ledger from CSV with a header."""
    return spark.read.schema(LABELLED).csv(path, header=True)


def words_of_files(spark: SparkSession, path: str, reader: Reader, batch: int = 4) -> DataFrame:
    """The words of all files, by the reader; unread (confidence -1) and blank ones go."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                rows = [(name, *r) for r in reader(name, bytes(content))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in WORDS.split(", ")])

    return files.mapInPandas(run, WORDS).filter((F.col("confidence") != -1) & (F.trim("text") != ""))


def shifted(band_words: DataFrame, left: str = "band_left") -> DataFrame:
    """Words of a cropped band in the page's coordinates."""
    return band_words.withColumn("left", F.col("left") + F.col(left))


def with_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tables of an older and a newer layout as one; what a table lacks is null."""
    return old.unionByName(new, allowMissingColumns=True)


# Pixels of a point of a text layer, and the confidence of its words.
SCALE, EXACT = 4, 100.0
# Fixed value: how rasterised pages are named.
PAGE_FILE = r"page-(\d+)\.png$"

#: From a file's name, its bytes and a resolution to (page file's name, image bytes).
Renderer = Callable[[str, bytes, int], list[tuple[str, bytes]]]
RASTERS = "doc_id string, path string, content binary"


def text_layer_words(items: DataFrame) -> DataFrame:
    """Words of a text layer (doc_id, page_no, text, x0, top, x1, bottom in points) in the pixels that layout expects."""
    px = lambda c: (c * SCALE).cast("int")
    size = lambda a, b: F.greatest(px(F.col(b) - F.col(a)), F.lit(1))
    return items.select(
        "doc_id", "page_no", "text", px(F.col("x0")).alias("left"), px(F.col("top")).alias("top"),
        size("x0", "x1").alias("width"), size("top", "bottom").alias("height"), F.lit(EXACT).alias("confidence"),
    )


def polygon_words(found: DataFrame) -> DataFrame:
    """Words of a recogniser that gives polygons (array of [x, y]) and confidences from 0 to 1; blank ones go."""
    axis = lambda i: F.transform("polygon", lambda p: p[i])
    low, high = (lambda i: F.array_min(axis(i)).cast("int")), (lambda i: F.array_max(axis(i)).cast("int"))
    kept = found.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return kept.select(
        "doc_id", "page_no", F.trim("text").alias("text"), low(0).alias("left"), low(1).alias("top"),
        F.greatest(high(0) - low(0), F.lit(1)).alias("width"), F.greatest(high(1) - low(1), F.lit(1)).alias("height"),
        (F.col("confidence").cast("double") * 100.0).alias("confidence"),
    )


def numeric_words(words_: DataFrame) -> DataFrame:
    """Words as digits-only recognition prints them; what has no such character goes."""
    digits = F.regexp_replace("text", f"[^{NUMERIC.replace('-', chr(92) + '-')}]", "")
    return words_.withColumn("text", digits).filter("text <> ''")


def region_text(words_: DataFrame, regions: DataFrame, number: bool = False) -> DataFrame:
    """The text of the words whose centres lie in each region (doc_id, page_no, region, x0, y0, x1, y1); ``number``: digits only."""
    seen = numeric_words(words_) if number else words_
    x, y = F.col("left") + F.col("width") / 2, F.col("top") + F.col("height") / 2
    placed = seen.withColumns({"__x": x, "__y": y}).join(regions, ["doc_id", "page_no"])
    inside = placed.filter((F.col("__x") >= F.col("x0")) & (F.col("__x") < F.col("x1")) & (F.col("__y") >= F.col("y0")) & (F.col("__y") < F.col("y1")))
    found = F.transform(F.sort_array(F.collect_list(F.struct("top", "left", "text"))), lambda w: w["text"])
    return inside.groupBy("doc_id", "page_no", "region").agg(F.array_join(found, " ").alias("text"))


def rasters_of_files(spark: SparkSession, path: str, renderer: Renderer, dpi: int = 300) -> DataFrame:
    """Rasterised pages of all files, by the renderer: doc_id, path, content, page_no."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                rows = [(name, *r) for r in renderer(name, bytes(content), dpi)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in RASTERS.split(", ")])

    return numbered_pages(files.mapInPandas(run, RASTERS))


def numbered_pages(files: DataFrame) -> DataFrame:
    """Page files (path) with the page number that their name holds; other files go."""
    page = F.regexp_extract("path", PAGE_FILE, 1)
    return files.withColumn("page_no", F.when(page != "", page.try_cast("int"))).filter("page_no IS NOT NULL")


def page_counts(pages: DataFrame) -> DataFrame:
    """How many pages each document has."""
    return pages.groupBy("doc_id").agg(F.count_distinct("page_no").alias("pages"), F.max("page_no").alias("last_page"))


def missing_columns(old: DataFrame, new: DataFrame) -> list[tuple[str, str]]:
    """Names and types of the columns that a newer layout has and an older one lacks."""
    have = {c.lower() for c in old.columns}
    return [(c, t) for c, t in new.dtypes if c.lower() not in have]
