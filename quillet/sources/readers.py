"""Sources and sinks (A1, A6, A7, A12-A14, B3-B5, B9): files by kind, landed OCR tables, JSON maps, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillet.schemas import BARCODES, OCR_WORDS


def file_mode(path: Column, mime: Column) -> Column:
    """A1: pdf by type or suffix, else image."""
    return F.when((mime == "application/pdf") | F.lower(path).endswith(".pdf"), "pdf").otherwise("image")


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Path, length, content and mode of a folder's files, sorted by name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return found.withColumn("mode", file_mode(F.col("path"), F.lit(""))).orderBy("path")


def ocr_words(spark: SparkSession, path: str, scale: float = 1.0) -> DataFrame:
    """Words that a reader has left as JSON lines; boxes are divided by the ``scale`` at which it read."""
    words = spark.read.schema(OCR_WORDS).json(path)
    return words.withColumns({c: F.col(c) / scale for c in ("x", "y", "w", "h")})


def barcodes(spark: SparkSession, path: str, most: int = 6) -> DataFrame:
    """Valid decoded symbols, the first ``most`` of a document in the order in which they were decoded (``ord``),
    so that whoever takes the first takes the decoder's first."""
    read = spark.read.schema(BARCODES).json(path).where("coalesce(is_valid, true) AND text IS NOT NULL AND text <> ''")
    order = Window.partitionBy("doc_id").orderBy("ord", "text")
    return read.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn", "is_valid")


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Key, and the value's columns, of a file that holds one JSON object by key."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "v"))
    return pairs.select("key", "v.*")


def write_report(summary: DataFrame, items: DataFrame, folder: str) -> int:
    """A summary file and a row per item; the exit code is 1 if any item leaks."""
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")  # one row
    items.write.mode("overwrite").json(f"{folder}/items")
    return int(items.where("leaks > 0").limit(1).count() > 0)


def turned(pixels: Column, width: Column, height: Column, quarters: int) -> Column:
    """A row-major pixel array after clockwise quarter turns."""
    w, h = width, height
    n = F.size(pixels) - 1
    if quarters % 4 == 1:
        return F.transform(F.sequence(F.lit(0), n), lambda k: F.get(pixels, ((h - 1 - k % h) * w + F.floor(k / h)).cast("int")))
    if quarters % 4 == 2:
        return F.reverse(pixels)
    if quarters % 4 == 3:
        return F.transform(F.sequence(F.lit(0), n), lambda k: F.get(pixels, (k % h * w + (w - 1 - F.floor(k / h))).cast("int")))
    return pixels


def fitted(width: Column, height: Column, most: int) -> Column:
    """struct(w, h) with the longer side at most ``most``."""
    k = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return F.struct(F.floor(width * k + 0.5).cast("int").alias("w"), F.floor(height * k + 0.5).cast("int").alias("h"))
