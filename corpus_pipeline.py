"""The corpus pipeline: quality, line dedup, near-duplicates, benchmark leaks, mix.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of ``documents``; ``n_chars`` follows a shortened text. The stages add no rule of their own to the operators'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.llm import decontaminate, lines, mixing, quality, simhash
from quillet.llm.common import table

#: Near-duplicates: Jaccard similarity of the sets of five-word shingles.
NEAR = {"shingle": 5, "similarity": 0.8}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return quality.resample(docs, table(spark, sf_dir, "labels"), columns=docs.columns).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of three-line passages; a document that loses all its lines goes."""
    short = lines.dedup_lines(docs).where("n_removed < n_lines OR n_lines IS NULL")
    counted = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return short.select(*[counted.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return simhash.keep_first(docs, **NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how much of each document the mix takes."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
]

#: The stages are models, hashes and components: not SQL. The tests hold each stage against planted cases, and its operator against
#: plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
