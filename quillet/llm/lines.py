"""Line dedup over windows of three consecutive lines. DataFrame functions only.

Every run of three lines of a document is a window, known by two 64-bit hashes, each of other hashes of its lines. A window's first occurrence is the one
with the smallest (doc_id, line); all lines that later occurrences cover go, spans that overlap or touch as one. The
rest of the lines, joined by line ends, is the new text; a document all of whose lines go keeps an empty text.

What moves: one narrow row per window, pre-aggregated on the map side before it meets the others of its hash, then a row
per later occurrence, then the texts once, by doc_id. A hot window is a hot key of plain joins only, which adaptive
execution splits; no group is ever collected but a document's own line numbers.

Defined results: a null text is empty; texts of fewer than three lines have no window and stay; a null doc_id counts as
the smallest; rows that repeat a doc_id are one document each, in the order of their text hashes (exact repeats: all
are the first); no rows give no rows; other columns come along unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import NULL_ID

#: Lines that make a window.
WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _windows(docs: DataFrame) -> DataFrame:
    """id, th (text hash), line, w1, w2: one row per window."""
    hashed = docs.select("id", "th", F.transform(_lines(F.col("text")), lambda s: F.struct(F.xxhash64(s).alias("a"), F.xxhash64(F.lit("second"), s).alias("b"))).alias("h"))

    def window(i: Column) -> Column:
        h = [F.get("h", i + k) for k in range(WINDOW)]
        return F.struct(i.alias("line"), F.xxhash64(*[x["a"] for x in h]).alias("w1"), F.xxhash64(*[x["b"] for x in h]).alias("w2"))

    several = hashed.where(F.size("h") >= WINDOW)
    return several.select("id", "th", F.inline(F.transform(F.sequence(F.lit(0), F.size("h") - WINDOW), window)))


def later_windows(docs: DataFrame) -> DataFrame:
    """id, th, line of every window that also occurs before."""
    windows = _windows(docs)
    repeated = (
        windows.groupBy("w1", "w2")
        .agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "line")).alias("first"))
        .where("n > 1")
        .select("w1", "w2", "first")
    )
    return windows.join(repeated, ["w1", "w2"]).where(F.struct("id", "th", "line") > F.col("first")).select("id", "th", "line")


def merged_runs(windows: DataFrame) -> DataFrame:
    """id, th, runs: per document the covered lines as (from, to); windows that overlap or touch make one run."""
    starts = windows.groupBy("id", "th").agg(F.array_sort(F.collect_set("line")).alias("starts"))
    at = lambda k: F.get("starts", k)
    opens = F.filter(F.sequence(F.lit(0), F.size("starts") - 1), lambda k: (k == 0) | (at(k) - at(F.greatest(k - 1, F.lit(0))) > WINDOW))
    run = lambda k, j: F.struct(at(k).alias("from"), (at(F.coalesce(F.get("opens", j + 1), F.size("starts")) - 1) + (WINDOW - 1)).alias("to"))
    return starts.withColumn("opens", opens).select("id", "th", F.transform("opens", run).alias("runs"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The input's columns with the shortened text, then n_lines and n_removed."""
    own = docs.columns
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    held = wrapped.select(
        F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("row.text").alias("th"), F.col("row.text").alias("text"), "row"
    )
    later = later_windows(held.select("id", "th", "text"))
    joined = held.select("id", "th", "row").join(merged_runs(later), ["id", "th"], "left")
    lined = joined.select("row", "runs", _lines(F.col("row.text")).alias("lines"))
    runs_, lines = F.col("runs"), F.col("lines")
    # The lines before each run and after the last one; what lies in a run is left out.
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(runs_)),
            lambda j: F.slice(
                lines,
                F.coalesce(F.get(runs_, j - 1)["to"], F.lit(-1)) + 2,
                F.greatest(F.coalesce(F.get(runs_, j)["from"], F.size(lines)) - F.coalesce(F.get(runs_, j - 1)["to"], F.lit(-1)) - 1, F.lit(0)),
            ),
        )
    )
    text = F.when(runs_.isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    removed = F.coalesce(F.aggregate(runs_, F.lit(0), lambda a, r: a + r["to"] - r["from"] + 1), F.lit(0))
    return lined.select(
        *[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in own], F.size(lines).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed")
    )
