"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a target in words: a share of the whole budget by weight, stopped at ``most`` times the source's size,
the excess shared again. Whole passes over a source come first; what is left is fitted by document lengths: each
length gives its proportional number of documents, what that rounds off going on to the next longer one, up to ``SLACK``
longest documents before the budget; a bounded-knapsack dynamic programme over the lengths closes the rest. Which
documents of a length are taken is decided by a seeded hash, so reruns agree.

What moves: (source, length, salt, count) rows, pre-aggregated, one row per distinct length to the task that fits a
source; then narrow (doc_id, source, size) rows, a source's length dealt by ``SALTS`` ranges of the hash. The driver sees
sums over sources, never a row per source.

Defined results: a null text has size 0, and a document of size 0 is taken 0 words; a null source is a source of its
own, after all others; a null doc_id is a document like any other; repeated rows count as often as they occur; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of the hash that the documents of one source and length are dealt by.
SALTS = 256
#: Longest documents' worth of words that the dynamic programme gets to fill at least.
SLACK = 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length make up the budget as nearly as possible without passing it."""
    take = np.zeros(len(lengths), np.int64)
    total = sum(w * c for w, c in zip(lengths.tolist(), counts.tolist(), strict=True))
    budget = max(0, min(int(budget), total))
    if budget == total:
        return np.where(lengths > 0, counts, 0).astype(np.int64)
    shared = max(0, budget - SLACK * int(lengths.max(initial=0)))
    seen = used = 0
    for i in np.argsort(lengths, kind="stable").tolist():
        w, c = int(lengths[i]), int(counts[i])
        seen += w * c
        if w:
            take[i] = min(c, (shared * seen // total - used) // w)
            used += w * int(take[i])
    return take + bounded_knapsack(lengths, counts - take, budget - used)


def bounded_knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The dynamic programme: by sum, the step that reached it first, a step being a power of two of documents of a length."""
    steps: list[tuple[int, int]] = [(0, 0)]
    by = np.full(budget + 1, -1, np.int32)
    by[0] = 0
    for i in np.argsort(lengths, kind="stable").tolist():
        left, chunk = min(int(counts[i]), budget // int(lengths[i])) if lengths[i] else 0, 1
        while left > 0 and by[budget] < 0:
            k = min(chunk, left)
            shift = k * int(lengths[i])
            fresh = (by[: budget + 1 - shift] >= 0) & (by[shift:] < 0)
            steps.append((i, k))
            by[shift:][fresh] = len(steps) - 1
            left, chunk = left - k, chunk * 2
    take = np.zeros(len(lengths), np.int64)
    at = int(np.flatnonzero(by >= 0)[-1])
    while at:
        i, k = steps[by[at]]  # the sum before it was reached by an earlier step
        take[i] += k
        at -= k * int(lengths[i])
    return take


def _in_order(sources: DataFrame, parts: int) -> DataFrame:
    """The sources with their place, from 0, by code point, null last: ranges are numbered, then rows inside a range."""
    key = [F.col("source").isNull(), F.col("source")]
    ranged = durable(sources.repartitionByRange(parts, *key).withColumn("part", F.spark_partition_id()))  # a second sampling could cut elsewhere
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = ranged.groupBy("part").agg(F.count("*").alias("here")).select("part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"))
    inside = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*key)))
    return inside.join(offsets, "part").select(*sources.columns, (F.col("offset") + F.col("rank") - 1).alias("place"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], factor: float, most: float) -> DataFrame:
    """source, source_size, target of (source, size): shares of the budget by weight, none above ``most`` times its size;
    the excess goes to the others by weight.

    At the end every open source has one number of words for each unit of weight, and the others are full. That number
    rises round by round, a sum over the sources each, until no further source is full.
    """
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    known = durable(_in_order(per, parts).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")))
    budget = factor * float(known.agg(F.coalesce(F.sum("source_size"), F.lit(0))).collect()[0][0])
    level, full = 0.0, None
    while True:
        over = F.col("weight") * level > F.col("cap")
        now = known.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("words"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight")).collect()[0]
        if now["n"] == full or not now["weight"]:
            break
        level, full = (budget - now["words"]) / now["weight"], now["n"]
    return known.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * (level if full is not None else 0.0)).alias("target"))


def _side(df: DataFrame) -> DataFrame:
    """With a flag and a filled value for the source: null-safe equality that stays hashable."""
    return df.withColumn("no_source", F.col("source").isNull()).withColumn("of", F.coalesce("source", F.lit("")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), factor: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, passes (whole passes), extra (one more time or not), taken (words)."""
    id_ = F.col("doc_id").cast("long")
    order = F.xxhash64(F.lit(seed), F.coalesce(id_, F.lit(0)), F.col("text"))
    sized = durable(docs.select(id_.alias("doc_id"), "source", words(F.col("text")).alias("size"), order.alias("h")))
    dealt = _side(sized.withColumn("salt", F.pmod(F.shiftright("h", 20), F.lit(SALTS))))
    group = ["no_source", "of", "size"]
    counts = durable(dealt.groupBy("source", *group, "salt").agg(F.count("*").alias("here")))
    lengths = counts.groupBy("source", *group).agg(F.sum("here").alias("count"))
    targets = _side(source_targets(lengths.select("source", (F.col("size") * F.col("count")).alias("size")), weights, factor, most)).drop("source")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = int(target // size) if size else 0
        take = fit_counts(pdf["size"].to_numpy(), pdf["count"].to_numpy(), int(round(target)) - passes * size)
        return pdf.drop(columns="count").assign(passes=passes, take=take)

    fitted = lengths.drop("source").join(targets, ["no_source", "of"]).select(*group, "count", "source_size", "target")
    plan = fitted.groupBy("no_source", "of").applyInPandas(fit, "no_source boolean, of string, size long, source_size long, target double, passes long, take long")
    before = Window.partitionBy(*group).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # SALTS rows at most
    room = counts.drop("source").withColumn("earlier", F.coalesce(F.sum("here").over(before), F.lit(0))).drop("here").join(plan, group)
    rows = dealt.join(room, [*group, "salt"]).withColumn("rank", F.row_number().over(Window.partitionBy(*group, "salt").orderBy("h", "doc_id")))
    extra = (F.col("earlier") + F.col("rank") <= F.col("take")).cast("long")
    placed = rows.select("doc_id", "source", "size", "source_size", "target", "passes", extra.alias("extra"))
    return placed.withColumn("taken", F.col("size") * (F.col("passes") + F.col("extra")))
