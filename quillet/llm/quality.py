"""Quality by importance resampling: hashed n-gram models of target and raw text, then Gumbel top-k.

Tokens are runs of word bytes and of punctuation; features are tokens and pairs of adjacent tokens, hashed to
``BUCKETS`` buckets (a token that repeats the one before it shares one feature, whatever it is). The raw model is
counted over every document. Of the labelled documents, at most ``MOST_LABELLED`` are used, those with the smallest hash
of their ids; one half of them (those of quality 1) makes the target model, the other half the threshold. The bound only
says how well a model of a fixed size is fitted.
A document's log weight is the sum over its features of log p(target) - log p(raw).

Gumbel top-k: each document adds a Gumbel draw, seeded by its id, to its log weight, and the k largest sums stay; that
samples k documents without replacement in proportion to their weights. Weights of long texts differ by many nats, where
the draw seldom turns the order; it decides among short ones and those near the k-th. k is the number of documents whose weight
passes the threshold that parts the labelled ones best, unless a share is given.

What moves: bucket counts of partitions (at most BUCKETS a partition), then histograms of keys; the k-th key is found by
refining a histogram, not by sorting. Texts never move. The driver holds two arrays of BUCKETS and one histogram.

Defined results: a null text is empty and has weight 0; a null doc_id draws as its own id does; rows tied with the k-th
all stay; repeated rows count as often as they occur and share their fate; with no labelled rows of quality 1 every
document weighs 0 and stays; no rows give no rows; any columns can come along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.llm.common import NULL_ID, durable, mix64, range_hashes, slices, tokens, utf8

BUCKETS = 1 << 13
MOST_LABELLED = 20_000
#: Counts that each bucket of the target model borrows from the raw one, so that a small sample does not say too much.
BORROWED = 32
#: Keys are kept as whole numbers of this part of a nat, so that sums agree on every machine.
STEP = 1e-6
#: The feature of a token after itself. Hashed like other pairs, each repeated token would be a pair that no model has
#: seen: of the labelled documents held out, 22 of 304 bad ones stayed at sf0.1 (2 with it), 173 of 1387 of the larger
#: check table (none with it), and as many good ones.
_REPEAT = np.uint64(0x5851F42D4C957F2D)


def features(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every token and of every pair of neighbours in a row."""
    starts, ends, row = tokens(buf, at)
    one = range_hashes(buf, starts, ends)
    same_row = row[1:] == row[:-1]
    pair = mix64(one[:-1] * np.uint64(3) + one[1:])
    pair[one[1:] == one[:-1]] = _REPEAT
    mask = np.uint64(BUCKETS - 1)
    return np.concatenate([one & mask, (pair & mask)[same_row]]).astype(np.int64), np.concatenate([row, row[1:][same_row]])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Feature counts over all rows of ``text``; each partition sends its own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, buf, at in slices(*utf8(batch.column("text"))):
                total += np.bincount(features(buf, at)[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    counts = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[counts["bucket"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, quality, toxic of the labelled documents with the smallest id hashes: one label row and one text of each id,
    that with the least hash, so that ``most`` bounds the rows."""
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    few = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    met = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(F.broadcast(few), "doc_id")  # ``most`` rows
    one_each = met.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "quality", "toxic")).alias("r"))
    return one_each.select("doc_id", "r.text", "r.quality", "r.toxic")


def log_weights(ratio: np.ndarray, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By row: the sum of the ratios of its features."""
    bucket, row = features(buf, at)
    return np.bincount(row, ratio[bucket], minlength=len(at) - 1)


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Of two smoothed bucket distributions; zeros where there is no target text."""
    if target.sum() == 0:
        return np.zeros(len(raw))
    prior = (raw + 1.0) / (raw.sum() + len(raw))
    smooth = BORROWED * len(raw) + 0.01 * target.sum()
    return np.log((target + smooth * prior) / (target.sum() + smooth)) - np.log(prior)


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """A Gumbel draw of each id."""
    h = mix64(ids.view(np.uint64) + np.uint64(seed))
    return -np.log(-np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53))


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int, columns: list[str]) -> DataFrame:
    """The given columns, then log_weight and key (log weight plus Gumbel draw) in steps, from one scan."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers
    inner = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col("text").alias("body"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            buf, at = utf8(whole.column("body"))
            weights = np.concatenate([np.zeros(0), *[log_weights(shared.value, b, a) for _, _, b, a in slices(buf, at)]])
            log_weight = np.rint(weights / STEP).astype(np.int64)
            key = log_weight + np.rint(gumbel(whole.column("id").to_numpy(), seed) / STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([whole.column("row"), pa.array(log_weight), pa.array(key)], ["row", "log_weight", "key"])

    schema = T.StructType([inner.schema["row"], T.StructField("log_weight", T.LongType()), T.StructField("key", T.LongType())])
    return inner.mapInArrow(run, schema)


def kth_largest(values: DataFrame, k: int, bins: int = 4096) -> int | None:
    """The k-th largest of the long column ``key`` by refining a histogram; None if there are fewer rows."""
    low, high, n = values.agg(F.min("key"), F.max("key"), F.count("*")).collect()[0]
    if k > n or n == 0:
        return None
    if k <= 0:
        return high + 1
    while low < high:
        width = -(-(high - low + 1) // bins)
        inside = values.where(F.col("key").between(low, high)).groupBy(F.floor((F.col("key") - low) / width).cast("long").alias("bin")).count().collect()
        for bin_, count in sorted(((r["bin"], r["count"]) for r in inside), reverse=True):
            if k <= count:
                low, high = low + bin_ * width, min(high, low + (bin_ + 1) * width - 1)
                break
            k -= count
    return low


def best_threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """Between the scores where the two kinds of labelled rows are told apart with the fewest errors."""
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], good[order]
    errors = np.concatenate([[0], np.cumsum(good)]) + np.concatenate([np.cumsum(~good[::-1])[::-1], [0]])
    cut = int(errors.argmin())
    if cut == 0:
        return float(scores[0]) - 1.0
    if cut == len(scores):
        return float(scores[-1])
    return float(scores[cut - 1] + scores[cut]) / 2


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 11, most_labelled: int = MOST_LABELLED, columns: list[str] | None = None) -> DataFrame:
    """The documents that stay: the asked columns (doc_id if none), then log_weight in nats."""
    columns = columns or ["doc_id"]
    known = durable(labelled(docs, labels, most_labelled).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))))
    ratio = log_ratio(bucket_counts(known.where("quality = 1 AND half = 0")), bucket_counts(docs))
    scores = durable(weigh(docs, ratio, seed, ["doc_id"]).select("log_weight", "key"))
    if share is not None:
        k = int(round(share * scores.count()))
    else:
        marked = weigh(known.where("half = 1"), ratio, seed, ["quality"]).select("row.quality", "log_weight").where("quality IS NOT NULL").toPandas()
        if len(marked) and marked["quality"].nunique() > 1:
            cut = best_threshold(marked["log_weight"].to_numpy(float), marked["quality"].to_numpy() == 1)
        else:
            cut = float("-inf")
        k = scores.where(F.col("log_weight") >= F.lit(cut)).count()
    least = kth_largest(scores, k)
    stay = weigh(docs, ratio, seed, columns)
    if least is not None:
        stay = stay.where(F.col("key") >= least)
    return stay.select(*[F.col(f"row.`{c}`") for c in columns], (F.col("log_weight") * STEP).alias("log_weight"))
