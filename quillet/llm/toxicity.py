"""Toxicity by cumulative-link ordinal regression over sparse text features.

The model is P(severity > k | x) = sigmoid(w . x - threshold_k): one weight vector for all grades, ordered thresholds.
x holds log(1 + count) of indicator words: all words that occur much more often in labelled documents above some grade than
in those up to it, by a z-score of document frequencies. Expected severity is the sum of P(severity > k) over k.

The fit uses at most ``MOST_LABELLED`` labelled documents, those with the smallest hash of their ids, one row of each id and
groups of copies once;
the driver holds their indicator counts only, as (document, word, value). Every document is scored in one scan without a
shuffle.

Labels say a ``grade`` of 0 or more, if they have such a column; ``graded`` makes three of toxic and quality. Else they say
toxic or not: those are two grades, and expected severity is the probability of the upper one.

Defined results: a null or empty text has no indicator and scores like any text without one; labelled rows with a null
label are not used; with labels of one kind only every document has severity 0; rows with a null doc_id and repeated
rows are scored like others, a row each; equal likelihoods of grades give the lower one; no rows give no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import KIND, LOWER, durable, mix64, range_hashes, slices, tokens, utf8
from quillet.llm.quality import labelled

MOST_LABELLED = 20_000
#: An indicator word occurs in so many documents above a grade at least, and is so uneven.
LEAST_DOCS, LEAST_Z = 4, 5.0


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, lower-cased in A-Z."""
    starts, ends, row = tokens(buf, at)
    real = KIND[buf[starts]] == 1 if len(starts) else np.zeros(0, bool)
    return range_hashes(LOWER[buf], starts[real], ends[real]), row[real]


@dataclass(frozen=True)
class Ordinal:
    """Word hashes (sorted) with their weights, and the ordered thresholds."""

    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, scores: np.ndarray) -> np.ndarray:
        """Rows x thresholds: P(severity > k)."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -500, 500)))


def indicator_counts(hashes: np.ndarray, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, indicator, log(1 + count)) of the indicators that a row has."""
    if len(hashes) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    h, row = words(buf, at)
    place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    hit = hashes[place] == h
    key, count = np.unique(row[hit] * len(hashes) + place[hit], return_counts=True)
    return key // len(hashes), key % len(hashes), np.log1p(count)


def weigh_rows(model: Ordinal, column: pa.Array) -> np.ndarray:
    """w . x by row."""
    out = [np.zeros(0)]
    for _, _, buf, at in slices(*utf8(column)):
        row, word, x = indicator_counts(model.hashes, buf, at)
        out.append(np.bincount(row, x * model.weights[word], minlength=len(at) - 1))
    return np.concatenate(out)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade of labels (doc_id, toxic, quality): 0 clean, 1 toxic, 2 toxic and of quality 0."""
    return labels.select("doc_id", F.when(F.col("toxic") == 0, 0).when(F.col("toxic") > 0, F.when(F.col("quality") == 0, 2).otherwise(1)).alias("grade"))


def pair_sets(column: pa.Array) -> list[np.ndarray]:
    """Of each text the sorted hashes of its pairs of words; of one word its own."""
    out = []
    for _, _, buf, at in slices(*utf8(column)):
        h, row = words(buf, at)
        first = np.searchsorted(row, np.arange(len(at)))
        pair = mix64(h * np.uint64(3) + np.concatenate([h[1:], h[-1:]]))
        out += [np.unique(pair[a : max(a + 1, b - 1)]) if b > a else pair[:0] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


#: Orders of word pairs in which copies are looked for, and the share of pairs that copies have in common.
ORDERS, ALIKE = 4, 0.5


def unlike(sample: DataFrame) -> DataFrame:
    """text, grade of one document from each group of copies, near ones included: the words of one text that was copied
    often must not pass for signs of what its copies are labelled. In each of ``ORDERS`` orders, documents with one least
    word pair are held against the first of them, and those that share ``ALIKE`` of all their pairs with it go; documents
    that have a passage in common only stay."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pair_sets(batch.column("text"))
            keys = [[int(mix64(s ^ np.uint64(k * 0x51ED270B)).min().astype(np.int64)) if len(s) else 0 for s in sets] for k in range(ORDERS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in keys)], [*batch.schema.names, *(f"k{k}" for k in range(ORDERS))])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, first = pair_sets(batch.column("text")), pair_sets(batch.column("other"))
            shared = [len(np.intersect1d(a, b, True)) for a, b in zip(mine, first, strict=True)]
            other = [x < ALIKE * (len(a) + len(b) - x) for x, a, b in zip(shared, mine, first, strict=True)]
            yield batch.filter(pa.array(other, pa.bool_()))

    keys = [f"k{k}" for k in range(ORDERS)]
    kind = "doc_id long, text string, grade int, " + ", ".join(f"{k} long" for k in keys)
    marked = durable(sample.mapInArrow(least, kind))
    for key in keys:
        firsts = marked.groupBy(key).agg(F.min(F.struct(F.xxhash64("doc_id"), "doc_id", "text")).alias("r"), F.count("*").alias("n"))
        met = marked.join(firsts.select(key, F.col("r.doc_id").alias("first"), F.col("r.text").alias("other"), "n"), key)
        alone = (F.col("n") == 1) | (F.col("doc_id") == F.col("first"))
        names = ["doc_id", "text", "grade", *keys]
        apart = met.where(~alone).select(*names, "other").mapInArrow(check, kind + ", other string")
        marked = durable(met.where(alone).select(*names).unionByName(apart.select(*names)))
    return marked.select("text", "grade")


def find_indicators(sample: DataFrame) -> np.ndarray:
    """Hashes of the words that occur much more often above some grade of the sample (text, grade) than up to it, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grade = batch.column("grade").to_numpy(zero_copy_only=False)
            for first, _, buf, at in slices(*utf8(batch.column("text"))):
                h, row = words(buf, at)
                seen = np.unique(np.stack([row.astype(np.uint64), h]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
                of = grade[first + seen[0].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(seen[1].view(np.int64)), pa.array(of.astype(np.int64))], ["word", "grade"])

    sizes = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    n, top = sum(sizes.values()), max(sizes, default=0)
    said = sample.select("text", "grade").mapInArrow(run, "word long, grade long")
    per = said.groupBy("word").agg(F.count("*").alias("d"), *[F.count_if(F.col("grade") > k).alias(f"d{k}") for k in range(top)])
    uneven = F.lit(False)
    for k in range(top):
        n1 = sum(m for g, m in sizes.items() if g > k)
        if 0 < n1 < n:
            p1, p0, p = F.col(f"d{k}") / n1, (F.col("d") - F.col(f"d{k}")) / (n - n1), F.col("d") / n
            z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / (n - n1)) + 1e-12)
            uneven = uneven | ((F.col(f"d{k}") >= LEAST_DOCS) & (z >= LEAST_Z))
    found = per.where(uneven).select("word").toPandas()["word"]  # of a bounded sample
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


@dataclass(frozen=True)
class Sparse:
    """The entries (row, column, value) of a matrix."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    rows: int
    columns: int

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], minlength=self.rows)

    def back(self, slope: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * slope[self.row], minlength=self.columns)


def fit_ordinal(x: Sparse, grade: np.ndarray, steps: int = 600, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by maximum likelihood (Adam, all rows a step); thresholds are a start plus positive gaps."""
    top, m = int(grade.max()) if len(grade) else 0, x.columns
    if top == 0:
        return np.zeros(m), np.full(1, 50.0)
    theta = np.zeros(m + top)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    theta[m] = 2.0
    rows = np.arange(len(grade))
    for step in range(1, steps + 1):
        w, gaps = theta[:m], theta[m:]
        limits = np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))
        over = 1 / (1 + np.exp(-np.clip(x.times(w)[:, None] - limits[None, :], -50, 50)))
        padded = np.concatenate([np.ones((len(rows), 1)), over, np.zeros((len(rows), 1))], 1)
        high, low = padded[rows, grade], padded[rows, grade + 1]
        p = np.maximum(high - low, 1e-12)
        # d log p / d score: of a sigmoid s it is s (1 - s)
        up, down = high * (1 - high) / p, low * (1 - low) / p
        slope = up - down
        g_limits = np.bincount(np.maximum(grade - 1, 0), np.where(grade > 0, -up, 0.0), minlength=top) + np.bincount(np.minimum(grade, top - 1), np.where(grade < top, down, 0.0), minlength=top)
        tail = np.cumsum(g_limits[::-1])[::-1]
        g_gaps = np.concatenate([tail[:1], tail[1:] * np.exp(gaps[1:])])
        grad = -np.concatenate([x.back(slope), g_gaps]) / len(rows)
        grad[:m] += decay * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gaps = theta[m:]
    return theta[:m], np.cumsum(np.concatenate([gaps[:1], np.exp(gaps[1:])]))


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Ordinal:
    """A model of docs (doc_id, text) with labels (doc_id, toxic, or grade)."""
    grade = F.col("grade" if "grade" in labels.columns else "toxic").cast("int")
    known = labelled(docs, labels.select("doc_id", F.lit(None).cast("int").alias("quality"), grade.alias("toxic")), most_labelled)
    sample = unlike(known.where("toxic IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").alias("grade")))
    hashes = find_indicators(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, at in slices(*utf8(batch.column("text"))):
                row, word, x = indicator_counts(hashes, buf, at)
                edges = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(v)) for v in (word, x)]
                yield pa.RecordBatch.from_arrays([batch.column("grade").slice(first, end - first), *lists], ["grade", "word", "x"])

    # In an order of its own, so that the sums of the fit do not depend on how the rows were dealt.
    rows = sorted(((int(g), tuple(w), tuple(x)) for g, w, x in sample.mapInArrow(run, "grade int, word array<long>, x array<double>").toPandas().itertuples(index=False)))
    sizes = [len(w) for _, w, _ in rows]
    flat = lambda k, kind: np.array([v for r in rows for v in r[k]], kind)
    x = Sparse(np.repeat(np.arange(len(rows)), sizes), flat(1, np.int64), flat(2, float), len(rows), len(hashes))
    weights, thresholds = fit_ordinal(x, np.array([g for g, _, _ in rows], np.int64))
    return Ordinal(hashes, weights, thresholds)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, expected_severity, severity (the median grade), toxic (severity above 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over = model.exceed(weigh_rows(model, batch.column("text")))
            grade = (over > 0.5).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(over.sum(1), 6)), pa.array(grade.astype(np.int32)), pa.array(grade > 0)], ["doc_id", "expected_severity", "severity", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_severity double, severity int, toxic boolean")
