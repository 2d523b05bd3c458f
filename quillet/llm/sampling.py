"""Consistent weighted sampling fingerprints. DataFrame functions only.

Terms are a text's words (runs of bytes other than 0x20 and 0x09-0x0D), weighted by how often they occur. For each of
``SAMPLES`` samples a term k of weight S draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its own hash and gets
``t = floor(ln S / r + b)`` and ``ln a = ln c - r (t + 1 - b)``; the sample is the (k, t) with the least ``ln a``.
Two texts agree in a sample with a probability of their generalised Jaccard similarity: sum of least weights over sum
of greatest. The fingerprint is 16 bits of each sample, in hex; likeness is the share of equal samples.

Term weights come from the sorted hashes of a row's own words, so no (document, word) rows are shuffled. The samples
are aggregates over the rows of a document, in whole-stage code; the texts move once, by doc_id.

Defined results: a null text is empty; an empty text has the fingerprint of zeros and likeness 1 to another empty text;
equal texts have equal fingerprints. Rows that repeat a doc_id follow one another by text hash, equal rows last of their
like included, and each has its result row; a null doc_id is the smallest id and shown as null; a lone document is its
own next one; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import NULL_ID, durable, unkeyed

SAMPLES, GROUP = 64, 8
#: Quantiles of a draw's distribution that a hash picks from; of the last ``OUTER``, more bits pick anew, level by level.
BINS, OUTER, LEVELS = 512, 8, 4
#: Hash seeds of the samples start here; another value gives other samples.
SEED = 7919


def word_hashes(text: Column) -> Column:
    """Sorted hashes of a text's words, repeats included."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def gamma_quantiles(p: np.ndarray) -> np.ndarray:
    """Of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)."""
    low, high = np.zeros(len(p)), np.full(len(p), 60.0)
    for _ in range(70):
        mid = (low + high) / 2
        below = -np.expm1(-mid) - mid * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def _constant(values: np.ndarray) -> Column:
    """An array constant, folded before the plan runs."""
    return F.split(F.lit(",".join(f"{x:.6g}" for x in values)), ",").cast("array<double>")


def tails() -> np.ndarray:
    """By level and bin, the share of the distribution that lies beyond: ``LEVELS`` times ``BINS``, each level the outer end of the one before."""
    inside = 1 - (np.arange(BINS) + 0.5) / BINS
    return np.concatenate([inside * (OUTER / BINS) ** k for k in range(LEVELS)])


def _place(bits: list[Column]) -> Column:
    """The place in ``tails()`` that the bins of each level say."""
    place = F.lit(BINS * (LEVELS - 1)) + bits[-1]
    for k in reversed(range(LEVELS - 1)):
        place = F.when(bits[k] < BINS - OUTER, F.lit(BINS * k) + bits[k]).otherwise(place)
    return place


def sample(h: Column, log_s: Column) -> Column:
    """One value to take the minimum of: ln a in the high bits, a mark of (k, t) in the low 16.

    h holds the draws: 9 bits pick r and 9 pick c, as quantiles; 28 bits are b. The minima of long texts come from large r
    and small c, so those ends are picked anew by bits of a second hash, down to shares of 4e-9.
    """
    beyond = tails()
    part = lambda x, shift: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(BINS - 1)).cast("int")
    more = F.xxhash64(h)
    r = F.get(_constant(gamma_quantiles(1 - beyond)), _place([part(h, 0), *[part(more, 9 * k) for k in range(LEVELS - 1)]]))
    log_c = F.get(_constant(np.log(gamma_quantiles(beyond))), _place([BINS - 1 - part(h, 9), *[part(more, 9 * k + 27) for k in range(LEVELS - 1)]]))
    b = F.shiftrightunsigned(h, 36) * F.lit(2.0**-28)
    t = F.floor(log_s / r + b)
    log_a = log_c - r * (t + F.lit(1.0) - b)
    mark = h.bitwiseXOR(F.shiftrightunsigned(h, 29)).bitwiseXOR(t * F.lit(40503)).bitwiseAND(F.lit(0xFFFF))
    return F.shiftleft(F.floor(log_a * F.lit(2.0**32)), 16).bitwiseOR(mark)


def signatures(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, fingerprint: SAMPLES x 16 bits, binary; one row per distinct keys. Texts without words give zeros."""
    sorted_words = texts.select(*keys, word_hashes(F.coalesce(F.col(text), F.lit(""))).alias("hashes"))
    # A run of equal hashes starts where the value changes. The starts are a column: inside a lambda they would be made anew.
    hashes = F.col("hashes")
    starts = F.filter(F.sequence(F.lit(1), F.size(hashes)), lambda i: (i == 1) | (F.get(hashes, i - 1) != F.get(hashes, i - 2)))
    begun = sorted_words.select(*keys, "hashes", F.when(F.size(hashes) > 0, starts).alias("starts"))
    run = lambda i, j: F.struct(F.get(hashes, i - 1).alias("k"), (F.coalesce(F.get("starts", j + 1), F.size(hashes) + 1) - i).alias("s"))
    runs = begun.select(*keys, F.transform("starts", run).alias("runs"))
    # Samples come in groups of GROUP, a row per term and group: the code of one row stays small enough to be compiled.
    grouped = runs.select(*keys, "runs", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // GROUP - 1))).alias("group"))
    terms = grouped.select(*keys, "group", F.explode_outer("runs").alias("term"))
    seed = F.col("group") * GROUP + SEED
    drawn = terms.select(
        *keys, "group", F.log(F.col("term.s").cast("double")).alias("log_s"),
        *[F.when(F.col("term").isNotNull(), F.xxhash64("term.k", seed + i)).alias(f"h{i}") for i in range(GROUP)],
    )
    best = drawn.groupBy(*keys, "group").agg(*[F.min(sample(F.col(f"h{i}"), F.col("log_s"))).alias(f"m{i}") for i in range(GROUP)])
    marks = F.transform(F.array(*[f"m{i}" for i in range(GROUP)]), lambda m: F.lpad(F.hex(F.coalesce(m, F.lit(0)).bitwiseAND(F.lit(0xFFFF))), 4, "0"))
    parts = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("group", F.array_join(marks, "").alias("marks")))).alias("parts"))
    return parts.select(*keys, F.unhex(F.array_join(F.col("parts.marks"), "")).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two fingerprints, 0 to 1."""
    places = F.sequence(F.lit(0), F.lit(SAMPLES - 1))
    same = F.filter(places, lambda i: F.substring(a, 2 * i + 1, F.lit(2)) == F.substring(b, 2 * i + 1, F.lit(2)))
    return F.size(same) / F.lit(float(SAMPLES))


def neighbours(keys: DataFrame, parts: int) -> DataFrame:
    """id, th, n_chars, next_id, next_th of (id, th, n_chars) in ascending order, after the last the first.

    Keys alone move, in ranges; a range hands its first key on through a table of one row per range. The ranges are
    checkpointed, since a second sampling of them could cut elsewhere.
    """
    key = F.struct("id", "th")
    ranged = durable(keys.repartitionByRange(parts, "id", "th").withColumn("part", F.spark_partition_id()))
    inside = ranged.withColumn("next", F.lead(key).over(Window.partitionBy("part").orderBy("id", "th")))
    firsts = ranged.groupBy("part").agg(F.min(key).alias("first"))
    turn = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("following"), F.min("first").over(Window.partitionBy(F.lit(0))).alias("very_first"))
    met = inside.join(turn, "part").withColumn("next", F.coalesce("next", "following", "very_first"))
    return met.select(*keys.columns, F.col("next.id").alias("next_id"), F.col("next.th").alias("next_th"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """id, th, times, next_id, next_th, n_chars, text, edited: the last quarter of the code points gives way to the next
    document's first ones.

    A text of an id is one row, and ``times`` says for how many input rows it stands: of m equal rows m - 1 are followed
    by their like, and the last by the next text.
    """
    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = whole.repartition("id", "th").groupBy("id", "th").agg(F.first("text").alias("text"))
    sizes = durable(whole.groupBy("id", "th").agg(F.first(F.char_length("text")).alias("n_chars"), F.count("*").alias("copies")))
    order = neighbours(sizes, parts)
    one = lambda next_id, next_th, times: F.struct(F.col(next_id).alias("next_id"), F.col(next_th).alias("next_th"), times.alias("times"))
    follow = F.array(one("next_id", "next_th", F.lit(1).cast("long")), one("id", "th", F.col("copies") - 1))
    pairs = order.select("id", "th", "n_chars", F.inline(F.filter(follow, lambda f: f["times"] > 0)))
    wanted = pairs.select(F.col("next_id").alias("id"), F.col("next_th").alias("th"), F.col("id").alias("to_id"), F.col("th").alias("to_th"), "times", "n_chars", F.floor(F.col("n_chars") / 4).cast("int").alias("quarter"))
    heads = placed.join(wanted, ["id", "th"]).select(
        F.col("to_id").alias("id"), F.col("to_th").alias("th"), F.col("id").alias("next_id"), F.col("th").alias("next_th"), "times", "n_chars", "quarter", F.expr("substring(text, 1, quarter)").alias("head")
    )
    return placed.join(heads, ["id", "th"]).select(
        "id", "th", "times", "next_id", "next_th", "n_chars", "text", F.concat(F.expr("substring(text, 1, n_chars - quarter)"), "head").alias("edited")
    )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    both = edited_texts(docs)
    key = ["id", "th", "times", "next_id", "next_th", "n_chars", "edited_sha256"]
    side = lambda number, text: F.struct(F.lit(number).alias("side"), F.col(text).alias("body"))
    sides = both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select(*key, F.inline(F.array(side(0, "text"), side(1, "edited"))))
    signed = signatures(sides, [*key, "side"], "body")
    pick = lambda number: F.max(F.when(F.col("side") == number, F.col("fingerprint")))
    rows = durable(signed.groupBy(*key).agg(pick(0).alias("fingerprint"), pick(1).alias("edited_fingerprint")))
    following = rows.groupBy(F.col("id").alias("next_id"), F.col("th").alias("next_th")).agg(F.first("fingerprint").alias("next_fingerprint"))
    # The hex columns come last: inside a lambda a name can mean an alias of the same select.
    near = rows.join(following, ["next_id", "next_th"]).select(
        "*", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next")
    )
    shown = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    every = near.select(F.col("id").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", *shown, "near_edited", "near_next", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return unkeyed(every.drop("col"))
