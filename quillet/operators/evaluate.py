"""Scoring against ground truth (E14, F15, B9) and the redaction loop."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.operators.components import cut_lineage


def match(text):
    """Lower-case letters and digits, as answers are compared."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def score_fields(truth: DataFrame, found: DataFrame, names: tuple[str, ...] = ("type", "origin", "destination", "date", "carrier", "seat")) -> DataFrame:
    """Ticket, field, ok for every field that the truth has; a carrier is right if either holds the other."""
    both = truth.select("ticket", F.col("fields").alias("t")).join(found.select("ticket", F.col("fields").alias("f")), "ticket", "left")
    rows = both.select("ticket", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(f"t.{n}", F.lit("")).alias("want"), F.coalesce(f"f.{n}", F.lit("")).alias("got")) for n in names])))
    a, b = match(F.col("want")), match(F.col("got"))
    near = (F.col("field") == "carrier") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    return rows.where("want <> ''").select("ticket", "field", ((a == b) | near).alias("ok"))


def leaks(secrets: DataFrame, words: DataFrame) -> DataFrame:
    """ticket, leaks: secrets (ticket, secret) that can still be read in a word of the final image (ticket, text), boxes
    removed or not. A secret counts once, however often it stands; no ticket's words are gathered."""
    plain = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    hidden = secrets.select("ticket", plain("secret").alias("secret")).where("secret <> ''").groupBy("ticket", "secret").agg(F.count("*").alias("n"))
    said = words.select("ticket", plain("text").alias("said")).where("said <> ''").distinct()
    met = hidden.join(said, "ticket").where(F.contains("said", "secret")).groupBy("ticket", "secret").agg(F.first("n").alias("n"))
    return met.groupBy("ticket").agg(F.sum("n").alias("leaks"))


def upper_medians(rows: DataFrame, group: str, value: str, bins: int = 4096, rounds: int = 3) -> DataFrame:
    """group, median: the value at place n // 2 of each group's sorted values, exactly; nulls do not count.

    Each round counts a group's values in ``bins`` equal bins and keeps the one that holds the place, so no group is
    gathered or sorted whole: what is left after the last round is a share of bins^-rounds of the range, with its ties
    counted.
    """
    values = cut_lineage(rows.select(group, F.col(value).cast("double").alias("v")).where("v IS NOT NULL"))  # read once, then as two columns
    ends = values.groupBy(group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.floor(F.count("*") / 2).alias("place"))
    same = lambda other: F.col(f"a.{group}").eqNullSafe(F.col(f"{other}.{group}"))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)

    def inside(ends: DataFrame) -> DataFrame:
        met = values.alias("a").join(ends.alias("e"), same("e") & F.col("v").between(F.col("lo"), F.col("hi")))
        return met.select(F.col(f"a.{group}").alias(group), "v", "lo", "hi", "place")

    for _ in range(rounds):
        per = inside(ends).groupBy(group, "place", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("n").over(Window.partitionBy(group).orderBy("bin")) - F.col("n")
        hit = per.withColumn("before", before).where("before <= place AND place < before + n")
        ends = hit.select(group, "lo", "hi", (F.col("place") - F.col("before")).alias("place"))
    per = inside(ends).groupBy(group, "place", "v").agg(F.count("*").alias("n"))
    run = F.sum("n").over(Window.partitionBy(group).orderBy("v"))
    return per.withColumn("run", run).where("run > place").groupBy(group).agg(F.min("v").alias("median"))


def summary(results: DataFrame, group: str) -> DataFrame:
    """n, iou_90 (share of 0.9 or more), mean_iou, median_ms (upper), max_ms, clean (no leak)."""
    sums = results.groupBy(group).agg(
        F.count("*").alias("n"), F.avg((F.col("iou") >= 0.9).cast("int")).alias("iou_90"), F.avg("iou").alias("mean_iou"),
        F.max("ms").alias("max_ms"), F.count_if(F.col("leaks") == 0).alias("clean"),
    )
    middle = upper_medians(results, group, "ms").withColumnRenamed(group, "of")
    both = sums.join(middle, sums[group].eqNullSafe(middle["of"]), "left")
    return both.select(group, "n", "iou_90", "mean_iou", F.col("median").alias("median_ms"), "max_ms", "clean")


def score_quads(quads: DataFrame, n: int = 160) -> DataFrame:
    """Id, iou of (id, found, truth), convex quads: shares of a grid of n x n points of their common bounds.

    A column of the grid meets a quad in one run of points, between the highest and the lowest of its edges. The edges are
    lines in units of the grid, worked out once a pair; n rows a pair take their ends from those, in compiled code, and are
    summed where they are made.
    """
    sides, corners = {"f": "found", "t": "truth"}, range(4)
    flat = quads.select("id", *[F.get(q, k)[c].alias(f"{s}{c}{k}") for s, q in sides.items() for k in corners for c in "xy"])
    at = lambda s, c, k: F.col(f"{s}{c}{k % 4}")
    flat = flat.withColumns({f"{c}{e}": f(*[f"{s}{c}{k}" for s in sides for k in corners]) for c in "xy" for e, f in ((0, F.least), (1, F.greatest))})
    unit = n / (F.col("y1") - F.col("y0"))
    lines = {}
    for s in sides:
        around = sum((at(s, "x", k) * at(s, "y", k + 1) - at(s, "x", k + 1) * at(s, "y", k) for k in corners), F.lit(0.0))
        for k in corners:
            dx, dy = at(s, "x", k + 1) - at(s, "x", k), at(s, "y", k + 1) - at(s, "y", k)
            ahead = F.when(around < 0, -dx).otherwise(dx)
            slope = dy / F.nullif(dx, F.lit(0.0)) * unit
            base = (at(s, "y", k) - F.col("y0")) * unit - 0.5 - slope * at(s, "x", k)
            for end, here in (("lo", ahead > 0), ("hi", ahead < 0)):
                lines |= {f"{s}{end}m{k}": F.when(here, slope), f"{s}{end}c{k}": F.when(here, base)}
        lines |= {f"{s}left": F.least(*[at(s, "x", k) for k in corners]), f"{s}right": F.greatest(*[at(s, "x", k) for k in corners])}
    edges = flat.select("id", "x0", "x1", *[c.alias(name) for name, c in lines.items()])
    x = F.col("x0") + (F.col("k") + 0.5) / n * (F.col("x1") - F.col("x0"))
    grid = edges.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("gx", x)

    def bound(s: str, end: str):
        each = [F.col(f"{s}{end}m{k}") * F.col("gx") + F.col(f"{s}{end}c{k}") for k in corners]
        met = F.col("gx").between(F.col(f"{s}left"), F.col(f"{s}right"))
        return F.when(met, F.greatest(*each, F.lit(0.0))).otherwise(float(n)) if end == "lo" else F.when(met, F.least(*each, F.lit(n - 1.0))).otherwise(-1.0)

    ends = grid.select("id", *[bound(s, end).alias(f"{s}{end}") for s in sides for end in ("lo", "hi")])
    points = lambda lo, hi: F.greatest(F.lit(0), F.floor(hi + 1e-9) - F.ceil(lo - 1e-9) + 1)
    both = ends.select("id", points(F.greatest("flo", "tlo"), F.least("fhi", "thi")).alias("common"), (points(F.col("flo"), F.col("fhi")) + points(F.col("tlo"), F.col("thi"))).alias("each"))
    total = both.groupBy("id").agg(F.sum("common").alias("common"), F.sum("each").alias("each"))
    return total.select("id", F.when(F.col("each") > 0, F.col("common") / (F.col("each") - F.col("common"))).otherwise(0.0).alias("iou"))


def until_clean(state: DataFrame, check: Callable[[DataFrame], DataFrame], hide: Callable[[DataFrame, DataFrame, float], DataFrame], rounds: int = 4) -> tuple[DataFrame, int]:
    """Checks and hides until nothing leaks, at most ``rounds`` times, growing boxes by a quarter more each round."""
    for k in range(rounds):
        open_ = check(state)
        if open_.isEmpty():
            return state, k
        state = cut_lineage(hide(state, open_, 0.25 * (k + 1)))  # else each check would run all rounds before it again
    return state, rounds
