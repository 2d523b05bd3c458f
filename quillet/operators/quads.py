"""Quads from outlines (M2) and their sides moved onto edges (M3).

A hull is an array fold over points sorted by place; a side's samples are rows, and those of all quads meet the edge pixels
in one equi-join, so that no image is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.scalar import let
from quillet.operators.boxes import distance

POINT = "struct<x:double,y:double>"
# Tolerances of the simplification as shares of the outline's length; half widths of the two bands.
TOLERANCES, BANDS = (0.015, 0.025, 0.035, 0.05, 0.07), (14, 6)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def outline_points(runs: DataFrame, group: str, *keys: str) -> DataFrame:
    """group, keys, points: the ends of a component's runs (group, keys, y, x0, x1), which hold its hull; two a line."""
    lines = runs.groupBy(group, *keys, "y").agg(F.min("x0").alias("a"), F.max("x1").alias("b"))
    ends = F.array_distinct(F.array(point(F.col("a"), F.col("y")), point(F.col("b"), F.col("y"))))
    return lines.groupBy(group, *keys).agg(F.array_sort(F.flatten(F.collect_list(ends))).alias("points"))


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def convex_hull(points: Column) -> Column:
    """The corners around an array of points, from the first by (x, y), clockwise as seen with y downwards; points between
    corners are left out. Fewer than three corners are all there is of a line."""
    none = F.array().cast(f"array<{POINT}>")

    def chain(ordered: Column) -> Column:
        """One side: each point drops the corners that it turns back from; those are the last of the chain."""

        def step(kept: Column, p: Column) -> Column:
            last = F.sequence(F.lit(1), F.size(kept) - 1)
            turns = F.filter(last, lambda k: _cross(F.get(kept, k - 1), F.get(kept, k), p) > 0)
            return F.when(F.size(kept) < 2, F.concat(kept, F.array(p))).otherwise(F.concat(F.slice(kept, 1, F.size(turns) + 1), F.array(p)))

        return F.aggregate(ordered, none, step)

    def both(ordered: Column) -> Column:
        sides = F.struct(chain(ordered).alias("a"), chain(F.reverse(ordered)).alias("b"))
        ends = lambda c: F.slice(c, 1, F.size(c) - 1)
        return F.when(F.size(ordered) < 3, ordered).otherwise(let(sides, lambda s: F.concat(ends(s["a"]), ends(s["b"]))))

    return let(F.array_sort(F.array_distinct(points)), both)


def perimeter(q: Column) -> Column:
    steps = F.transform(q, lambda p, i: distance(p, F.get(q, (i + 1) % F.size(q))))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def simplified(hull: Column, tolerance: Column, rounds: int = 3) -> Column:
    """The hull's corners that stay: the two that are farthest apart from the first one on, then in each round, between
    neighbours that stay, the one farthest from their line, if it is farther than the tolerance. Three rounds tell whether
    four corners, or more, or fewer, are left."""
    n = F.size(hull)
    at = lambda k: F.get(hull, F.pmod(k, n).cast("int"))
    far = lambda k: F.array_max(F.transform(hull, lambda p, i: F.struct(distance(p, F.get(hull, k)).alias("d"), (-i).alias("i"))))["i"]

    def more(kept: Column) -> Column:
        def best(a: Column, t: Column) -> Column:
            b = F.when(t + 1 < F.size(kept), F.get(kept, t + 1)).otherwise(F.get(kept, 0) + n)
            off = lambda i: F.abs(_cross(at(a), at(b), at(i))) / F.greatest(distance(at(a), at(b)), F.lit(1e-9))
            between = F.when(b - a > 1, F.sequence(a + 1, b - 1)).otherwise(F.array().cast("array<int>"))
            return F.array_max(F.transform(between, lambda i: F.struct(off(i).alias("d"), F.pmod(i, n).cast("int").alias("i"))))

        found = F.filter(F.transform(kept, best), lambda s: s["d"] > tolerance)
        return F.array_sort(F.concat(kept, F.transform(found, lambda s: s["i"])))

    def ends(two: Column) -> Column:
        return F.array_sort(F.array_distinct(two))

    first = let((-far(F.lit(0))).cast("int"), lambda k: ends(F.array(k, (-far(k)).cast("int"))))
    kept = first
    for _ in range(rounds):
        kept = let(kept, more)
    return F.transform(kept, lambda k: F.get(hull, k))


def least_rectangle(hull: Column) -> Column:
    """The four corners of the rectangle of least area around a hull: one of its sides lies along one of the hull's."""

    def around(a: Column, i: Column) -> Column:
        b = F.get(hull, (i + 1) % F.size(hull))
        unit = F.struct(((b["x"] - a["x"]) / distance(a, b)).alias("x"), ((b["y"] - a["y"]) / distance(a, b)).alias("y"))

        def spans(u: Column) -> Column:
            along, across = F.transform(hull, lambda p: p["x"] * u["x"] + p["y"] * u["y"]), F.transform(hull, lambda p: p["y"] * u["x"] - p["x"] * u["y"])
            return F.struct(F.array_min(along).alias("a0"), F.array_max(along).alias("a1"), F.array_min(across).alias("c0"), F.array_max(across).alias("c1"), u.alias("u"), i.alias("i"))

        return let(unit, spans)

    ranked = F.array_min(F.transform(F.transform(hull, around), lambda s: F.struct(((s["a1"] - s["a0"]) * (s["c1"] - s["c0"])).alias("area"), s["i"].alias("i"), s.alias("s"))))["s"]
    corner = lambda s, a, c: point(s["u"]["x"] * a - s["u"]["y"] * c, s["u"]["y"] * a + s["u"]["x"] * c)
    return let(ranked, lambda s: F.array(corner(s, s["a0"], s["c0"]), corner(s, s["a1"], s["c0"]), corner(s, s["a1"], s["c1"]), corner(s, s["a0"], s["c1"])))


def quad_from_hull(hull: Column) -> Column:
    """M2: struct(quad, fallback): the first simplification that leaves four corners, with ever larger tolerances; once one
    leaves fewer, or none leaves four, the least rectangle. Null of what is no area."""

    def tried(state: Column) -> Column:
        each = [simplified(state["hull"], state["length"] * t) for t in TOLERANCES]
        return let(F.array(*each), chosen(state["hull"]))

    def chosen(hull: Column):
        def pick(all_: Column) -> Column:
            hit = F.array_min(F.filter(F.transform(all_, lambda q, i: F.when(F.size(q) <= 4, i)), lambda i: i.isNotNull()))
            four = F.get(all_, hit)
            good = F.coalesce(F.size(four) == 4, F.lit(False))
            return F.when(good, F.struct(four.alias("quad"), F.lit(False).alias("fallback"))).otherwise(F.struct(least_rectangle(hull).alias("quad"), F.lit(True).alias("fallback")))

        return pick

    state = F.struct(hull.alias("hull"), perimeter(hull).alias("length"))
    return F.when(F.size(hull) >= 3, let(state, tried))


def _snapped(quads: DataFrame, edges: DataFrame, group: str, key: str, band: int) -> DataFrame:
    """One pass: key, group, quad, support of (key, group, quad)."""
    a, b = F.get("quad", F.col("side")), F.get("quad", (F.col("side") + 1) % 4)
    size = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
    sides = quads.select(key, group, "quad", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("side")).withColumns({"a": a, "b": b, "len": F.when(size == 0, 1.0).otherwise(size)})
    sides = sides.withColumns({"ux": (F.col("b.x") - F.col("a.x")) / F.col("len"), "uy": (F.col("b.y") - F.col("a.y")) / F.col("len"), "steps": F.greatest(F.lit(10), F.floor(F.col("len") / 4 + 0.5))})
    t = F.col("s") / F.col("steps")
    samples = sides.withColumn("s", F.explode(F.sequence(F.lit(1).cast("long"), F.col("steps") - 1))).where((t >= 0.08) & (t <= 0.92))
    samples = samples.withColumns({"cx": F.col("a.x") + (F.col("b.x") - F.col("a.x")) * t, "cy": F.col("a.y") + (F.col("b.y") - F.col("a.y")) * t})
    # Places along the normal in the order of looking: 0, 1, -1, 2, -2, ...
    off = F.col("o")
    looked = samples.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2 * band)))).withColumn("o", F.when(F.col("k") % 2 == 1, (F.col("k") + 1) / 2).otherwise(-F.col("k") / 2))
    looked = looked.withColumns({"px": F.col("cx") - F.col("uy") * off, "py": F.col("cy") + F.col("ux") * off}).where("px > -1 AND py > -1")
    trunc = lambda c: F.when(F.col(c) < 0, F.lit(0)).otherwise(F.floor(c))
    looked = looked.where("px >= 0 AND py >= 0").withColumns({"x": trunc("px").cast("long"), "y": trunc("py").cast("long")})
    on = edges.select(group, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    hits = looked.join(on, [group, "x", "y"], "left_semi").groupBy(key, "side", "s").agg(F.min(F.struct("k", "o", "px", "py")).alias("at"))
    lines = hits.groupBy(key, "side").agg(
        F.count("*").alias("n"), F.count_if(F.abs("at.o") <= 2).alias("close"), F.avg("at.px").alias("mx"), F.avg("at.py").alias("my"),
        (F.atan2(2 * F.covar_pop("at.px", "at.py"), F.var_pop("at.px") - F.var_pop("at.py")) / 2).alias("angle"),
    )
    # F17 of six points or more, along the side; else the side itself.
    near = sides.join(samples.groupBy(key, "side").agg(F.count("*").alias("looked")), [key, "side"], "left").join(lines, [key, "side"], "left")
    fits = F.coalesce(F.col("n") >= 6, F.lit(False))
    same = F.signum(F.cos("angle") * F.col("ux") + F.sin("angle") * F.col("uy"))
    way = F.when(same < 0, -1.0).otherwise(1.0)
    fitted = near.select(
        key, group, "quad", "side", F.coalesce("looked", F.lit(0)).alias("looked"), F.coalesce("close", F.lit(0)).alias("close"),
        F.when(fits, F.col("mx")).otherwise(F.col("a.x")).alias("x"), F.when(fits, F.col("my")).otherwise(F.col("a.y")).alias("y"),
        F.when(fits, F.cos("angle") * way).otherwise(F.col("ux")).alias("ux"), F.when(fits, F.sin("angle") * way).otherwise(F.col("uy")).alias("uy"),
    )
    four = fitted.groupBy(key, group, "quad").agg(F.array_sort(F.collect_list(F.struct("side", "x", "y", "ux", "uy"))).alias("l"), F.sum("looked").alias("looked"), F.sum("close").alias("close"))

    def corner(q: Column, i: Column) -> Column:
        one, two = F.get("l", (i + 3) % 4), F.get("l", i)
        den = one["ux"] * two["uy"] - one["uy"] * two["ux"]
        step = ((two["x"] - one["x"]) * two["uy"] - (two["y"] - one["y"]) * two["ux"]) / den
        return F.when(F.abs(den) < 1e-6, q).otherwise(point(one["x"] + one["ux"] * step, one["y"] + one["uy"] * step))

    moved = four.withColumn("next", F.transform("quad", corner))
    far = F.array_max(F.zip_with("next", "quad", distance))
    return moved.select(key, group, F.when(far < band * 2.5, F.col("next")).otherwise(F.col("quad")).alias("quad"), F.when(F.col("looked") > 0, F.col("close") / F.col("looked")).otherwise(0.0).alias("support"))


def snapped(quads: DataFrame, edges: DataFrame, group: str, key: str) -> DataFrame:
    """M3: key, group, quad, support of quads (key, group, quad: four points) after two passes over edge pixels
    (group, x, y), the second in a narrower band.

    Each side is looked at every four pixels, away from its ends; the edge pixel nearest along the normal counts, and a line
    through those of a side replaces it. Corners are where neighbouring lines meet; a quad that would move by more than two
    and a half bands stays. Support is the share of places with an edge within two pixels, in the last pass.
    """
    for band in BANDS:
        quads = _snapped(quads.select(key, group, "quad"), edges, group, key, band)
    return quads
