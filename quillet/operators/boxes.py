"""Boxes and quads."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.scalar import let
from quillet.schemas import BOX

#: Board units: its width, and the width of an item at scale 1.
BOARD, BASE = 1000.0, 300.0


def size_of(scale: Column, aspect: Column) -> tuple[Column, Column]:
    """L2."""
    return F.lit(BASE) * scale, F.lit(BASE) * scale * aspect


def bounds(x: Column, y: Column, rotation: Column, scale: Column, aspect: Column) -> Column:
    """L1: struct(x0, y0, x1, y1) around an item turned by degrees."""
    w, h = size_of(scale, aspect)
    r = F.radians(rotation)
    bw = F.abs(w * F.cos(r)) + F.abs(h * F.sin(r))
    bh = F.abs(w * F.sin(r)) + F.abs(h * F.cos(r))
    return F.struct((x - bw / 2).alias("x0"), (y - bh / 2).alias("y0"), (x + bw / 2).alias("x1"), (y + bh / 2).alias("y1"))


def overlap_area(a: Column, b: Column) -> Column:
    """L3, of structs (x0, y0, x1, y1)."""
    wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    tall = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return wide * tall


def corners(box: Column) -> Column:
    return F.struct(box["x"].alias("x0"), box["y"].alias("y0"), (box["x"] + box["w"]).alias("x1"), (box["y"] + box["h"]).alias("y1"))


def overlap_ratio(a: Column, b: Column) -> Column:
    """L4: common area over the smaller area, of boxes (x, y, w, h)."""
    return overlap_area(corners(a), corners(b)) / F.greatest(F.least(a["w"] * a["h"], b["w"] * b["h"]), F.lit(1e-12))


def pad(box: Column, share: float = 0.35, width: float | None = None, height: float | None = None) -> Column:
    """Grown by a share of its height, inside the image."""
    p = box["h"] * share
    x, y = F.greatest(F.lit(0.0), box["x"] - p), F.greatest(F.lit(0.0), box["y"] - p)
    x1, y1 = box["x"] + box["w"] + p, box["y"] + box["h"] + p
    x1 = x1 if width is None else F.least(F.lit(width), x1)
    y1 = y1 if height is None else F.least(F.lit(height), y1)
    return F.struct(x.alias("x"), y.alias("y"), (x1 - x).alias("w"), (y1 - y).alias("h"))


def blur_pad(box: Column, reason: Column, width: Column, height: Column) -> Column:
    """8% of the short side for codes, 40% of the height for text; whole pixels, inside the image."""
    p = F.when(reason == "barcode", F.least(box["w"], box["h"]) * 0.08).otherwise(box["h"] * 0.4)
    low = lambda c: F.greatest(F.lit(0.0), F.floor(box[c] - p).cast("double"))
    high = lambda c, size, most: F.least(most.cast("double"), F.ceil(box[c] + box[size] + p).cast("double"))
    return F.struct(low("x").alias("x"), low("y").alias("y"), (high("x", "w", width) - low("x")).alias("w"), (high("y", "h", height) - low("y")).alias("h"))


def manual_box_ok(box: Column) -> Column:
    """D8."""
    return (box["w"] > 8) & (box["h"] > 8)


def overlapping_pairs(left: DataFrame, right: DataFrame, key: str, least: float, cell: float = 128.0) -> DataFrame:
    """Pairs of boxes (key, id, box) of one document that overlap by more than ``least`` of the smaller one.

    Boxes meet by key and grid cell, so that a key with many boxes does not meet itself as a whole. A pair is found once, in
    the cell that holds the upper left corner of what they share: that is a cell where one of the two begins along x and one
    along y. So four joins by where boxes begin take the place of one of all that lies in a cell, and the smaller the cells
    are, the nearer are the rows that meet to those that overlap.
    """

    def dealt(df: DataFrame, side: str) -> DataFrame:
        box = F.col("box")
        first, last = lambda c: F.floor(box[c] / cell), lambda c, size: F.floor((box[c] + box[size]) / cell)
        rows = df.select(key, F.col("id").alias(side), box.alias(f"box_{side}"), first("x").alias("fx"), first("y").alias("fy"), F.explode(F.sequence(first("x"), last("x", "w"))).alias("cx"), F.sequence(first("y"), last("y", "h")).alias("ys"))
        rows = rows.select(key, side, f"box_{side}", "fx", "fy", "cx", F.explode("ys").alias("cy"))
        return rows.select(key, side, f"box_{side}", "cx", "cy", (F.col("fx") == F.col("cx")).alias(f"x_{side}"), (F.col("fy") == F.col("cy")).alias(f"y_{side}"))

    x, y = F.col("box_a"), F.col("box_b")
    meet = (x["x"] < y["x"] + y["w"]) & (y["x"] < x["x"] + x["w"]) & (x["y"] < y["y"] + y["h"]) & (y["y"] < x["y"] + x["h"])
    home = (F.floor(F.greatest(x["x"], y["x"]) / cell) == F.col("cx")) & (F.floor(F.greatest(x["y"], y["y"]) / cell) == F.col("cy"))
    a, b = dealt(left, "a"), dealt(right, "b")
    ways = (("x_a AND y_a", "true"), ("NOT (x_a AND y_a)", "x_b AND y_b"), ("x_a AND NOT y_a", "NOT x_b AND y_b"), ("NOT x_a AND y_a", "x_b AND NOT y_b"))
    met = [a.where(one).drop("x_a", "y_a").join(b.where(other).drop("x_b", "y_b"), [key, "cx", "cy"]) for one, other in ways]
    return reduce(DataFrame.unionByName, met).where(meet & home & (overlap_ratio(x, y) > least)).drop("cx", "cy")


def first_come(boxes: Column, most: float = 0.6) -> Column:
    """Boxes in order, without those that overlap an accepted one by more than ``most``."""
    none = F.array().cast(f"array<{BOX}>")
    free = lambda taken, b: ~F.exists(taken, lambda t: overlap_ratio(t, b) > most)
    return F.aggregate(boxes, none, lambda taken, b: F.when(free(taken, b), F.concat(taken, F.array(b))).otherwise(taken))


def merge_grow(boxes: Column, most: float = 0.3) -> Column:
    """The largest first; each grows the first box that it overlaps by more than ``most``, or stands alone."""
    by_area = F.transform(F.array_sort(F.transform(boxes, lambda b: F.struct((-b["w"] * b["h"]).alias("k"), b.alias("b")))), lambda s: s["b"])

    def union(a: Column, b: Column) -> Column:
        x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
        return F.struct(x.alias("x"), y.alias("y"), (F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x).alias("w"), (F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y).alias("h"))

    def step(out: Column, b: Column) -> Column:
        hit = F.array_position(F.transform(out, lambda o: overlap_ratio(o, b) > most), True)
        return F.when(hit > 0, F.transform(out, lambda o, i: F.when(i + 1 == hit, union(o, b)).otherwise(o))).otherwise(F.concat(out, F.array(b)))

    return F.aggregate(by_area, F.array().cast(f"array<{BOX}>"), step)


def _next(q: Column, k: int = 1) -> Column:
    return F.transform(q, lambda _, i: F.get(q, (i + k) % F.size(q)))


def polygon_area(q: Column) -> Column:
    """L9."""
    cross = F.zip_with(q, _next(q), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def interior_angles(q: Column) -> Column:
    """Degrees at each corner."""

    def angle(p: Column, i: Column) -> Column:
        a, b = F.get(q, (i + 3) % 4), F.get(q, (i + 1) % 4)
        dot = (a["x"] - p["x"]) * (b["x"] - p["x"]) + (a["y"] - p["y"]) * (b["y"] - p["y"])
        size = distance(a, p) * distance(b, p)
        cos = dot / F.when(size == 0, 1.0).otherwise(size)
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))

    return F.transform(q, angle)


def rotate_quad(q: Column, turns: int) -> Column:
    """L12."""
    k = turns % 4
    return F.concat(F.slice(q, k + 1, 4 - k), F.slice(q, 1, k)) if k else q


def order_quad(q: Column) -> Column:
    """Clockwise by angle about the centre; first the edge that points most nearly to the right."""
    mean = lambda q, f: F.aggregate(q, F.lit(0.0), lambda s, p: s + p[f]) / 4

    def clockwise(c: Column) -> Column:
        turned = F.transform(c["q"], lambda p, i: F.struct(F.atan2(p["y"] - c["y"], p["x"] - c["x"]).alias("t"), i.alias("i"), p.alias("p")))
        return F.transform(F.array_sort(turned), lambda s: s["p"])

    def from_first(clock: Column) -> Column:
        ahead = lambda i: F.get(clock, (i + 1) % 4)
        edge = F.transform(clock, lambda a, i: (ahead(i)["x"] - a["x"]) / F.coalesce(F.nullif(distance(a, ahead(i)), F.lit(0.0)), F.lit(1.0)))
        first = let(edge, lambda e: F.array_position(e, F.array_max(e)).cast("int") - 1)
        return let(first, lambda k: F.transform(clock, lambda _, i: F.get(clock, (i + k) % 4)))

    return let(let(F.struct(q.alias("q"), mean(q, "x").alias("x"), mean(q, "y").alias("y")), clockwise), from_first)


def quad_error(a: Column, b: Column) -> Column:
    """F16: mean distance of corners over the longer diagonal."""
    diagonal = F.greatest(distance(F.get(a, 0), F.get(a, 2)), distance(F.get(b, 0), F.get(b, 2)))
    return F.aggregate(F.zip_with(a, b, distance), F.lit(0.0), lambda s, d: s + d) / 4 / diagonal


def _edges(q: Column) -> Column:
    return F.zip_with(q, _next(q), lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy")))


def _inside(edges: Column, x: Column, y: Column) -> Column:
    side = F.transform(edges, lambda e: F.signum(e["dx"] * (y - e["y"]) - e["dy"] * (x - e["x"])))
    return ~((F.array_max(side) > 0) & (F.array_min(side) < 0))


def inside_quad(q: Column, x: Column, y: Column) -> Column:
    return let(_edges(q), lambda e: _inside(e, x, y))


def _oriented(q: Column) -> Column:
    """Edges, turned so that the inside lies at their positive side."""
    around = F.aggregate(F.zip_with(q, _next(q), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, c: s + c)
    way = F.when(around < 0, -1.0).otherwise(1.0)
    turned = lambda w: F.transform(_edges(q), lambda e: F.struct(e["x"].alias("x"), e["y"].alias("y"), (e["dx"] * w).alias("dx"), (e["dy"] * w).alias("dy")))
    return let(way, turned)


def _reach(edges: Column, x: Column) -> Column:
    """struct(lo, hi): the y of a convex polygon at x; lo above hi where there are none."""
    bound = lambda e: e["y"] + e["dy"] * (x - e["x"]) / e["dx"]
    low = F.array_max(F.transform(F.filter(edges, lambda e: e["dx"] > 0), bound))
    high = F.array_min(F.transform(F.filter(edges, lambda e: e["dx"] < 0), bound))
    out = F.exists(edges, lambda e: (e["dx"] == 0) & (e["dy"] * (x - e["x"]) > 0))
    return F.struct(F.when(out, math.inf).otherwise(F.coalesce(low, F.lit(math.inf))).alias("lo"), F.coalesce(high, F.lit(-math.inf)).alias("hi"))


def quad_iou(a: Column, b: Column, n: int = 160) -> Column:
    """Over a grid of n x n points of the common bounds, of convex quads.

    A column of the grid meets a convex quad in one run of points, so a row costs n columns, not n x n points.
    """
    both = F.concat(a, b)
    frame = F.struct(
        F.array_min(both["x"]).alias("x0"), F.array_max(both["x"]).alias("x1"), F.array_min(both["y"]).alias("y0"), F.array_max(both["y"]).alias("y1"), _oriented(a).alias("a"), _oriented(b).alias("b")
    )

    def share(f: Column) -> Column:
        place = lambda y: (y - f["y0"]) / (f["y1"] - f["y0"]) * n - 0.5

        def points(lo: Column, hi: Column) -> Column:
            first, last = F.ceil(F.greatest(place(lo), F.lit(0.0))), F.floor(F.least(place(hi), F.lit(n - 1.0)))
            return F.when(lo > hi, 0).otherwise(F.greatest(F.lit(0), last - first + 1))

        def column(k: Column) -> Column:
            x = f["x0"] + (k + 0.5) / n * (f["x1"] - f["x0"])
            counted = lambda r: F.struct(
                points(F.greatest(r["a"]["lo"], r["b"]["lo"]), F.least(r["a"]["hi"], r["b"]["hi"])).alias("common"), (points(r["a"]["lo"], r["a"]["hi"]) + points(r["b"]["lo"], r["b"]["hi"])).alias("each")
            )
            return let(F.struct(_reach(f["a"], x).alias("a"), _reach(f["b"], x).alias("b")), counted)

        total = F.aggregate(
            F.transform(F.sequence(F.lit(0), F.lit(n - 1)), column),
            F.struct(F.lit(0).cast("long").alias("common"), F.lit(0).cast("long").alias("each")),
            lambda s, c: F.struct((s["common"] + c["common"]).alias("common"), (s["each"] + c["each"]).alias("each")),
        )
        return let(total, lambda t: F.when(t["each"] > 0, t["common"] / (t["each"] - t["common"])).otherwise(0.0))

    return let(frame, share)


def line_intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of the lines through a, b and c, d; null if parallel."""
    den = (a["x"] - b["x"]) * (c["y"] - d["y"]) - (a["y"] - b["y"]) * (c["x"] - d["x"])
    p, q = a["x"] * b["y"] - a["y"] * b["x"], c["x"] * d["y"] - c["y"] * d["x"]
    point = F.struct(((p * (c["x"] - d["x"]) - (a["x"] - b["x"]) * q) / den).alias("x"), ((p * (c["y"] - d["y"]) - (a["y"] - b["y"]) * q) / den).alias("y"))
    return F.when(F.abs(den) > 1e-9, point)


def inset_quad(width: Column, height: Column, share: float) -> Column:
    """The image's own corners, drawn in by a share of each side."""
    x, y = width * share, height * share
    point = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    return F.array(point(x, y), point(width - x, y), point(width - x, height - y), point(x, height - y))


def board_height(bottom: Column, least: float = 700.0) -> Column:
    """aggregate over the items' lower bounds."""
    return F.ceil(F.greatest(F.lit(least), F.coalesce(F.max(bottom) + 60, F.lit(0.0)))).cast("long")


def fit_zoom(x0: Column, y0: Column, x1: Column, y1: Column, width: float, height: float, fit: float) -> Column:
    """F8: aggregate: zoom that shows all items with a margin of 30, at most 2.2 times the given fit."""
    return F.least(F.lit(width) / (F.max(x1) - F.min(x0) + 60), F.lit(height) / (F.max(y1) - F.min(y0) + 60), F.lit(2.2 * fit))
