"""Flattened items (M4), rounded cards (M6) and regions put back into their image."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.operators.boxes import distance
from quillet.operators.pixels import wipe_hidden

# The margin around a flattened item, its longest side, and a card's corners.
MARGIN, LONGEST, CORNER = 0.05, 1600, 0.03


def flat_size(quads: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The quads with w, h of the item and m, the margin on every side: means of opposite sides, at most LONGEST."""
    q = [F.get("quad", k) for k in range(4)]
    w, h = (distance(q[0], q[1]) + distance(q[3], q[2])) / 2, (distance(q[0], q[3]) + distance(q[1], q[2])) / 2
    half = lambda c: F.floor(c + 0.5).cast("int")
    sized = quads.withColumn("w", w).withColumn("h", h).withColumn("k", F.least(F.lit(1.0), LONGEST / F.greatest("w", "h")))
    sized = sized.withColumns({"w": half(F.col("w") * F.col("k")), "h": half(F.col("h") * F.col("k"))}).drop("k")
    return sized.withColumn("m", F.greatest(half(F.col("w") * margin), half(F.col("h") * margin)))


def projected(quad: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """Where (u, v) of the unit square lies in the quad, in closed form: the square's corners are the quad's."""
    p = [F.get(quad, k) for k in range(4)]
    dx1, dx2, dx3 = p[1]["x"] - p[2]["x"], p[3]["x"] - p[2]["x"], p[0]["x"] - p[1]["x"] + p[2]["x"] - p[3]["x"]
    dy1, dy2, dy3 = p[1]["y"] - p[2]["y"], p[3]["y"] - p[2]["y"], p[0]["y"] - p[1]["y"] + p[2]["y"] - p[3]["y"]
    den = dx1 * dy2 - dx2 * dy1
    g, h = (dx3 * dy2 - dx2 * dy3) / den, (dx1 * dy3 - dx3 * dy1) / den
    depth = g * u + h * v + 1
    at = lambda c: ((p[1][c] - p[0][c] + g * p[1][c]) * u + (p[3][c] - p[0][c] + h * p[3][c]) * v + p[0][c]) / depth
    return at("x"), at("y")


def _cubic(t: Column) -> list[Column]:
    """Weights of the four values around a place, by distance, of the cubic with -3/4."""
    a = -0.75
    one, two = t + 1, 2 - t
    outer = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    inner = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    return [outer(one), inner(t), inner(1 - t), outer(two)]


def flattened(quads: DataFrame, pixels: DataFrame, group: str, key: str, channels: tuple[str, ...], cubic: bool = True, margin: float = MARGIN) -> DataFrame:
    """M4: key, x, y, channels: each quad (key, group, quad) of its image as a rectangle with a margin of what lies around.

    Every pixel of the result is a row that takes its 4 x 4 (or 2 x 2) neighbours by an equi-join and sums them by weight;
    beyond the image the border's pixels go on. Values are rounded and stay within 0 to 255.
    """
    frame = pixels.groupBy(group).agg((F.max("x") + 1).alias("wide"), (F.max("y") + 1).alias("tall"))
    sized = flat_size(quads.select(key, group, "quad"), margin).join(frame, group)
    u, v = (F.col("x") - F.col("m")) / F.col("w"), (F.col("y") - F.col("m")) / F.col("h")
    cells = sized.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") + 2 * F.col("m") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") + 2 * F.col("m") - 1)))
    sx, sy = projected(F.col("quad"), u, v)
    cells = cells.select(key, group, "x", "y", "wide", "tall", sx.alias("sx"), sy.alias("sy"))
    cells = cells.withColumns({"fx": F.floor("sx"), "fy": F.floor("sy")}).withColumns({"tx": F.col("sx") - F.col("fx"), "ty": F.col("sy") - F.col("fy")})
    weights = (lambda t: _cubic(t)) if cubic else (lambda t: [1 - t, t])
    taps = lambda c: F.inline(F.array(*[F.struct(F.lit(k - (1 if cubic else 0)).alias(f"o{c}"), w.alias(f"w{c}")) for k, w in enumerate(weights(F.col(f"t{c}")))]))
    near = cells.select("*", taps("x")).select("*", taps("y"))
    held = lambda c, size: F.least(F.greatest(F.col(f"f{c}") + F.col(f"o{c}"), F.lit(0)), F.col(size) - 1).alias(f"p{c}")
    near = near.select(key, group, "x", "y", held("x", "wide"), held("y", "tall"), (F.col("wx") * F.col("wy")).alias("weight"))
    source = pixels.select(group, F.col("x").cast("long").alias("px"), F.col("y").cast("long").alias("py"), *channels)
    summed = near.join(source, [group, "px", "py"]).groupBy(key, "x", "y").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in channels])
    return summed.select(key, "x", "y", *[F.least(F.greatest(F.floor(F.round(c, 9) + 0.5), F.lit(0)), F.lit(255)).cast("int").alias(c) for c in channels])


def in_rounded(x: Column, y: Column, left: Column, top: Column, w: Column, h: Column, radius: Column) -> Column:
    """Whether a pixel lies in a rectangle with round corners: no farther from the rectangle drawn in by the radius."""
    r = F.floor(F.greatest(F.lit(1.0), F.least(radius, w / 2, h / 2)) + 0.5)
    dx = F.greatest(left + r - x, x - (left + w - r), F.lit(0.0))
    dy = F.greatest(top + r - y, y - (top + h - r), F.lit(0.0))
    return dx * dx + dy * dy <= r * r


def soft_alpha(inside, x: Column, y: Column, sigma: float = 0.7) -> Column:
    """0 to 255: how much of a pixel's surroundings is inside a convex shape, weighed by a Gaussian over 5 x 5 pixels; an
    expression alone, since the shape is one. If the four corners of those pixels are inside, all are."""
    w = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-2, 3)]
    total = sum(w) ** 2
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w[i + 2] * w[j + 2] / total).alias("w")) for i in range(-2, 3) for j in range(-2, 3)])
    part = F.aggregate(offsets, F.lit(0.0), lambda s, o: s + F.when(inside(x + o["i"], y + o["j"]), o["w"]).otherwise(0.0))
    whole = inside(x - 2, y - 2) & inside(x + 2, y - 2) & inside(x - 2, y + 2) & inside(x + 2, y + 2)
    return F.when(whole, 255).otherwise(F.floor(F.round(255 * part, 9) + 0.5).cast("int"))


def rounded_card(pixels: DataFrame, items: DataFrame, group: str, radius: float | Column = CORNER) -> DataFrame:
    """M6: group, x, y, r, g, b, a: the item (group, left, top, w, h) of each image as a card with soft round corners, cropped
    to what can be seen and a margin of two; hidden pixels are white (M5). A radius may differ by item.

    Items and crops meet the pixels line by line: the size of a table of pixels is known too late to choose the side of a
    join by it, and an image is as many groups as it has lines.
    """
    line = [group, "y"]
    at = items.select(group, *[F.col(c).cast("double").alias(c) for c in ("left", "top", "w", "h")], (radius if isinstance(radius, Column) else F.lit(radius)).alias("radius"))
    # Two lines of softness and two of margin lie above and below an item.
    held = at.withColumn("y", F.explode(F.sequence(F.floor(F.col("top") - 4).cast("int"), F.ceil(F.col("top") + F.col("h") + 4).cast("int"))))
    met = pixels.join(held.hint("merge"), line)
    shape = lambda x, y: in_rounded(x, y, F.col("left"), F.col("top"), F.col("w"), F.col("h"), F.least("w", "h") * F.col("radius"))
    shown = met.withColumn("alpha", soft_alpha(shape, F.col("x"), F.col("y")))
    box = shown.where("alpha > 0").groupBy(group).agg((F.min("x") - 2).alias("x0"), (F.max("x") + 2).alias("x1"), (F.min("y") - 2).alias("y0"), (F.max("y") + 2).alias("y1"))
    lines = box.select(group, "x0", "x1", "y0", F.explode(F.sequence("y0", "y1")).alias("y"))
    cut = shown.join(lines.hint("merge"), line).where("x BETWEEN x0 AND x1")
    left, top = F.greatest(F.col("x0"), F.lit(0)), F.greatest(F.col("y0"), F.lit(0))
    return cut.select(group, (F.col("x") - left).alias("x"), (F.col("y") - top).alias("y"), *[wipe_hidden(F.col(c), F.col("alpha")).alias(c) for c in "rgb"], F.col("alpha").alias("a"))


def put_back(pixels: DataFrame, regions: DataFrame, group: str) -> DataFrame:
    """The pixels (group, x, y, r, g, b, a) with regions (group, id, left, top, width, height, bytes RGBA) in their
    places; where regions overlap, that of the greatest id shows."""
    k = F.col("k")
    each = regions.select(group, "id", "left", "top", "width", "bytes", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("k"))
    byte = lambda c: F.conv(F.hex(F.substring(F.col("bytes"), 4 * k + c + 1, F.lit(1))), 16, 10).cast("int")
    new = F.struct("id", *[byte(c).alias(n) for c, n in enumerate("rgba")])
    rows = each.select(group, (F.col("left") + k % F.col("width")).alias("x"), (F.col("top") + F.floor(k / F.col("width")).cast("int")).alias("y"), new.alias("new"))
    top = rows.groupBy(group, "x", "y").agg(F.max("new").alias("new"))
    return pixels.join(top, [group, "x", "y"], "left").select(group, "x", "y", *[F.coalesce(F.col(f"new.{c}"), F.col(c)).alias(c) for c in "rgba"])
