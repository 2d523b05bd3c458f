"""Code regions from grey pixels alone (M7, M8): filters over lines and columns, masks, blobs, then the checks of M9-M11.

Pixels are a full table (group, x, y, v). A filter goes along lines, then along columns, as windows with a frame: each is
one shuffle by (group, y) or (group, x), so that an image is as many groups as it has lines. What holds for a whole image
meets its lines before its pixels (``pixels.on_lines``): pixels dealt by image would stay together for all filters that
follow. The number of tasks follows the number of pixels (``pixels.dealt``). Results equal those of the usual image operators on 8-bit values: differences saturate, means are rounded, frames mirror at the border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.operators import pixels as P
from quillet.operators.boxes import merge_grow
from quillet.operators.components import cut_lineage
from quillet.operators.regions import blobs, labelled, mask_runs

# Shares of an image and sizes in pixels of what can be a code.
LEAST_BARS, LEAST_ALONG, LEAST_ACROSS = 0.006, 0.08, 14
LEAST_BLOCK, LEAST_SIDE, ASPECTS, DENSE = 0.008, 40, (0.6, 1.65), 0.28
WEAK_EDGE, STRONG_EDGE = 60, 160


def frames(pixels: DataFrame, group: str) -> DataFrame:
    """group, wide, tall."""
    return pixels.groupBy(group).agg((F.max("x") + 1).alias("wide"), (F.max("y") + 1).alias("tall"))


def lines_of(pixels: DataFrame, group: str) -> DataFrame:
    """group, y."""
    return pixels.select(group, "y").distinct()


def _line(group: str, along: str) -> tuple[list[str], Column]:
    return [group, "y" if along == "x" else "x"], F.col(along)


def beside(value: Column, group: str, along: str, mirror: bool) -> tuple[Column, Column]:
    """The values before and after along a line; at the border the one on the other side, or the pixel's own."""
    keys, at = _line(group, along)
    line = Window.partitionBy(*keys).orderBy(at)
    before, after = F.lag(value).over(line), F.lead(value).over(line)
    return (F.coalesce(before, after, value), F.coalesce(after, before, value)) if mirror else (F.coalesce(before, value), F.coalesce(after, value))


def gradients(pixels: DataFrame, group: str, side: int, middle: int, mirror: bool, tasks: int | None = None) -> DataFrame:
    """group, x, y, v, gx, gy: 3 x 3 differences, smoothed across by (side, middle, side)."""
    left, right = beside(F.col("v"), group, "x", mirror)
    lines = P.dealt(pixels, tasks, group, "y").select(group, "x", "y", "v", left.alias("l"), right.alias("r"))
    lines = lines.select(group, "x", "y", "v", (F.col("r") - F.col("l")).alias("d"), (side * (F.col("l") + F.col("r")) + middle * F.col("v")).alias("s"))
    lines = P.dealt(lines, tasks, group, "x")
    up, down = beside(F.col("d"), group, "y", mirror)
    above, below = beside(F.col("s"), group, "y", mirror)
    return lines.select(group, "x", "y", "v", (side * (up + down) + middle * F.col("d")).alias("gx"), (below - above).alias("gy"))


def frame_over(df: DataFrame, group: str, along: str, reach: Column | int, f, value: str, name: str) -> DataFrame:
    """``name``: ``f`` of ``value`` over the pixels up to ``reach`` away along a line, as far as there are any. The reach may
    differ from image to image: places are scaled so that the frame is one up to the next half pixel."""
    keys, at = _line(group, along)
    if isinstance(reach, int):
        return df.withColumn(name, f(value).over(Window.partitionBy(*keys).orderBy(at).rangeBetween(-reach, reach)))
    return df.withColumn(name, f(value).over(Window.partitionBy(*keys).orderBy(2.0 * at / (2 * reach + 1)).rangeBetween(-1, 1)))


def mirrored(df: DataFrame, size: str, along: str, reach: Column) -> DataFrame:
    """With the pixels up to ``reach`` from a border again beyond it, the border's own pixel left out."""
    at, n = F.col(along), F.col(size)
    places = F.array(at, F.when((at >= 1) & (at <= reach), -at), F.when((at >= n - 1 - reach) & (at <= n - 2), 2 * (n - 1) - at))
    return df.withColumn(along, F.explode(F.array_compact(places)))


def box_sums(df: DataFrame, group: str, value: str, reach: Column, tasks: int | None = None) -> DataFrame:
    """The rows (with wide, tall) and ``sum``: of ``value`` over the square up to ``reach`` away, mirrored at the border. With
    ``tasks`` the rows come dealt by line."""
    for along, size in (("x", "wide"), ("y", "tall")):
        df = P.dealt(df, tasks, group, "x") if along == "y" else df
        df = frame_over(mirrored(df, size, along, reach), group, along, reach, F.sum, value if along == "x" else "sum", "sum").where((F.col(along) >= 0) & (F.col(along) < F.col(size)))
    return df


def otsu(values: DataFrame, group: str, value: str) -> DataFrame:
    """group, cut: the value that parts the others in two classes, up to it and above, with the greatest variance between."""
    counts = values.groupBy(group, value).agg(F.count("*").alias("n"))
    up, every = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(group)
    mass = F.col("n") * F.col(value)
    ran = counts.select(group, value, F.sum("n").over(up).alias("n1"), F.sum(mass).over(up).alias("s1"), F.sum("n").over(every).alias("n"), F.sum(mass).over(every).alias("s"))
    apart = F.pow(F.col("s1") * F.col("n") - F.col("s") * F.col("n1"), 2) / (F.col("n1") * (F.col("n") - F.col("n1")))  # times n**3
    return ran.select(group, value, F.when(F.col("n1") < F.col("n"), apart).otherwise(0.0).alias("apart")).groupBy(group).agg(F.max_by(value, F.struct(F.col("apart"), -F.col(value))).alias("cut"))


def morphed(mask: DataFrame, group: str, steps: tuple[tuple[str, object, object], ...], tasks: int | None = None) -> DataFrame:
    """A full mask (group, x, y, on as 0 or 1) after running maxima and minima: (along, F.max or F.min, reach). With ``tasks``
    the mask comes dealt for the first."""
    for k, (along, f, reach) in enumerate(steps):
        if k and along != steps[k - 1][0]:
            mask = P.dealt(mask, tasks, *_line(group, along)[0])
        mask = frame_over(mask, group, along, reach, f, "on", "on")
    return mask


def bar_mask(pixels: DataFrame, group: str, vertical: bool = False) -> DataFrame:
    """group, x, y of what stands out by steps across the bars and none along them: closed over the gaps between bars, then
    opened so that thin lines go."""
    tasks = P.tasks_of(pixels)
    g = gradients(pixels, group, 3, 10, mirror=True, tasks=tasks)
    size = lambda c: F.least(F.abs(F.col(c)), F.lit(255))
    across, along = ("gy", "gx") if vertical else ("gx", "gy")
    steps = g.select(group, "x", "y", F.greatest(size(across) - size(along), F.lit(0)).alias("d"))
    lines = cut_lineage(lines_of(pixels, group))
    steps = P.on_lines(P.dealt(steps, tasks, group, "y"), lines, frames(pixels, group), group, tasks)
    mean = box_sums(steps, group, "d", F.lit(4), tasks).select(group, "x", "y", F.bround(F.col("sum") / 81).cast("int").alias("m"))
    mean = cut_lineage(mean)
    on = P.on_lines(P.dealt(mean, tasks, group, "y"), lines, otsu(mean, group, "m"), group, tasks).select(group, "x", "y", (F.col("m") > F.col("cut")).cast("int").alias("on"))
    x, y = (3, 10) if vertical else (10, 3)
    closed = (("x", F.max, x), ("y", F.max, y), ("y", F.min, y), ("x", F.min, x))
    opened = (("x", F.min, 4), ("y", F.min, 4), ("y", F.max, 4), ("x", F.max, 4))
    return morphed(on, group, closed + opened, tasks).where("on = 1").select(group, "x", "y")


def _in_regions(pixels: DataFrame, boxes: DataFrame, group: str) -> DataFrame:
    """The pixels of each region, under the region as a struct; they meet line by line."""
    region = F.struct(*[F.col(c) for c in (group, "x", "y", "w", "h")]).alias("region")
    lines = boxes.select(group, region, F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)).alias("y"))
    x, r = F.col("x"), F.col("region")
    tasks = P.tasks_of(pixels)
    met = P.dealt(pixels, tasks, group, "y").join(P.dealt(lines, tasks, group, "y").hint("shuffle_hash"), [group, "y"])
    return met.where((x >= r["x"]) & (x < r["x"] + r["w"])).select("region", "x", "y", "v")


def bar_blocks(pixels: DataFrame, group: str, vertical: bool = False) -> DataFrame:
    """group, x, y, w, h of solid blocks of the mask that are large and long enough for a code."""
    along, across = ("h", "w") if vertical else ("w", "h")
    least = F.col("wide") * LEAST_ALONG * (F.col("tall") / F.col("wide") if vertical else F.lit(1))
    found = blobs(mask_runs(bar_mask(pixels, group, vertical), group), group).join(frames(pixels, group), group)
    sized = found.where((F.col("w") * F.col("h") >= F.col("wide") * F.col("tall") * LEAST_BARS) & (F.col(along) >= least) & (F.col(across) >= LEAST_ACROSS))
    return sized.select(group, "x", "y", "w", "h")


def checked_bars(pixels: DataFrame, boxes: DataFrame, group: str, vertical: bool = False) -> DataFrame:
    """The boxes whose lines alternate across the bars (M9) and hardly change along them."""
    held = cut_lineage(_in_regions(pixels, boxes, group))
    tasks = P.tasks_of(held)
    lined = P.scan_lines(held, "region", vertical, tasks).where(P.stripy(F.col("scans"))).select("region")
    return lined.join(P.coherent(held, "region", vertical, tasks).where("coherent"), "region").select("region.*")


def bar_regions(pixels: DataFrame, group: str, vertical: bool = False) -> DataFrame:
    """M7: group, x, y, w, h of linear and stacked codes."""
    pixels = cut_lineage(pixels)
    return checked_bars(pixels, bar_blocks(pixels, group, vertical), group, vertical)


def canny(pixels: DataFrame, group: str, low: int = WEAK_EDGE, high: int = STRONG_EDGE) -> DataFrame:
    """group, x, y of edge pixels: crests of the gradient above ``low`` that connect to one above ``high``."""
    tasks = P.tasks_of(pixels)
    g = gradients(pixels, group, 1, 2, mirror=False, tasks=tasks)
    g = P.dealt(g.select(group, "x", "y", "gx", "gy", (F.abs("gx") + F.abs("gy")).alias("m")), tasks, group, "y")
    row, column = Window.partitionBy(group, "y").orderBy("x"), Window.partitionBy(group, "x").orderBy("y")
    g = g.withColumns({"ml": F.coalesce(F.lag("m").over(row), F.lit(0)), "mr": F.coalesce(F.lead("m").over(row), F.lit(0))})
    g = P.dealt(g, tasks, group, "x").withColumns({f"{c}{way}": F.coalesce(f(c).over(column), F.lit(0)) for c in ("m", "ml", "mr") for way, f in (("u", F.lag), ("d", F.lead))})
    ax, ay, m = F.abs("gx"), F.abs("gy"), F.col("m")
    level = ax * 13573  # the tangent of 22.5 degrees in 15 bits; that of 67.5 degrees is two more
    same = (F.col("gx") < 0) == (F.col("gy") < 0)
    crest = (
        F.when(ay * 32768 < level, (m > F.col("ml")) & (m >= F.col("mr")))
        .when(ay * 32768 > level + ax * 65536, (m > F.col("mu")) & (m >= F.col("md")))
        .when(same, (m > F.col("mlu")) & (m > F.col("mrd")))
        .otherwise((m > F.col("mru")) & (m > F.col("mld")))
    )
    kept = g.where((m > low) & crest).select(group, "x", "y", (m > high).alias("strong"))
    runs = cut_lineage(mask_runs(P.dealt(kept, tasks, group, "y"), group, F.max("strong").alias("strong")))
    parts = cut_lineage(labelled(runs, group, 1, "strong"))
    held = parts.join(parts.groupBy(group, "ly", "lx").agg(F.max("strong").alias("any")).where("any").drop("any"), [group, "ly", "lx"])
    return held.select(group, "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def block_regions(pixels: DataFrame, group: str) -> DataFrame:
    """M8: group, x, y, w, h, density of matrix codes: dense edges (F13's share over a square of 3.5% of the short side),
    about square, large enough, with flips both ways (M11); the density is that of the whole region."""
    pixels = cut_lineage(pixels)
    edges = cut_lineage(canny(pixels, group))
    tasks = P.tasks_of(pixels)
    frame = frames(pixels, group)
    size = F.greatest(F.lit(9), F.floor(F.least("wide", "tall") * 0.035 + 0.5).cast("int"))
    places = (group, "x", "y")
    marked = P.dealt(pixels.select(*places), tasks, *places).join(P.dealt(edges.withColumn("e", F.lit(1)), tasks, *places), list(places), "left")
    marked = P.on_lines(P.dealt(marked, tasks, group, "y"), lines_of(pixels, group), frame.withColumn("reach", F.floor(size / 2).cast("int")), group, tasks)
    marked = marked.select(group, "x", "y", F.coalesce("e", F.lit(0)).alias("e"), "wide", "tall", "reach")
    side = 2 * F.col("reach") + 1
    dense = box_sums(marked, group, "e", F.col("reach"), tasks).withColumn("on", (F.bround(255 * F.col("sum") / (side * side)) > F.floor(F.lit(255 * DENSE))).cast("int"))
    reach = F.col("reach")
    closing = (("x", F.max, reach), ("y", F.max, reach), ("y", F.min, reach), ("x", F.min, reach))
    closed = morphed(P.dealt(dense, tasks, group, "y"), group, closing, tasks).where("on = 1")
    found = blobs(mask_runs(closed, group), group).join(frame, group)
    w, h = F.col("w"), F.col("h")
    sized = found.where((w / h >= ASPECTS[0]) & (w / h <= ASPECTS[1]) & (w * h >= F.col("wide") * F.col("tall") * LEAST_BLOCK) & (F.least("w", "h") >= LEAST_SIDE))
    held = cut_lineage(_in_regions(pixels, sized, group))
    inked = _in_regions(edges.withColumn("v", F.lit(1)), sized, group).groupBy("region").agg(F.count("*").alias("inked"))
    # M11 looks at every second pixel from the region's corner.
    cornered = held.select("region", (F.col("x") - F.col("region.x")).alias("x"), (F.col("y") - F.col("region.y")).alias("y"), "v")
    found = P.blocky(cornered, "region", P.tasks_of(held)).where("blocky").join(inked, "region", "left")
    return found.select("region.*", (F.coalesce("inked", F.lit(0)) / (F.col("region.w") * F.col("region.h"))).alias("density"))


def merged_regions(found: DataFrame, group: str) -> DataFrame:
    """H8: group, boxes: overlapping regions merged."""
    box = F.struct(*[F.col(c).cast("double").alias(c) for c in "xywh"])
    return found.groupBy(group).agg(merge_grow(F.array_sort(F.collect_list(box))).alias("boxes"))


def code_regions(pixels: DataFrame, group: str) -> DataFrame:
    """M7, M8, H8: group, boxes: what was found upright, lying and square; an image has a bounded number of regions, since
    each takes a share of it."""
    every = bar_regions(pixels, group).unionByName(bar_regions(pixels, group, True)).unionByName(block_regions(pixels, group).drop("density"))
    return merged_regions(every, group)
