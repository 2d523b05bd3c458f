"""Regions of masks (H10, M16): runs of pixels by line, their components, holes, outlines and boxes.

A mask is a table (group, x, y) of the pixels that are on. It becomes runs (group, y, x0, x1), both ends in; all else joins
runs of neighbouring lines, which meet in cells of ``CELL`` columns, so that a line of many runs is many groups. A run is
known by (group, y, x0), a component by its first run in reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.operators.components import components, cut_lineage

CELL = 64


def mask_runs(mask: DataFrame, group: str, *sums: Column) -> DataFrame:
    """Runs of a mask without repeated pixels, and sums over the pixels of each."""
    line = Window.partitionBy(group, "y").orderBy("x")
    placed = mask.withColumn("island", F.col("x") - F.row_number().over(line))
    return placed.groupBy(group, "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), *sums).drop("island")


def joined_runs(runs: DataFrame, group: str) -> DataFrame:
    """Runs that touch on one line, as one."""
    line = Window.partitionBy(group, "y").orderBy("x0")
    opens = F.coalesce(F.col("x0") > F.lag("x1").over(line) + 1, F.lit(True)).cast("int")
    island = runs.withColumn("opens", opens).withColumn("island", F.sum("opens").over(line))
    return island.groupBy(group, "y", "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("island")


def gaps(runs: DataFrame, group: str) -> DataFrame:
    """What lies between the runs, in the box around a group's runs and a margin of one: the first line is all gap. ``first``
    is that line."""
    box = runs.groupBy(group).agg((F.min("x0") - 1).alias("lo"), (F.max("x1") + 1).alias("hi"), (F.min("y") - 1).alias("top"), (F.max("y") + 1).alias("bottom"))
    lines = box.select(group, F.explode(F.sequence("top", "bottom")).alias("y"), F.col("top").alias("first"), "lo", "hi")
    ends = lines.select(group, "y", "first", F.explode(F.array(F.col("lo") - 1, F.col("hi") + 1)).alias("x0")).withColumn("x1", F.col("x0"))
    line = Window.partitionBy(group, "y").orderBy("x0")
    after, first = F.lead("x0").over(line), F.first("first", ignorenulls=True).over(line)  # an end is the first of its line
    between = runs.select(group, "y", "x0", "x1").unionByName(ends, True).select(group, "y", (F.col("x1") + 1).alias("x0"), (after - 1).alias("x1"), first.alias("first"))
    return between.where("x0 <= x1")


def touching(runs: DataFrame, group: str, reach: int, *also: str, lower_also: tuple[str, ...] = ()) -> DataFrame:
    """group, y, a0, a1, b0, b1, ``also`` of the upper run and ``lower_also`` of the lower one, there named b_...: pairs of runs on lines y and y+1 that share a column, or with
    a reach of 1 a corner."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL)))
    low, high = F.col("x0") - reach, F.col("x1") + reach
    upper = runs.select(group, "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"), *also, cells(low, high).alias("cell"))
    lower = runs.select(group, (F.col("y") - 1).alias("y"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), *[F.col(c).alias(f"b_{c}") for c in lower_also], cells(F.col("x0"), F.col("x1")).alias("cell"))
    met = upper.join(lower, [group, "y", "cell"]).where((F.col("a0") - reach <= F.col("b1")) & (F.col("a1") + reach >= F.col("b0")))
    return met.where(F.floor(F.greatest(F.col("a0") - reach, F.col("b0")) / CELL) == F.col("cell")).drop("cell")  # of all cells the first


def labelled(runs: DataFrame, group: str, reach: int = 1, *also: str) -> DataFrame:
    """The runs, and ``also`` of them, with the line and column (ly, lx) of the first run of their component."""
    at = lambda y, x: F.struct(F.col(group).alias("g"), F.col(y).alias("y"), F.col(x).alias("x"))
    # Runs of one extent on lines that follow each other are one node, known by its first line: paths get shorter.
    same = Window.partitionBy(group, "x0", "x1")
    placed = runs.withColumn("island", F.col("y") - F.row_number().over(same.orderBy("y")))
    placed = cut_lineage(placed.withColumn("top", F.min("y").over(Window.partitionBy(group, "x0", "x1", "island"))).drop("island"))
    links = touching(placed, group, reach, "top", lower_also=("top",)).select(at("top", "a0").alias("a"), at("b_top", "b0").alias("b"))
    found = components(links)
    named = placed.withColumn("node", at("top", "x0")).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return named.select(group, "y", "x0", "x1", *also, F.col("root.y").alias("ly"), F.col("root.x").alias("lx"))


def filled(runs: DataFrame, group: str) -> DataFrame:
    """The runs with all holes, and what lies in holes: everything the outside does not reach from side to side."""
    around = labelled(gaps(runs, group), group, 0, "first")
    holes = around.where("ly > first").select(group, "y", "x0", "x1")
    return joined_runs(runs.select(group, "y", "x0", "x1").unionByName(holes), group)


def outlines(marked: DataFrame, group: str) -> DataFrame:
    """group, ly, lx, x, y, w, h, area of the components of labelled runs without holes: boxes, and the area inside the line
    through the middles of the outer pixels.

    That line bounds the squares between four pixels of the component and halves those between three; both are counted
    where runs of neighbouring lines overlap.
    """
    a0, a1, b0, b1 = (F.col(c) for c in ("a0", "a1", "b0", "b1"))
    half = lambda inside: F.when(inside, 0.5).otherwise(0.0)
    corners = half((b0 > a0) & (b0 <= a1)) + half((b1 >= a0) & (b1 < a1)) + half((a0 > b0) & (a0 <= b1)) + half((a1 >= b0) & (a1 < b1))
    squares = F.greatest(F.lit(0), F.least("a1", "b1") - F.greatest("a0", "b0"))
    areas = touching(marked, group, 0, "ly", "lx").groupBy(group, "ly", "lx").agg(F.sum(squares + corners).alias("area"))
    boxes = marked.groupBy(group, "ly", "lx").agg(F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    return boxes.join(areas, [group, "ly", "lx"], "left").withColumn("area", F.coalesce("area", F.lit(0.0)))


def outer(runs: DataFrame, group: str) -> DataFrame:
    """The labelled runs, holes filled, of the components that no other one surrounds."""
    return cut_lineage(labelled(cut_lineage(filled(runs, group)), group))


def blobs(runs: DataFrame, group: str, fill: float = 0.55) -> DataFrame:
    """Group, x, y, w, h, fill of components whose outline fills more than that share of their box, holes included."""
    share = F.col("area") / (F.col("w") * F.col("h"))
    return outlines(outer(runs, group), group).withColumn("fill", share).where(F.col("fill") > fill).select(group, "x", "y", "w", "h", "fill")


def largest(runs: DataFrame, group: str) -> DataFrame:
    """The runs, holes filled, of each group's component with the greatest outline; of equal ones the first in reading
    order; none where no outline has an area."""
    marked = outer(runs, group)
    best = outlines(marked, group).where("area > 0").groupBy(group).agg(F.max_by(F.struct("ly", "lx"), F.struct(F.col("area"), -F.col("ly"), -F.col("lx"))).alias("best"))
    return marked.join(best.select(group, "best.ly", "best.lx"), [group, "ly", "lx"]).select(group, "y", "x0", "x1")
