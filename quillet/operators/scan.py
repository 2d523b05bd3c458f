"""What a scan has found, put together (I1, I4-I6, L16, M12, D7, H11): boxes of all sources, secrets, verification rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions.scalar import filled, let
from quillet.operators import bcbp
from quillet.operators.boxes import overlap_ratio
from quillet.schemas import BOX


def union_sources(**sources: DataFrame) -> DataFrame:
    """doc_id, rank, ord, reason, box of all sources (doc_id, ord, reason, box), ranked in the order given."""
    ranked = [df.select("doc_id", F.lit(rank).alias("rank"), "ord", "reason", "box") for rank, df in enumerate(sources.values())]
    return reduce(DataFrame.unionByName, ranked)


def scan_boxes(found: DataFrame, most: float = 0.6) -> DataFrame:
    """doc_id, boxes: of each document the boxes in order of rank and ord, without those that overlap an earlier one by
    more than ``most``. A document's boxes are some dozens."""
    entry = F.struct("rank", "ord", "box", "reason")
    docs = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    taken = F.array().cast(f"array<struct<reason:string,box:{BOX}>>")
    mine = lambda e: F.struct(e["reason"].cast("string").alias("reason"), e["box"].cast(BOX).alias("box"))
    free = lambda kept, e: ~F.exists(kept, lambda t: overlap_ratio(t["box"], e["box"]) > most)
    kept = F.aggregate("all", taken, lambda kept, e: F.when(free(kept, e), F.concat(kept, F.array(mine(e)))).otherwise(kept))
    return docs.select("doc_id", kept.alias("boxes"))


def words_inside(words: DataFrame, boxes: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, box_id, text: the words of each box (doc_id, box_id, box) by more than ``least`` of the smaller area, as
    one text in reading order. A line flags few boxes, so the equality on the document is the join."""
    w = words.select("doc_id", "ord", "text", F.struct("x", "y", "w", "h").alias("word"))
    met = w.join(boxes, "doc_id").where(overlap_ratio(F.col("word"), F.col("box")) > least)
    lists = met.groupBy("doc_id", "box_id").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("in"))
    return lists.select("doc_id", "box_id", F.array_join(F.col("in.text"), "").alias("text"))


def secrets(barcodes: DataFrame, flagged: DataFrame) -> DataFrame:
    """I4: doc_id, secret: the booking reference of each decoded pass, and the text of each flagged box."""
    pnr = F.get(bcbp.decode(F.col("text"))["legs"], 0)["pnr"]
    return barcodes.select("doc_id", filled(pnr).alias("secret")).unionByName(flagged.select("doc_id", F.col("text").alias("secret"))).where("secret IS NOT NULL").distinct()


def live_boxes(boxes: Column, removed: Column) -> Column:
    """The boxes whose id is not among the removed ones."""
    return F.filter(boxes, lambda b: ~F.array_contains(removed, b["id"]))


def grow(box: Column, share: Column) -> Column:
    """A box that did not hide its code grows to all sides, twice as much in height."""
    return F.struct(
        (box["x"] - box["w"] * share).alias("x"), (box["y"] - box["h"] * share * 2).alias("y"), (box["w"] * (1 + share * 2)).alias("w"), (box["h"] * (1 + share * 4)).alias("h")
    )


def grow_hit(boxes: Column, left: Column, share: Column, most: float = 0.3) -> Column:
    """Boxes (array of BOX) after a round that could still read a code at ``left``: the first box that overlaps it grows,
    or a grown box for it is added."""
    hit = F.array_position(F.transform(boxes, lambda b: overlap_ratio(b, left) > most), True)
    return F.when(hit > 0, F.transform(boxes, lambda b, i: F.when(i + 1 == hit, grow(b, share)).otherwise(b))).otherwise(F.concat(boxes, F.array(grow(left, share))))


def join_masks(one: Column, other: Column, how: str) -> Column:
    """Masks (arrays of booleans) joined pixel by pixel."""
    both = {"or": lambda a, b: a | b, "and": lambda a, b: a & b}[how]
    return F.zip_with(one, other, both)


def grow_linear(lines: Column, first: Column, last: Column, least: float = 0.75) -> Column:
    """struct(first, last) of a linear code whose scan line was read somewhere in lines first to last: the code goes on
    at either side while a line (array of samples) repeats the middle line's pattern of dark and light in more than ``least``
    of its samples, by as many lines as the code is long at most."""
    # A line's threshold is bound, so that it is worked out once a line and not once a sample.
    dark = lambda v: let((F.array_min(v) + F.array_max(v)) / 2, lambda cut: F.transform(v, lambda s: s < cut))
    middle = dark(F.get(lines, F.floor((first + last) / 2).cast("int")))
    same = lambda v, m: F.size(F.filter(F.zip_with(dark(v), m, lambda a, b: a == b), lambda x: x)) / F.size(m) > least
    agrees = lambda m: F.transform(lines, lambda v: same(v, m))
    stop = lambda flags: F.filter(F.transform(flags, lambda ok, i: F.when(~ok, i)), lambda i: i.isNotNull())
    reach = F.size(F.get(lines, first))

    def ends(stops: Column) -> Column:
        above = F.coalesce(F.array_max(F.filter(stops, lambda i: i < first)) + 1, F.lit(0))
        below = F.coalesce(F.array_min(F.filter(stops, lambda i: i > last)) - 1, F.size(lines) - 1)
        return F.struct(F.greatest(above, first - reach).alias("first"), F.least(below, last + reach).alias("last"))

    return let(stop(let(middle, agrees)), ends)


def by_score(found: DataFrame) -> DataFrame:
    """All detections, the best first."""
    return found.orderBy(F.desc("score"), "id")
