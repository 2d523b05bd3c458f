"""Texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more: SimHash, MinHash blocks, an exact check.

Every set has the 64-bit SimHash of ``simhash``. Sets of one fingerprint, and those whose fingerprints pairs of 16-bit
blocks bring together within ``DISTANCE`` bits, are candidates. Sets of similarity 0.8 differ in some ten bits, which no
split into blocks finds; for those, MinHash blocks are the way.

Words and shingles are those of ``simhash``, as sets: repeats of a shingle count once, and a shingle stands as its XXH64.
A text's set gives ``BANDS`` block values of ``ROWS`` minima each. A pair of similarity s shares none of them with a
probability of (1 - s^ROWS)^BANDS: one pair in twenty million at 0.8, fewer above. Texts that share no shingle share no
block. Every pair that shares a block is checked on the whole sets, so no pair below ``similarity`` is a link.

Equal sets are one node, so copies cost one row. Of the nodes that agree in a block

* a block with two members gives its pair at once, blocks up to ``SMALL`` members are joined;
* larger blocks are compared set by set in one task, up to about ``PIECE`` shingles and ``MEMBERS`` sets; pairs that
  earlier links of the task connect already are not compared again;
* in still larger blocks every set is held against that of the least member first. Those that link to it are connected
  and mostly done: of a block of like pages nothing is left. Distance, one less similarity, is a metric: a set that does
  not link to the first can link only to one whose distance to the first differs by no more than a link's. What is left,
  with the linked sets that some of it could still link to, is dealt into pieces, and each pair of pieces is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import durable, mix64, utf8
from quillet.llm import simhash
from quillet.llm.simhash import components

BANDS, ROWS = 32, 4
#: Bits in which fingerprints may differ, and the blocks they are split into.
DISTANCE, BLOCKS = 2, 4
SMALL, PIECE, MEMBERS = 8, 1 << 20, 4096
_DRAWS = np.random.default_rng(42).integers(0, 2**32, (2, BANDS * ROWS, 1), dtype=np.uint32)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    return np.unique(np.array([digest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The block values of a set that is not empty."""
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(high), 512):
        x = (high[None, k : k + 512] ^ _DRAWS[0]) * (_DRAWS[1] | np.uint32(1))
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(1), out=least)
    value = np.arange(1, BANDS + 1).astype(np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + column)
    return value


def _sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    buf, at = utf8(column)
    raw = buf.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield shingle_set(raw[a:b], shingle)


def signatures(texts: DataFrame, shingle: int) -> DataFrame:
    """id, th, fp (a 128-bit hash of the set), sim (its SimHash), size, bands (none of an empty set) of (id, th, text). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sims, sizes, values = [], [], [], []
            for s in _sets(batch.column("text"), shingle):
                fps.append(xxhash.xxh3_128_digest(s.tobytes()))
                sims.append(simhash.majority(s, 1) if len(s) else bytes(8))
                sizes.append(len(s))
                values.append(bands(s).tobytes() if len(s) else b"")
            arrays = [batch.column("id"), batch.column("th"), pa.array(fps, pa.binary()), pa.array(sims, pa.binary()), pa.array(sizes, pa.int32()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "th", "fp", "sim", "size", "bands"])

    return texts.select("id", "th", "text").mapInArrow(run, "id long, th long, fp binary, sim binary, size int, bands binary")


def alike(nodes: DataFrame) -> DataFrame:
    """a, b: nodes (node, sim) of sets that are not empty whose SimHash fingerprints are equal or linked, enough of them to
    connect all such."""
    sims = nodes.where("size > 0").select("node", "sim")
    distinct = durable(sims.groupBy("sim").agg(F.min("node").alias("id")))
    same = sims.join(distinct, "sim").where("node <> id").select(F.col("id").alias("a"), F.col("node").alias("b"))
    near = simhash.links(distinct.select("id", F.col("sim").alias("fp")), simhash.block_tables(64, BLOCKS), 1, DISTANCE)
    return near.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _block_rows(nodes: DataFrame) -> DataFrame:
    """key (band and its value), node, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(0, whole.num_rows, 4096):
                batch = whole.slice(row, 4096)
                keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
                each = [np.repeat(batch.column(c).to_numpy(), BANDS) for c in ("node", "size")]
                yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, each)], ["key", "node", "size"])

    return nodes.where("size > 0").select("node", "size", "bands").mapInArrow(run, "key long, node long, size int")


def similarities(one: np.ndarray, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Jaccard similarity of a sorted set to each of the sets that lie in ``values`` one after another."""
    place = np.minimum(np.searchsorted(one, values), len(one) - 1)
    common = np.add.reduceat((one[place] == values).astype(np.int64), starts)
    return common / (len(one) + sizes - common)


def forest(ids: np.ndarray, sets: list[np.ndarray], first: np.ndarray, rest: np.ndarray, similarity: float, tied: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The links between the sets at the places ``first`` and those at ``rest``, less those that earlier ones make needless;
    the ``tied`` sets are connected already."""
    label = np.arange(len(ids))
    if tied is not None and tied.any():
        label[tied] = int(np.flatnonzero(tied)[0])
    sizes = np.array([len(s) for s in sets])
    same = np.array_equal(first, rest)
    found = []
    for k, a in enumerate(first.tolist()):
        other = rest[k + 1 :] if same else rest
        fits = np.minimum(sizes[other], sizes[a]) / np.maximum(sizes[other], sizes[a]) >= similarity
        other = other[(label[other] != label[a]) & fits]
        if len(other) == 0:
            continue
        n = sizes[other]
        near = other[similarities(sets[a], np.concatenate([sets[x] for x in other]), np.cumsum(n) - n, n) >= similarity]
        groups, at = np.unique(label[near], return_index=True)
        found += [(int(ids[a]), int(ids[x])) for x in near[at].tolist()]
        label[np.isin(label, groups)] = label[a]
    return found


def _led(rows: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of blocks (key, node, size): the links to each block's least node, and what is left to compare: key, node, size, and
    whether it is tied to the least node already. Each set is sent once."""
    firsts = rows.groupBy("key").agg(F.min("node").alias("first"))
    shown = firsts.join(sets.select(F.col("node").alias("first"), F.col("hashes").alias("led_by")), "first")
    met = rows.join(sets, "node").join(shown, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, first = ([np.frombuffer(x.as_py(), np.uint64) for x in batch.column(c)] for c in ("hashes", "led_by"))
            near = [float(similarities(a, b, np.zeros(1, np.int64), np.array([len(b)]))[0]) for a, b in zip(mine, first, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "node", "size", "first")), pa.array(near, pa.float64())], ["key", "node", "size", "first", "near"])

    held = durable(met.select("key", "node", "size", "first", "hashes", "led_by").mapInArrow(run, "key long, node long, size int, first long, near double"))
    reach = 1 - similarity + 1e-9
    linked = F.col("near") >= similarity
    edge = held.where(~linked & (F.col("near") >= similarity - reach)).groupBy("key").agg((F.max("near") + reach).alias("edge"))
    left = held.join(edge, "key", "left").where(~linked | (F.col("near") <= F.col("edge")))
    return held.where(linked & (F.col("node") != F.col("first"))).select(F.col("first").alias("a"), F.col("node").alias("b")), left.select("key", "node", "size", linked.alias("tied"))


def links(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b: nodes of at least that similarity, enough of them to connect all that are linked.

    ``nodes`` has node, id, th, sim, size, bands; id and th name the row of ``texts`` that shows the node's text.
    """
    rows = _block_rows(nodes)
    sized = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("all")
    )
    # Blocks with the same members say the same: one of them is enough.
    sized = durable(sized.where("n > 1").groupBy("n", "total", "lo", "hi", "all").agg(F.min("key").alias("key")))
    twos = sized.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    more = durable(rows.join(sized.where("n > 2").select("key", "n", "total"), "key"))
    some = more.where(F.col("n") <= SMALL).select("key", "node")
    pairs = some.withColumnRenamed("node", "a").join(some.withColumnRenamed("node", "b"), "key").where("a < b").select("a", "b")
    pairs = durable(twos.unionByName(pairs).unionByName(alike(nodes)).distinct())
    large = more.where(F.col("n") > SMALL)

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(large.select("node")).distinct()
    shown = texts.join(nodes.select("node", "id", "th").join(wanted, "node"), ["id", "th"]).groupBy("node").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([s.tobytes() for s in _sets(batch.column("text"), shingle)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), sets], ["node", "hashes"])

    sets = durable(shown.mapInArrow(run, "node long, hashes binary"))
    of = lambda data: np.frombuffer(data, np.uint64)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                one, two = of(x.as_py()), of(y.as_py())
                fits = min(len(one), len(two)) / max(len(one), len(two)) >= similarity
                keep.append(fits and bool(similarities(one, two, np.zeros(1, np.int64), np.array([len(two)]))[0] >= similarity))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")

    pieces = F.greatest(F.ceil(F.col("total") / PIECE), F.ceil(F.col("n") / MEMBERS)).cast("int")
    large = large.withColumn("pieces", pieces)
    led, left = _led(large.where("pieces > 1").select("key", "node", "size"), sets, similarity)
    again = left.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total")).withColumn("pieces", pieces).select("key", "pieces")
    rest = left.join(again, "key").select("key", "node", "tied", "pieces")
    whole = large.where("pieces = 1").select("key", "node", F.lit(False).alias("tied"), "pieces")
    dealt = whole.unionByName(rest).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "key", "node", "tied", "mine", F.least("mine", "with").alias("p"), F.greatest("mine", "with").alias("q")
    )
    dealt = dealt.join(sets, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        mine = pdf["mine"].to_numpy()
        found = forest(pdf["node"].to_numpy(), [of(x) for x in pdf["hashes"]], np.flatnonzero(mine == p), np.flatnonzero(mine == q), similarity, pdf["tied"].to_numpy(bool))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    dense = dealt.groupBy("key", "p", "q").applyInPandas(compare, "a long, b long").unionByName(led)
    return near.unionByName(dense).distinct()


def firsts(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """id, th: of each component of linked texts the least pair of id and text hash, of (id, th, text); ids are never null."""
    rows = durable(signatures(texts, shingle))
    same = rows.groupBy("fp").agg(F.min(F.struct("id", "th")).alias("least"), F.first("sim").alias("sim"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = durable(same.select(F.monotonically_increasing_id().alias("node"), "least.id", "least.th", "sim", "size", "bands"))
    found = components(links(nodes, texts, shingle, similarity))
    named = nodes.select("node", "id", "th").join(found.withColumnRenamed("id", "node"), "node", "left")
    return named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("id", "th")).alias("least")).select("least.id", "least.th")
