"""Prefix trie of conversations that families share the start of, merged family first.

1. A family is all conversations with one base id, c - c % ``FAMILY``. Turns meet by base id, the base conversation's first,
   as a sorted stream: a task rebuilds one conversation after another from the base's first turns and its own, and keeps the
   family's trie alone. A node's key is a digest of its parent's key and its last turn; its members are bits of one number,
   as a family has fewer than 40 ids. Only the first shuffle carries turns, as digests with word counts.
2. The family nodes are shuffled by key and merged: members, ends and the smallest member add up on the map side first.
3. Sums over subtrees need no walk over the trie. Along a conversation the smallest member never falls, so every
   conversation owns the lower part of its own path, its chain, and each node is in one chain. The subtree of a node is the
   chains of its members, less what its own owner's chain holds above it. Sums of chains, a row per conversation, go back to
   the families, which send them up as sums per node.
4. The ids that end at a node are joined in ranges of ``IDS`` ids, then hashed in order as a stream.

No step holds a group whole: families above ``HELD`` nodes are sent in parts, which merge like those of several families;
running sums along a chain go by blocks of ``BLOCK`` nodes.

Defined results: a null role or text is empty; a null turn sorts first; rows with equal turns are ordered by role, then by
the MD5 of role and text; repeated rows are turns of their own; rows without a conv_id belong to no conversation; no rows
give no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import durable, kept

FAMILY, HEAD = 20, 4
HELD, BLOCK, IDS = 100_000, 4096, 8192
ROOT = bytes(16)
_NODE = "base long, key binary, parent binary, depth long, words long, least long, members long, ended array<long>"


def head_length(conv_id: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(b"%d" % conv_id) % HEAD


def turns_of(rows: DataFrame) -> DataFrame:
    """base, conv, turn, role, digest, words of every row."""
    conv, role, text = F.col("conv_id").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows.where(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("base"),
        conv.alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.md5(F.concat(F.md5(role.cast("binary")), text).cast("binary")).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )


class _Family:
    """The trie of one family, or of a part of it, and the conversation that is being entered."""

    def __init__(self, base: int) -> None:
        self.base, self.first, self.parts = base, [], []
        self.nodes: dict[bytes, list] = {}

    def enter(self, key: bytes, parent: bytes | None, words: int) -> None:
        if len(self.nodes) >= HELD:
            self.parts.append(self.rows())
        node = self.nodes.setdefault(key, [parent, self.depth, words, self.conv, 0, []])
        node[3] = min(node[3], self.conv)
        node[4] |= 1 << (self.conv - self.base + FAMILY - 1)
        self.key = key

    def begin(self, conv: int) -> None:
        self.conv, self.depth, self.own = conv, 0, 0
        self.enter(ROOT, None, 0)
        if conv != self.base:
            for turn in self.first[: head_length(conv)]:
                self.step(*turn)

    def step(self, digest: str, words: int) -> None:
        self.depth += 1
        self.enter(hashlib.blake2b(self.key + bytes.fromhex(digest), digest_size=16).digest(), self.key, words)

    def turn(self, digest: str, words: int) -> None:
        """The next turn of the conversation's own."""
        self.own += 1
        if self.conv == self.base and self.own < HEAD:
            self.first.append((digest, words))
        if self.conv == self.base or self.own > head_length(self.conv):
            self.step(digest, words)

    def end(self) -> None:
        self.nodes[self.key][5].append(self.conv)

    def rows(self) -> pa.RecordBatch:
        of = list(self.nodes.values())
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        columns = [pa.array([self.base] * len(of), pa.int64()), pa.array(list(self.nodes), pa.binary()), *(pa.array([x[k] for x in of], t) for k, t in enumerate(kinds))]
        self.nodes = {}
        return pa.RecordBatch.from_arrays(columns, ["base", "key", "parent", "depth", "words", "least", "members", "ended"])


def families(turns: DataFrame) -> DataFrame:
    """The nodes of each family's trie: base, key, parent, depth, words of the last turn, least member, members as bits, ids
    that end there."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = None
        for batch in batches:
            for base, conv, digest, words in zip(*(batch.column(k).to_pylist() for k in ("base", "conv", "digest", "words")), strict=True):
                if family is None or base != family.base:
                    if family:
                        family.end()
                        yield from (*family.parts, family.rows())
                    family = _Family(base)
                    family.begin(conv)
                elif conv != family.conv:
                    family.end()
                    family.begin(conv)
                family.turn(digest, words)
                yield from family.parts
                family.parts.clear()
        if family:
            family.end()
            yield from (*family.parts, family.rows())

    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_turns = turns.withColumn("later", F.col("conv") != F.col("base")).repartition(parts, "base")
    near = sorted_turns.sortWithinPartitions("base", "later", "conv", F.asc_nulls_first("turn"), "role", "digest")
    return near.select("base", "conv", "digest", "words").mapInArrow(build, _NODE)


def _before(nodes: DataFrame) -> DataFrame:
    """key, above: what the chain of a node's owner holds above the node, by blocks of depths."""
    blocks = nodes.groupBy("conv", F.floor(F.col("depth") / BLOCK).alias("block")).agg(F.sum("value").alias("value"))
    ahead = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("value").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = nodes.select("key", "conv", "depth", "value", F.floor(F.col("depth") / BLOCK).alias("block"))
    placed = placed.withColumn("inside", F.coalesce(F.sum("value").over(inside), F.lit(0)))
    return placed.join(blocks, ["conv", "block"]).select("key", (F.col("ahead") + F.col("inside")).alias("above"))


def _ends(family: DataFrame) -> DataFrame:
    """key, ends_sha256: the digest of the ids that end at each node, ascending, joined by commas."""
    ids = family.where(F.size("ended") > 0).select("key", F.explode("ended").alias("conv"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    ranges = ids.groupBy("key", F.floor(F.col("conv") / IDS).alias("range")).agg(text.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k == key:
                    sha.update(b"," + ids.encode())
                else:
                    if sha:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
            yield _pairs(done)
        if sha:
            yield _pairs([(key, sha.hexdigest())])

    parts = int(family.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(parts, "key").sortWithinPartitions("key", "range").mapInArrow(digest, "key binary, ends_sha256 string")


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([h for _, h in rows], pa.string())], ["key", "ends_sha256"])


def _of_members(of: str) -> Column:
    """The sum over the chains of a family whose conversations are members."""
    mine = F.filter("chains", lambda x: x["bit"].bitwiseAND(F.col("members")) != 0)
    return F.coalesce(F.aggregate(mine, F.lit(0).cast("long"), lambda total, x: total + x[of]), F.lit(0))


def prefix_trie(rows: DataFrame) -> DataFrame:
    """key, parent_key, conv_id, depth, parent_conv_id, words, n_convs, n_ends, n_children, n_leaves, saved_tokens, ends_sha256."""
    with kept(families(turns_of(rows))) as family:
        sums = (F.min("least").alias("conv"), F.sum(F.bit_count("members").cast("long")).alias("n_convs"), F.sum(F.size("ended").cast("long")).alias("n_ends"))
        one = [F.first(c).alias(c) for c in ("parent", "depth", "words")]
        with kept(family.groupBy("key").agg(*sums, *one).withColumn("value", (F.col("n_convs") - 1) * F.col("words"))) as nodes:
            leaf = F.max((F.col("n_convs") == F.col("n_ends")).cast("long")).alias("leaf")
            chains = nodes.groupBy("conv").agg(F.sum("value").alias("value"), leaf)
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("conv") % FAMILY + FAMILY - 1).cast("int"))
            chains = chains.select((F.col("conv") - F.col("conv") % FAMILY).alias("base"), F.struct(bit.alias("bit"), "value", "leaf").alias("chain"))
            of_family = chains.groupBy("base").agg(F.collect_list("chain").alias("chains"))  # fewer than 40
            sent = family.join(of_family, "base", "left").select("key", _of_members("value").alias("value"), _of_members("leaf").alias("leaf"))
            below = sent.groupBy("key").agg(F.sum("value").alias("below"), F.sum("leaf").alias("n_leaves"))
            children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
            parents = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
            out = nodes.join(parents, "parent", "left").join(below, "key").join(_before(nodes), "key").join(children, "key", "left").join(_ends(family), "key", "left")
            out = out.select(
                "key",
                F.col("parent").alias("parent_key"),
                F.col("conv").alias("conv_id"),
                "depth",
                "parent_conv_id",
                "words",
                "n_convs",
                "n_ends",
                F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                "n_leaves",
                (F.col("below") - F.col("above")).alias("saved_tokens"),
                F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
            )
            return durable(out)
