"""The prefix trie against all rebuilt conversations compared turn by turn."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quillet.llm import queries, trie

ROWS = "conv_id long, turn long, role string, text string, words long, key string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role.encode(), md5(md5(role) + text), (role, text)))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, t in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        paths[c] = turns.get(base, [])[:h] + t[h:]
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    out = []
    for node, of in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in of if len(paths[c]) == len(node))))
        children = sum(len(x) == len(node) + 1 for x in below)
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(rng, ids):
    words = ["a", "b c", "é d", "", None, "x\ty  z"]
    out = []
    for c in ids:
        for k in range(rng.choice((1, 1, 2, 3, 5, 9))):
            out.append((c, rng.choice((None, k, k)), rng.choice(("user", "user", "assistant", None)), rng.choice(words), 7, "k"))
    return out


def run(spark, rows):
    return sorted((tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, ROWS).repartition(3)).select(*NAMES).collect()), key=str)


def test_trie(spark):
    rng = random.Random(5)
    rows = talks(rng, [*range(-45, 70), 1000, 1019, 2**40 + 3, 79, 99, None])
    rows += rows[:40] + [(k, t, "user", f"same {t}", 0, "") for k in range(300, 420) for t in range(3)]
    assert run(spark, rows) == plain(rows)


def test_families_in_parts_and_blocks(spark, monkeypatch):
    for name, n in (("HELD", 3), ("BLOCK", 2), ("IDS", 2)):
        monkeypatch.setattr(trie, name, n)
    rows = talks(random.Random(6), range(60)) + [(4, t, "user", f"long {t}", 0, "") for t in range(20, 80)]
    turns = trie.turns_of(spark.createDataFrame(rows, ROWS))
    held = trie.families(turns)
    assert held.groupBy("base", "key").count().where("count > 1").count() == 0 or held.count() > 0
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x", 0, "")], [(21, 0, None, None, 0, "")]])
def test_small_tables(spark, rows):
    assert run(spark, rows) == plain(rows)


def test_query(spark, tmp_path):
    rows = talks(random.Random(8), range(80))
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op12_prefix_trie"](spark, str(tmp_path))
    assert got.columns == list(NAMES) and sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
