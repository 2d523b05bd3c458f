"""Substring dedup and its index against all windows and all matches tried in turn."""

import hashlib
import random
import re

import numpy as np
import pytest

from quillet.llm import arrays, fmindex, queries, substrings

DOCS = "doc_id long, text string, words string, id long, kept long"


def plain(rows):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    order = lambda i: -(2**63) if i is None else i
    least = {}
    for (i, *_), w in zip(rows, lists, strict=True):
        for k in range(len(w) - 49):
            least[tuple(w[k : k + 50])] = min(order(i), least.get(tuple(w[k : k + 50]), 2**63))
    out = []
    for (i, *_), w in zip(rows, lists, strict=True):
        gone = {x for k in range(len(w) - 49) if least[tuple(w[k : k + 50])] < order(i) for x in range(k, k + 50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def texts(rng):
    say = lambda n, k=4000: [f"w{rng.randrange(k)}" for _ in range(n)]
    shared = [say(rng.choice((50, 51, 60, 90, 300))) for _ in range(6)] + [["x"] * 80, say(200, 2)]
    out = [say(rng.randrange(0, 120)) for _ in range(15)]
    for _ in range(70):
        w = say(rng.randrange(30)) + rng.choice(shared) + say(rng.randrange(30)) + rng.choice(([], [], rng.choice(shared)))
        if rng.random() < 0.3 and w:
            w[rng.randrange(len(w))] = "edit"
        out.append(w)
    out += [out[3], out[20], out[20], ["y"] * 49, ["y"] * 50, ["z"] * 200, ["z"] * 120, say(3000), shared[4] * 2, ["ab", "c"] * 60, []]
    long = ["é" * 90, "ü" * 200] * 40
    return [rng.choice((" ", "\n", " \t\x0b")).join(w) for w in out] + [" ".join(long), " ".join(long[1:]), None, "  "]


def rows(rng):
    some = texts(rng)
    ids = rng.sample(range(-20, 500), len(some))
    out = [(i, t, "a", 1, 2) for i, t in zip(ids, some, strict=True)]
    return out + [(None, some[30], "", 0, 0), (None, some[31], "", 0, 0), (ids[2], some[40], "", 0, 0), (ids[2], some[40], "", 0, 0), (ids[5], some[5], "", 0, 0)]


@pytest.mark.parametrize("shard", [2048, 3])
def test_query(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(substrings, "SHARD", shard)
    monkeypatch.setattr(substrings, "PART", min(shard, 512))
    some = rows(random.Random(shard))
    spark.createDataFrame(some, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_substring_dedup"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == plain(some)


def test_kept_text_and_no_rows(spark):
    one = " ".join(f"w{k}" for k in range(60))
    found = substrings.dedup(spark.createDataFrame([(2, "in  front " + one + "\nbehind", "", 0, 0), (1, one, "", 0, 0)], DOCS))
    assert sorted(map(tuple, found.collect())) == [(1, 60, 0, one), (2, 63, 60, "in front behind")]
    assert substrings.dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_matching_statistics():
    rng = random.Random(2)
    for _ in range(60):
        k = rng.choice((1, 2, 3, 8))
        pieces = [[rng.randrange(k) for _ in range(rng.randrange(0, 30))] for _ in range(rng.randrange(1, 9))]
        owner, below = (np.array([rng.randrange(n) for _ in pieces]) for n in (5, 7))
        text, sizes = np.array(sum(pieces, []), np.int64), np.array([len(p) for p in pieces], np.int64)
        end = np.cumsum(sizes)
        got = fmindex.FmIndex(text, sizes, k, owner).matching_statistics(text, end - sizes, end, below, 1)
        want = []
        for p, most in zip(pieces, below, strict=True):
            others = ["".join(map(str, q)) for q, o in zip(pieces, owner, strict=True) if o < most]
            want += [max((n for n in range(len(p) - j + 1) if any("".join(map(str, p[j : j + n])) in q for q in others)), default=0) for j in range(len(p))]
        assert got.tolist() == want


def test_ranks_of_the_wavelet_tree():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 5, 64, 100):
        text = rng.integers(0, alphabet, 200)
        tree = fmindex.WaveletTree(text, alphabet)
        symbol, place = rng.integers(0, alphabet, 300), rng.integers(0, 201, 300)
        assert tree.rank(symbol, place).tolist() == [int((text[:p] == s).sum()) for s, p in zip(symbol, place, strict=True)]


def test_suffixes_prefixes_minima():
    rng = random.Random(3)
    for _ in range(40):
        pieces = [[rng.randrange(3) for _ in range(rng.randrange(0, 20))] for _ in range(rng.randrange(1, 6))]
        codes = np.array([x for k, p in enumerate(pieces) for x in (*(y + len(pieces) for y in p), k)], np.int64)
        order, rank = arrays.sort_suffixes(codes)
        text = codes.tolist()
        assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:]) and order[rank].tolist() == list(range(len(text)))
        end = np.cumsum([len(p) + 1 for p in pieces]) - 1
        begin = np.concatenate([[0], end[:-1] + 1])
        common = arrays.common_prefixes(codes, order, rank)
        assert arrays.common_prefixes_of_pieces(codes, begin, end, order, rank).tolist() == common
        low = arrays.Minima(np.array([-1, *common, -1]))
        for k in range(1, len(common) + 1):
            before, after = low.smaller_around(np.array([k]), np.array([common[k - 1]]))
            around = [-1, *common, -1]
            assert before[0] == max(m for m in range(k) if around[m] < common[k - 1]) and after[0] == min(m for m in range(k + 1, len(around)) if around[m] < common[k - 1])
            assert low.least(np.array([0]), np.array([k]))[0] == min(around[:k])
