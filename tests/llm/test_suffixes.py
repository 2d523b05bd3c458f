"""Suffix-array dedup against all strings counted in a dictionary."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quillet.llm import suffixes

DOCS = "doc_id long, text string, body string, id long, anchor long"


def plain(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by counting every 200-byte string."""
    n = suffixes.LENGTH
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[k : k + n] for t in texts for k in range(len(t) - n + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - n + 1):
            if count[t[k : k + n]] > 1:
                gone[k : k + n] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(rng):
    words = "the of and Ñandú größe là a ab abc".split() + [str(k) for k in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(60) for _ in range(4)]
    out = [say(rng.randrange(0, 120)) for _ in range(25)]
    for _ in range(40):  # passages in the middle, at either end, with an edit
        t = say(rng.randrange(0, 60)) + rng.choice(shared) + say(rng.randrange(0, 60))
        if rng.random() < 0.4:
            k = rng.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        out.append(t)
    out += [out[3], out[30], "x" * 199, "x" * 200, "y" * 201, "z" * 700, "ab" * 300, "\0" * 400, "", None, shared[0], say(3000)]
    return out + [say(20) + "ab" * 150 + say(20)]


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    for text in (b"banana", b"", b"a", b"\0\0\0", b"abab" * 40, bytes(rng.choice(b"ab") for _ in range(700))):
        order, _ = suffixes.suffix_array(np.frombuffer(text, np.uint8))
        assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:])
        cuts = sorted({0, *(rng.randrange(len(text)) for _ in range(5))}) if text else []
        common = suffixes.kasai(np.frombuffer(text, np.uint8), np.array(cuts, np.int64), order, 50)
        for a, b, h in zip(order[:-1].tolist(), order[1:].tolist(), common[1:].tolist(), strict=True):
            x, y = text[a : a + 50], text[b : b + 50]
            assert h == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def test_owners_are_the_first_least_of_each_window():
    rng = np.random.default_rng(4)
    for n, w in ((1, 3), (3, 3), (40, 7), (200, 151), (1000, 151)):
        h = rng.integers(0, 30, n).astype(np.uint64)
        want = [k + int(h[k : k + w].argmin()) for k in range(n - w + 1)]
        assert suffixes.owners(h << np.uint64(32), w).tolist() == want


@pytest.mark.parametrize("shard", [1024, 2])
def test_dedup(spark, monkeypatch, shard):
    monkeypatch.setattr(suffixes, "SHARD_PIECES", shard)
    monkeypatch.setattr(suffixes, "MERGE_ROWS", 50)
    rows = [(k, t) for k, t in enumerate(texts(random.Random(7)))] + [(None, "no id " * 60)]
    got = suffixes.dedup(spark.createDataFrame([(i, t, "b", 1, 2) for i, t in rows], DOCS)).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows), key=str)


def test_repeats_and_empty(spark):
    rows = [(1, "one two three " * 40), (1, "one two three " * 40), (2, "lone " + "".join(chr(97 + k % 26) + str(k) for k in range(200)))]
    got = suffixes.dedup(spark.createDataFrame([(i, t, "b", 1, 2) for i, t in rows], DOCS)).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows))
    assert suffixes.dedup(spark.createDataFrame([], DOCS)).count() == 0
