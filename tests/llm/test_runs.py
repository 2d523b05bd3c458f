"""Periodic runs against every period of every document tried in turn."""

import hashlib
import random
import re
import zlib

import pytest

from quillet.llm import queries, runs

DOCS = "doc_id long, text string, runs string, collapsed string, doc long"


def plain(words, least=12):
    """(start, length, period) of all runs, by comparing words each period apart."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start >= q and i - start + q >= least:
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words)
    s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return doc_id, len(found), s, m, q, 1000 * m // q if found else None, sha("".join("%d,%d,%d\n" % r for r in found)), sha(kept)


def words(rng):
    out = [b"%d" % rng.randrange(rng.choice((1, 2, 3, 50))) for _ in range(rng.randrange(60))]
    if rng.random() < 0.5:
        out += out[: rng.randrange(1, 9)] * rng.randrange(2, 9) + [b"%d" % rng.randrange(3) for _ in range(rng.randrange(20))]
    return out * rng.choice((1, 1, 1, 2))


@pytest.mark.parametrize("least", [12, 4, 1, 7])
def test_runs_of_lists(least):
    rng = random.Random(least)
    for _ in range(60):
        lists = [words(rng) for _ in range(rng.randrange(0, 8))]
        assert [list(map(tuple, r.tolist())) for r in runs.runs_of(lists, least)] == [plain(w, least) for w in lists]


def test_many_runs_in_one_text():
    a, b = [b"a"], [b"a", b"b"]
    for _ in range(11):  # a Fibonacci word is full of runs
        a, b = b, b + a
    assert list(map(tuple, runs.runs_of([b])[0].tolist())) == plain(b)


def test_long_texts_and_chunks_of_leaves(monkeypatch):
    rng = random.Random(3)
    text = [b"%d" % rng.randrange(2) for _ in range(3000)]
    whole = runs.runs_of([text])[0].tolist()
    assert list(map(tuple, whole)) == plain(text)
    monkeypatch.setattr(runs, "LEAVES", 50)
    assert runs.runs_of([text])[0].tolist() == whole
    assert runs.runs_of([[b"x"] * 200_000])[0].tolist() == [[0, 200_000, 1]]
    assert runs.runs_of([b"a b c d e f g".split() * 20_000])[0].tolist() == [[0, 140_000, 7]]


def rows(rng):
    out = [(k, b" ".join(words(rng)).decode(), "x", "y", k) for k in range(120)]
    out += [(500, None, None, None, 0), (501, "", "", "", 0), (502, " \x0b\t\n ", "", "", 0), (None, "a b " * 20, "", "", 0), (3, "again " * 30, "", "", 0)]
    out += [(3, "again " * 30, "", "", 0), (503, "é ü x " * 40, "", "", 0), (504, "w" * 40 + " ", "", "", 0), (505, "n  " * 12, "", "", 0), (-20, "p q r " * 9, "", "", 0)]
    return out


def test_query(spark, tmp_path):
    some = rows(random.Random(4))
    spark.createDataFrame(some, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain_row(i, t) for i, t, *_ in some), key=str)


def test_texts_and_no_rows(spark):
    found = runs.find_runs(spark.createDataFrame([(7, " x  y " + "la " * 12 + "z", "", "", 0)], DOCS))
    assert found.select("n_words", "collapsed").collect() == [(15, "x y la z")]
    assert runs.find_runs(spark.createDataFrame([], DOCS)).collect() == []
