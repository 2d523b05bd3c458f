"""The toxicity query against a fit and scores in plain Python, dense and without batches."""

import math
import random
import re
from collections import Counter

import numpy as np

from quillet.llm import queries, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, labels):
    known = [(re.findall(r"[a-z0-9]+", t.lower()), labels[i]) for i, t in rows if i in labels]
    n1 = sum(g for _, g in known)
    n0, d1, d = len(known) - n1, Counter(), Counter()
    for words, g in known:
        for w in set(words):
            d[w] += 1
            d1[w] += g
    signs = []
    for w in d:
        p1, p0, p = d1[w] / n1, (d[w] - d1[w]) / n0, d[w] / len(known)
        if d1[w] >= toxicity.LEAST_DOCS and (p1 - p0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12) >= toxicity.LEAST_Z:
            signs.append(w)
    x_of = lambda words: np.array([math.log1p(words.count(w)) for w in signs])
    x, y = np.array([x_of(w) for w, _ in known]), np.array([g for _, g in known])
    w, limit = np.zeros(len(signs)), 2.0
    m, v = np.zeros(len(signs) + 1), np.zeros(len(signs) + 1)
    for step in range(1, 601):
        off = 1 / (1 + np.exp(limit - x @ w)) - y
        grad = np.append(x.T @ off / len(y) + 1e-5 * w, -off.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, limit = w - move[:-1], limit - move[-1]
    return {i: 1 / (1 + math.exp(limit - x_of(re.findall(r"[a-z0-9]+", t.lower())) @ w)) for i, t in rows}, signs


def test_query(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(6))
    rows, labels = [], {}
    for k in range(500):
        w = [word() for _ in range(rng.randrange(5, 60))]
        bad = k % 4 == 0
        for _ in range(rng.randrange(1, 4) if bad else rng.random() < 0.05):
            w.insert(rng.randrange(len(w)), rng.choice(("Idiot", "moron,", "scum")))
        rows.append((k, " ".join(w)))
        if k % 3:
            labels[k] = int(bad)
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, g) for i, g in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_toxicity"](spark, str(tmp_path)).collect()}
    want, signs = plain(rows, labels)
    assert set(signs) == {"idiot", "moron", "scum"} and len(got) == 500
    assert all(abs(got[i]["expected_severity"] - p) < 1e-4 and got[i]["toxic"] == (p > 0.5) for i, p in want.items())
    assert sum(got[k]["toxic"] == (k % 4 == 0) for k in range(0, 500, 3)) > 0.93 * 167
