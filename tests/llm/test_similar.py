"""Near-duplicates by exact Jaccard similarity of shingle sets against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quillet.llm import simhash, similar

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def shingles(t):
    w = t.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def pairs_at(rng, low, high, n, words=120):
    """Isolated pairs of texts with a similarity from low to high."""
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(8))
    out = []
    while len(out) < n:
        a = [word() for _ in range(words)]
        b = list(a)
        while alike(" ".join(a), " ".join(b)) > high:
            b[rng.randrange(words)] = word()
        if alike(" ".join(a), " ".join(b)) >= low:
            out.append((" ".join(a), " ".join(b)))
    return out


def kept_of(spark, pairs):
    rows = [(2 * k + side, t) for k, p in enumerate(pairs) for side, t in enumerate(p)]
    return {r["doc_id"] for r in simhash.keep_first(docs_of(spark, rows), **corpus_pipeline.NEAR).collect()}


def test_all_pairs_at_the_threshold_are_found(spark):
    pairs = pairs_at(random.Random(1), 0.8, 0.85, 300)
    assert kept_of(spark, pairs) == {2 * k for k in range(300)}


def test_pairs_below_the_threshold_stay(spark):
    pairs = pairs_at(random.Random(2), 0.70, 0.78, 200)
    assert len(kept_of(spark, pairs)) == 400


def test_components_are_those_of_brute_force(spark, monkeypatch):
    from quillet.llm import similar

    rng = random.Random(3)
    texts = ["", None, "one", "One", "a b c d e", "a b c d e f", "a b c d e a b c d e"]
    for _ in range(4):  # drifting copies: some alike, some not, in blocks of all sizes
        w = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for _ in range(40):
            if rng.random() < 0.5:
                w[rng.randrange(100)] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(w[: rng.randrange(85, 101)]))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and alike(texts[i] or "", texts[j] or "") >= 0.8:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    for small, members in ((8, 4096), (3, 5)):
        monkeypatch.setattr(similar, "SMALL", small)
        monkeypatch.setattr(similar, "MEMBERS", members)
        assert {r["doc_id"] for r in simhash.keep_first(docs_of(spark, enumerate(texts)), **corpus_pipeline.NEAR).collect()} == set(root)


def test_a_block_of_like_texts_is_compared_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillet.llm import similar

    rng = random.Random(8)
    page = [f"w{k}" for k in range(60)]
    texts = [" ".join(page[:20] + [f"v{k}"] + page[20:]) for k in range(1500)]  # alike in pairs, none equal
    far = [" ".join(page[:30] + [f"u{k}x{j}" for j in range(20)] + page[30:]) for k in range(30)]
    sent = []
    whole = similar._led
    monkeypatch.setattr(similar, "MEMBERS", 64)
    monkeypatch.setattr(similar, "_led", lambda *a: sent.append(whole(*a)) or sent[-1])
    rows = list(enumerate(texts)) + [(5000 + k, t) for k, t in enumerate(far)]
    rng.shuffle(rows)
    kept = {r["doc_id"] for r in simhash.keep_first(docs_of(spark, rows), **corpus_pipeline.NEAR).collect()}
    assert kept == {0} | {5000 + k for k in range(30)}
    left = sent[0][1].groupBy("key").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in left) < 1500  # of the many blocks of 1500 almost nothing is dealt to pairs of pieces


def test_unlike_texts_of_one_id_stay(spark):
    pairs = pairs_at(random.Random(4), 0.9, 0.95, 12)
    rows = [(None, a) for a, _ in pairs[:6]] + [(7, a) for a, _ in pairs[6:]]
    near = [(100 + k, b) for k, (_, b) in enumerate(pairs)]  # each near one of the texts above, none near each other
    got = simhash.keep_first(docs_of(spark, rows + near + rows[:2] + rows[-2:]), **corpus_pipeline.NEAR).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted((i or 0, t) for i, t in rows)


def test_simhash_links_are_candidates(spark, monkeypatch):
    """fingerprints within two bits bring sets together, and one pair more of equal fingerprints; the check follows."""
    draw = np.random.default_rng(11)
    words = [f"w{k}" for k in draw.integers(0, 10**9, 900)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[::-1]), ""]
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "id long, th long, text string")
    nodes = similar.signatures(rows, 5).withColumn("node", F.col("id"))
    sims = {r["id"]: r["sim"] for r in nodes.collect()}
    bits = lambda a, b: (int.from_bytes(sims[a]) ^ int.from_bytes(sims[b])).bit_count()
    assert bits(0, 1) <= 2 < bits(0, 2)
    assert [tuple(r) for r in similar.alike(nodes).collect()] == [(0, 1)]
    equal = nodes.where("id = 0").unionByName(nodes.where("id = 0").withColumn("node", F.lit(7).cast("long")))
    assert [tuple(r) for r in similar.alike(equal).collect()] == [(0, 7)]
    asked = []
    monkeypatch.setattr(similar, "alike", lambda n, f=similar.alike: asked.append(1) or f(n))
    assert sorted(r["id"] for r in similar.firsts(rows, 5, 0.8).collect()) == [0, 2, 3] and asked
