"""Weighted sampling of long texts against exact generalised Jaccard similarity."""

import numpy as np

from quillet.llm import sampling


def test_long_texts_with_uneven_weights(spark, monkeypatch):
    """Texts that share 20 frequent words, half of all words, and nothing else: similarity 1/3."""
    rows = []
    for k, n in enumerate((20000, 20000, 100000)):
        for side in "ab":
            rows.append((k, side, " ".join([f"common{k}x{j % 20}" for j in range(n // 2)] + [f"{side}{k}x{j}" for j in range(n // 2)])))
    texts = spark.createDataFrame(rows, "k int, side string, text string")
    off = {0: [], 1: [], 2: []}
    for seed in (7919, 100, 1000, 2000):
        monkeypatch.setattr(sampling, "SEED", seed)
        fp = {(r["k"], r["side"]): r["fingerprint"] for r in sampling.signatures(texts, ["k", "side"]).collect()}
        for k in off:
            off[k].append(np.mean([fp[k, "a"][i : i + 2] == fp[k, "b"][i : i + 2] for i in range(0, 128, 2)]))
    print({k: float(np.mean(v)) for k, v in off.items()})
    assert all(abs(np.mean(v) - 1 / 3) < 0.1 for v in off.values())  # 256 samples: a deviation of 0.03
