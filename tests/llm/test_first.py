"""Chat formatting, URL filters, source mixing and SimHash against plain Python."""

import fnmatch
import itertools
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillet.llm import chat, mixing, simhash, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, id long, key string"


def docs_of(spark, rows):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, "y") for i, t, s in rows], DOCS)


def chat_escape(text):
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nhi", "<\\|", "<\\\\|im_next|>", "|>", "<", "", None, "é<|", "x" * 50000]
    rows = [(c, t, random.Random(c * 31 + t).choice(["user", "assistant", "a|b\n%7C", None]), nasty[(c + t) % len(nasty)], "z") for c in range(6) for t in range(9)]
    rows += [(8, t, "user" if t % 3 else "assistant", f"{t}é<|" * (t % 5), "z") for t in range(700)]
    rows += [(7, 1, "user", "same", "z"), (7, 1, "user", "same", "z"), (None, None, "assistant", "no id", "z")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    got = {r["conv_id"]: r for r in out.select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text("formatted", "mask").alias("loss")).collect()}
    want = {}
    for c, t, role, text, _ in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [tuple(x) for x in got[c]["back"]] == [x[1:] for x in turns]
        assert got[c]["loss"] == "".join(x[2] for x in turns if x[1] == "assistant")
        assert got[c]["n_turns"] == len(turns)
        under = [got[c]["formatted"][m["start"] : m["start"] + m["length"]] for m in got[c]["mask"]]
        assert under == [chat_escape(x[2]) for x in turns if x[1] == "assistant" and x[2]]
        assert got[c]["formatted"].count("<|im_start|>") == got[c]["n_blocks"] == len(list(itertools.groupby(x[1] for x in turns)))


def test_chat_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_shift_and_is_fnmatch():
    rng = random.Random(3)
    globs = ["*ab*", "a?b", "*", "", "ab*ba", "?*?", "*a*b*a*", "x" * 70 + "*", "*" + "ab" * 40] + ["".join(rng.choice("ab?*") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    texts = ["".join(rng.choice("abx") for _ in range(rng.randrange(0, 12))) for _ in range(200)] + ["x" * 90, "ab" * 50, ""]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    fits = urls.ShiftAnd(globs).match(buf, at)
    assert fits.tolist() == [[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts]


def test_urls(spark):
    rules = [urls.Rule.site(v, r) for v, r in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))]
    cases = {
        "http://A.Example.NET/en/1?x=/de/": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "https://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "https://example.com/de/1": ("example.com", "/de/1", "example.com/de/", "block"),
        "https://x.example.com/a.net/en/": ("x.example.com", "/a.net/en/", None, "allow"),
        "https://net": ("net", "", None, "allow"),
        "https://net/": ("net", "/", "net/", "block"),
        "https://x.org/fr/y://z#f": ("x.org", "/fr/y://z", "org/fr/", "allow"),
        "https://www.casino-win.example.com/en/": ("www.casino-win.example.com", "/en/", None, "block"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://x.com/" + "a" * 5000 + "casino": ("x.com", "/" + "a" * 5000 + "casino", None, "block"),
    }
    rows = [(k, u, "h", "r") for k, u in enumerate(cases)] + [(None, None, "h", "r")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string, rule string"), rules).collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0])) == [(k, *v) for k, v in enumerate(cases.values())] + [(None, "", "", None, "allow")]


def test_knapsack_is_best():
    rng = random.Random(5)
    for _ in range(60):
        lengths = np.array(sorted({rng.randrange(1, 30) for _ in range(5)}))
        counts = np.array([rng.randrange(0, 4) for _ in lengths])
        budget = rng.randrange(0, 120)
        sums = {sum(a * b for a, b in zip(lengths.tolist(), c)) for c in itertools.product(*(range(x + 1) for x in counts.tolist()))}
        take = mixing.bounded_knapsack(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert (take * lengths).sum() == max(s for s in sums if s <= budget)


def plain_targets(sizes, weights, factor, most):
    """Shares by weight; whoever is above its cap is set to it, and the rest is shared again."""
    full, total = {}, factor * sum(sizes)
    while True:
        left, open_ = total - sum(full.values()), [k for k in range(len(sizes)) if k not in full]
        share = {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = [k for k in open_ if share[k] > most * sizes[k]]
        if not over:
            return [full.get(k, share.get(k)) for k in range(len(sizes))]
        full |= {k: most * sizes[k] for k in over}


def test_fit_counts_of_many_lengths():
    rng = np.random.default_rng(3)
    for n, top in ((5, 9), (4000, 20_000), (300, 1_000_000), (1, 7)):
        lengths = np.unique(rng.integers(0, top, n))
        counts = rng.integers(1, 50, len(lengths))
        total = int((lengths * counts).sum())
        for budget in (0, 1, total // 7, total // 2, total - 1, total, total + 5):
            take = mixing.fit_counts(lengths, counts, budget)
            assert (take >= 0).all() and (take <= counts).all() and int((take * lengths).sum()) <= max(0, budget)
            if n > 100 and budget not in (1, total - 1):  # with so many lengths the budget is met to the word, and no length is favoured
                assert int((take * lengths).sum()) == min(budget, total)
                if 0 < budget < total:
                    half = len(lengths) // 2
                    share = [(take[k] * lengths[k]).sum() / max(1, (counts[k] * lengths[k]).sum()) for k in (slice(0, half), slice(half, None))]
                    assert abs(share[0] - share[1]) < 0.02


def test_targets_of_many_sources(spark):
    rng = random.Random(4)
    sizes = {"".join(rng.choice("aBé𝄞z") for _ in range(5)): rng.choice((0, 3, 50, 1000, 100_000)) for _ in range(200)} | {None: 77}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows, (3, 1, 2), 1.5, 2.0).collect()}
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None]
    want = plain_targets([sizes[n] for n in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5, 2)
    assert all(abs(got[n] - t) < 1e-6 * max(1, t) for n, t in zip(names, want, strict=True))


def test_mix_deals_a_hot_length(spark):
    rows = [(i if i % 3 else None, f"w{i} x y", "hot") for i in range(3000)] + [(9000 + i, "a b", None) for i in range(5)]
    out = mixing.mix(docs_of(spark, rows)).collect()
    hot = [r["taken"] for r in out if r["source"] == "hot"]
    assert len(out) == len(rows) and set(hot) <= {3, 6} and abs(sum(hot) - out[0]["target"]) <= 3 or out[0]["source"] is None


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "b", "b", "b", "b", None])) for i in range(600)]
    rows += [(600, None, "a"), (601, "x", "Z"), (601, "x", "Z"), (None, "p\tq", "a")]
    out = mixing.mix(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs_of(spark, rows).repartition(3)).collect()), key=str)
    size = {}
    for r in rows:
        size[r[2]] = size.get(r[2], 0) + len((r[1] or "").split())
    names = sorted([x for x in size if x is not None]) + [None]
    want = np.array(plain_targets([size[n] for n in names], [3, 1, 2, 3], 1.5, 2))
    for n, t in zip(names, want):
        mine = [r for r in out if r["source"] == n]
        assert all(abs(r["target"] - t) < 1e-6 and r["source_size"] == size[n] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - t) <= 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert abs(sum(want) - 1.5 * sum(size.values())) < 1e-6 and (want <= 2 * np.array([size[n] for n in names]) + 1e-9).all()


def test_mix_empty(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0


def plain_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_components(fps, distance):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


def near_texts(rng, n):
    base = [" ".join(rng.choice("the of and Élan in Über to x y z".split()) + str(rng.randrange(50)) for _ in range(300)) for _ in range(6)]
    out = []
    for _ in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(9)
        out.append(" ".join(w))
    return out


def test_simhash(spark, monkeypatch):
    rng = random.Random(2)
    texts = near_texts(rng, 140) + ["", None, "one", "One two", "a b c", "A  b\tc", "\u00a0", "word " * 20000]
    rows = [(i + 10, t, "s") for i, t in enumerate(texts)]
    fps = [plain_fingerprint(t) for t in texts]
    want = [(i + 10, f"{fps[i]:016x}", r + 10) for i, r in enumerate(plain_components(fps, 2))]
    for small, piece in ((48, 4096), (3, 4)):
        monkeypatch.setattr(simhash, "SMALL", small)
        monkeypatch.setattr(simhash, "PIECE", piece)
        got = simhash.near_duplicates(docs_of(spark, rows))
        assert sorted(map(tuple, got.collect())) == want


def test_simhash_nulls_and_empty(spark):
    got = simhash.near_duplicates(docs_of(spark, [(None, "a b c", "s"), (3, "a b c", "s"), (3, "a b c", "s")])).collect()
    assert [(r[0], r[2]) for r in sorted(got, key=lambda r: (r[0] is not None, r[0]))] == [(None, None), (3, None), (3, None)]
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
