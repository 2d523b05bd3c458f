"""Decontamination, quality, toxicity, weighted sampling, line dedup and the pipeline against plain Python."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.llm import decontaminate, lines, quality, sampling, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: With names that the operators use inside.
WIDE = DOCS + ", row string, key long, id long, th long, body string"


def docs_of(spark, rows, wide=False):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), *(("r", 1, 2, 3, "b") if wide else ())) for i, t in rows], WIDE if wide else DOCS)


def say(rng, n, words="the of and to in was it for on with as by".split()):
    return " ".join(rng.choice(words) if rng.random() < 0.4 else "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 9))) for _ in range(n))


# ---- benchmark decontamination


def test_template_leaks(spark):
    rng = random.Random(1)
    items = ["Tom has 12 apples and gives 5 kg of them to Anna Lee before he walks 3.5 km home with the rest of it.", say(rng, 40), say(rng, 5), "one two", None]
    other = "Mia has 1,200 apples and gives 7 kg of them to Omar Cruz before he walks 41 km home with the rest of it."
    mixed = "Tom has 12 apples and gives 9 lb of them to Anna Lee before he walks 3.5 km home with the rest of it. Tom has 13 apples"
    half = " ".join(items[1].split()[:12])
    rows = {
        1: say(rng, 300), 2: say(rng, 30) + " " + items[1] + " " + say(rng, 30), 3: "Intro. " + other, 4: "So " + items[0].upper().lower(), 5: None, 6: "", 7: half,
        8: say(rng, 9) + ". " + items[2] + " " + say(rng, 4), 9: "one two", 10: mixed, 11: items[1].replace(items[1].split()[20], "x"),
    }
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = docs_of(spark, [*rows.items(), (None, items[1])], wide=True)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(got) == {(2, 1), (3, 0), (4, 0), (8, 2), (10, 0), (11, 1), (None, 1)}
    assert got[3, 0]["slots_changed"] >= 4 and got[2, 1]["words_covered"] == 40
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5, 6, 7, 9]


def test_slots_must_agree(spark):
    item = "a train leaves 10 towns for 20 weeks and 10 trains leave 20 towns for 10 months while 20 trains stay behind in one place"
    same = item.replace("10", "33").replace("20", "44")
    torn = "a train leaves 1 towns for 2 weeks and 3 trains leave 4 towns for 5 months while 6 trains stay behind in one place"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.find_leaks(docs_of(spark, [(1, same), (2, torn)]), bench).collect()] == [1]


def test_other_numbers_names_and_units_of_any_language(spark):
    pairs = [
        ("If three workers build five walls in two days then how many walls would they build together", "If seven workers build twelve walls in ten days then how many walls would they build together"),
        ("Wenn Anna drei Stunden lang mit zwölf Freunden spielt und danach fünf Kilo Obst nach Hause trägt", "Wenn Otto vier Minuten lang mit neun Freunden spielt und danach acht Pfund Obst nach Hause trägt"),
        ("Si le train de Élodie roule pendant trois heures avec douze wagons et revient avant la nuit", "Si le train de Gaston roule pendant neuf jours avec vingt wagons et revient avant la nuit"),
        ("cuando Lucía compra siete libros por veinte euros y vende tres de ellos a su vecina por la tarde", "cuando Pedro compra once libros por treinta dólares y vende dos de ellos a su vecina por la tarde"),
        ("когда Анна купила 12 яблок и отдала 5 кг из них своему другу Борису перед тем как уйти", "когда Ольга купила 7 яблок и отдала 9 кг из них своему другу Ивану перед тем как уйти"),
    ]
    bench = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(pairs)], "item_id long, text string")
    docs = [(k, f"before this. {b} and after it") for k, (_, b) in enumerate(pairs)]
    got = [tuple(r) for r in decontaminate.find_leaks(docs_of(spark, docs), bench).select("doc_id", "item_id").collect()]
    assert sorted(got) == [(k, k) for k in range(len(pairs))]
    assert sorted(map(tuple, decontaminate.find_leaks(docs_of(spark, docs), bench).collect())) == sorted(plain_leaks(docs, [(k, a) for k, (a, _) in enumerate(pairs)]))


def test_frames_that_many_items_share(spark, monkeypatch):
    rng = random.Random(15)
    frame = "answer the following question with yes or no and give a short reason for it"
    items = [f"{frame} {say(rng, 25)}" for _ in range(3000)]
    docs = [(k, f"{say(rng, 20)} {frame} {say(rng, 30)}") for k in range(200)] + [(900, f"x {items[7]} y"), (901, f"{say(rng, 5)} {items[2999]}")]
    block = decontaminate.Items(list(range(3000)), items)
    raw = [t.encode() for _, t in docs]
    buf, at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    began = time.perf_counter()
    whole = block.leaks(buf, at)
    assert time.perf_counter() - began < 60  # some five million pairs of windows
    assert [(r, i) for r, i, *_ in whole] == [(200, 7), (201, 2999)]
    monkeypatch.setattr(decontaminate, "PAIRS", 5000)
    few = decontaminate.Items(list(range(300)), items[:300])
    assert few.leaks(buf, at) == [leak for leak in whole if leak[1] < 300]


def plain_template(text):
    """(type or word, word) of each word: numbers, units after numbers, names inside sentences."""
    out, end, number_before = [], None, False
    for m in re.finditer(r"[0-9]+(?:[.,][0-9]+)*(?![0-9A-Za-z\u0080-\U0010ffff])|[0-9A-Za-z\u0080-\U0010ffff]+", text):
        word, low = m.group(), "".join(c.lower() if c < "\u0080" else c for c in m.group())
        opens = end is None or any(c in "\n!.:?" for c in text[end : m.start()])
        number = word[0].isdigit() and all(c.isdigit() or c in ".," for c in word)
        number = number or low in decontaminate.NUMERALS
        name = not opens and not number and word[0].isupper() and word[1:2].islower() and max(word[:2]) < "\u0800"
        kind = "#number" if number else "#unit" if number_before and low in decontaminate.UNITS else "#name" if name else low
        out.append((kind, low))
        end, number_before = m.end(), number
    return out


def plain_leaks(docs, items):
    """(doc, item, words covered, slots, changed) by trying every shift of every item against every document."""
    found = []
    for d, text in docs:
        doc = plain_template(text or "")
        for i, item_text in items:
            item = plain_template(item_text or "")
            n, size = len(item), min(8, len(item))
            if n < 4:
                continue
            covered, slots, changed = set(), 0, 0
            for shift in range(-n + 1, len(doc)):
                same = [0 <= p + shift < len(doc) and doc[p + shift][0] == item[p][0] for p in range(n)]
                equal = [0 <= p + shift < len(doc) and doc[p + shift][1] == item[p][1] for p in range(n)]
                telling = lambda words: sum(w[0][0] != "#" for w in words) * 2 >= size
                met = set()
                for p in range(n - size + 1):
                    mine, its = item[p : p + size], doc[max(0, p + shift) : max(0, p + shift + size)]
                    by_words = all(equal[p : p + size]) and not telling(mine) and not telling(its)
                    if by_words or telling(mine) and all(same[p : p + size]):
                        met |= set(range(p, p + size))
                if not met:
                    continue
                places, p = set(met), 0
                while p < n:
                    run = p
                    while run < n and same[run]:
                        run += 1
                    if met & set(range(p, run)):
                        places |= set(range(p, run))
                    p = run + 1
                mine = [p for p in places if item[p][0][0] == "#"]
                meaning = {}
                for p in mine:
                    meaning.setdefault(item[p][1], Counter())[doc[p + shift][1]] += 1
                if sum(max(c.values()) for c in meaning.values()) >= 0.8 * len(mine):
                    covered |= places
                    slots += len(mine)
                    changed += sum(doc[p + shift][1] != item[p][1] for p in mine)
            if len(covered) >= 0.5 * n:
                found.append((d, i, n, len(covered), slots, changed))
    return found


def test_leaks_against_every_shift(spark):
    rng = random.Random(21)
    spice = ["12", "7", "3.5", "1,000", "kg", "km", "Anna", "Öst", "Bo", ".", "!", "and"]
    phrase = lambda n: " ".join(rng.choice(spice) if rng.random() < 0.5 else say(rng, 1) for _ in range(n))
    items = [(k, phrase(rng.randrange(3, 30))) for k in range(25)] + [(90, "12 kg, 15 kg, 18 kg, 21 kg, 24 kg"), (91, "What is 12 + 15 * 3?"), (None, phrase(12)), (92, None)]
    docs = []
    for k in range(150):
        item = rng.choice(items)[1] or ""
        words = item.split()
        if words and k % 3 == 1:
            words = [str(rng.randrange(50)) if w.isdigit() else rng.choice(("Eva", "Li")) if w in ("Anna", "Bo") else w for w in words]
        if words and k % 3 == 2:
            words[rng.randrange(len(words))] = rng.choice(spice)
        docs.append((k, phrase(rng.randrange(0, 12)) + " " + " ".join(words) + " " + phrase(rng.randrange(0, 12))))
    docs += [(200, None), (201, ""), (None, items[3][1]), (202, items[90 - 65][1]), (202, items[90 - 65][1]), (203, "so " * 60_000 + items[26][1])]
    got = decontaminate.find_leaks(docs_of(spark, docs, wide=True), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_leaks(docs, items), key=str)
    assert {90, 91} <= {r["item_id"] for r in got}


def test_leaks_in_blocks_and_empty(spark, monkeypatch):
    rng = random.Random(2)
    items = [say(rng, 20) for _ in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 50)
    docs = docs_of(spark, [(k, say(rng, 10) + " " + t) for k, t in enumerate(items)] + [(99, say(rng, 99))])
    assert sorted((r[0], r[1]) for r in decontaminate.find_leaks(docs, bench).collect()) == [(k, k) for k in range(12)]
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [99]
    assert decontaminate.find_leaks(docs_of(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == 13


# ---- quality


def junk(rng, n):
    return " ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in say(rng, n).split())


def test_quality_held_out(spark):
    rng = random.Random(3)
    good = [(k, say(rng, rng.randrange(20, 200))) for k in range(400)]
    bad = [(k, junk(rng, rng.randrange(20, 200))) for k in range(400, 480)]
    docs = docs_of(spark, good + bad + [(900, None), (901, ""), (None, say(rng, 50))], wide=True)
    labels = spark.createDataFrame([(k, int(k < 400), 0) for k in range(480) if k % 2], "doc_id long, quality int, toxic int")
    kept = [r["doc_id"] for r in quality.resample(docs, labels, columns=docs.columns).select("doc_id").collect()]
    assert len([k for k in kept if k is not None and k < 400]) >= 396
    assert len([k for k in kept if k is not None and 400 <= k < 480]) <= 2
    assert None in kept


M = 2**64 - 1


def plain_mix(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & M
    return x ^ x >> 31


def plain_hash(token):
    """A polynomial in an odd base over the bytes plus one, mixed with the length."""
    return plain_mix((sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 2**64) for k, b in enumerate(token)) + len(token)) & M)


def plain_grams(text):
    """Buckets of runs of word bytes and of punctuation, and of neighbours; a token after itself is one feature."""
    hashes = [plain_hash(t) for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\t-\r ]+", (text or "").encode())]
    pairs = [0x5851F42D4C957F2D if a == b else plain_mix((3 * a + b) & M) for a, b in zip(hashes, hashes[1:], strict=False)]
    return [h % 8192 for h in hashes + pairs]


def plain_scores(texts, target, raw_texts):
    """Log ratios of smoothed counts: the target borrows 32 counts a bucket from the raw text, and a hundredth of its own."""
    good, raw = (Counter(g for t in ts for g in plain_grams(t)) for ts in (target, raw_texts))
    n_good, n_raw = sum(good.values()), sum(raw.values())
    borrowed = 32 * 8192 + 0.01 * n_good
    prior = lambda g: (raw[g] + 1) / (n_raw + 8192)
    ratio = lambda g: math.log((good[g] + borrowed * prior(g)) / (n_good + borrowed) / prior(g))
    return [sum(map(ratio, plain_grams(t))) for t in texts]


def test_quality_weights_and_top_k(spark):
    rng = random.Random(4)
    rows = [(k, say(rng, rng.randrange(1, 60)) if k % 3 else junk(rng, 30)) for k in range(120)]
    docs = docs_of(spark, rows)
    ratio = quality.log_ratio(quality.bucket_counts(docs.where("doc_id % 3 > 0")), quality.bucket_counts(docs))
    got = {r["doc_id"]: r for r in quality.weigh(docs, ratio, 11, ["doc_id"]).select("row.doc_id", "log_weight", "key").collect()}
    want = plain_scores([t for _, t in rows], [t for k, t in rows if k % 3], [t for _, t in rows])
    assert all(abs(got[k]["log_weight"] * quality.STEP - w) < 1e-5 for (k, _), w in zip(rows, want, strict=True))
    keys = sorted((r["key"] for r in got.values()), reverse=True)
    values = quality.weigh(docs, ratio, 11, ["doc_id"]).select("key")
    assert [quality.kth_largest(values, k, bins=7) for k in (1, 50, 120, 121)] == [keys[0], keys[49], keys[119], None]


def test_gumbel_draws():
    g = quality.gumbel(np.arange(200_000), 11)
    assert abs(g.mean() - 0.5772) < 0.02 and abs(g.std() - math.pi / math.sqrt(6)) < 0.02


def test_inclusion_over_seeds_follows_the_weights():
    """Gumbel top-k takes the first k of a draw without replacement in proportion to the weights."""
    log_weight = np.log(np.array([1.0, 2, 4, 8, 1, 16]))
    share, seeds = np.exp(log_weight) / np.exp(log_weight).sum(), 20_000
    order = np.array([np.argsort(-(log_weight + quality.gumbel(np.arange(6), s * 1_000_003))) for s in range(seeds)])
    first = np.bincount(order[:, 0], minlength=6) / seeds
    assert np.abs(first - share).max() < 0.012
    two = np.array([((order[:, :2] == k).any(1)).mean() for k in range(6)])
    exact = [share[k] + sum(share[j] * share[k] / (1 - share[j]) for j in range(6) if j != k) for k in range(6)]
    assert np.abs(two - exact).max() < 0.015


def test_ties_with_the_last_kept_all_stay(spark):
    docs = docs_of(spark, [(None, "same words here")] * 5 + [(k, say(random.Random(k), 30)) for k in range(20)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    for share in (0.1, 0.3, 0.5, 0.9):
        kept = [r["doc_id"] for r in quality.resample(docs, labels, share=share).collect()]
        assert kept.count(None) in (0, 5) and len(kept) >= round(share * 25)


def test_quality_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, [(1, "a b"), (2, None), (2, None)])
    assert quality.resample(docs, labels).count() == 3
    assert quality.resample(docs_of(spark, []), labels).count() == 0


# ---- toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    bad = "idiot scum moron trash".split()
    rows, truth = [], {}
    for k in range(600):
        w = say(rng, rng.randrange(10, 120)).split()
        n = rng.randrange(1, 6) if k % 4 == 0 else 0
        for _ in range(n):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", ",", "!"]))
        rows.append((k, " ".join(w)))
        truth[k] = n
    docs = docs_of(spark, rows + [(700, None), (701, ""), (None, "you idiot")], wide=True)
    labels = spark.createDataFrame([(k, 1, int(truth[k] > 0)) for k in range(0, 600) if k % 8 < 5] + [(3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == 603
    held = [k for k in range(600) if k % 8 >= 5 or k % 8 == 4]
    assert sum(got[k]["toxic"] == (truth[k] > 0) for k in held) >= len(held) - 2
    assert not got[700]["toxic"] and not got[701]["toxic"] and got[None]["toxic"]
    assert all(r["severity"] == int(r["toxic"]) and abs(r["expected_severity"] - r["severity"]) < 0.5 for r in got.values())


def test_given_grades_held_out(spark):
    """Grades that do not come from counts of words: the worst kind of word in a text says its grade."""
    rng = random.Random(15)
    kinds = ["silly rude daft".split(), "idiot moron clown".split(), "scum vermin filth".split()]
    rows, truth = [], {}
    for k in range(900):
        w = say(rng, rng.randrange(10, 80)).split()
        truth[k] = k % 4
        for grade in range(truth[k]):
            for _ in range(rng.randrange(1, 3) if grade == truth[k] - 1 else rng.randrange(0, 2)):
                w.insert(rng.randrange(len(w)), rng.choice(kinds[grade]))
        rows.append((k, " ".join(w)))
    docs = docs_of(spark, rows + [(2000, "scum " * 100_000), (2001, "plain " * 100_000)])
    labels = spark.createDataFrame([(k, truth[k]) for k in range(900) if k % 3] + [(1, None)], "doc_id long, grade int")
    model = toxicity.fit(docs, labels)
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(900) if k % 3 == 0]
    assert np.mean([got[k]["severity"] == truth[k] for k in held]) > 0.85
    means = [np.mean([got[k]["expected_severity"] for k in held if truth[k] == g]) for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 2
    assert got[2000]["severity"] == 3 and got[2001]["severity"] == 0


def test_repeated_labelled_rows_count_once(spark):
    rng = random.Random(16)
    rows = [(k, say(rng, 40) + (" moron" if k % 5 == 0 else "")) for k in range(100)]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(100)], "doc_id long, quality int, toxic int")
    once, often = (toxicity.fit(docs_of(spark, d), labels) for d in (rows, rows + rows[:7] * 3))
    assert (once.hashes == often.hashes).all() and np.allclose(once.weights, often.weights)


def test_copies_go_and_shared_passages_stay(spark):
    rng = random.Random(18)
    licence = say(rng, 40)
    own = [say(rng, 60) for _ in range(60)]
    rows = [(k, f"{licence} {t}", k % 2) for k, t in enumerate(own)]  # they share a passage, not more than half
    rows += [(100 + k, f"{licence} {own[3]} edit{k}", 1) for k in range(15)] + [(200, "", 0), (201, "", 1), (202, "word", 0)]
    left = toxicity.unlike(spark.createDataFrame(rows, "doc_id long, text string, grade int").repartition(3)).collect()
    texts = [r["text"] for r in left]
    assert all(f"{licence} {t}" in texts for k, t in enumerate(own) if k != 3)
    assert sum(own[3] in t for t in texts) == 1 and texts.count("") == 1 and texts.count("word") == 1


def test_three_grades_of_toxic_and_quality(spark):
    rng = random.Random(19)
    rows, labels, truth = [], [], {}
    for k in range(600):
        grade = (0, 0, 0, 1, 2)[k % 5]
        w = say(rng, rng.randrange(10, 60)).split()
        for _ in range(grade and rng.randrange(2, 4)):
            w.insert(rng.randrange(len(w)), rng.choice(("idiot", "moron") if grade == 1 else ("scum", "vermin")))
        rows.append((k, " ".join(w), "en", "s", 0))
        truth[k] = grade
        if k % 4:
            labels.append((k, int(grade < 2), int(grade > 0)))
    docs = spark.createDataFrame(rows + [(9000, "x", "", "", 0)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    given = spark.createDataFrame(labels + [(9000, 1, 0), (None, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, toxicity.graded(given))).collect()}
    held = [k for k in truth if k % 4 == 0]
    assert np.mean([got[k]["severity"] == truth[k] for k in held]) > 0.95 and all(got[k]["toxic"] == (truth[k] > 0) for k in held)
    means = [np.mean([got[k]["expected_severity"] for k in held if truth[k] == g]) for g in range(3)]
    assert means == sorted(means) and means[2] > 1.5


def test_labelled_rows_are_bounded(spark):
    docs = docs_of(spark, [(k % 7, f"text {k}") for k in range(100)] + [(None, "x")])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(9)] + [(3, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.labelled(docs, labels, 5).collect()
    assert len(got) == len({r["doc_id"] for r in got}) <= 5
    assert {r["doc_id"] for r in quality.labelled(docs, labels, 50).collect()} == set(range(7))


def test_ordinal_fit_orders_thresholds():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 3))
    score = x @ np.array([1.5, -1.0, 0.0]) + rng.logistic(size=4000)
    grade = (score > 0.5).astype(int) + (score > 2.0)
    dense = toxicity.Sparse(np.repeat(np.arange(4000), 3), np.tile(np.arange(3), 4000), x.ravel(), 4000, 3)
    w, limits = toxicity.fit_ordinal(dense, grade, steps=1500)
    assert np.allclose(w, [1.5, -1.0, 0.0], atol=0.15) and np.allclose(limits, [0.5, 2.0], atol=0.15)


def test_toxicity_of_one_kind(spark):
    docs = docs_of(spark, [(1, "a b c"), (2, "d")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r["toxic"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()] == [False, False]
    assert toxicity.score(docs_of(spark, []), toxicity.fit(docs, labels)).count() == 0


# ---- consistent weighted sampling


def jaccard(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_weighted_sampling(spark):
    rng = random.Random(7)
    rows = [(k * 3, say(rng, rng.randrange(80, 300))) for k in range(60)] + [(500, None), (501, ""), (502, "x"), (None, "ünï cödé text   y")]
    all_ = sampling.fingerprint_edits(docs_of(spark, rows, wide=True)).collect()
    got = {r["doc_id"]: r for r in all_}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    off = []
    for (i, t), (j, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u, r = t or "", u or "", got[i]
        edited = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if len(t) > 300:
            off.append(r["near_edited"] - jaccard(t, edited))
        if i is not None and len(t) > 300 and len(u) > 300:
            off.append(r["near_next"] - jaccard(t, u))
    assert len(got) == len(rows) and abs(np.mean(off)) < 0.02 and np.std(off) < 0.09
    assert got[500]["fingerprint"] == got[501]["fingerprint"] and got[500]["near_next"] == 1.0


def test_weighted_sampling_of_repeated_ids(spark):
    rows = [(4, "b c d e f g"), (4, "b c d e f g"), (4, "b c d e f g"), (4, "q r s t"), (None, "n one"), (None, None), (9, "z" * 100_000)]
    got = sampling.fingerprint_edits(docs_of(spark, rows, wide=True)).collect()
    hashed = spark.createDataFrame(rows, "i long, t string").selectExpr("i", "t", "coalesce(i, -9223372036854775808) AS k", "xxhash64(t) AS h").collect()
    order = [(r["i"], r["t"] or "") for r in sorted(hashed, key=lambda r: (r["k"], r["h"]))]
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        want.append((i, len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == sorted(want, key=str)
    assert [r["near_next"] for r in got if r["doc_id"] == 4].count(1.0) == 2


def test_quantised_draws_keep_the_collision_rate():
    """The share of equal samples, over many samples, against exact gamma draws and against the true similarity."""
    rng = np.random.default_rng(8)
    n = 6000
    for one, other in (((5, 3, 1, 0), (5, 1, 1, 2)), ((40, 1, 1, 1), (10, 1, 1, 1)), ((1,) * 20 + (0,) * 10, (1,) * 10 + (0,) * 10 + (1,) * 10), ((9, 0, 2), (1, 5, 2))):
        a, b = np.array(one, float), np.array(other, float)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        quantiles = sampling.gamma_quantiles((np.arange(sampling.BINS) + 0.5) / sampling.BINS)
        rates = []
        for draw in (lambda s: rng.gamma(2, 1, s), lambda s: quantiles[rng.integers(0, sampling.BINS, s)]):
            r, c, u = draw((n, len(a))), draw((n, len(a))), rng.random((n, len(a)))

            def least(weight, r=r, c=c, u=u):
                with np.errstate(divide="ignore"):
                    t = np.floor(np.log(weight) / r + u)
                    ln_a = np.where(weight > 0, np.log(c) - r * (t + 1 - u), np.inf)
                k = ln_a.argmin(1)
                return k, t[np.arange(n), k]

            (k1, t1), (k2, t2) = least(a), least(b)
            rates.append(((k1 == k2) & (t1 == t2)).mean())
        assert abs(rates[0] - true) < 0.02 and abs(rates[1] - true) < 0.02, (rates, true)


def test_weights_count(spark):
    texts = {1: "a a a a b", 2: "a b b b b", 3: "b a a a a"}
    out = sampling.signatures(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), ["doc_id"])
    fp = {r["doc_id"]: r["fingerprint"] for r in out.collect()}
    assert fp[1] == fp[3]
    same = sum(fp[1][k : k + 2] == fp[2][k : k + 2] for k in range(0, 128, 2)) / 64
    assert abs(same - 0.25) < 0.2
    assert sampling.fingerprint_edits(docs_of(spark, [])).count() == 0


# ---- line dedup


def plain_lines(rows):
    """Windows of three lines in the order of ids; later ones take their lines with them."""
    texts = {i: (t or "").split("\n") for i, t in rows}
    seen, out = {}, {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 2):
            seen.setdefault(tuple(texts[i][k : k + 3]), (i, k))
    for i, ls in texts.items():
        gone = {k + d for k in range(len(ls) - 2) if seen[tuple(ls[k : k + 3])] != (i, k) for d in range(3)}
        out[i] = ("\n".join(x for k, x in enumerate(ls) if k not in gone), len(ls), len(gone))
    return out


def test_line_dedup(spark):
    rng = random.Random(8)
    pool = [f"line {k}" for k in range(12)]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for k in range(80)] + [(100, None), (101, ""), (102, "a\na\na\na\na"), (103, "q\n" * 5000)]
    docs = docs_of(spark, rows, wide=True)
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs).collect()}
    want = plain_lines(rows)
    assert {i: (r["text"] or "", r["n_lines"], r["n_removed"]) for i, r in got.items()} == want
    assert got[100]["text"] is None and lines.dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_removed"]


def test_line_dedup_repeats_and_nulls(spark):
    t = "a\nb\nc"
    got = [(r["doc_id"], r["text"]) for r in lines.dedup_lines(docs_of(spark, [(5, t), (5, t), (7, t), (None, t)])).collect()]
    assert sorted(got, key=str) == [(5, ""), (5, ""), (7, ""), (None, t)]
    assert lines.dedup_lines(docs_of(spark, [])).count() == 0


# ---- the pipeline


def shingles(t):
    w = t.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_near_dedup_finds_similar_texts(spark):
    import corpus_pipeline

    rng = random.Random(9)
    rows, groups = [], {}
    for g in range(40):
        base = say(rng, 150).split()
        for c in range(4):
            w = list(base)
            for _ in range(c):
                w[rng.randrange(150)] = "edit"
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(w)))
    kept = {r["doc_id"] for r in simhash.keep_first(docs_of(spark, rows + [(None, ""), (900, None), (5, rows[5][1])], wide=True), **corpus_pipeline.NEAR).collect()}
    left = Counter(groups[k] for k in kept if k in groups)
    assert set(left) == set(range(40)) and sum(left.values()) <= 44
    assert None in kept and 900 not in kept  # two empty texts are one group


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    item = say(rng, 30)
    good = {k: "\n".join(say(rng, 25) for _ in range(6)) for k in range(150)}
    rows = dict(good)
    rows |= {200 + k: junk(rng, 120) for k in range(30)}
    rows |= {300: good[3], 301: good[4].replace(good[4].split()[9], "changed", 1), 302: good[5] + "\n" + item, 303: say(rng, 60) + " " + item}
    docs_of(spark, rows.items()).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 200 or k >= 300), 0) for k in rows if k % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after.append({r["doc_id"] for r in docs.collect()})
    assert len([k for k in after[0] if 200 <= k < 230]) <= 1 and len([k for k in after[0] if k < 150]) >= 148
    assert 300 not in after[1] and len(after[0] - after[1]) == 1
    assert {302, 303} & after[2] and not {302, 303} & after[3] and after[2] - after[3] <= {302, 303}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == after[4] == after[3]


@pytest.mark.parametrize("name", ["op1_chat_format", "op8_url_filter", "op10_line_dedup"])
def test_sql_is_there(name):
    from quillet.llm import queries

    assert name in queries.QUERIES and name in queries.ORACLE_SQL and F is not None
