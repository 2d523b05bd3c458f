"""The registered queries over the tables of a small folder, against plain Python."""

import hashlib
import random

import pytest

from quillet.llm import queries
from tests.llm import test_first, test_second, test_suffixes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    path = tmp_path_factory.mktemp("sf")
    say = test_second.say
    passage, item = say(rng, 60), "Tom has 12 apples and gives 5 kg of them to Anna Lee before he walks 3.5 km home again."
    texts = [say(rng, rng.randrange(0, 150)) for _ in range(50)]
    texts += [say(rng, 20) + " " + passage + " " + say(rng, 20) for _ in range(6)] + [texts[3], texts[3], "", None, "É " * 400, texts[7] + "x"]
    texts += [say(rng, 10) + ". " + item.replace("12", "7").replace("Anna", "Olga") + " " + say(rng, 9), item]
    rows = [(k * 2, t, "en", rng.choice(("a", "b", "c", None)), len(t or "")) for k, t in enumerate(texts)] + [(None, "null id " + passage, "en", "b", 0)]
    spark.createDataFrame(rows, test_second.DOCS).write.parquet(f"{path}/documents.parquet")
    items = [(1, item), (2, say(rng, 20)), (3, None), (4, "one two three")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), [(i, t, s) for i, t, _, s, _ in rows], items


def rows_of(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def test_op2(spark, folder):
    path, docs, items = folder
    got = sorted(map(tuple, rows_of(spark, path, "op2_decontaminate")), key=str)
    assert got == sorted(test_second.plain_leaks([(i, t) for i, t, _ in docs], items), key=str) and len(got) == 2


def test_op5(spark, folder):
    path, docs, _ = folder
    got = sorted(map(tuple, rows_of(spark, path, "op5_suffix_dedup")), key=str)
    assert got == sorted(test_suffixes.plain([(i, t) for i, t, _ in docs]), key=str) and sum(r[2] > 0 for r in got) > 8


def test_op6(spark, folder):
    path, docs, _ = folder
    got = {r["doc_id"]: r for r in rows_of(spark, path, "op6_weighted_fingerprint")}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0]))
    for (i, t, _), (_, u, _) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        edited = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(got[i]["near_edited"] - test_second.jaccard(t, edited)) < 0.3 or len(t.split()) < 3
    equal = [got[i]["fingerprint"] for i, t, _ in docs if t == docs[3][1]]
    assert len(equal) == 3 and len(set(equal)) == 1


def test_op7(spark, folder):
    path, docs, _ = folder
    got = rows_of(spark, path, "op7_source_mix")
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted(n for n in sizes if n) + [None]
    targets = dict(zip(names, test_first.plain_targets([sizes[n] for n in names], [3, 1, 2, 3], 1.5, 2), strict=True))
    assert len(got) == len(docs) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for n in names:
        mine = [r for r in got if r["source"] == n]
        assert all(abs(r["target"] - targets[n]) < 1e-6 and r["source_size"] == sizes[n] for r in mine) and abs(sum(r["taken"] for r in mine) - targets[n]) <= 1


def test_op9(spark, folder):
    path, docs, _ = folder
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows_of(spark, path, "op9_simhash")}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0]))
    fps = [test_first.plain_fingerprint(t) for _, t, _ in order]
    roots = test_first.plain_components(fps, 2)
    assert got == {i: (f"{f:016x}", order[r][0]) for (i, _, _), f, r in zip(order, fps, roots, strict=True)}


def test_every_query_is_registered():
    numbers = {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")}
    assert numbers == set(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
