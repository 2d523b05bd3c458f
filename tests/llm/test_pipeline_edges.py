"""The pipeline on empty tables, nulls, repeated rows and ids, and columns whose names clash with its own."""

import random

import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, key long, body string, hashes string"


def write(spark, path, docs, items=(), labels=()):
    spark.createDataFrame(list(docs), DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def staged(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{path}/stage{k}")
        docs = spark.read.parquet(f"{path}/stage{k}")
        out.append(docs)
    return out


def test_empty_tables(spark, tmp_path):
    out = staged(spark, write(spark, tmp_path, []))
    assert [d.count() for d in out] == [0] * 5 and out[3].columns == [c.split()[0] for c in DOCS.split(", ")]


def test_nulls_repeats_and_clashing_names(spark, tmp_path):
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    item = say(30)
    texts = [say(rng.randrange(20, 90)) for _ in range(30)]
    rows = [(k, t, None if k % 7 == 0 else "en", None if k % 5 == 0 else "s", None if k % 3 == 0 else len(t)) for k, t in enumerate(texts)]
    rows += [(100, None, "en", "s", 0), (101, "", "en", None, 0), (None, texts[3] + " end", None, None, None), (None, None, None, None, None), (2, texts[2], "en", "s", 1), (2, say(40), "en", "s", 1)]
    rows += [(200, f"{say(5)} {item} {say(4)}", "en", "s", 9)] * 2
    docs = [(*r, "r", 7, 8, "b", "h") for r in rows]
    out = staged(spark, write(spark, tmp_path, docs, [(1, item), (None, None), (1, item)], [(None, 1, 0), (3, None, None), (5, 1, 0), (5, 1, 0)]))
    kept = out[3].collect()
    assert out[3].columns == [c.split()[0] for c in DOCS.split(", ")] and {r["row"] for r in kept} == {"r"} and {r["size"] for r in kept} == {7}
    assert not any(item in (r["text"] or "") for r in kept)
    ids = [r["doc_id"] for r in kept]
    assert set(range(30)) - {3} <= set(ids) and ids.count(2) == 2 and sum(r["text"] == texts[2] for r in kept) == 1
    assert sum((r["text"] or "").startswith(texts[3]) for r in kept) == 1  # of near copies the least id stays, null first
    final = out[4].collect()
    assert len(final) == len(kept) and all(0 <= r["taken"] <= 2 * r["size"] for r in final)


@pytest.mark.parametrize("stage", range(5))
def test_stages_alone_take_empty_tables(spark, tmp_path, stage):
    path = write(spark, tmp_path, [])
    assert corpus_pipeline.STAGES[stage][1](spark, spark.read.parquet(f"{path}/documents.parquet"), path).count() == 0
