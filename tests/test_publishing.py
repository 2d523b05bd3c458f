"""The publishing store: outcomes, versions, repeated and failed batches; stage figures in one pass."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillet.operators import metered, share
from quillet.streaming import publishing



def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def sha(x):
    return hashlib.sha256(x).hexdigest()


def body(*blobs):
    return json.dumps({"tickets": [{"id": f"ticket{k}", "image": {"hash": sha(b), "w": 1, "h": 1}, "photo": None} for k, b in enumerate(blobs)], "placements": []})


def ask(id_, token, owner, title, blobs, fresh, seq=None):
    return (id_, id_ if seq is None else seq, "publish", token, owner, title, body(*blobs), fresh, None, None)


def upload(id_, token, owner, data, claimed=None):
    return (id_, id_, "upload", token, owner, None, None, None, sha(claimed if claimed is not None else data), data)


def state(spark, root, at=None):
    store = publishing.read_store(spark, root, at)
    shares = sorted((r["token"], r["owner_hash"], r["title"]) for r in store["shares"].collect())
    return shares, sorted((r["token"], bytes(r["bytes"])) for r in store["assets"].collect()), sorted((r["id"], r["status"]) for r in store["outcomes"].collect())


BATCHES = [
    [ask(1, None, "ann", "one", [b"a", b"b"], "f1"), ask(2, "gone", "bob", "two", [b"c"], "f2"), ask(3, None, "eve", "stolen", [b"x"], "f1"), upload(4, "f1", "ann", b"a")],
    [upload(5, "f1", "ann", b"b"), upload(6, "f1", "bob", b"b"), upload(7, "nope", "ann", b"b"), upload(8, "f2", "bob", b"c", b"d"), upload(9, "f2", "bob", b"z"), upload(10, "f2", "bob", b"c"), upload(11, "f2", "bob", b"c")],
    [ask(12, "f1", "ann", "newer", [b"b", b"n"], "f9"), ask(13, "f1", "bob", "mine", [], "f8"), ask(14, "f2", "bob", "old", [b"c"], "f7", 1), ask(15, "f2", "bob", "last", [], "f6", 2)],
]
AFTER = (
    [("f1", "ann", "newer"), ("f2", "bob", "last")],
    [("f1", b"b")],
    [(1, 201), (2, 201), (3, 403), (4, 200), (5, 200), (6, 403), (7, 404), (8, 400), (9, 400), (10, 200), (11, 200), (12, 200), (13, 403), (14, 200), (15, 200)],
)


def frame(spark, rows):
    return spark.createDataFrame(rows, publishing.REQUESTS)


def test_batches_once_again_and_after_a_failure(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    publishing.create_store(spark, root)
    assert state(spark, root) == ([], [], [])
    for k, rows in enumerate(BATCHES):
        before = state(spark, root)
        # Fails with the commit left to write: nothing is seen.
        with monkeypatch.context() as m:
            writer = type(spark.range(1).write)
            whole = writer.parquet
            m.setattr(writer, "parquet", lambda self, path, *a, **b: (_ for _ in ()).throw(OSError("disk")) if "commits" in path else whole(self, path, *a, **b))
            with pytest.raises(OSError):
                publishing.apply_batch(frame(spark, rows), k, root, now())
        assert state(spark, root) == before
        for _ in range(2):  # again, and repeated
            publishing.apply_batch(frame(spark, rows), k, root, now())
        if k == 1:
            assert state(spark, root)[1] == [("f1", b"a"), ("f1", b"b"), ("f2", b"c")]
    assert state(spark, root) == AFTER
    assert state(spark, root, 1)[0] == [("f1", "ann", "one"), ("f2", "bob", "two")]  # earlier versions can still be read


def test_stream(spark, tmp_path):
    root, folder = str(tmp_path / "store"), tmp_path / "in"
    publishing.create_store(spark, root)
    for k, rows in enumerate(BATCHES):
        frame(spark, rows).coalesce(1).write.parquet(str(folder / f"b{k}"))
        publishing.publish_stream(spark.readStream.schema(publishing.REQUESTS).option("recursiveFileLookup", "true").parquet(str(folder)), root, str(tmp_path / "at"), now()).awaitTermination()
    assert state(spark, root) == AFTER


def test_fresh_tokens_have_one_owner(spark):
    shares = spark.createDataFrame([("t1", "ann", "x", "{}", None, None)], publishing._SHARES)
    asked = "id long, token string, owner_hash string, title string, manifest string, seq long, fresh string"
    rows = [(1, None, "bob", "a", "{}", 1, "t2"), (2, None, "bob", "b", "{}", 2, "t2"), (3, None, "eve", "c", "{}", 3, "t2"), (4, None, "eve", "d", "{}", 4, "t1"), (5, None, None, "e", "{}", 5, "t3")]
    after, said = share.publish(shares, spark.createDataFrame(rows, asked), now())
    assert sorted(tuple(r) for r in said.select("id", "status").collect()) == [(1, 201), (2, 201), (3, 403), (4, 403), (5, 201)]
    assert sorted((r["token"], r["title"]) for r in after.collect()) == [("t1", "x"), ("t2", "b"), ("t3", "e")]


def test_figures_come_with_the_rows(spark, tmp_path):
    path = str(tmp_path / "n")
    spark.range(1000).write.parquet(path)
    stages = metered.Stages()
    first = stages.metered("read", spark.read.parquet(path), total=F.sum("id"))
    second = stages.metered("kept", first.where("id % 3 = 0"), most=F.max("id"))
    with stages.timed("write"):
        second.write.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, stages.figures(spark).collect())) == [("kept", "most", 999), ("kept", "rows", 334), ("read", "rows", 1000), ("read", "total", 499500)]
    plan = second._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("CollectMetrics") == 2
    assert [r["stage"] for r in stages.times(spark).collect()] == ["write"]
