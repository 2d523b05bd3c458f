"""Layout, boxes, store, sharing, streams, pixels and evaluation."""

import datetime as dt
import hashlib
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet import schemas
from quillet.operators import boxes, evaluate, layout, pixels, share, store
from quillet.sources import readers
from quillet.streaming import live

POINT = "array<struct<x:double,y:double>>"
#: A page of nine items that the placer must give again, seed "demo:" and the id.
PLACED = [
    ("boarding", 0.4311, 505.32571592833847, 113.57941996632144, 5.2), ("rail", 0.5356, 186.7069725766778, 113.55525880074129, -5.6),
    ("hawkwind", 0.6656, 829.8012536116876, 152.6209850674495, 1.3), ("wallet", 1.7964, 476.17956640338525, 369.9319062368013, 3.0),
    ("concert", 0.3711, 186.22745119966567, 262.9004209707491, 1.4), ("metro", 0.5578, 759.2703557237983, 323.0685713076964, -3.2),
    ("bbd", 0.57, 178.85505406511948, 406.82746700849384, -0.4), ("museum", 1.4634, 721.4905430199578, 582.3976134173572, 5.5), ("cairo", 0.5578, 183.78624565526843, 583.2949741366319, 2.1),
]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def quad(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def box(x, y, w, h):
    return F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("xywh", (x, y, w, h))])


def test_placer_gives_the_known_page(spark):
    items = spark.createDataFrame([("b", n, a, k) for k, (n, a, *_) in enumerate(PLACED)], "board string, ticket_id string, aspect double, ord int")
    got = {r["ticket_id"]: r for r in layout.auto_place(items, "board", F.lit("demo:")).collect()}
    for k, (n, _, x, y, turn) in enumerate(PLACED):
        assert (got[n]["x"], got[n]["y"], got[n]["rotation"], got[n]["z"]) == (x, y, turn, k + 1)


def test_placer_keeps_its_rules(spark):
    aspects = [0.4, 0.55, 0.7, 1.6, 0.35, 1.3, 0.5, 0.9]
    items = spark.createDataFrame([("b", f"t{k}", aspects[k % 8], k) for k in range(40)], "board string, ticket_id string, aspect double, ord int")
    got = layout.auto_place(items, "board").collect()
    around = []
    for r in got:
        half = layout.half_size(r["rotation"], r["scale"], aspects[int(r["ticket_id"][1:]) % 8])
        around.append((r["x"] - half[0], r["y"] - half[1], r["x"] + half[0], r["y"] + half[1]))
    assert all(0 < abs(r["rotation"]) <= 7 for r in got) and all(a[0] >= 0 and a[2] <= 1000 and a[1] >= 0 for a in around)
    for i, a in enumerate(around):
        for b in around[:i]:
            both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
            assert both <= 0.121 * min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    assert sorted(map(tuple, got)) == sorted(map(tuple, layout.auto_place(items.repartition(3), "board").collect()))
    assert layout.scatter(items, "board").count() == 40


def test_arranged_by_date(spark):
    rows = [("b", f"t{k}", 0.5 + k / 10, d) for k, d in enumerate(["2026-03-01", "", "2025-01-01", "2026-02-01", "2024-05-05", "", "2026-01-01", "2023-01-01"])]
    got = sorted(layout.arrange(spark.createDataFrame(rows, "board string, ticket_id string, aspect double, date string"), "board").collect(), key=lambda r: r["z"])
    assert [r["ticket_id"] for r in got] == ["t7", "t4", "t2", "t6", "t3", "t0", "t1", "t5"]
    assert [r["rotation"] for r in got] == [-1.2, 1.2] * 4
    assert all(a["y"] < b["y"] + 1e-9 or abs(a["y"] - b["y"]) < 150 for a, b in zip(got, got[1:]))


def test_layers_and_moves(spark):
    p = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("b", "x", 7)], "collage_id string, ticket_id string, z int")
    up = {(r[0], r[1]): r["z"] for r in layout.raise_item(p, "collage_id", F.col("ticket_id") == "x").collect()}
    assert up == {("a", "x"): 4, ("a", "y"): 3, ("b", "x"): 8}
    down = {(r[0], r[1]): r["z"] for r in layout.send_back(p.where("collage_id = 'a'"), "collage_id", F.col("ticket_id") == "x").collect()}
    assert down == {("a", "x"): 2, ("a", "y"): 3} or down["a", "x"] < down["a", "y"] and min(down.values()) >= 0
    assert one(spark, layout.snap_turn(F.lit(359.0))) == 360.0 and one(spark, layout.snap_turn(F.lit(5.0))) == 5.0
    assert one(spark, layout.nudge(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(2.9), F.lit("+"), F.lit(False)))["scale"] == 3.0


def test_quads(spark):
    square = quad((0, 0), (10, 0), (10, 10), (0, 10))
    assert one(spark, boxes.polygon_area(square)) == 100
    assert [round(a) for a in one(spark, boxes.interior_angles(square))] == [90] * 4
    assert [tuple(p) for p in one(spark, boxes.order_quad(quad((10, 10), (0, 0), (0, 10), (10, 0))))] == [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert [tuple(p) for p in one(spark, boxes.rotate_quad(square, 5))][0] == (10, 0)
    assert one(spark, boxes.quad_error(square, quad((1, 0), (11, 0), (11, 10), (1, 10)))) == pytest.approx(1 / math.hypot(10, 10))
    assert one(spark, boxes.quad_iou(square, quad((5, 0), (15, 0), (15, 10), (5, 10)), 30)) == pytest.approx(1 / 3, abs=0.03)
    assert tuple(one(spark, boxes.line_intersection(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 2), (0, 2), (2, 0))]))) == (1, 1)
    assert one(spark, pixels.quad_score(square, F.lit(100.0), F.lit(100.0), F.lit(20.0), F.lit(20.0))) > 0
    assert one(spark, pixels.quad_score(square, F.lit(10.0), F.lit(10.0), F.lit(20.0), F.lit(20.0))) == 0


def test_greedy_boxes(spark):
    many = F.array(box(0, 0, 10, 10), box(1, 1, 10, 10), box(50, 50, 5, 5))
    assert [tuple(b) for b in one(spark, boxes.first_come(many))] == [(0, 0, 10, 10), (50, 50, 5, 5)]
    assert [tuple(b) for b in one(spark, boxes.merge_grow(F.array(box(1, 1, 10, 10), box(0, 0, 20, 20), box(18, 0, 4, 20))))] == [(0, 0, 22, 20)]
    assert one(spark, boxes.overlap_ratio(box(0, 0, 10, 10), box(5, 0, 10, 10))) == 0.5
    assert tuple(one(spark, boxes.pad(box(10, 10, 20, 20), 0.5, 35.0, 100.0))) == (0, 0, 35, 40)


def tables(spark):
    collages = spark.createDataFrame([("c1", "One", dt.datetime(2026, 1, 1)), ("c2", "Two", dt.datetime(2026, 2, 1)), ("c3", "", None)], "id string, title string, updated_at timestamp")
    placements = spark.createDataFrame([("c1", "t1", 2), ("c1", "t2", 1), ("c2", "t2", 1), ("c2", "gone", 3)], "collage_id string, ticket_id string, z int")
    tickets = spark.createDataFrame([("t1", 100, 50, True, False), ("t2", 100, 80, False, True), ("t9", 1, 1, False, False)], "id string, width int, height int, blur_off boolean, has_photo boolean")
    return collages, placements, tickets


def test_store(spark):
    collages, placements, tickets = tables(spark)
    assert {r["id"]: [i["ticket_id"] for i in r["items"]] for r in store.collage_contents(collages, placements, tickets).collect()} == {"c1": ["t2", "t1"], "c2": ["t2"], "c3": []}
    assert [r["id"] for r in store.newest_first(collages).collect()] == ["c2", "c1", "c3"]
    left = store.remove_collage(collages, placements, tickets, collages.where("id = 'c1'"))
    assert [sorted(r[0] for r in df.collect()) for df in left] == [["c2", "c3"], ["c2", "c2"], ["t2", "t9"]]
    new = spark.createDataFrame([("c1", "t1", 9, 1), ("c1", "t1", 10, 2), ("c9", "t1", 1, 1)], "collage_id string, ticket_id string, z int, seq int")
    assert {(r[0], r[1]): r["z"] for r in store.upsert(placements, new, ["collage_id", "ticket_id"]).collect()}["c1", "t1"] == 10
    assert {r["id"]: (r["aspect"], r["kind"]) for r in store.cards(tickets).collect()}["t1"] == (0.5, "cutout")
    assert store.collages_of(placements, collages, "t2").count() == 2
    images = spark.createDataFrame([("t1", "blurred", b"1"), ("t2", "blurred", b"2"), ("t2", "photo", b"3"), ("t1", "photo", b"4")], schemas.IMAGES)
    got = {(r["collage_id"], r["ticket_id"]): r["photo"] for r in store.publishable(placements, tickets, images).collect()}
    assert {k: v and bytes(v) for k, v in got.items()} == {("c1", "t1"): None, ("c1", "t2"): b"3", ("c2", "t2"): b"3"}
    names = spark.createDataFrame([("1.sql",), ("0.sql",)], "name string")
    assert [r["name"] for r in store.pending(names, names.where("name = '0.sql'")).collect()] == ["1.sql"]
    days = spark.createDataFrame([(dt.date(2026, 1, 1),), (dt.date(2026, 1, 20),)], "d date")
    assert days.agg(store.recent_trip(F.col("d"), "2026-02-01").alias("r")).collect()[0]["r"] is True


def manifest(**change):
    h = hashlib.sha256(b"x").hexdigest()
    ticket = {"id": "ticket1", "fields": {n: "" for n in ("title", "origin", "destination", "date", "carrier", "seat")} | {"type": "train"}, "note": "", "image": {"hash": h, "w": 10, "h": 5}, "photo": None} | change
    return json.dumps({"tickets": [ticket], "placements": [{"ticketId": "ticket1", "x": 1.0, "y": 2.0, "rotation": 0.0, "scale": 1.0, "z": 1}]})


def test_manifests(spark):
    texts = [manifest(), manifest(id="Bad"), manifest(note="x" * 601), "not json", manifest(image={"hash": "z", "w": 1, "h": 1}), json.dumps({"tickets": [{"id": "nope"}], "placements": []})]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", share.manifest_faults(F.lit("t"), share.read_manifest(F.col("t"))).alias("f")).collect()
    got = {r["k"]: r["f"] for r in rows}
    assert got[0] == [] and got[1] == ["ticket id"] and got[2] == ["note"] and got[3] and got[4] == ["image"] and "ticket id" in got[5]
    for odd in (manifest(id="ticket1\n"), manifest(image={"hash": "0" * 64 + "\n", "w": 1, "h": 1}), manifest().replace('"photo"', '"picture"'), manifest(note="\U0001f3ab" * 301)):
        faults = spark.createDataFrame([(odd,)], "t string").select(share.manifest_faults(F.lit("t"), share.read_manifest(F.col("t"))).alias("f")).first()["f"]
        assert len(faults) == 1
    assert not one(spark, share.is_token(F.lit("a" * 22 + "\n")))
    assert one(spark, share.is_token(F.lit("a" * 22))) and not one(spark, share.is_token(F.lit("a" * 21)))
    secret = "s" * 24
    assert one(spark, share.owner_matches(F.lit(secret), F.lit(hashlib.sha256(secret.encode()).hexdigest()))) and not one(spark, share.owner_matches(F.lit(None).cast("string"), F.lit("x")))
    assert one(spark, share.share_status(F.lit(True), F.lit(secret), F.lit(False), F.array().cast("array<string>"))) == 429


def test_assets(spark):
    h = [hashlib.sha256(bytes([k])).hexdigest() for k in range(4)]
    m = json.dumps({"tickets": [{"id": "ticket1", "image": {"hash": h[0], "w": 1, "h": 1}, "photo": {"hash": h[1], "w": 1, "h": 1}}, {"id": "ticket2", "image": {"hash": h[0], "w": 1, "h": 1}}], "placements": []})
    shares = spark.createDataFrame([("s1", m), ("s2", json.dumps({"tickets": [], "placements": []}))], "token string, t string").select("token", share.read_manifest(F.col("t")).alias("m"))
    assets = spark.createDataFrame([("s1", h[0]), ("s1", h[2]), ("s2", h[3]), ("s3", h[3])], "token string, hash string")
    assert [tuple(r) for r in share.missing_assets(shares, assets).select("token", "hash").collect()] == [("s1", h[1])]
    assert sorted(map(tuple, share.drop_unreferenced(shares, assets).collect())) == [("s1", h[0]), ("s3", h[3])]
    up = spark.createDataFrame([("s1", h[1], bytes([1]), 1), ("s1", h[1], bytes([1]), 2), ("s1", h[1], b"other", 3), ("s1", h[0], bytes([0]), 4), ("s1", h[2], bytes([2]), 5)], "token string, hash string, bytes binary, ord int")
    assert [r["ord"] for r in share.ingest_assets(up, shares, assets).collect()] == [1]
    assert [df.count() for df in share.delete_shares(shares, assets, shares.where("token = 's1'"))] == [1, 2]
    assert share.key_faults(assets.unionByName(assets.limit(1)), ["token", "hash"]).count() == 1
    assert share.reference_faults(assets, shares, "token").count() == 1


def test_limiter(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [("a", k, start + dt.timedelta(seconds=k)) for k in range(32)] + [("b", 99, start)] + [("a", 100, start + dt.timedelta(minutes=60)), ("a", 101, start + dt.timedelta(minutes=60, seconds=1))]
    got = {r["event_id"]: r["admitted"] for r in live.admit(spark.createDataFrame(rows, "key string, event_id long, at timestamp"), "key", "at", 30, 60).collect()}
    assert [k for k, ok in got.items() if not ok] == [30, 31] or sorted(k for k, ok in got.items() if not ok) == [30, 31]


@pytest.mark.parametrize("kind", ["long", "string", "double"])
def test_limiter_of_any_key(spark, tmp_path, kind):
    start = dt.datetime(2026, 1, 1)
    names = {"long": [None, 2**60 + 1, 2**60, -3], "string": [None, "", "=", "a\n"], "double": [None, float("nan"), 0.1, 1e300]}[kind]
    rows = sorted([(k, n * 3 + j, start + dt.timedelta(seconds=40 * n + 7 * (n // 12) ** 3)) for n in range(60) for j, k in enumerate(names)], key=lambda r: r[1])
    batch = live.admit(spark.createDataFrame(rows, f"key {kind}, event_id long, at timestamp").repartition(3), "key", "at", 2, 2)
    got = sorted((repr(r["key"]), r["at"], r["event_id"], r["admitted"]) for r in batch.collect())
    want = []
    for k in names:
        kept = []
        for i, t in sorted((r[1], r[2]) for r in rows if r[0] is k):
            kept = [x for x in kept if x > t - dt.timedelta(minutes=2)]
            want.append((repr(k), t, i, len(kept) < 2))
            kept += [t] if len(kept) < 2 else []
    assert got == sorted(want) and len({w[3] for w in want}) == 2
    if kind != "double":
        live_rows = streamed(spark, tmp_path, [(k, t) for k, _, t in rows], f"key {kind}, at timestamp", lambda s: live.limit_stream(s, 2, 2), 4)
        assert sorted((repr(r["key"]), r["at"], r["admitted"]) for r in live_rows.collect()) == sorted((k, t, ok) for k, t, _, ok in want)


def test_still_frames(spark):
    start = dt.datetime(2026, 1, 1)
    at = lambda dx: [(dx, 0.0), (100.0 + dx, 0.0), (100.0 + dx, 100.0), (dx, 100.0)]
    shifts = [0, 0, 0, 50] + [50] * 9
    rows = [("c", start + dt.timedelta(milliseconds=120 * k), at(float(d)), 0.1 if k == 1 else 0.9) for k, d in enumerate(shifts)]
    got = sorted(live.still_frames(spark.createDataFrame(rows, schemas.FRAMES)).collect(), key=lambda r: r["ts"])
    assert [r["streak"] for r in got] == [0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9] and [k for k, r in enumerate(got) if r["fires"]] == [9]


def test_intake_takes_each_file_once(spark, tmp_path):
    for d in ("in", "done", "state"):
        (tmp_path / d).mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF")
    stream = live.intake(spark, str(tmp_path / "in"), str(tmp_path / "done"))
    for _ in range(2):
        q = stream.select("path", "length").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "b.PDF").write_bytes(b"x")
    (tmp_path / "a.png").write_bytes(b"y")
    assert [(r["path"][-5:], r["mode"]) for r in readers.files(spark, str(tmp_path)).collect()] == [("a.png", "image"), ("b.PDF", "pdf")]
    (tmp_path / "t.json").write_text(json.dumps({"one": {"w": 1}, "two": {"w": 2}}))
    assert sorted(map(tuple, readers.json_map(spark, str(tmp_path / "t.json"), "struct<w:int>").collect())) == [("one", 1), ("two", 2)]
    grid = F.array(*map(F.lit, range(6)))
    assert one(spark, readers.turned(grid, F.lit(3), F.lit(2), 1)) == np.rot90(np.arange(6).reshape(2, 3), -1).ravel().tolist()
    assert one(spark, readers.turned(grid, F.lit(3), F.lit(2), 3)) == np.rot90(np.arange(6).reshape(2, 3), 1).ravel().tolist()
    assert tuple(one(spark, readers.fitted(F.lit(5200), F.lit(2600), 2600))) == (2600, 1300)


def test_pixels(spark):
    v = spark.createDataFrame([("i", k) for k in list(range(100)) * 2 + [255]], "img string, v int")
    assert tuple(pixels.histogram_cut(v, "img", "v").collect()[0]) == ("i", 2, 98)
    stripes = F.array(F.array(*[F.lit(255 * (k // 2 % 2)) for k in range(40)]))
    assert one(spark, pixels.stripy(stripes)) and not one(spark, pixels.stripy(F.array(F.array(*map(F.lit, range(0, 40))))))
    bars = spark.createDataFrame([("i", x, y, 255 * (x // 2 % 2)) for x in range(12) for y in range(12)], "img string, x int, y int, v int")
    assert pixels.coherent(bars, "img").collect()[0]["coherent"] and not pixels.coherent(bars, "img", True).collect()[0]["coherent"]
    blocks = spark.createDataFrame([("i", x, y, 255 * ((x // 2 + y // 2) % 2)) for x in range(12) for y in range(12)], "img string, x int, y int, v int")
    assert pixels.blocky(blocks, "img").collect()[0]["blocky"]
    page = spark.createDataFrame([("i", x, y, *([0] * 3 if 4 <= x <= 8 and 4 <= y <= 10 else [255] * 3)) for x in range(40) for y in range(40)], "img string, x int, y int, r int, g int, b int")
    assert tuple(pixels.content_box(page, "img", 40, 40).collect()[0]) == ("i", 3, 3, 9, 11)
    image = np.random.default_rng(1).integers(0, 256, (30, 40, 4)).astype(np.uint8)
    out = pixels.smear(image, 10, 3)
    assert (out[..., 3] == image[..., 3]).all() and out[..., :3].std() < image[..., :3].std() / 2
    regions = spark.createDataFrame([(1, 40, 30, image.tobytes(), "barcode", 30.0, 3)], "id long, width int, height int, bytes binary, reason string, raw_height double, seed int")
    assert len(pixels.redact(regions).collect()[0]["bytes"]) == image.size


def test_evaluation(spark):
    f = "ticket string, fields struct<type:string,origin:string,destination:string,date:string,carrier:string,seat:string>"
    truth = spark.createDataFrame([("a", ("train", "X", "Y", "", "Northwind Air Lines", ""))], f)
    found = spark.createDataFrame([("a", ("train", "x.", "Z", "", "Northwind Air", "1"))], f)
    assert {r["field"]: r["ok"] for r in evaluate.score_fields(truth, found).collect()} == {"type": True, "origin": True, "destination": False, "carrier": True}
    secrets = spark.createDataFrame([("a", "QX-7K2P"), ("a", "ABCDEF")], "ticket string, secret string")
    words = spark.createDataFrame([("a", "ref:"), ("a", "qx7k2p")], "ticket string, text string")
    assert evaluate.leaks(secrets, words).collect()[0]["leaks"] == 1
    results = spark.createDataFrame([("p", 0.95, 1.0, 0), ("p", 0.5, 3.0, 1)], "kind string, iou double, ms double, leaks int")
    assert tuple(evaluate.summary(results, "kind").collect()[0]) == ("p", 2, 0.5, 0.725, 3.0, 3.0, 1)


def test_registry_names():
    from quillet.plans import registry

    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.QUERIES) >= 35


# ---- ties, streams and sources of the second round -------------------------------------------------------------------


def test_last_row_wins_by_a_total_order(spark):
    placements = spark.createDataFrame([("c", "t", 1)], "collage_id string, ticket_id string, z int")
    new = [("c", "t", 7, 2), ("c", "t", 9, 2), ("c", "t", 8, 2), ("c", "u", 1, None), ("c", "t", 99, 1)]
    for rows in (new, new[::-1]):
        frame = spark.createDataFrame(rows, "collage_id string, ticket_id string, z int, seq int")
        got = sorted(map(tuple, store.upsert(placements, frame.repartition(3), ["collage_id", "ticket_id"]).collect()))
        assert got == [("c", "t", 9), ("c", "u", 1)]
        plain = sorted(map(tuple, store.upsert(placements, frame.drop("seq"), ["collage_id", "ticket_id"]).collect()))
        assert plain == [("c", "t", 9), ("c", "u", 1)]  # by its text: a brace sorts after a nine
    ties = spark.createDataFrame([("h", 1, "b"), ("h", 1, "a"), ("h", 2, "0"), ("k", 5, "x")], "hash string, at int, name string")
    stored = spark.createDataFrame([("k",)], "hash string")
    assert [tuple(r) for r in share.insert_new(ties, stored, ["hash"], "at").collect()] == [("h", 1, "a")]


def test_empty_collages_keep_the_type_of_ids(spark):
    placements = spark.createDataFrame([(1, 10, 1)], "collage_id long, ticket_id long, z int")
    out = store.collage_contents(spark.createDataFrame([(1,), (2,)], "id long"), placements, spark.createDataFrame([(10,)], "id long"))
    assert dict(out.dtypes)["items"] == "array<struct<z:int,ticket_id:bigint>>"
    assert {r["id"]: [i["ticket_id"] for i in r["items"]] for r in out.collect()} == {1: [10], 2: []}


def test_symbols_in_the_order_of_the_decoder(spark, tmp_path):
    rows = [{"doc_id": 1, "ord": k, "text": t, "is_valid": v} for k, (t, v) in enumerate([("z", True), ("a", False), ("", True), ("m", None), ("a", True), ("q", True), ("b", True), ("c", True), ("d", True)])]
    (tmp_path / "codes.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = sorted(((r["ord"], r["text"]) for r in readers.barcodes(spark, str(tmp_path / "codes.json"), 5).collect()))
    assert got == [(0, "z"), (3, "m"), (4, "a"), (5, "q"), (6, "b")]
    (tmp_path / "words.json").write_text(json.dumps({"doc_id": 1, "ord": 0, "text": "x", "conf": 90.0, "line": 1, "x": 30.0, "y": 60.0, "w": 15.0, "h": 9.0}))
    word = readers.ocr_words(spark, str(tmp_path / "words.json"), 1.5).collect()[0]
    assert (word["x"], word["y"], word["w"], word["h"]) == (20, 40, 10, 6)
    items = spark.createDataFrame([("a", 0), ("b", 2)], "ticket string, leaks int")
    assert readers.write_report(items.groupBy().count(), items, str(tmp_path / "report")) == 1
    assert readers.write_report(items.groupBy().count(), items.where("leaks = 0"), str(tmp_path / "clean")) == 0


def streamed(spark, tmp_path, rows, schema, transform, batches=3):
    """All rows of a stream whose files come one after the other."""
    folder = tmp_path / "in"
    folder.mkdir()
    step = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{k}"))
        os.utime(next((folder / f"b{k}").glob("*.parquet")), (1_700_000_000 + k, 1_700_000_000 + k))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = transform(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_limiter_as_a_stream_agrees_with_the_batch(spark, tmp_path):
    rng = random.Random(3)
    at, rows = dt.datetime(2026, 1, 1), []
    for k in range(160):
        # Bursts, lulls shorter than the window, and one that is longer, as after an outage.
        at += dt.timedelta(seconds=rng.choice((1, 5, 200, 900)), milliseconds=k) if k != 90 else dt.timedelta(hours=5)
        rows.append((rng.choice("ab"), at, k))
    batch = live.admit(spark.createDataFrame(rows, "key string, at timestamp, event_id long"), "key", "at", 4, 60)
    want = sorted((r["key"], r["at"], r["admitted"]) for r in batch.collect())
    got = streamed(spark, tmp_path, [(k, t) for k, t, _ in rows], "key string, at timestamp", lambda s: live.limit_stream(s, 4, 60), 5)
    assert sorted((r["key"], r["at"], r["admitted"]) for r in got.collect()) == want and not all(w[2] for w in want)


def test_still_streak_as_a_stream_agrees_with_the_batch(spark, tmp_path):
    rng = random.Random(4)
    rows, shift = [], 0.0
    for k in range(120):
        shift += rng.choice((0.0,) * 9 + (40.0,))
        corners = [(shift + x + rng.random() * 0.1, y) for x, y in ((0.0, 0.0), (100.0, 0.0), (100.0, 50.0), (0.0, 50.0))]
        rows.append((rng.choice("ab"), dt.datetime(2026, 1, 1) + dt.timedelta(milliseconds=120 * k), None if k % 31 == 30 else corners, 0.1 if k % 23 == 0 else 0.9))
    schema = f"camera_id string, ts timestamp, corners {POINT}, score double"
    want = sorted(map(tuple, live.still_frames(spark.createDataFrame(rows, schema)).collect()))
    got = sorted(map(tuple, streamed(spark, tmp_path, rows, schema, live.still_stream, 4).collect()))
    assert got == want and sum(r[3] for r in got) == 2


def test_idle_cameras_start_anew_and_late_frames_stay_out(spark, tmp_path):
    box = [(x, y) for x, y in ((0.0, 0.0), (100.0, 0.0), (100.0, 50.0), (0.0, 50.0))]
    at = lambda ms: dt.datetime(2026, 1, 1) + dt.timedelta(milliseconds=ms)
    b = [("b", at(3_600_000 + k), box, 0.9) for k in range(16)]  # their clock expires a
    frames = [("a", at(120 * k), box, 0.9) for k in range(8)] + b + [("a", at(3_700_000 + 120 * k), box, 0.9) for k in range(7)] + [("b", at(3_600_001), box, 0.9)]
    got = streamed(spark, tmp_path, frames, f"camera_id string, ts timestamp, corners {POINT}, score double", live.still_stream, 4).collect()
    assert sorted(r["ts"] for r in got if r["camera_id"] == "a" and r["fires"]) == [at(720), at(3_700_720)]
    assert sum(r["ts"] == at(3_600_001) for r in got) == 1  # the late one is left out


def test_late_results_as_a_stream(spark, tmp_path):
    rng = random.Random(6)
    text = lambda: rng.choice((None, "x", "y", "", "zz"))
    rows = [(f"k{rng.randrange(12)}", dt.datetime(2026, 1, 1) + dt.timedelta(seconds=rng.randrange(3000)), k, rng.choice(("edit", "result", "result")), text(), text()) for k in range(300)]
    schema = "key string, at timestamp, seq long, kind string, title string, seat string"
    want = sorted(map(tuple, live.merge_late(spark.createDataFrame(rows, schema), "key", ("title", "seat")).collect()))
    rng.shuffle(rows)
    got = streamed(spark, tmp_path, rows, schema, lambda s: live.merge_stream(s, ("title", "seat"), "2 hours"), 5)
    last = got.groupBy("key").agg(F.max_by(F.struct("title", "seat"), "events").alias("r"), F.max("events").alias("n"))
    assert sorted(map(tuple, last.select("key", "r.*").collect())) == want and last.agg(F.sum("n")).first()[0] == 300


def test_trailing_counts_in_buckets(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), k, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=rng.randrange(0, 9000))) for k in range(400)]
    events = spark.createDataFrame(rows, "key string, event_id long, at timestamp")
    want = {k: sum(o == key and dt.timedelta(0) <= t - u < dt.timedelta(seconds=600) for o, _, u in rows) for key, k, t in rows}
    for bucket in (None, 600, 1000):
        assert {r["event_id"]: r["n"] for r in live.trailing_count(events, "key", "at", 600, bucket).collect()} == want


def test_quad_overlaps_of_turned_quads(spark):
    rng = random.Random(11)

    def turned():
        x, y, w, h, t = rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(5, 50), rng.uniform(5, 50), rng.uniform(0, math.pi)
        around = [(x + a * math.cos(t) - b * math.sin(t), y + a * math.sin(t) + b * math.cos(t)) for a, b in ((-w, -h), (w, -h), (w * 0.7, h), (-w, h))]
        return around if rng.random() < 0.5 else around[::-1]

    pairs = [(k, turned(), turned()) for k in range(60)] + [(99, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(20.0, 0.0), (30.0, 0.0), (30.0, 10.0), (20.0, 10.0)])]
    quad = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame(pairs, f"id int, found {quad}, truth {quad}")
    got = {r["id"]: r["iou"] for r in evaluate.score_quads(df, 40).collect()}
    same = {r["id"]: r["iou"] for r in df.select("id", boxes.quad_iou(F.col("found"), F.col("truth"), 40).alias("iou")).collect()}

    def inside(q, x, y):
        side = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(q, q[1:] + q[:1], strict=True)]
        return min(side) >= 0 or max(side) <= 0

    for k, a, b in pairs:
        xs, ys = zip(*(a + b), strict=True)
        points = [(min(xs) + (i + 0.5) / 40 * (max(xs) - min(xs)), min(ys) + (j + 0.5) / 40 * (max(ys) - min(ys))) for i in range(40) for j in range(40)]
        one, two = [inside(a, *p) for p in points], [inside(b, *p) for p in points]
        want = sum(map(lambda p, q: p and q, one, two)) / max(1, sum(map(lambda p, q: p or q, one, two)))
        assert got[k] == pytest.approx(want, abs=1e-9) and same[k] == pytest.approx(want, abs=1e-9)


def test_medians_are_exact(spark):
    rng = random.Random(6)
    rows = [(g, rng.choice((rng.random() * 1e6, 5.0, -3.0))) for g in ("a", "b", None) for _ in range(501)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("nan", None)]
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    got = {r["g"]: r["median"] for r in evaluate.upper_medians(spark.createDataFrame(rows, "g string, v double"), "g", "v", bins=8).collect()}
    assert got == {g: sorted(v)[len(v) // 2] for g, v in want.items()}


def test_overlaps_by_cells(spark):
    rng = random.Random(7)
    rows = [("k", k, (rng.uniform(-50, 400), rng.uniform(-50, 300), rng.uniform(1, 300), rng.uniform(1, 90))) for k in range(120)]
    frame = spark.createDataFrame(rows, "k string, id int, box struct<x:double,y:double,w:double,h:double>")

    def share_of(a, b):
        w, h = (max(0, min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
        return w * h / min(a[2] * a[3], b[2] * b[3])

    want = {(i, j) for _, i, a in rows for _, j, b in rows if i < j and share_of(a, b) > 0.3}
    for cell in (40.0, 128.0, 1000.0):
        assert sorted(tuple(r) for r in boxes.overlapping_pairs(frame, frame, "k", 0.3, cell).where("a < b").select("a", "b").collect()) == sorted(want)


def test_draws_are_those_of_a_counter(spark):
    def plain(seed, n):
        state = 0
        for c in seed:
            state = (31 * state + ord(c)) % 2**32
        out = []
        for _ in range(n):
            state = (state + 0x6D2B79F5) % 2**32
            t = (state ^ state >> 15) * (1 | state) % 2**32
            t = (t + ((t ^ t >> 7) * (61 | t)) % 2**32) % 2**32 ^ t
            out.append((t ^ t >> 14) / 2**32)
        return out

    for seed in ("", "a", "demo:boarding", "é–x" * 9):
        assert layout.draws(seed, 0, 50).tolist() == plain(seed, 50) and layout.draws(seed, 20, 30).tolist() == plain(seed, 50)[20:]
    noise = pixels.grain(3, 50_000)
    assert abs(noise.mean() - 0.5) < 0.01 and abs(noise.std() - 12**-0.5) < 0.01 and (noise != pixels.grain(4, 50_000)).all()
