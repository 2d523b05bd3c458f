"""Hulls, quads, snapped sides, flattened items and cards against plain Python and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.operators import pixels, quads, regions, warp

POINTS = "array<struct<x:double,y:double>>"


def xy(ps):
    return [(float(x), float(y)) for x, y in ps]


def plain_hull(ps):
    ps = sorted(set(ps))
    if len(ps) < 3:
        return ps
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def side(order):
        out = []
        for p in order:
            while len(out) >= 2 and cross(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return side(ps) + side(ps[::-1])


def area(q):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(q, q[1:] + q[:1], strict=True))) / 2


def plain_rectangle(hull):
    best = math.inf
    for a, b in zip(hull, hull[1:] + hull[:1], strict=True):
        n = math.dist(a, b)
        u = ((b[0] - a[0]) / n, (b[1] - a[1]) / n)
        along, across = [p[0] * u[0] + p[1] * u[1] for p in hull], [p[1] * u[0] - p[0] * u[1] for p in hull]
        best = min(best, (max(along) - min(along)) * (max(across) - min(across)))
    return best


def test_hulls_and_quads(spark):
    rng = random.Random(4)
    sets = [[(rng.randrange(40), rng.randrange(30)) for _ in range(rng.randrange(1, 60))] for _ in range(30)] + [[(0, 0), (5, 5), (9, 9)], [(2, 2)], [(3, 1), (3, 1)]]
    turned = lambda w, h, d: [(100 + x * math.cos(d) - y * math.sin(d), 90 + x * math.sin(d) + y * math.cos(d)) for x, y in ((-w, -h), (w, -h), (w, h), (-w, h))]
    boxes = [turned(30 + k, 12 + k % 7, 0.11 * k) for k in range(12)]
    clipped = [[p for a, b, c in zip(q[-1:] + q[:-1], q, q[1:] + q[:1], strict=True) for p in ((b[0] + (a[0] - b[0]) * 0.01, b[1] + (a[1] - b[1]) * 0.01), (b[0] + (c[0] - b[0]) * 0.01, b[1] + (c[1] - b[1]) * 0.01))] for q in boxes]
    wheel = [[(50 + 40 * math.cos(t * math.pi / 3), 50 + 40 * math.sin(t * math.pi / 3)) for t in range(6)]]
    triangle = [[(0, 0), (30, 0), (0, 20)]]
    every = [xy(s) for s in sets + boxes + clipped + wheel + triangle]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(every)], f"k int, p {POINTS}").withColumn("hull", quads.convex_hull(F.col("p")))
    got = {r["k"]: r for r in df.withColumn("q", quads.quad_from_hull(F.col("hull"))).collect()}
    for k, s in enumerate(every):
        hull = [(p["x"], p["y"]) for p in got[k]["hull"]]
        assert hull == plain_hull(s)
        q = got[k]["q"]
        if len(hull) < 3:
            assert q is None
            continue
        quad = [(p["x"], p["y"]) for p in q["quad"]]
        assert len(quad) == 4
        if q["fallback"]:
            assert area(quad) == pytest.approx(plain_rectangle(hull))
        else:
            assert set(quad) <= set(hull) and area(quad) <= area(hull) + 1e-9
    n = len(sets)
    for k in range(n, n + 24):
        assert not got[k]["q"]["fallback"] and area([(p["x"], p["y"]) for p in got[k]["q"]["quad"]]) > 0.95 * area(every[n + (k - n) % 12])
    assert got[n + 24]["q"]["fallback"] and got[n + 25]["q"]["fallback"] and area([(p["x"], p["y"]) for p in got[n + 25]["q"]["quad"]]) == pytest.approx(600)


def test_outline_points(spark):
    mask = [(0, x, y) for x in range(3, 20) for y in range(2, 9)]
    runs = regions.mask_runs(spark.createDataFrame(mask, "img int, x int, y int"), "img")
    hull = quads.outline_points(runs, "img").select(quads.convex_hull(F.col("points")).alias("h")).first()["h"]
    assert {(p["x"], p["y"]) for p in hull} == {(3, 2), (19, 2), (19, 8), (3, 8)}


def plain_snap(on, quad):
    support = 0.0
    for band in (14, 6):
        lines, hits, total = [], 0, 0
        for i in range(4):
            a, b = quad[i], quad[(i + 1) % 4]
            n = math.dist(a, b) or 1
            u = ((b[0] - a[0]) / n, (b[1] - a[1]) / n)
            steps, found = max(10, math.floor(n / 4 + 0.5)), []
            for s in range(1, steps):
                t = s / steps
                if not 0.08 <= t <= 0.92:
                    continue
                total += 1
                cx, cy = a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t
                for o in sorted(range(-band, band + 1), key=lambda o: (abs(o), -o)):
                    px, py = cx - u[1] * o, cy + u[0] * o
                    if px >= 0 and py >= 0 and (int(px), int(py)) in on:
                        found.append((px, py))
                        hits += abs(o) <= 2
                        break
            if len(found) < 6:
                lines.append((a, u))
                continue
            x, y = np.array(found).T
            d = 0.5 * math.atan2(2 * ((x - x.mean()) * (y - y.mean())).sum(), ((x - x.mean()) ** 2).sum() - ((y - y.mean()) ** 2).sum())
            v = (math.cos(d), math.sin(d))
            lines.append(((x.mean(), y.mean()), v if v[0] * u[0] + v[1] * u[1] >= 0 else (-v[0], -v[1])))
        corners = []
        for i in range(4):
            (p, u), (q, v) = lines[(i + 3) % 4], lines[i]
            den = u[0] * v[1] - u[1] * v[0]
            t = ((q[0] - p[0]) * v[1] - (q[1] - p[1]) * v[0]) / den if abs(den) >= 1e-6 else None
            corners.append(quad[i] if t is None else (p[0] + u[0] * t, p[1] + u[1] * t))
        if max(math.dist(p, q) for p, q in zip(corners, quad, strict=True)) < band * 2.5:
            quad = corners
        support = hits / total if total else 0.0
    return quad, support


def test_snapped_sides(spark):
    rng = random.Random(6)
    true = [(40.0, 30.0), (180.0, 42.0), (172.0, 120.0), (34.0, 110.0)]
    on = {(int(a[0] + (b[0] - a[0]) * t / 400), int(a[1] + (b[1] - a[1]) * t / 400)) for a, b in zip(true, true[1:] + true[:1], strict=True) for t in range(400)}
    on |= {(rng.randrange(220), rng.randrange(150)) for _ in range(60)}
    rough = [[(x + rng.uniform(-9, 9), y + rng.uniform(-9, 9)) for x, y in true] for _ in range(4)] + [[(300.0, 300.0), (380.0, 300.0), (380.0, 360.0), (300.0, 360.0)]]
    found = quads.snapped(spark.createDataFrame([(k, 0, q) for k, q in enumerate(rough)], f"id int, img int, quad {POINTS}"), spark.createDataFrame([(0, x, y) for x, y in on], "img int, x int, y int"), "img", "id")
    got = {r["id"]: r for r in found.collect()}
    for k, q in enumerate(rough):
        want, support = plain_snap(on, q)
        assert np.allclose([(p["x"], p["y"]) for p in got[k]["quad"]], want) and got[k]["support"] == pytest.approx(support)
    assert max(math.dist((p["x"], p["y"]), t) for p, t in zip(got[0]["quad"], true, strict=True)) < 2 and got[0]["support"] > 0.9 and got[4]["support"] == 0


def plain_warp(image, quad, cubic, margin=0.05):
    d = math.dist
    w, h = (d(quad[0], quad[1]) + d(quad[3], quad[2])) / 2, (d(quad[0], quad[3]) + d(quad[1], quad[2])) / 2
    w, h = math.floor(w + 0.5), math.floor(h + 0.5)
    m = max(math.floor(w * margin + 0.5), math.floor(h * margin + 0.5))
    rows, right = [], []
    for (x, y), (u, v) in zip(quad, [(m, m), (m + w, m), (m + w, m + h), (m, m + h)], strict=True):
        rows += [[u, v, 1, 0, 0, 0, -x * u, -x * v], [0, 0, 0, u, v, 1, -y * u, -y * v]]
        right += [x, y]
    c = np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)
    out = np.zeros((h + 2 * m, w + 2 * m), int)
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            sx, sy, k = c @ (x, y, 1)
            sx, sy = sx / k, sy / k
            fx, fy = math.floor(sx), math.floor(sy)
            reach = range(-1, 3) if cubic else range(2)
            weight = (lambda t: (1.25 * t - 2.25) * t * t + 1 if t <= 1 else ((-0.75 * t + 3.75) * t - 6) * t + 3) if cubic else (lambda t: 1 - t)
            v = sum(weight(abs(sx - fx - i)) * weight(abs(sy - fy - j)) * image[min(max(fy + j, 0), image.shape[0] - 1), min(max(fx + i, 0), image.shape[1] - 1)] for i in reach for j in reach)
            out[y, x] = min(max(math.floor(round(v, 9) + 0.5), 0), 255)
    return out


@pytest.mark.parametrize("cubic", [True, False])
def test_flattened(spark, cubic):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (40, 50))
    some = [[(8.0, 6.0), (38.0, 9.5), (41.0, 30.0), (5.5, 28.0)], [(-3.0, 2.0), (20.0, 2.0), (20.0, 20.0), (-3.0, 20.0)]]
    table = spark.createDataFrame([(1, x, y, int(image[y, x])) for y in range(40) for x in range(50)], "img int, x int, y int, v int")
    got = warp.flattened(spark.createDataFrame([(k, 1, q) for k, q in enumerate(some)], f"id int, img int, quad {POINTS}"), table, "img", "id", ("v",), cubic).collect()
    for k, q in enumerate(some):
        want = plain_warp(image, q, cubic)
        have = {(r["x"], r["y"]): r["v"] for r in got if r["id"] == k}
        assert len(have) == want.size
        assert sum(abs(have[x, y] - want[y, x]) > 1 for x, y in have) == 0 and sum(have[x, y] != want[y, x] for x, y in have) < 5


def test_rounded_card(spark):
    rows = [(1, x, y, 10, 20, 30) for x in range(60) for y in range(50)]
    card = warp.rounded_card(spark.createDataFrame(rows, "img int, x int, y int, r int, g int, b int"), spark.createDataFrame([(1, 6, 5, 45, 38)], "img int, left int, top int, w int, h int"), "img", 0.2).collect()
    at = {(r["x"], r["y"]): r for r in card}
    inside = np.zeros((60, 70))
    r = math.floor(38 * 0.2 + 0.5)
    for y in range(-2, 55):
        for x in range(-2, 65):
            dx, dy = max(6 + r - x, x - (51 - r), 0), max(5 + r - y, y - (43 - r), 0)
            inside[y + 2, x + 2] = dx * dx + dy * dy <= r * r
    w = np.exp(-(np.arange(-2, 3) ** 2) / 0.98)
    w /= w.sum()
    for y in range(50):
        for x in range(60):
            want = math.floor(round(255 * float((inside[y : y + 5, x : x + 5] * np.outer(w, w)).sum()), 9) + 0.5)
            if (x - 2, y - 1) in at:
                got = at[x - 2, y - 1]
                assert got["a"] == want and (got["r"], got["g"], got["b"]) == ((10, 20, 30) if want else (255, 255, 255))
            else:
                assert want == 0
    assert at[20, 20]["a"] == 255 and min(r["a"] for r in card) == 0


def test_regions_put_back(spark):
    rows = [(1, x, y, 1, 2, 3, 255) for x in range(8) for y in range(6)]
    image = spark.createDataFrame(rows, "img int, x int, y int, r int, g int, b int, a int")
    parts = [(1, 1, 1, 1, 4, 3, bytes([9, 9, 9, 200] * 12)), (1, 2, 3, 2, 2, 2, bytes(range(16)))]
    df = spark.createDataFrame(parts, "img int, id long, left int, top int, width int, height int, bytes binary")
    got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in warp.put_back(image, df, "img").collect()}
    assert len(got) == 48 and got[0, 0] == (1, 2, 3, 255) and got[1, 1] == (9, 9, 9, 200) and got[3, 2] == (0, 1, 2, 3) and got[4, 3] == (12, 13, 14, 15)
    smeared = pixels.redact(df.withColumn("reason", F.lit("barcode")).withColumn("raw_height", F.lit(4.0)).withColumn("seed", F.lit(7)))
    assert warp.put_back(image, df.drop("bytes").join(smeared, "id"), "img").count() == 48
