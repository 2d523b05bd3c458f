"""Filters and code regions against loops over pixels."""

import random

import numpy as np
import pytest

from quillet.operators import codes, regions
from tests.test_regions import EIGHT, plain_outlines, walk


def at(a, y, x, mirror=True):
    h, w = a.shape
    if mirror:
        y, x = (h - 1 - abs(h - 1 - abs(y))), (w - 1 - abs(w - 1 - abs(x)))
    return int(a[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])


def plain_gradients(a, side, middle, mirror):
    h, w = a.shape
    k = {-1: side, 0: middle, 1: side}
    gx = [[sum(k[j] * (at(a, y + j, x + 1, mirror) - at(a, y + j, x - 1, mirror)) for j in k) for x in range(w)] for y in range(h)]
    gy = [[sum(k[i] * (at(a, y + 1, x + i, mirror) - at(a, y - 1, x + i, mirror)) for i in k) for x in range(w)] for y in range(h)]
    return np.array(gx), np.array(gy)


def plain_sums(a, reach):
    h, w = a.shape
    return np.array([[sum(at(a, y + j, x + i) for j in range(-reach, reach + 1) for i in range(-reach, reach + 1)) for x in range(w)] for y in range(h)])


def plain_otsu(values):
    best, cut = -1.0, None
    for t in sorted(set(values.ravel().tolist())):
        one, two = values[values <= t], values[values > t]
        apart = len(one) * len(two) * (one.mean() - two.mean()) ** 2 if len(two) else 0.0
        if apart > best * (1 + 1e-12):
            best, cut = apart, t
    return cut


def plain_frame(a, f, x, y):
    h, w = a.shape
    return np.array([[f(a[max(0, j - y) : j + y + 1, max(0, i - x) : i + x + 1]) for i in range(w)] for j in range(h)])


def plain_bar_mask(a, vertical):
    gx, gy = (np.minimum(abs(g), 255) for g in plain_gradients(a, 3, 10, True))
    d = np.maximum(gy - gx if vertical else gx - gy, 0)
    mean = np.rint(plain_sums(d, 4) / 81).astype(int)
    on = (mean > plain_otsu(mean)).astype(int)
    x, y = (3, 10) if vertical else (10, 3)
    for f, i, j in ((np.max, x, y), (np.min, x, y), (np.min, 4, 4), (np.max, 4, 4)):
        on = plain_frame(on, f, i, j)
    return on


def plain_canny(a, low, high):
    gx, gy = plain_gradients(a, 1, 2, False)
    m = abs(gx) + abs(gy)
    get = lambda y, x: int(m[y, x]) if 0 <= y < m.shape[0] and 0 <= x < m.shape[1] else 0
    kept = set()
    for y, x in zip(*np.nonzero(m > low), strict=True):
        ax, ay, v = abs(int(gx[y, x])), abs(int(gy[y, x])), int(m[y, x])
        if ay * 32768 < ax * 13573:
            crest = v > get(y, x - 1) and v >= get(y, x + 1)
        elif ay * 32768 > ax * (13573 + 65536):
            crest = v > get(y - 1, x) and v >= get(y + 1, x)
        else:
            s = 1 if (gx[y, x] < 0) == (gy[y, x] < 0) else -1
            crest = v > get(y - 1, x - s) and v > get(y + 1, x + s)
        if crest:
            kept.add((int(x), int(y)))
    edges, left = set(), set(kept)
    for x, y in kept:
        if (x, y) in left and m[y, x] > high:
            part = walk(kept, (x, y), EIGHT)
            edges |= part
            left -= part
    return edges


def image(rng, kind):
    h, w = 96, 130
    a = np.array([[200 + rng.randrange(12) for _ in range(w)] for _ in range(h)])
    if kind in ("bars", "both"):
        bars = [rng.choice((15, 235)) for _ in range(60)]
        a[12:44, 8:68] = np.array(bars)[None, :]
    if kind == "upright":
        a[10:80, 20:50] = np.array([rng.choice((15, 235)) for _ in range(70)])[:, None]
    if kind in ("block", "both"):
        a[44:92, 76:124] = [[20 if (i // 3 + j // 8) % 2 else 240 for i in range(48)] for j in range(48)]
    if kind == "text":
        a[20:60, 10:90] = np.array([[rng.choice((20, 230)) for _ in range(80)] for _ in range(40)])
    return a


@pytest.fixture(scope="module")
def pictures(spark):
    rng = random.Random(12)
    some = {k: image(rng, kind) for k, kind in enumerate(("both", "bars", "upright", "text", "plain"))}
    rows = [(k, x, y, int(a[y, x])) for k, a in some.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return some, spark.createDataFrame(rows, "img int, x int, y int, v int").repartition(4, "img", "y").cache()


def pixel_set(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["img"], set()).add((r["x"], r["y"]))
    return out


def test_filters(pictures):
    some, pixels = pictures
    for side, middle, mirror in ((3, 10, True), (1, 2, False)):
        got = {(r["img"], r["x"], r["y"]): (r["gx"], r["gy"]) for r in codes.gradients(pixels.where("img < 2"), "img", side, middle, mirror).collect()}
        for k in (0, 1):
            gx, gy = plain_gradients(some[k], side, middle, mirror)
            assert all(got[k, x, y] == (gx[y, x], gy[y, x]) for y in range(96) for x in range(130))
    assert {r["img"]: r["cut"] for r in codes.otsu(pixels, "img", "v").collect()} == {k: plain_otsu(a) for k, a in some.items()}


def test_bar_masks_and_edges(pictures):
    some, pixels = pictures
    for vertical in (False, True):
        got = pixel_set(codes.bar_mask(pixels, "img", vertical))
        for k, a in some.items():
            assert got.get(k, set()) == {(int(x), int(y)) for y, x in zip(*np.nonzero(plain_bar_mask(a, vertical)), strict=True)}
    got = pixel_set(codes.canny(pixels, "img"))
    for k, a in some.items():
        assert got.get(k, set()) == plain_canny(a, 60, 160)


def test_regions(pictures):
    some, pixels = pictures
    found = {vertical: {r["img"]: (r["x"], r["y"], r["w"], r["h"]) for r in codes.bar_regions(pixels, "img", vertical).collect()} for vertical in (False, True)}
    assert set(found[False]) == {0, 1} and set(found[True]) == {2}
    for vertical, boxes in found.items():
        for k, box in boxes.items():
            mask = {(int(x), int(y)) for y, x in zip(*np.nonzero(plain_bar_mask(some[k], vertical)), strict=True)}
            assert box in {o[2:6] for o in plain_outlines(mask)}
    blocks = {r["img"]: r for r in codes.block_regions(pixels, "img").collect()}
    assert set(blocks) == {0}  # bars are no square, and random pixels have no lasting crests
    r, edges = blocks[0], plain_canny(some[0], 60, 160)
    inside = sum(r["x"] <= x < r["x"] + r["w"] and r["y"] <= y < r["y"] + r["h"] for x, y in edges)
    assert r["density"] == inside / (r["w"] * r["h"]) and abs(r["x"] - 76) < 8 and abs(r["y"] - 44) < 8
    every = [(k, *box) for boxes in found.values() for k, box in boxes.items()] + [(0, *(int(r[c]) for c in "xywh")), (0, 70, 40, 30, 30)]
    merged = codes.merged_regions(pixels.sparkSession.createDataFrame(every, "img int, x int, y int, w int, h int"), "img")
    assert {r["img"]: len(r["boxes"]) for r in merged.collect()} == {0: 2, 1: 1, 2: 1}


def test_runs_keep_sums(spark):
    rows = [(0, 1, 1, 5), (0, 2, 1, 7), (0, 4, 1, 1)]
    from pyspark.sql import functions as F

    got = regions.mask_runs(spark.createDataFrame(rows, "img int, x int, y int, v int"), "img", F.sum("v").alias("s"))
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 2, 12), (0, 1, 4, 4, 1)]
