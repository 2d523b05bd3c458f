"""Masks against pixel-by-pixel walks in plain Python."""

import random
from collections import defaultdict

import pytest

from quillet.operators import components, regions

EIGHT = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if (x, y) != (0, 0)]
FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]


def walk(pixels, start, steps):
    seen, todo = {start}, [start]
    while todo:
        x, y = todo.pop()
        for dx, dy in steps:
            p = (x + dx, y + dy)
            if p in pixels and p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


def plain_outlines(mask):
    """Of each outer component: first pixel, box, area by the squares between pixels, and its pixels with holes."""
    if not mask:
        return []
    xs, ys = [x for x, _ in mask], [y for _, y in mask]
    box = {(x, y) for x in range(min(xs) - 1, max(xs) + 2) for y in range(min(ys) - 1, max(ys) + 2)}
    full = box - walk(box - mask, (min(xs) - 1, min(ys) - 1), FOUR)
    out = []
    while full:
        part = walk(full, next(iter(full)), EIGHT)
        full -= part
        area = 0.0
        for x, y in {(x - a, y - b) for x, y in part for a in (0, 1) for b in (0, 1)}:
            area += {4: 1.0, 3: 0.5}.get(sum((x + a, y + b) in part for a in (0, 1) for b in (0, 1)), 0.0)
        ys, xs = [y for _, y in part], [x for x, _ in part]
        first = min((y, x) for x, y in part)
        out.append((*first, min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, area, part))
    return out


def images(rng):
    shapes = defaultdict(set)
    for g in range(6):
        for _ in range(rng.randrange(1, 9)):
            x, y, w, h = rng.randrange(150), rng.randrange(20), rng.randrange(1, 40), rng.randrange(1, 12)
            shapes[g] |= {(x + i, y + j) for i in range(w) for j in range(h)}
            shapes[g] -= {(x + i, y + j) for i in range(2, w - 2) for j in range(1, h - 1) if rng.random() < 0.8}
        shapes[g] |= {(rng.randrange(200), rng.randrange(30)) for _ in range(40)}
    shapes[7] = {(3, 3)}
    shapes[8] = {(x, y) for x in range(30) for y in range(30) if (x % 10 in (0, 9) or y % 10 in (0, 9)) and (x + y) % 11}
    ring = {(x, y) for x in range(20) for y in range(20)} - {(x, y) for x in range(2, 18) for y in range(2, 18)}
    shapes[9] = ring | {(x, y) for x in range(6, 12) for y in range(6, 12)}
    shapes[10] = {(k, k) for k in range(70)} | {(69 - k, k) for k in range(70)}
    return shapes


@pytest.fixture(scope="module")
def masks(spark):
    shapes = images(random.Random(9))
    rows = [(g, x, y) for g, s in shapes.items() for x, y in s]
    return shapes, regions.mask_runs(spark.createDataFrame(rows, "img int, x int, y int"), "img")


def test_outlines(masks):
    shapes, runs = masks
    got = sorted((r["img"], r["ly"], r["lx"], r["x"], r["y"], r["w"], r["h"], r["area"]) for r in regions.outlines(regions.outer(runs, "img"), "img").collect())
    assert got == sorted((g, *o[:7]) for g, s in shapes.items() for o in plain_outlines(s))


def test_blobs_and_largest(masks):
    shapes, runs = masks
    kept = sorted(tuple(r) for r in regions.blobs(runs, "img").select("img", "x", "y", "w", "h").collect())
    want = sorted((g, *o[2:6]) for g, s in shapes.items() for o in plain_outlines(s) if o[6] / (o[4] * o[5]) > 0.55)
    assert kept == want and kept
    got = {(r["img"], x, r["y"]) for r in regions.largest(runs, "img").collect() for x in range(r["x0"], r["x1"] + 1)}
    best = {g: max(plain_outlines(s), key=lambda o: (o[6], -o[0], -o[1])) for g, s in shapes.items()}
    assert got == {(g, *p) for g, o in best.items() if o[6] > 0 for p in o[7]} and 7 not in {g for g, *_ in got}


def test_holes_and_no_pixels(spark, masks):
    shapes, runs = masks
    got = {(r["img"], x, r["y"]) for r in regions.filled(runs, "img").collect() for x in range(r["x0"], r["x1"] + 1)}
    assert got == {(g, *p) for g, s in shapes.items() for o in plain_outlines(s) for p in o[7]}
    none = regions.mask_runs(spark.createDataFrame([], "img int, x int, y int"), "img")
    assert regions.blobs(none, "img").collect() == [] and regions.largest(none, "img").collect() == []


def test_components_of_any_graph(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)] + [(f"p{k:03}", f"p{k + 1:03}") for k in range(150)] + [("s000", f"s{k:03}") for k in range(90)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "a string, b string")).collect()))
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {n: r for n, r in root.items() if n != r}
