"""Queries of masks, code regions, quads and flattened items (H10, M2-M4, M6-M8, M13, M16): embeddings as images, a label's
vectors one below the other."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.operators import boxes, codes, quads, regions, warp
from quillet.plans.base import query, spread, table
from quillet.plans.board import _PIXELS_SQL, _pixels

#: From a mask m (img, x, y): runs r, gaps g, gaps that the outside reaches o, runs without holes f with the place l of the
#: first run of their component, and its box and outline u.
OUTLINES_SQL = """r AS MATERIALIZED (SELECT img, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY img, y ORDER BY x) AS k FROM m) GROUP BY img, y, k),
    b AS (SELECT img, min(x0) - 1 AS lo, max(x1) + 1 AS hi, min(y) - 1 AS top, max(y) + 1 AS bottom FROM r GROUP BY img),
    e AS (SELECT img, y, lo - 1 AS x0, lo - 1 AS x1 FROM (SELECT *, unnest(range(top, bottom + 1)) AS y FROM b) UNION ALL SELECT img, y, hi + 1, hi + 1 FROM (SELECT *, unnest(range(top, bottom + 1)) AS y FROM b) UNION ALL SELECT * FROM r),
    g AS MATERIALIZED (SELECT img, y, x1 + 1 AS x0, z - 1 AS x1 FROM (SELECT *, lead(x0) OVER (PARTITION BY img, y ORDER BY x0) AS z FROM e) WHERE x1 + 1 <= z - 1),
    o AS (SELECT g.* FROM g JOIN b ON g.img = b.img AND g.y = b.top UNION SELECT g.* FROM o JOIN g ON g.img = o.img AND abs(g.y - o.y) = 1 AND g.x0 <= o.x1 AND g.x1 >= o.x0),
    h AS (SELECT img, y, x0, x1 FROM r UNION ALL SELECT * FROM g ANTI JOIN o USING (img, y, x0)),
    s AS (SELECT *, sum(opens) OVER (PARTITION BY img, y ORDER BY x0) AS k FROM (SELECT *, coalesce(x0 > lag(x1) OVER (PARTITION BY img, y ORDER BY x0) + 1, true)::INT AS opens FROM h)),
    w AS MATERIALIZED (SELECT img, y, min(x0) AS x0, max(x1) AS x1 FROM s GROUP BY img, y, k),
    t AS MATERIALIZED (SELECT a.img, a.y AS ay, a.x0 AS a0, a.x1 AS a1, b.y AS yb, b.x0 AS b0, b.x1 AS b1 FROM w AS a JOIN w AS b ON a.img = b.img AND b.y = a.y + 1 AND a.x0 - 1 <= b.x1 AND a.x1 + 1 >= b.x0),
    n AS MATERIALIZED (SELECT img, ay AS y, a0 AS x0, yb AS y2, b0 AS x2 FROM t UNION ALL SELECT img, yb, b0, ay, a0 FROM t),
    c AS (SELECT img, y, x0, y AS ly, x0 AS lx FROM w UNION SELECT n.img, n.y2, n.x2, c.ly, c.lx FROM c JOIN n USING (img, y, x0) WHERE (c.ly, c.lx) < (n.y2, n.x2)),
    l AS MATERIALIZED (SELECT img, y, x0, min((ly, lx)) AS l FROM c GROUP BY img, y, x0),
    q AS (SELECT t.img, l.l, sum(CASE WHEN a0 <= b1 AND a1 >= b0 THEN greatest(0, least(a1, b1) - greatest(a0, b0)) + ((b0 > a0 AND b0 <= a1)::INT + (b1 >= a0 AND b1 < a1)::INT + (a0 > b0 AND a0 <= b1)::INT + (a1 >= b0 AND a1 < b1)::INT) / 2.0 ELSE 0 END) AS area
          FROM t JOIN l ON l.img = t.img AND l.y = t.ay AND l.x0 = t.a0 GROUP BY t.img, l.l),
    u AS (SELECT img, l, x, y, w, h, coalesce(area, 0)::DOUBLE AS area FROM (SELECT img, l, min(x0) AS x, min(y) AS y, max(x1) - min(x0) + 1 AS w, max(y) - min(y) + 1 AS h FROM l JOIN w USING (img, y, x0) GROUP BY img, l) LEFT JOIN q USING (img, l))"""

#: Cells of 8 x 6 pixels are on by their first pixel; single pixels are cut out by their own.
_CELLS_SQL = f"""{_PIXELS_SQL}, m AS MATERIALIZED (SELECT p.img, p.x, p.y FROM p JOIN p AS c ON c.img = p.img AND c.x = p.x - p.x % 8 AND c.y = p.y - p.y % 6 WHERE c.v > 75 AND p.v < 140)"""


def _cells(spark, sf_dir) -> DataFrame:
    p = _pixels(spark, sf_dir)
    first = p.where("x % 8 = 0 AND y % 6 = 0").select("img", F.col("x").alias("cx"), F.col("y").alias("cy"), (F.col("v") > 75).alias("lit"))
    held = p.withColumns({"cx": F.col("x") - F.col("x") % 8, "cy": F.col("y") - F.col("y") % 6}).join(first, ["img", "cx", "cy"]).where("lit AND v < 140")
    return regions.mask_runs(held.select("img", "x", "y"), "img")


@query("m16_blobs", f"WITH RECURSIVE {_CELLS_SQL}, {OUTLINES_SQL} SELECT img, x, y, w, h, round(area / (w * h), 9) AS fill FROM u WHERE area / (w * h) > 0.55")
def m16_blobs(spark, sf_dir):
    return regions.blobs(_cells(spark, sf_dir), "img").select("img", "x", "y", "w", "h", F.round("fill", 9).alias("fill"))


@query(
    "h10_largest",
    f"""WITH RECURSIVE {_CELLS_SQL}, {OUTLINES_SQL}, k AS (SELECT img, arg_max(l, (area, -l[1], -l[2])) AS l FROM u WHERE area > 0 GROUP BY img)
    SELECT img, y, w.x0, w.x1 FROM k JOIN l USING (img, l) JOIN w USING (img, y, x0)""",
)
def h10_largest(spark, sf_dir):
    return regions.largest(_cells(spark, sf_dir), "img")


#: Pictures of two pixels a value: bars, a block of modules, or text by label, on grey paper with grain.
_PICTURES_SQL = f"""{_PIXELS_SQL}, pic AS MATERIALIZED (SELECT img, x, y, CASE WHEN img % 3 = 0 AND x BETWEEN 8 AND 71 AND y BETWEEN 12 AND 43 THEN CASE WHEN f % 2 = 0 THEN 15 ELSE 235 END
      WHEN img % 3 = 1 AND x BETWEEN 60 AND 107 AND y BETWEEN 20 AND 67 THEN CASE WHEN ((x - 60) // 3 + (y - 20) // 8) % 2 = 1 THEN 20 ELSE 240 END
      WHEN img % 3 = 2 AND x BETWEEN 10 AND 89 AND y BETWEEN 20 AND 59 THEN CASE WHEN v < 128 THEN 20 ELSE 230 END ELSE 200 + v % 12 END AS v
    FROM (SELECT p.img, 2 * p.x + i AS x, 2 * p.y + j AS y, p.v, q.v AS f FROM p JOIN p AS q ON q.img = p.img AND q.x = p.x AND q.y = 0, range(2) AS a(i), range(2) AS b(j))),
    fr AS MATERIALIZED (SELECT img, max(x) + 1 AS wide, max(y) + 1 AS tall FROM pic GROUP BY img)"""


def _pictures(spark, sf_dir) -> DataFrame:
    p = _pixels(spark, sf_dir)
    top = p.where("y = 0").select("img", "x", F.col("v").alias("f"))
    twice = lambda c: F.explode(F.array(2 * F.col(c), 2 * F.col(c) + 1)).alias(c)
    large = p.join(top, ["img", "x"]).select("img", twice("x"), "y", "v", "f").select("img", "x", twice("y"), "v", "f")
    x, y, v, kind = F.col("x"), F.col("y"), F.col("v"), F.col("img") % 3
    module = (F.floor((x - 60) / 3) + F.floor((y - 20) / 8)) % 2 == 1
    ink = F.when((kind == 0) & x.between(8, 71) & y.between(12, 43), F.when(F.col("f") % 2 == 0, 15).otherwise(235))
    ink = ink.when((kind == 1) & x.between(60, 107) & y.between(20, 67), F.when(module, 20).otherwise(240))
    ink = ink.when((kind == 2) & x.between(10, 89) & y.between(20, 59), F.when(v < 128, 20).otherwise(230)).otherwise(200 + v % 12)
    return large.select("img", "x", "y", ink.alias("v"))


def _gradients_sql(source: str, side: int, middle: int, mirror: bool) -> str:
    l, r = ("coalesce(lag({0}) OVER {1}, lead({0}) OVER {1}, {0})", "coalesce(lead({0}) OVER {1}, lag({0}) OVER {1}, {0})") if mirror else ("coalesce(lag({0}) OVER {1}, {0})", "coalesce(lead({0}) OVER {1}, {0})")  # noqa: E741
    at = lambda f, v, w: f.format(v, w)
    return f"""gl AS (SELECT img, x, y, v, {at(r, "v", "wx")} - {at(l, "v", "wx")} AS d, {side} * ({at(l, "v", "wx")} + {at(r, "v", "wx")}) + {middle} * v AS s FROM {source} WINDOW wx AS (PARTITION BY img, y ORDER BY x)),
    gr AS MATERIALIZED (SELECT img, x, y, {side} * ({at(l, "d", "wy")} + {at(r, "d", "wy")}) + {middle} * d AS gx, {at(r, "s", "wy")} - {at(l, "s", "wy")} AS gy FROM gl WINDOW wy AS (PARTITION BY img, x ORDER BY y))"""


def _box_sums_sql(source: str, value: str, reach: str) -> str:
    """bs (img, x, y, sum): sums over squares, mirrored at the border."""
    mirror = lambda c, size: f"({size} - 1 - abs({size} - 1 - abs({c})))"
    return f"""bh AS MATERIALIZED (SELECT a.img, a.x, a.y, sum(b.{value}) AS sum FROM (SELECT *, unnest(range(-{reach}, {reach} + 1)) AS i FROM {source} JOIN fr USING (img)) AS a JOIN {source} AS b ON b.img = a.img AND b.y = a.y AND b.x = {mirror("a.x + a.i", "a.wide")} GROUP BY ALL),
    bs AS MATERIALIZED (SELECT a.img, a.x, a.y, sum(b.sum) AS sum FROM (SELECT *, unnest(range(-{reach}, {reach} + 1)) AS i FROM bh JOIN fr USING (img)) AS a JOIN bh AS b ON b.img = a.img AND b.x = a.x AND b.y = {mirror("a.y + a.i", "a.tall")} GROUP BY ALL)"""


def _morphed_sql(source: str, steps: tuple[tuple[str, str, str], ...]) -> str:
    """mo (img, x, y, on) after running maxima and minima over rows of the frame's sizes."""
    out = []
    for k, (along, f, reach) in enumerate(steps):
        other = "y" if along == "x" else "x"
        out.append(f"mo{k} AS MATERIALIZED (SELECT img, x, y, {f}(lit) OVER (PARTITION BY img, {other} ORDER BY {along} RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS lit FROM {f'mo{k - 1}' if k else source})")
    return ",\n    ".join(out)


_IN_U = "JOIN pic ON pic.img = z.img AND pic.x >= z.x AND pic.x < z.x + z.w AND pic.y >= z.y AND pic.y < z.y + z.h"


@query(
    "m7_bars",
    f"""WITH RECURSIVE {_PICTURES_SQL}, {_gradients_sql("pic", 3, 10, True)},
    df AS MATERIALIZED (SELECT img, x, y, greatest(least(abs(gx), 255) - least(abs(gy), 255), 0) AS d FROM gr), {_box_sums_sql("df", "d", "4")},
    me AS MATERIALIZED (SELECT img, x, y, round_even(sum / 81.0, 0)::INT AS v FROM bs),
    hi AS (SELECT img, v, sum(count(*)) OVER (PARTITION BY img ORDER BY v) AS n1, sum(sum(v)) OVER (PARTITION BY img ORDER BY v) AS s1, sum(count(*)) OVER (PARTITION BY img) AS n, sum(sum(v)) OVER (PARTITION BY img) AS s FROM me GROUP BY img, v),
    ot AS (SELECT img, arg_max(v, (CASE WHEN n1 < n THEN pow(s1::DOUBLE * n - s::DOUBLE * n1, 2) / (n1::DOUBLE * (n - n1)) ELSE 0 END, -v)) AS cut FROM hi GROUP BY img),
    on0 AS (SELECT img, x, y, (v > cut)::INT AS lit FROM me JOIN ot USING (img)),
    {_morphed_sql("on0", (("x", "max", "10"), ("y", "max", "3"), ("y", "min", "3"), ("x", "min", "10"), ("x", "min", "4"), ("y", "min", "4"), ("y", "max", "4"), ("x", "max", "4")))},
    m AS MATERIALIZED (SELECT img, x, y FROM mo7 WHERE lit = 1), {OUTLINES_SQL},
    z AS MATERIALIZED (SELECT u.* FROM u JOIN fr USING (img) WHERE area / (w * h) > 0.55 AND w * h >= wide * tall * 0.006 AND w >= wide * 0.08 AND h >= 14),
    li AS (SELECT z.img, z.l, pic.x, pic.y, pic.v FROM z {_IN_U} WHERE pic.y IN (floor(z.y + z.h * 0.3 + 0.5), floor(z.y + z.h * 0.5 + 0.5), floor(z.y + z.h * 0.7 + 0.5))),
    mi AS (SELECT *, (min(v) OVER w3 + max(v) OVER w3) / 2 AS mid, max(v) OVER w3 - min(v) OVER w3 AS span FROM li WINDOW w3 AS (PARTITION BY img, l, y)),
    fl AS (SELECT img, l, y, span, (v > mid) <> (lag(v) OVER (PARTITION BY img, l, y ORDER BY x) > mid) AS flip FROM mi),
    st AS (SELECT img, l FROM (SELECT img, l, y, count(*) FILTER (WHERE flip) / count(*) AS flips FROM fl WHERE span >= 50 GROUP BY img, l, y) GROUP BY img, l HAVING avg(flips) > 0.12),
    co AS (SELECT z.img, z.l, z.x AS zx, z.y AS zy, z.w, z.h, pic.x, pic.y, abs(lead(v) OVER (PARTITION BY z.img, z.l, pic.y ORDER BY pic.x) - v) AS dx, abs(lead(v) OVER (PARTITION BY z.img, z.l, pic.x ORDER BY pic.y) - v) AS dy FROM z {_IN_U}),
    ch AS (SELECT img, l FROM co WHERE x >= floor(zx + w * 0.02 + 0.5) AND x < floor(zx + w * 0.98 + 0.5) - 1 AND y >= floor(zy + h * 0.15 + 0.5) AND y < floor(zy + h * 0.85 + 0.5) - 1 GROUP BY img, l HAVING sum(dx) > 0 AND sum(dy) / sum(dx) < 0.35)
    SELECT z.img, x, y, w, h, st.l IS NOT NULL AND ch.l IS NOT NULL AS bars FROM z LEFT JOIN st ON st.img = z.img AND st.l = z.l LEFT JOIN ch ON ch.img = z.img AND ch.l = z.l""",
)
def m7_bars(spark, sf_dir):
    """All blocks of the size of a code, and which of them are one."""
    pictures = codes.cut_lineage(_pictures(spark, sf_dir))
    sized = codes.cut_lineage(codes.bar_blocks(pictures, "img"))
    found = codes.checked_bars(pictures, sized, "img").withColumn("bars", F.lit(True))
    return sized.join(found, ["img", "x", "y", "w", "h"], "left").withColumn("bars", F.coalesce("bars", F.lit(False)))


@query(
    "m8_blocks",
    f"""WITH RECURSIVE {_PICTURES_SQL}, {_gradients_sql("pic", 1, 2, False)},
    ma AS MATERIALIZED (SELECT *, abs(gx) + abs(gy) AS m FROM gr),
    nb AS (SELECT a.*, coalesce(max(b.m) FILTER (WHERE b.x = a.x - 1 AND b.y = a.y), 0) AS l, coalesce(max(b.m) FILTER (WHERE b.x = a.x + 1 AND b.y = a.y), 0) AS r, coalesce(max(b.m) FILTER (WHERE b.x = a.x AND b.y = a.y - 1), 0) AS u, coalesce(max(b.m) FILTER (WHERE b.x = a.x AND b.y = a.y + 1), 0) AS d,
             coalesce(max(b.m) FILTER (WHERE b.x = a.x - 1 AND b.y = a.y - 1), 0) AS lu, coalesce(max(b.m) FILTER (WHERE b.x = a.x + 1 AND b.y = a.y - 1), 0) AS ru, coalesce(max(b.m) FILTER (WHERE b.x = a.x - 1 AND b.y = a.y + 1), 0) AS ld, coalesce(max(b.m) FILTER (WHERE b.x = a.x + 1 AND b.y = a.y + 1), 0) AS rd
           FROM (SELECT *, unnest([-1, 0, 1]) AS i FROM (SELECT *, unnest([-1, 0, 1]) AS j FROM ma WHERE m > 60)) AS a LEFT JOIN ma AS b ON b.img = a.img AND b.x = a.x + a.i AND b.y = a.y + a.j GROUP BY a.img, a.x, a.y, a.gx, a.gy, a.m, a.i, a.j),
    nn AS (SELECT img, x, y, gx, gy, m, max(l) AS l, max(r) AS r, max(u) AS u, max(d) AS d, max(lu) AS lu, max(ru) AS ru, max(ld) AS ld, max(rd) AS rd FROM nb GROUP BY img, x, y, gx, gy, m),
    cr AS MATERIALIZED (SELECT img, x, y, m FROM nn WHERE CASE WHEN abs(gy) * 32768 < abs(gx) * 13573 THEN m > l AND m >= r WHEN abs(gy) * 32768 > abs(gx) * (13573 + 65536) THEN m > u AND m >= d WHEN (gx < 0) = (gy < 0) THEN m > lu AND m > rd ELSE m > ru AND m > ld END),
    ed AS (SELECT img, x, y FROM cr WHERE m > 160 UNION SELECT cr.img, cr.x, cr.y FROM ed JOIN cr ON cr.img = ed.img AND abs(cr.x - ed.x) <= 1 AND abs(cr.y - ed.y) <= 1),
    em AS MATERIALIZED (SELECT * FROM ed),
    df AS MATERIALIZED (SELECT pic.img, pic.x, pic.y, (em.x IS NOT NULL)::INT AS d FROM pic LEFT JOIN em ON em.img = pic.img AND em.x = pic.x AND em.y = pic.y), {_box_sums_sql("df", "d", "4")},
    on0 AS (SELECT img, x, y, (round_even(255 * sum / 81.0, 0) > 71)::INT AS lit FROM bs),
    {_morphed_sql("on0", (("x", "max", "4"), ("y", "max", "4"), ("y", "min", "4"), ("x", "min", "4")))},
    m AS MATERIALIZED (SELECT img, x, y FROM mo3 WHERE lit = 1), {OUTLINES_SQL},
    z AS MATERIALIZED (SELECT u.* FROM u JOIN fr USING (img) WHERE area / (w * h) > 0.55 AND w / h BETWEEN 0.6 AND 1.65 AND w * h >= wide * tall * 0.008 AND least(w, h) >= 40),
    gd AS (SELECT z.img, z.l, pic.x - z.x AS x, pic.y - z.y AS y, v, min(v) OVER w2 AS lo, max(v) OVER w2 AS hi FROM z {_IN_U} WHERE (pic.x - z.x) % 2 = 0 AND (pic.y - z.y) % 2 = 0 WINDOW w2 AS (PARTITION BY z.img, z.l)),
    li AS (SELECT *, v > (lo + hi) / 2 AS lit FROM gd),
    fl AS (SELECT *, lag(lit) OVER (PARTITION BY img, l, y ORDER BY x) AS side, coalesce(lag(lit) OVER (PARTITION BY img, l, x ORDER BY y), lit) AS above FROM li),
    bl AS (SELECT img, l FROM fl WHERE side IS NOT NULL GROUP BY img, l HAVING any_value(hi - lo) >= 80 AND avg((NOT lit)::INT) > 0.25 AND avg((NOT lit)::INT) < 0.75 AND avg((lit <> side)::INT) > 0.12 AND avg((lit <> above)::INT) > 0.12),
    de AS (SELECT z.img, z.l, count(*) AS n FROM z JOIN em ON em.img = z.img AND em.x >= z.x AND em.x < z.x + z.w AND em.y >= z.y AND em.y < z.y + z.h GROUP BY z.img, z.l)
    SELECT z.img, x, y, w, h, round(coalesce(n, 0) / (w * h), 9) AS density FROM z JOIN bl ON bl.img = z.img AND bl.l = z.l LEFT JOIN de ON de.img = z.img AND de.l = z.l""",
)
def m8_blocks(spark, sf_dir):
    return codes.block_regions(_pictures(spark, sf_dir), "img").withColumn("density", F.round("density", 9))


def _point(x, y):
    return quads.point(F.lit(x) if isinstance(x, (int, float)) else x, F.lit(y) if isinstance(y, (int, float)) else y)


@query(
    "m2_quads",
    """WITH p AS (SELECT p_partkey AS id, 40.0 + p_size AS w, 30.0 + p_partkey % 23 AS h, (p_partkey % 9)::DOUBLE AS t FROM part)
    SELECT id, CASE id % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END AS corners, CASE WHEN id % 3 < 2 THEN id % 3 = 1 END AS fallback,
      CASE id % 3 WHEN 0 THEN round(h * (w - t), 6) WHEN 1 THEN round(w * h, 6) END AS area FROM p""",
)
def m2_quads(spark, sf_dir):
    """Points in any order: skewed quads with points on their sides and inside, right triangles, and lines."""
    key = F.col("p_partkey")
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(key.alias("id"), (F.lit(40.0) + F.col("p_size")).alias("w"), (F.lit(30.0) + key % 23).alias("h"), (key % 9).cast("double").alias("t"))
    w, h, t, kind = F.col("w"), F.col("h"), F.col("t"), F.col("id") % 3
    quad = F.array(_point(w / 2, t / 2), _point(w - t, h + t), _point(w / 2, h / 2), _point(0, 0), _point(t / 2, h / 2), _point(t, h), _point(w, t))
    line = F.array(_point(w, t), _point(0, 0), _point(w / 2, t / 2))
    points = F.when(kind == 0, quad).when(kind == 1, F.array(_point(w, 0), _point(0, 0), _point(0, h), _point(w / 2, h / 2))).otherwise(line)
    found = p.select("id", quads.convex_hull(points).alias("hull")).withColumn("q", quads.quad_from_hull(F.col("hull")))
    return found.select("id", F.size("hull").alias("corners"), F.col("q.fallback").alias("fallback"), F.round(boxes.polygon_area(F.col("q.quad")), 6).alias("area"))


def _snap_sql(k: int, band: int) -> str:
    """sn{k}: quads (img, x0..x3, y0..y3) and support after a pass over those of sn{k-1}."""
    corner = lambda c: f"CASE side WHEN 0 THEN {c}0 WHEN 1 THEN {c}1 WHEN 2 THEN {c}2 ELSE {c}3 END"
    after = lambda c: f"CASE side WHEN 0 THEN {c}1 WHEN 1 THEN {c}2 WHEN 2 THEN {c}3 ELSE {c}0 END"
    cross = lambda a, b: f"(a{a}.ux * a{b}.uy - a{a}.uy * a{b}.ux)"
    step = lambda a, b: f"((a{b}.x - a{a}.x) * a{b}.uy - (a{b}.y - a{a}.y) * a{b}.ux) / {cross(a, b)}"
    met = lambda c, a, b: f"CASE WHEN abs({cross(a, b)}) < 1e-6 THEN q.{c}{b} ELSE a{a}.{c} + a{a}.u{c} * {step(a, b)} END"
    new = ", ".join(f"{met(c, (i + 3) % 4, i)} AS n{c}{i}" for i in range(4) for c in "xy")
    far = ", ".join(f"sqrt(pow(nx{i} - x{i}, 2) + pow(ny{i} - y{i}, 2))" for i in range(4))
    return f"""sd{k} AS (SELECT *, {corner("x")} AS ax, {corner("y")} AS ay, {after("x")} AS bx, {after("y")} AS by_ FROM (SELECT *, unnest([0, 1, 2, 3]) AS side FROM sn{k - 1})),
    sl{k} AS (SELECT *, (bx - ax) / sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS ux, (by_ - ay) / sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS uy, greatest(10, floor(sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) / 4 + 0.5)) AS steps FROM sd{k}),
    ss{k} AS (SELECT * FROM (SELECT *, unnest(range(1, steps::BIGINT)) AS s FROM sl{k}) WHERE s / steps BETWEEN 0.08 AND 0.92),
    so{k} AS (SELECT img, side, s, o, ax + (bx - ax) * (s / steps) - uy * o AS px, ay + (by_ - ay) * (s / steps) + ux * o AS py FROM (SELECT *, unnest(range(-{band}, {band} + 1)) AS o FROM ss{k})),
    sh{k} AS (SELECT so{k}.img, side, s, arg_min({{'px': px, 'py': py, 'o': o}}, abs(o) * 2 - (o > 0)::INT) AS h FROM so{k} JOIN eg ON eg.img = so{k}.img AND eg.x = floor(px) AND eg.y = floor(py) GROUP BY so{k}.img, side, s),
    sf{k} AS (SELECT img, side, count(*) AS n, count(*) FILTER (WHERE abs(h.o) <= 2) AS near, avg(h.px) AS mx, avg(h.py) AS my, atan2(2 * covar_pop(h.px, h.py), var_pop(h.px) - var_pop(h.py)) / 2 AS a FROM sh{k} GROUP BY img, side),
    sc{k} AS (SELECT img, side, count(*) AS looked FROM ss{k} GROUP BY img, side),
    sg{k} AS (SELECT l.img, l.side, looked, coalesce(near, 0) AS near, CASE WHEN n >= 6 THEN mx ELSE ax END AS x, CASE WHEN n >= 6 THEN my ELSE ay END AS y,
      CASE WHEN n >= 6 THEN cos(a) * CASE WHEN cos(a) * ux + sin(a) * uy < 0 THEN -1 ELSE 1 END ELSE ux END AS ux, CASE WHEN n >= 6 THEN sin(a) * CASE WHEN cos(a) * ux + sin(a) * uy < 0 THEN -1 ELSE 1 END ELSE uy END AS uy
      FROM sl{k} AS l LEFT JOIN sf{k} AS f ON f.img = l.img AND f.side = l.side LEFT JOIN sc{k} AS c ON c.img = l.img AND c.side = l.side),
    sq{k} AS (SELECT q.*, {new}, (a0.near + a1.near + a2.near + a3.near) / (a0.looked + a1.looked + a2.looked + a3.looked) AS sup FROM (SELECT img, x0, y0, x1, y1, x2, y2, x3, y3 FROM sn{k - 1}) AS q {" ".join(f"JOIN sg{k} AS a{i} ON a{i}.img = q.img AND a{i}.side = {i}" for i in range(4))}),
    sn{k} AS MATERIALIZED (SELECT img, {", ".join(f"CASE WHEN greatest({far}) < {band} * 2.5 THEN n{c}{i} ELSE {c}{i} END AS {c}{i}" for i in range(4) for c in "xy")}, sup FROM sq{k})"""


@query(
    "m3_snapped",
    f"""WITH {_PIXELS_SQL}, eg AS MATERIALIZED (SELECT img, x, y FROM p WHERE v % 41 = 0 OR ((x BETWEEN 10 AND 50 AND (y = 6 OR y = 36) OR y BETWEEN 6 AND 36 AND (x = 10 OR x = 50)) AND v % 5 > 0)),
    sn0 AS (SELECT img, 10.0 + img % 4 AS x0, 3.0 + img % 5 AS y0, 47.0 + img % 3 AS x1, 8.0 AS y1, 52.0 AS x2, 34.0 + img % 4 AS y2, 7.0 + img % 6 AS x3, 38.0 AS y3 FROM (SELECT DISTINCT img FROM p)), {_snap_sql(1, 14)}, {_snap_sql(2, 6)}
    SELECT img, {", ".join(f"round({c}{i}, 6) AS {c}{i}" for i in range(4) for c in "xy")}, round(sup, 9) AS support FROM sn2""",
)
def m3_snapped(spark, sf_dir):
    """A rectangle with gaps among stray pixels, and a rough quad per image."""
    p = _pixels(spark, sf_dir)
    x, y, v = F.col("x"), F.col("y"), F.col("v")
    side = (x.between(10, 50) & y.isin(6, 36)) | (y.between(6, 36) & x.isin(10, 50))
    edges = p.where((v % 41 == 0) | (side & (v % 5 > 0))).select("img", "x", "y")
    k = F.col("img")
    rough = F.array(_point(k % 4 + 10, k % 5 + 3), _point(k % 3 + 47, 8), _point(52, k % 4 + 34), _point(k % 6 + 7, 38))
    found = quads.snapped(p.select("img").distinct().select("img", k.alias("id"), rough.alias("quad")), edges, "img", "id")
    return found.select("img", *[F.round(F.get("quad", i)[c], 6).alias(f"{c}{i}") for i in range(4) for c in "xy"], F.round("support", 9).alias("support"))


_CORNERS = {"x0": "6 + img % 5", "y0": "4.5", "x1": "50.25", "y1": "8 + img % 3", "x2": "57 + img % 9", "y2": "37", "x3": "2", "y3": "33 + img % 4"}


@query(
    "m4_flattened",
    f"""WITH {_PIXELS_SQL}, fr AS (SELECT img, max(x) + 1 AS wide, max(y) + 1 AS tall FROM p GROUP BY img), q0 AS (SELECT img, wide, tall, {", ".join(f"({e})::DOUBLE AS {c}" for c, e in _CORNERS.items())} FROM fr),
    q1 AS (SELECT *, floor((sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) + sqrt(pow(x2 - x3, 2) + pow(y2 - y3, 2))) / 2 + 0.5)::INT AS w, floor((sqrt(pow(x3 - x0, 2) + pow(y3 - y0, 2)) + sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) / 2 + 0.5)::INT AS h,
      x1 - x2 AS dx1, x3 - x2 AS dx2, x0 - x1 + x2 - x3 AS dx3, y1 - y2 AS dy1, y3 - y2 AS dy2, y0 - y1 + y2 - y3 AS dy3 FROM q0),
    q2 AS (SELECT *, greatest(floor(w * 0.05 + 0.5), floor(h * 0.05 + 0.5))::INT AS m, (dx3 * dy2 - dx2 * dy3) / (dx1 * dy2 - dx2 * dy1) AS g, (dx1 * dy3 - dx3 * dy1) / (dx1 * dy2 - dx2 * dy1) AS k FROM q1),
    c AS (SELECT *, (x - m) / w::DOUBLE AS u, (y - m) / h::DOUBLE AS v FROM (SELECT *, unnest(range(h + 2 * m)) AS y FROM (SELECT *, unnest(range(w + 2 * m)) AS x FROM q2))),
    d AS (SELECT img, x, y, wide, tall, ((x1 - x0 + g * x1) * u + (x3 - x0 + k * x3) * v + x0) / (g * u + k * v + 1) AS sx, ((y1 - y0 + g * y1) * u + (y3 - y0 + k * y3) * v + y0) / (g * u + k * v + 1) AS sy FROM c),
    e AS (SELECT *, sx - floor(sx) AS tx, sy - floor(sy) AS ty, unnest([-1, 0, 1, 2]) AS i FROM d), f AS (SELECT *, unnest([-1, 0, 1, 2]) AS j, abs(tx - i) AS ax FROM e), t AS (SELECT *, abs(ty - j) AS ay FROM f),
    n AS (SELECT t.img, t.x, t.y, sum({{wx}} * {{wy}} * p.v) AS v FROM t JOIN p ON p.img = t.img AND p.x = least(greatest(floor(sx)::INT + i, 0), wide - 1) AND p.y = least(greatest(floor(sy)::INT + j, 0), tall - 1) GROUP BY t.img, t.x, t.y)
    SELECT img, x, y, least(greatest(floor(round(v, 9) + 0.5), 0), 255)::INT AS v FROM n""".replace("{wx}", "(CASE WHEN ax <= 1 THEN (1.25 * ax - 2.25) * ax * ax + 1 ELSE ((-0.75 * ax + 3.75) * ax - 6) * ax + 3 END)").replace("{wy}", "(CASE WHEN ay <= 1 THEN (1.25 * ay - 2.25) * ay * ay + 1 ELSE ((-0.75 * ay + 3.75) * ay - 6) * ay + 3 END)"),
)
def m4_flattened(spark, sf_dir):
    """A skewed quad of each image."""
    p = _pixels(spark, sf_dir)
    at = [F.expr(f"cast({e} AS double)") for e in _CORNERS.values()]
    quad = F.array(*[quads.point(at[2 * k], at[2 * k + 1]) for k in range(4)])
    return warp.flattened(p.select("img").distinct().select("img", F.col("img").alias("id"), quad.alias("quad")), p, "img", "id", ("v",)).select(F.col("id").alias("img"), "x", "y", "v")


_SOFT = [math.exp(-(k * k) / 0.98) for k in range(-2, 3)]
_SOFT_SQL = "[" + ", ".join(f"{w / sum(_SOFT)!r}::DOUBLE" for w in _SOFT) + "]"


@query(
    "m6_cards",
    f"""WITH {_PIXELS_SQL}, i AS (SELECT img, 5.0 + img % 3 AS l, 4.0 AS t, 40.0 + img AS w, 30.0 AS h, 30 * (0.08 + img % 4 / 20.0) AS radius FROM (SELECT DISTINCT img FROM p)), r AS (SELECT *, floor(greatest(1, least(radius, w / 2, h / 2)) + 0.5) AS r FROM i),
    n AS (SELECT img, x, y, v, a.i, b.j, x + a.i AS ax, y + b.j AS ay FROM p, range(-2, 3) AS a(i), range(-2, 3) AS b(j)),
    s AS (SELECT img, x, y, any_value(v) AS v, sum(CASE WHEN pow(greatest(l + r - ax, ax - (l + w - r), 0), 2) + pow(greatest(t + r - ay, ay - (t + h - r), 0), 2) <= r * r THEN {_SOFT_SQL}[i + 3] * {_SOFT_SQL}[j + 3] ELSE 0 END) AS a FROM n JOIN r USING (img) GROUP BY img, x, y),
    f AS (SELECT img, x, y, v, floor(round(255 * a, 9) + 0.5)::INT AS a FROM s), b AS (SELECT img, min(x) - 2 AS x0, max(x) + 2 AS x1, min(y) - 2 AS y0, max(y) + 2 AS y1 FROM f WHERE a > 0 GROUP BY img)
    SELECT img, x - greatest(x0, 0) AS x, y - greatest(y0, 0) AS y, CASE WHEN a = 0 THEN 255 ELSE v END AS r, a FROM f JOIN b USING (img) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""",
)
def m6_cards(spark, sf_dir):
    """Cards with corners of 8% to 23% by image."""
    p = _pixels(spark, sf_dir).select("img", "x", "y", F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b"))
    items = p.select("img").distinct().select("img", (F.col("img") % 3 + 5).alias("left"), F.lit(4).alias("top"), (F.col("img") + 40).alias("w"), F.lit(30).alias("h"))
    every = warp.rounded_card(p, items, "img", F.lit(0.08) + F.col("img") % 4 / 20)
    return every.select("img", "x", "y", "r", "a")


@query(
    "m13_put_back",
    f"""WITH {_PIXELS_SQL} SELECT img, x, y, CASE WHEN x BETWEEN 9 AND 18 AND y BETWEEN 8 AND 8 + img THEN 16 WHEN x BETWEEN 4 AND 11 AND y BETWEEN 3 AND 14 THEN 9 ELSE v END AS r,
      CASE WHEN x BETWEEN 9 AND 18 AND y BETWEEN 8 AND 8 + img THEN 200 WHEN x BETWEEN 4 AND 11 AND y BETWEEN 3 AND 14 THEN 255 ELSE 254 END AS a FROM p""",
)
def m13_put_back(spark, sf_dir):
    """Two regions an image, the second over the first."""
    p = _pixels(spark, sf_dir)
    part = lambda id_, left, top, w, h, rgba: F.struct(*[F.lit(v).cast("int").alias(n) if isinstance(v, int) else v.cast("int").alias(n) for n, v in (("id", id_), ("left", left), ("top", top), ("width", w), ("height", h))], F.unhex(F.repeat(F.lit(rgba), (F.lit(w) * h).cast("int"))).alias("bytes"))
    regions_ = p.select("img").distinct().select("img", F.inline(F.array(part(1, 4, 3, 8, F.lit(12), "090909FF"), part(2, 9, 8, 10, F.col("img") + 1, "101010C8"))))
    out = warp.put_back(p.select("img", "x", "y", F.col("v").alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"), F.lit(254).alias("a")), regions_, "img")
    return out.select("img", "x", "y", "r", "a")
