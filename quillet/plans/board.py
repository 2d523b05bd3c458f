"""Queries of boxes, boards and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions.scalar import let
from quillet.operators import boxes, layout, pixels, scan
from quillet.operators.components import cut_lineage
from quillet.plans.base import query, spread, table

_BOX_SQL = "b AS (SELECT p_partkey, (p_partkey * 37 % 500)::DOUBLE AS x, (p_partkey * 91 % 400)::DOUBLE AS y, 60.0 + p_size AS w, 20.0 + p_partkey % 30 AS h, CASE WHEN p_partkey % 3 = 0 THEN 'barcode' ELSE 'ticket-number' END AS reason FROM part)"


def _box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*[v.cast("double").alias(c) for c, v in zip("xywh", (x, y, w, h), strict=True)])


def _boxes(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", _box(k * 37 % 500, k * 91 % 400, F.lit(60.0) + F.col("p_size"), F.lit(20.0) + k % 30).alias("b"), F.when(k % 3 == 0, "barcode").otherwise("ticket-number").alias("reason"))


@query(
    "l5_padded",
    f"""WITH {_BOX_SQL}, p AS (SELECT *, CASE WHEN reason = 'barcode' THEN least(w, h) * 0.08 ELSE h * 0.4 END AS m FROM b)
    SELECT p_partkey, round(greatest(0, x - h * 0.35), 6) AS x, round(least(500, x + w + h * 0.35) - greatest(0, x - h * 0.35), 6) AS w, round(least(400, y + h + h * 0.35) - greatest(0, y - h * 0.35), 6) AS h,
      greatest(0, floor(x - m))::DOUBLE AS bx, greatest(0, floor(y - m))::DOUBLE AS by, (least(500, ceil(x + w + m)) - greatest(0, floor(x - m)))::DOUBLE AS bw, (least(400, ceil(y + h + m)) - greatest(0, floor(y - m)))::DOUBLE AS bh, w > 8 AND h > 8 AS ok FROM p""",
)
def l5_padded(spark, sf_dir):
    """L5, L8, D8."""
    p = _boxes(spark, sf_dir)
    out = p.select("p_partkey", boxes.pad(F.col("b"), 0.35, 500.0, 400.0).alias("p"), boxes.blur_pad(F.col("b"), F.col("reason"), F.lit(500), F.lit(400)).alias("q"), boxes.manual_box_ok(F.col("b")).alias("ok"))
    return out.select("p_partkey", *[F.round(f"p.{c}", 6).alias(c) for c in "xwh"], *[F.col(f"q.{c}").alias(f"b{c}") for c in "xywh"], "ok")


@query(
    "l6_scan_boxes",
    """WITH b AS (SELECT p_partkey, (p_partkey % 60)::DOUBLE AS d, (p_partkey % 35)::DOUBLE AS e FROM part),
    o AS (SELECT *, greatest(0, 100 - d) / 100 AS ab, greatest(0, 100 - e) / 100 AS ac, greatest(0, 100 - abs(d - e)) / 100 AS bc FROM b)
    SELECT p_partkey, 'decoded' || CASE WHEN ab <= 0.6 THEN ',region' ELSE '' END || CASE WHEN ac <= 0.6 AND NOT (ab <= 0.6 AND bc > 0.6) THEN ',flagged' ELSE '' END AS kept FROM o""",
)
def l6_scan_boxes(spark, sf_dir):
    """Three boxes of one size from three sources, shifted to the right."""
    p = table(spark, sf_dir, "part")
    at = lambda reason, shift: p.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("ord"), F.lit(reason).alias("reason"), _box(shift, F.lit(0), F.lit(100), F.lit(20)).alias("box"))
    found = scan.union_sources(decoded=at("decoded", F.lit(0)), regions=at("region", F.col("p_partkey") % 60), flagged=at("flagged", F.col("p_partkey") % 35))
    return scan.scan_boxes(found).select(F.col("doc_id").alias("p_partkey"), F.array_join(F.transform("boxes", lambda b: b["reason"]), ",").alias("kept"))


@query(
    "l7_merged",
    """WITH b AS (SELECT p_partkey, (p_partkey % 130)::DOUBLE AS d FROM part)
    SELECT p_partkey, CASE WHEN greatest(0, least(50, 100 - d)) / 50 > 0.3 THEN '0.0:' || greatest(100, d + 50)::DOUBLE ELSE '0.0:100.0,' || d || ':50.0' END AS boxes FROM b""",
)
def l7_merged(spark, sf_dir):
    """The larger box takes in the smaller one if that overlaps it by more than 30%."""
    p = table(spark, sf_dir, "part")
    both = F.array(_box(F.col("p_partkey") % 130, F.lit(0), F.lit(50), F.lit(20)), _box(F.lit(0), F.lit(0), F.lit(100), F.lit(20)))
    shown = F.array_join(F.transform(boxes.merge_grow(both), lambda b: F.concat_ws(":", b["x"].cast("string"), b["w"].cast("string"))), ",")
    return p.select("p_partkey", shown.alias("boxes"))


@query(
    "f6_layers",
    """WITH o AS (SELECT o_custkey AS c, o_orderkey AS t, (o_orderkey % 50)::INT AS z, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS mine FROM orders),
    m AS (SELECT *, max(z) OVER (PARTITION BY c) AS top, min(z) OVER (PARTITION BY c) AS low FROM o),
    b AS (SELECT *, CASE WHEN mine THEN low - 1 ELSE z END AS back FROM m)
    SELECT t, CASE WHEN mine THEN top + 1 ELSE z END AS raised, back - least(min(back) OVER (PARTITION BY c), 0) AS sent FROM b""",
)
def f6_layers(spark, sf_dir):
    """The newest order of each customer to the front, and to the back."""
    last = F.col("o_orderkey") == F.max("o_orderkey").over(Window.partitionBy("o_custkey"))
    p = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("t"), (F.col("o_orderkey") % 50).cast("int").alias("z"), last.alias("mine"))
    up = layout.raise_item(p, "o_custkey", F.col("mine")).select("t", F.col("z").alias("raised"))
    return up.join(layout.send_back(p, "o_custkey", F.col("mine")).select("t", F.col("z").alias("sent")), "t")


@query(
    "f7_boards",
    """WITH b AS (SELECT p_brand, (p_partkey * 37 % 900)::DOUBLE AS x, (p_partkey * 91 % 1500)::DOUBLE AS y, 300.0 * (0.5 + p_partkey % 5 / 4.0) AS w, p_size / 20.0 + 0.3 AS a FROM part)
    SELECT p_brand, ceil(greatest(700, max(y + w * a / 2) + 60))::BIGINT AS height, round(least(390 / (max(x + w / 2) - min(x - w / 2) + 60), 640 / (max(y + w * a / 2) - min(y - w * a / 2) + 60), 0.88), 9) AS zoom FROM b GROUP BY p_brand""",
)
def f7_boards(spark, sf_dir):
    """F7, F8, L1, L2."""
    k = F.col("p_partkey")
    bound = boxes.bounds((k * 37 % 900).cast("double"), (k * 91 % 1500).cast("double"), F.lit(0.0), F.lit(0.5) + k % 5 / 4.0, F.col("p_size") / 20.0 + 0.3)
    b = table(spark, sf_dir, "part").select("p_brand", bound.alias("b"))
    zoom = boxes.fit_zoom(*[F.col(f"b.{c}") for c in ("x0", "y0", "x1", "y1")], 390.0, 640.0, 0.4)
    return b.groupBy("p_brand").agg(boxes.board_height(F.col("b.y1")).alias("height"), F.round(zoom, 9).alias("zoom"))


@query(
    "q6_added",
    """WITH p AS (SELECT o_custkey, count(*) AS n, max(o_orderkey % 50) AS top FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey)
    SELECT c_custkey AS collage_id, (460 + coalesce(n, 0) % 3 * 40)::DOUBLE AS x, 195.0::DOUBLE AS y, (-3 + coalesce(n, 0) % 5 * 1.5)::DOUBLE AS rotation, (coalesce(top, 0) + 1)::INT AS z FROM customer LEFT JOIN p ON c_custkey = o_custkey""",
)
def q6_added(spark, sf_dir):
    there = table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("collage_id"), (F.col("o_orderkey") % 50).cast("int").alias("z"))
    out = layout.added_item(there, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("collage_id")), "new", 0.5)
    return out.select("collage_id", "x", "y", "rotation", "z")


@query(
    "q8_moves",
    """WITH m AS (SELECT p_partkey, (p_partkey * 13 % 1400 - 200)::DOUBLE AS x, (p_partkey * 29 % 900 - 300)::DOUBLE AS y, (p_partkey * 7 % 721 - 360)::DOUBLE AS r, 0.3 + p_partkey % 28 / 10.0 AS s, p_partkey % 9 AS k FROM part),
    t AS (SELECT *, CASE WHEN r % 360 < 0 THEN r % 360 + 360 ELSE r % 360 END AS turn FROM m)
    SELECT p_partkey, round(least(greatest(x, s * -75), s * 75 + 1000), 6) AS x, round(greatest(y, s * -75), 6) AS y, CASE WHEN turn < 2 THEN r - turn WHEN turn > 358 THEN r - (turn - 360) ELSE r END AS turned,
      round(CASE k WHEN 0 THEN x - 10 WHEN 1 THEN x + 10 ELSE x END, 6) AS nx, round(CASE k WHEN 2 THEN y - 10 WHEN 3 THEN y + 10 ELSE y END, 6) AS ny, CASE k WHEN 4 THEN r - 3 WHEN 5 THEN r + 3 ELSE r END AS nr,
      round(CASE k WHEN 6 THEN least(greatest(s * 1.08, 0.3), 3) WHEN 7 THEN least(greatest(s / 1.08, 0.3), 3) ELSE s END, 6) AS ns FROM t""",
)
def q8_moves(spark, sf_dir):
    """Where a drag, a turn and a key leave an item."""
    k = F.col("p_partkey")
    m = table(spark, sf_dir, "part").select(
        "p_partkey", (k * 13 % 1400 - 200).cast("double").alias("x"), (k * 29 % 900 - 300).cast("double").alias("y"), (k * 7 % 721 - 360).cast("double").alias("r"), (F.lit(0.3) + k % 28 / 10.0).alias("s"),
        F.element_at(F.array(*map(F.lit, ("ArrowLeft", "ArrowRight", "ArrowUp", "ArrowDown", "[", "]", "+", "-", "a"))), (k % 9 + 1).cast("int")).alias("key"),
    )
    x, y = layout.drag(F.col("x") - 5, F.col("y") + 3, F.lit(5.0), F.lit(-3.0), F.col("s"), F.lit(0.5) * 2 / 2)
    key = layout.nudge(F.col("x"), F.col("y"), F.col("r"), F.col("s"), F.col("key"), F.lit(False))
    out = m.select("p_partkey", x.alias("dx"), layout.drag(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.col("s"), F.lit(1.0))[1].alias("dy"), layout.snap_turn(F.col("r")).alias("turned"), key.alias("n"))
    return out.select("p_partkey", F.round("dx", 6).alias("x"), F.round("dy", 6).alias("y"), "turned", F.round("n.x", 6).alias("nx"), F.round("n.y", 6).alias("ny"), F.col("n.rotation").alias("nr"), F.round("n.scale", 6).alias("ns"))


@query(
    "d6_route",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'digital' WHEN p_partkey % 5 = 1 THEN 'paper' WHEN p_size / 10.0 > 1.85 THEN 'digital'
      WHEN p_partkey % 2 = 0 AND p_partkey % 100 < 88 AND p_partkey % 40 < 20 THEN 'paper' ELSE 'digital' END AS kind FROM part""",
)
def d6_route(spark, sf_dir):
    k = F.col("p_partkey")
    mode = F.when(k % 5 == 0, "pdf").when(k % 5 == 1, "camera").otherwise("image")
    kind = pixels.route_scan(mode, F.lit(10.0), F.col("p_size").cast("double"), k % 2 == 0, k % 100 / 100.0, k % 40 / 1000.0)
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


@query(
    "l14_geometry",
    """WITH p AS (SELECT p_partkey, (p_partkey % 50 + 1)::DOUBLE AS a, (p_size + 1)::DOUBLE AS b FROM part)
    SELECT p_partkey, round(a * b / (a + b), 6) AS x, round(a * b / (a + b), 6) AS y, round(a * 0.12, 6) AS ix, round(b - b * 0.12, 6) AS iy FROM p""",
)
def l14_geometry(spark, sf_dir):
    """The line through the origin at 45 degrees meets the line between the points at a and b of the axes."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 50 + 1).cast("double").alias("a"), (F.col("p_size") + 1).cast("double").alias("b"))
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero = F.lit(0.0)
    hit = boxes.line_intersection(at(zero, zero), at(F.lit(1.0), F.lit(1.0)), at(F.col("a"), zero), at(zero, F.col("b")))
    inset = boxes.inset_quad(F.col("a"), F.col("b"), 0.12)
    return p.select("p_partkey", hit.alias("h"), inset.alias("q")).select("p_partkey", F.round("h.x", 6).alias("x"), F.round("h.y", 6).alias("y"), F.round(F.get("q", 0)["x"], 6).alias("ix"), F.round(F.get("q", 2)["y"], 6).alias("iy"))


@query(
    "h5_best_quad",
    """WITH q AS (SELECT p_brand, p_partkey AS id, 200.0 + p_size * 10 AS w, 100.0 + p_partkey % 200 AS h FROM part),
    s AS (SELECT *, w * h / 800000 AS share, greatest(0.0, 1.0) AS fill FROM q),
    r AS (SELECT p_brand, id, CASE WHEN share < 0.05 OR share > 0.97 THEN 0 ELSE least(1, sqrt(share / 0.33)) END AS score FROM s)
    SELECT p_brand, arg_max(id, score * 1000000000 - id) AS id, round(max(score), 9) AS score FROM r GROUP BY p_brand HAVING max(score) > 0.12""",
)
def h5_best_quad(spark, sf_dir):
    """Upright boxes well inside an image of 1000 x 800; their fill is 1."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    w, h, o = F.lit(200.0) + F.col("p_size") * 10, F.lit(100.0) + F.col("p_partkey") % 200, F.lit(50.0)
    quad = F.array(at(o, o), at(o + w, o), at(o + w, o + h), at(o, o + h))
    score = pixels.quad_score(quad, w * h, w * h, F.lit(1000.0), F.lit(800.0))
    best = pixels.best_candidate(table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("id"), score.alias("score")), "p_brand")
    return best.select("p_brand", "id", F.round("score", 9).alias("score"))


# ---- pixels: embeddings as images, a label's vectors one below the other ---------------------------------------------

_PIXELS_SQL = """v AS (SELECT label AS img, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, embedding FROM embeddings),
    p AS (SELECT img, y, i - 1 AS x, floor(abs(embedding[i]::DOUBLE) * 400)::INT % 256 AS v FROM (SELECT img, y, embedding, unnest(range(1, 65)) AS i FROM v))"""


def _pixels(spark, sf_dir) -> DataFrame:
    y = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    e = table(spark, sf_dir, "embeddings").withColumn("y", y).select(F.col("label").alias("img"), "y", F.posexplode("embedding").alias("x", "e"))
    return e.select("img", "y", "x", (F.floor(F.abs(F.col("e").cast("double")) * 400).cast("int") % 256).alias("v"))


#: The same images with bars, modules, a slow change of grey, or what they hold, by label, so that every check has both answers.
_PLANTED_SQL = (
    _PIXELS_SQL.replace("p AS (", "held AS (")
    + """, p AS (SELECT o.img, o.y, o.x, CASE o.img % 4 WHEN 0 THEN CASE WHEN q.v % 2 = 0 THEN 15 ELSE 235 END WHEN 1 THEN CASE WHEN (o.x // 3 + o.y // 8) % 2 = 1 THEN 20 ELSE 240 END WHEN 2 THEN 100 + o.x // 8 ELSE o.v END AS v
    FROM held AS o JOIN held AS q ON q.img = o.img AND q.x = o.x AND q.y = 0)"""
)


def _planted(spark, sf_dir) -> DataFrame:
    p = _pixels(spark, sf_dir)
    x, y, kind = F.col("x"), F.col("y"), F.col("img") % 4
    bars, module = F.when(F.col("top") % 2 == 0, 15).otherwise(235), F.when((F.floor(x / 3) + F.floor(y / 8)) % 2 == 1, 20).otherwise(240)
    ink = F.when(kind == 0, bars).when(kind == 1, module).when(kind == 2, F.lit(100) + F.floor(x / 8)).otherwise(F.col("v"))
    return p.join(p.where("y = 0").select("img", "x", F.col("v").alias("top")), ["img", "x"]).select("img", "y", "x", ink.cast("int").alias("v"))


@query(
    "m10_coherent",
    f"""WITH {_PLANTED_SQL}, s AS (SELECT *, abs(lead(v) OVER (PARTITION BY img, y ORDER BY x) - v) AS dx, abs(lead(v) OVER (PARTITION BY img, x ORDER BY y) - v) AS dy, max(y) OVER (PARTITION BY img) + 1 AS tall FROM p)
    SELECT img, sum(dx) > 0 AND sum(dy) / sum(dx) < 0.35 AS coherent FROM s WHERE x >= 1 AND x < 62 AND y >= floor(tall * 0.15 + 0.5) AND y < floor(tall * 0.85 + 0.5) - 1 GROUP BY img""",
)
def m10_coherent(spark, sf_dir):
    return pixels.coherent(_planted(spark, sf_dir), "img")


@query(
    "m11_blocky",
    f"""WITH {_PLANTED_SQL}, g AS (SELECT *, min(v) OVER (PARTITION BY img) AS lo, max(v) OVER (PARTITION BY img) AS hi FROM p WHERE x % 2 = 0 AND y % 2 = 0),
    o AS (SELECT *, v > (lo + hi) / 2 AS lit FROM g),
    f AS (SELECT *, lag(lit) OVER (PARTITION BY img, y ORDER BY x) AS l, coalesce(lag(lit) OVER (PARTITION BY img, x ORDER BY y), lit) AS a FROM o)
    SELECT img, any_value(hi - lo) >= 80 AND avg((NOT lit)::INT) > 0.25 AND avg((NOT lit)::INT) < 0.75 AND avg((lit <> l)::INT) > 0.12 AND avg((lit <> a)::INT) > 0.12 AS blocky FROM f WHERE l IS NOT NULL GROUP BY img""",
)
def m11_blocky(spark, sf_dir):
    return pixels.blocky(_planted(spark, sf_dir), "img")


@query(
    "m9_three_lines",
    f"""WITH {_PLANTED_SQL}, t AS (SELECT *, max(y) OVER (PARTITION BY img) + 1 AS tall FROM p),
    l AS (SELECT img, x, v, y FROM t WHERE y IN (floor(tall * 0.3 + 0.5), floor(tall * 0.5 + 0.5), floor(tall * 0.7 + 0.5))),
    m AS (SELECT *, (min(v) OVER w + max(v) OVER w) / 2 AS mid, max(v) OVER w - min(v) OVER w AS span FROM l WINDOW w AS (PARTITION BY img, y)),
    f AS (SELECT img, y, span, (v > mid) <> (lag(v) OVER (PARTITION BY img, y ORDER BY x) > mid) AS flip FROM m),
    r AS (SELECT img, y, count(*) FILTER (WHERE flip) / 64.0 AS flips FROM f WHERE span >= 50 GROUP BY img, y)
    SELECT img, coalesce(avg(flips) > 0.12, false) AS stripy FROM (SELECT DISTINCT img FROM p) LEFT JOIN r USING (img) GROUP BY img""",
)
def m9_three_lines(spark, sf_dir):
    return pixels.scan_lines(_planted(spark, sf_dir), "img").select("img", pixels.stripy(F.col("scans")).alias("stripy"))


@query(
    "f11_border",
    f"""WITH {_PIXELS_SQL}, t AS (SELECT *, max(y) OVER (PARTITION BY img) + 1 AS tall FROM p),
    e AS (SELECT img, v FROM t WHERE x % 2 = 0 AND y % 2 = 0 AND (x < 4 OR x >= 60 OR y < greatest(4, floor(least(64, tall) * 0.04 + 0.5)) OR y >= tall - greatest(4, floor(least(64, tall) * 0.04 + 0.5)))),
    s AS (SELECT img, list_sort(list(v)) AS s FROM e GROUP BY img)
    SELECT img, s[len(s) // 2 + 1] AS r, 255 - s[(len(s) - 1) - len(s) // 2 + 1] AS g FROM s""",
)
def f11_border(spark, sf_dir):
    p = _pixels(spark, sf_dir).select("img", "x", "y", F.col("v").alias("r"), (F.lit(255) - F.col("v")).alias("g"))
    return pixels.border_median(p, "img", ("r", "g"))


@query(
    "f14_content",
    f"""WITH {_PIXELS_SQL}, d AS (SELECT img, min(x) FILTER (WHERE hit) AS x0, max(x) FILTER (WHERE hit) AS x1, min(y) FILTER (WHERE hit) AS y0, max(y) FILTER (WHERE hit) AS y1
      FROM (SELECT *, x % 2 = 0 AND y % 2 = 0 AND 3 * (255 - v) < 720 AND x > 9 AND y > 3 AS hit FROM p) GROUP BY img)
    SELECT img, CASE WHEN x1 > x0 AND y1 > y0 THEN greatest(0, x0 - 2) ELSE 0 END AS x0, CASE WHEN x1 > x0 AND y1 > y0 THEN greatest(0, y0 - 2) ELSE 0 END AS y0,
      CASE WHEN x1 > x0 AND y1 > y0 THEN least(64, x1 + 2) ELSE 64 END AS x1, CASE WHEN x1 > x0 AND y1 > y0 THEN least(80, y1 + 2) ELSE 80 END AS y1 FROM d""",
)
def f14_content(spark, sf_dir):
    """F14, L15."""
    ink = F.when((F.col("x") > 9) & (F.col("y") > 3), 255 - F.col("v")).otherwise(255)
    box = pixels.content_box(_pixels(spark, sf_dir).select("img", "x", "y", *[ink.alias(c) for c in "rgb"]), "img", 64, 80)
    return box.select("img", *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(
    "f13_pixel_sums",
    f"""WITH {_PIXELS_SQL}, e AS (SELECT img, avg((v > 100)::INT) AS density FROM p WHERE NOT (x BETWEEN 10 AND 50) GROUP BY img),
    f AS (SELECT img, avg(x) AS cx, avg(y) AS cy, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS angle FROM p WHERE v > 100 GROUP BY img),
    m AS (SELECT img, sum(floor((v * (x * 4) + (255 - x * 4) * 255) / 255 + 0.5)) AS flat, sum(CASE WHEN x = 0 THEN 255 ELSE v END) AS wiped, round(sum(greatest(0, least(255, (v - 20) * 255 / 24.0))), 3) AS stretched, sum(floor((v * 299 + (255 - v) * 587 + v * 114) / 1000)) AS lum FROM p GROUP BY img)
    SELECT img, round(density, 9) AS density, round(cx, 6) AS cx, round(cy, 6) AS cy, round(angle, 6) AS angle, flat::BIGINT AS flat, wiped::BIGINT AS wiped, stretched, lum::BIGINT AS lum FROM e JOIN f USING (img) JOIN m USING (img)""",
)
def f13_pixel_sums(spark, sf_dir):
    """F13, F17, M5's last step, M14, M15."""
    p = _pixels(spark, sf_dir)
    v, alpha = F.col("v"), F.col("x") * 4
    edges = pixels.outside_density(p.select("img", F.col("x").between(10, 50).alias("masked"), (v > 100).alias("edge")), "img")
    line = pixels.fit_line(p.where(v > 100), "img")
    sums = p.groupBy("img").agg(
        F.sum(pixels.flatten_alpha(v, alpha, 255)).alias("flat"), F.sum(pixels.wipe_hidden(v, alpha)).alias("wiped"),
        F.round(F.sum(pixels.stretch(v, F.lit(20), F.lit(30))), 3).alias("stretched"), F.sum(pixels.luminance(v, 255 - v, v)).alias("lum"),
    )
    both = edges.join(line, "img").join(sums, "img")
    return both.select("img", F.round("density", 9).alias("density"), *[F.round(c, 6).alias(c) for c in ("cx", "cy", "angle")], F.col("flat").cast("long"), F.col("wiped").cast("long"), "stretched", F.col("lum").cast("long"))


@query(
    "m12_grown",
    """SELECT p_partkey, 10 - p_partkey % 6 AS first, 10 + p_partkey % 4 AS last FROM part""",
)
def m12_grown(spark, sf_dir):
    """Lines of one pattern about line 10, as far as the key says, with its reverse beyond."""
    k = F.col("p_partkey")
    bars = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: (i % 2 * 255).cast("double"))
    both = let(bars, lambda b: F.struct(b.alias("bars"), F.transform(b, lambda v: 255.0 - v).alias("blank")))
    lines = let(both, lambda s: F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.when((i >= 10 - k % 6) & (i <= 10 + k % 4), s["bars"]).otherwise(s["blank"])))
    p = spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", lines.alias("lines"))
    ends = scan.grow_linear(F.col("lines"), F.lit(10), F.lit(10))
    return p.select("p_partkey", ends.alias("e")).select("p_partkey", F.col("e.first").cast("long").alias("first"), F.col("e.last").cast("long").alias("last"))


@query(
    "q2_rules",
    "SELECT s_nationkey, count(*) AS items, 0::BIGINT AS off_board, 0::BIGINT AS covered, 0::BIGINT AS flat, 0::BIGINT AS layers_missing FROM supplier GROUP BY s_nationkey",
)
def q2_rules(spark, sf_dir):
    """Q1, Q2: what a placed board must hold: all items on it, none covered by more than 12%, none level, layers from 1."""
    items = _suppliers(spark, sf_dir)
    return _rules(layout.auto_place(items, "s_nationkey"), items)


def _suppliers(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select("s_nationkey", F.col("s_name").alias("ticket_id"), (F.lit(0.3) + F.col("s_suppkey") % 17 / 10.0).alias("aspect"), F.col("s_suppkey").alias("ord"))


def _rules(placed: DataFrame, items: DataFrame) -> DataFrame:
    # An item is known by its board and layer, which is its place in the order; names may come again.
    order = Window.partitionBy("s_nationkey").orderBy("ord")
    placed = cut_lineage(placed).join(items.select("s_nationkey", F.row_number().over(order).alias("z"), "aspect"), ["s_nationkey", "z"])
    around = boxes.bounds(F.col("x"), F.col("y"), F.col("rotation"), F.col("scale"), F.col("aspect"))
    b = placed.withColumn("b", around)
    sized = b.select("s_nationkey", F.col("z").alias("id"), F.struct(F.col("b.x0").alias("x"), F.col("b.y0").alias("y"), (F.col("b.x1") - F.col("b.x0")).alias("w"), (F.col("b.y1") - F.col("b.y0")).alias("h")).alias("box"))
    over = boxes.overlapping_pairs(sized, sized, "s_nationkey", 0.1200001).where("a < b").groupBy("s_nationkey").agg(F.count("*").alias("covered"))
    per = b.groupBy("s_nationkey").agg(
        F.count("*").alias("items"), F.count_if((F.col("b.x0") < 0) | (F.col("b.x1") > 1000) | (F.col("b.y0") < 0)).alias("off_board"),
        F.count_if((F.col("rotation") == 0) | (F.abs("rotation") > 7)).alias("flat"), (F.count("*") - F.max("z")).alias("layers_missing"),
    )
    return per.join(over, "s_nationkey", "left").withColumn("covered", F.coalesce("covered", F.lit(0)).cast("long"))


@query(
    "q5_scattered",
    "SELECT s_nationkey, count(*) AS items, 0::BIGINT AS off_board, 0::BIGINT AS covered, 0::BIGINT AS flat, 0::BIGINT AS layers_missing, CASE WHEN count(*) > 4 THEN true END AS other_order FROM supplier GROUP BY s_nationkey",
)
def q5_scattered(spark, sf_dir):
    """Q5: the same rules for boards in seeded order; of boards with more than four items another seed gives another one."""
    items = _suppliers(spark, sf_dir).drop("ord")
    one, two = (cut_lineage(layout.scatter(items, "s_nationkey", seed)) for seed in ("arrange", "again"))
    moved = one.select("s_nationkey", "z", F.col("ticket_id").alias("t1")).join(two.select("s_nationkey", "z", F.col("ticket_id").alias("t2")), ["s_nationkey", "z"])
    other = moved.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.bool_or(F.col("t1") != F.col("t2")).alias("other_order"))
    return _rules(one, layout.seeded_order(items, "s_nationkey", "arrange")).join(other.select("s_nationkey", F.when(F.col("n") > 4, F.col("other_order")).alias("other_order")), "s_nationkey")
