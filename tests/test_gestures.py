"""Gestures: known moves, and the stream against the batch."""

import datetime as dt
import math
import random

from quillet.streaming import gestures
from tests.test_operators import streamed

START = dt.datetime(2026, 1, 1)
FIELDS = [p.split()[0] for p in gestures.EVENTS.split(", ")]


def event(seq, ms, kind, board="b", **more):
    return tuple(({"board": board, "ts": START + dt.timedelta(milliseconds=ms), "seq": seq, "kind": kind} | more).get(f) for f in FIELDS)


def place(seq, target, x, y, z, board="b"):
    return event(seq, 0, "place", board, target=target, x=x, y=y, rotation=0.0, scale=1.0, aspect=0.5, z=z)


def moves(spark, rows):
    got = gestures.board_moves(spark.createDataFrame(rows, gestures.EVENTS)).collect()
    return [(r["seq"], r["target"], r["what"], round(r["x"], 6), round(r["y"], 6), round(r["rotation"], 6), round(r["scale"], 6), r["z"]) for r in sorted(got, key=lambda r: r["seq"])]


def test_known_gestures(spark):
    rows = [place(1, "a", 400.0, 300.0, 1), place(2, "c", 600.0, 300.0, 4)]
    down = lambda seq, ms, p, target, x, y, **m: event(seq, ms, "down", pointer=p, target=target, x=x, y=y, **m)
    move = lambda seq, ms, p, x, y: event(seq, ms, "move", pointer=p, x=x, y=y)
    up = lambda seq, ms, p: event(seq, ms, "up", pointer=p, x=0.0, y=0.0)
    rows += [down(10, 1000, 1, "a", 400.0, 300.0), move(11, 1100, 1, 404.0, 303.0), up(12, 1300, 1)]  # a tap
    rows += [down(20, 2000, 1, "a", 400.0, 300.0), up(21, 2500, 1)]  # held too long
    rows += [down(30, 3000, 1, "a", 400.0, 300.0), move(31, 3100, 1, 404.0, 304.0), move(32, 3200, 1, 425.0, 290.0), move(33, 3300, 1, 3000.0, -3000.0), up(34, 3400, 1)]
    rows += [down(40, 4000, 1, "c", 600.0, 300.0), down(41, 4100, 2, None, 700.0, 300.0), move(42, 4200, 2, 600.0, 500.0), up(43, 4300, 2), up(44, 4400, 1)]
    rows += [down(50, 5000, 1, "c", 700.0, 300.0, handle="rotate"), move(51, 5100, 1, 600.0, 401.0), up(52, 5200, 1)]
    rows += [down(60, 6000, 1, "c", 700.0, 300.0, handle="resize"), move(61, 6100, 1, 650.0, 300.0), up(62, 6200, 1)]
    rows += [event(70, 7000, "key", target="a", key="ArrowLeft", shift=True), event(71, 7010, "key", target="a", key="Enter"), event(72, 7020, "key", target="a", key="q"), event(73, 7030, "key", target="zz", key="]")]
    got = moves(spark, rows)
    assert [g[:3] for g in got] == [
        (12, "a", "flip"), (32, "a", "raise"), (32, "a", "move"), (33, "a", "move"), (34, "a", "commit"), (42, "c", "move"), (43, "c", "commit"),
        (51, "c", "move"), (52, "c", "commit"), (61, "c", "move"), (62, "c", "commit"), (70, "a", "commit"), (71, "a", "flip"),
    ]
    at = {(g[0], g[2]): g[3:] for g in got}
    assert at[32, "move"] == (425.0, 290.0, 0.0, 1.0, 5) and at[33, "move"][:2] == (1075.0, -37.5)
    assert at[42, "move"][2:4] == (90.0, 2.0) and at[51, "move"][2] == 180.0 and at[61, "move"][3] == 1.0 and at[70, "commit"][0] == 1035.0


def session(rng, board, seq):
    rows, ms = [place(seq + k, f"t{k}", rng.uniform(100, 900), rng.uniform(50, 500), k, board) for k in range(4)], 10
    seq += 4
    down = []
    for _ in range(160):
        ms += rng.choice((5, 40, 200, 700))
        kind = rng.choice(("down", "move", "move", "move", "up", "key"))
        more = {"x": rng.uniform(0, 1000), "y": rng.uniform(0, 700)}
        if kind == "down":
            more |= {"pointer": rng.randrange(1, 4), "target": rng.choice(("t0", "t1", "t2", "t3", None, "gone")), "handle": rng.choice((None, None, "rotate", "resize"))}
            down.append(more["pointer"])
        elif kind == "key":
            more |= {"target": rng.choice(("t0", "t9")), "key": rng.choice(("ArrowUp", "[", "+", "-", "Enter", "x")), "shift": rng.random() < 0.5}
        else:
            more |= {"pointer": rng.choice(down or [9])}
        rows.append(event(seq, ms, kind, board, **more))
        seq += 1
    return rows


def test_stream_agrees_with_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted(session(rng, "one", 0) + session(rng, "two", 1000), key=lambda r: r[1])
    want = sorted(map(tuple, gestures.board_moves(spark.createDataFrame(rows, gestures.EVENTS).repartition(3)).collect()))
    # Neighbouring files hold each other's events; the last rows only move the watermark on.
    k = len(rows) // 4
    mixed = [r for half in (rows[: 2 * k], rows[2 * k :]) for r in sorted(half, key=lambda r: (r[2] % 2, r[1]))]
    mixed += [event(9000 + j, 10_000_000, "up", "end", pointer=1) for j in range(len(rows) // 3)]
    got = sorted(map(tuple, streamed(spark, tmp_path, mixed, gestures.EVENTS, lambda s: gestures.board_stream(s, "1 hour"), 5).collect()))
    assert got == want and len({w[4] for w in want}) == 4


def test_level():
    assert gestures.level(361.0) == 360.0 and gestures.level(-1.5) == 0.0 and gestures.level(2.5) == 2.5 and math.isclose(gestures.level(719.0), 720.0)
