"""Pointer and key events of boards as moves of their items, as a stream and as a batch.

One small fold serves both forms: rows of a board in order of (ts, seq). The batch form has its order from the shuffle. The
stream keeps what has come until the watermark passes it, so that events of other batches, late within the watermark, still
come in order; a timer folds them, and another drops a board that has been idle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# A press is a tap below these; shares of a turn that count as level; sizes of items.
TAP_MS, DRAG_PX, LEVEL, SCALES, BASE, BOARD = 450, 6, 2, (0.3, 3.0), 300.0, 1000.0
#: down, move, up (pointer, x, y, target: an item; handle: null, rotate or resize), key (target, key, shift), and place: an
#: item's x, y, rotation, scale, aspect and z before all else. Coordinates are those of the board times its zoom of 1.
EVENTS = "board string, ts timestamp, seq long, kind string, pointer long, target string, handle string, x double, y double, key string, shift boolean, rotation double, scale double, aspect double, z int"
MOVES = "board string, ts timestamp, seq long, target string, what string, x double, y double, rotation double, scale double, z int"
_ITEM = ("x", "y", "rotation", "scale", "aspect", "z")
_GESTURE = ("what", "target", "pointer", "x0", "y0", "t0", "moved", "a0", "d0", "ix", "iy", "irotation", "iscale")
_FIELDS = [part.split()[0] for part in EVENTS.split(", ")]


def _held(value: float, low: float, high: float) -> float:
    return min(max(value, low), high)


def level(rotation: float) -> float:
    """A turn within two degrees of level becomes level."""
    r = rotation % 360
    return rotation - (r - 360 if r > 180 else r) if min(r, 360 - r) < LEVEL else rotation


class Hands:
    """What a board's pointers do: items by id, pointers by number, and one gesture."""

    def __init__(self, items: dict, pointers: dict, gesture: dict | None) -> None:
        self.items, self.pointers, self.gesture = items, pointers, gesture

    def fold(self, e: dict) -> list[tuple]:
        """(target, what) of what an event changes: move, raise, flip, commit."""
        return getattr(self, f"_{e['kind']}")(e)

    def _place(self, e: dict) -> list[tuple]:
        self.items[e["target"]] = {k: e[k] for k in _ITEM}
        return []

    def _begin(self, what: str, target: str, e: dict, **more) -> None:
        item = self.items[target]
        self.gesture = dict.fromkeys(_GESTURE) | {"what": what, "target": target, "pointer": e["pointer"], "x0": e["x"], "y0": e["y"], "t0": e["ts"], "moved": False} | more
        self.gesture |= {f"i{k}": item[k] for k in ("x", "y", "rotation", "scale")}

    def _pair(self) -> tuple[float, float]:
        (ax, ay), (bx, by) = list(self.pointers.values())[:2]
        return math.atan2(by - ay, bx - ax), math.hypot(bx - ax, by - ay)

    def _down(self, e: dict) -> list[tuple]:
        item = self.items.get(e["target"])
        if item is None:
            self.pointers[e["pointer"]] = (e["x"], e["y"])
            held = self.gesture and self.gesture["target"]
            if held in self.items and len(self.pointers) == 2:  # a second finger beside the item
                angle, apart = self._pair()
                self._begin("pinch", held, e, a0=angle, d0=apart or 1.0)
        elif e["handle"]:
            dx, dy = e["x"] - item["x"], e["y"] - item["y"]
            self._begin(e["handle"], e["target"], e, a0=math.atan2(dy, dx), d0=math.hypot(dx, dy) or 1.0)
        else:
            self.pointers[e["pointer"]] = (e["x"], e["y"])
            if len(self.pointers) == 2:
                held = self.gesture["target"] if self.gesture else e["target"]
                angle, apart = self._pair()
                self._begin("pinch", held if held in self.items else e["target"], e, a0=angle, d0=apart or 1.0)
            else:
                self._begin("drag", e["target"], e)
        return []

    def _move(self, e: dict) -> list[tuple]:
        if e["pointer"] in self.pointers:
            self.pointers[e["pointer"]] = (e["x"], e["y"])
        g, out = self.gesture, []
        if not g or (g["what"] != "pinch" and g["pointer"] != e["pointer"]):
            return []
        item = self.items[g["target"]]
        if g["what"] == "drag":
            dx, dy = e["x"] - g["x0"], e["y"] - g["y0"]
            if not g["moved"] and math.hypot(dx, dy) < DRAG_PX:
                return []
            if not g["moved"]:
                g["moved"] = True
                top = max(0, *(i["z"] for i in self.items.values()), 0)
                if item["z"] < top:
                    item["z"] = top + 1
                    out.append((g["target"], "raise"))
            half = BASE * g["iscale"] / 2
            item["x"], item["y"] = _held(g["ix"] + dx, -half / 2, BOARD + half / 2), max(-half * item["aspect"] / 2, g["iy"] + dy)
        elif g["what"] == "pinch":
            if len(self.pointers) < 2:
                return []
            angle, apart = self._pair()
            item["rotation"], item["scale"] = g["irotation"] + math.degrees(angle - g["a0"]), _held(g["iscale"] * (apart / g["d0"]), *SCALES)
        else:
            dx, dy = e["x"] - g["ix"], e["y"] - g["iy"]
            if g["what"] == "rotate":
                item["rotation"] = level(g["irotation"] + math.degrees(math.atan2(dy, dx) - g["a0"]))
            else:
                item["scale"] = _held(g["iscale"] * (math.hypot(dx, dy) / g["d0"]), *SCALES)
        return [*out, (g["target"], "move")]

    def _up(self, e: dict) -> list[tuple]:
        self.pointers.pop(e["pointer"], None)
        g = self.gesture
        if not g or (g["what"] != "pinch" and g["pointer"] != e["pointer"]) or (g["what"] == "pinch" and len(self.pointers) >= 2):
            return []
        self.gesture = None
        if g["what"] != "drag" or g["moved"]:
            return [(g["target"], "commit")]
        return [(g["target"], "flip")] if (e["ts"] - g["t0"]).total_seconds() * 1000 < TAP_MS else []

    def _key(self, e: dict) -> list[tuple]:
        item, key = self.items.get(e["target"]), e["key"]
        if item is None:
            return []
        if key in ("Enter", " "):
            return [(e["target"], "flip")]
        step = 40.0 if e["shift"] else 10.0
        moves = {"ArrowLeft": ("x", -step), "ArrowRight": ("x", step), "ArrowUp": ("y", -step), "ArrowDown": ("y", step), "[": ("rotation", -3.0), "]": ("rotation", 3.0)}
        if key in moves:
            item[moves[key][0]] += moves[key][1]
        elif key in ("+", "=", "-"):
            item["scale"] = _held(item["scale"] / 1.08 if key == "-" else item["scale"] * 1.08, *SCALES)
        else:
            return []
        return [(e["target"], "commit")]


def _moves(hands: Hands, events: list[dict]) -> list[tuple]:
    out = []
    for e in events:
        for target, what in hands.fold(e):
            item = hands.items[target]
            out.append((e["board"], e["ts"], e["seq"], target, what, item["x"], item["y"], item["rotation"], item["scale"], item["z"]))
    return out


_NAMES = [part.split()[0] for part in MOVES.split(", ")]
_TYPES = [{"string": pa.string(), "timestamp": pa.timestamp("us", "UTC"), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[part.split()[1]] for part in MOVES.split(", ")]


def _rows(pdf: pd.DataFrame) -> list[dict]:
    """Rows as dicts with None for what is missing and whole pointers."""
    plain = pdf.astype(object).where(pdf.notna(), None)
    return [r | {"pointer": None if r["pointer"] is None else int(r["pointer"]), "z": None if r["z"] is None else int(r["z"])} for r in plain.to_dict("records")]


def board_moves(events: DataFrame) -> DataFrame:
    """MOVES of a bounded table of EVENTS: the boards' rows come sorted and are folded one after another."""
    near = events.select(*_FIELDS).repartition("board").sortWithinPartitions("board", "ts", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        board, hands = None, None
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                if hands is None or e["board"] != board:
                    board, hands = e["board"], Hands({}, {}, None)
                out += _moves(hands, [e])
            columns = zip(*out, strict=True) if out else [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    return near.mapInArrow(run, MOVES)


class BoardHands(StatefulProcessor):
    """State: items and pointers as maps, the gesture, and the events that the watermark has not passed."""

    def __init__(self, idle_minutes: int) -> None:
        self.idle = idle_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "target string", "x double, y double, rotation double, scale double, aspect double, z int")
        self.pointers = handle.getMapState("pointers", "pointer long", "x double, y double, place long")
        self.gesture = handle.getValueState("gesture", "what string, target string, pointer long, x0 double, y0 double, t0 timestamp, moved boolean, a0 double, d0 double, ix double, iy double, irotation double, iscale double")
        self.waiting = handle.getListState("waiting", EVENTS)
        self.until = handle.getValueState("until", "ms long")  # when the board counts as idle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [e for pdf in rows for e in _rows(pdf)]
        self.waiting.appendList([tuple(e[f] for f in _FIELDS) for e in came])
        for ms in {math.ceil(e["ts"].timestamp() * 1000) for e in came}:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [dict(zip(_FIELDS, e, strict=True)) for e in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((e for e in held if e["ts"].timestamp() * 1000 <= now), key=lambda e: (e["ts"], e["seq"]))
        if not due:
            if not held and self.until.exists() and now >= self.until.get()[0]:
                for state in (self.items, self.pointers, self.gesture, self.waiting, self.until):
                    state.clear()
            return
        items = {k[0]: dict(zip(_ITEM, v, strict=True)) for k, v in self.items.iterator()} if self.items.exists() else {}
        placed = sorted(((v[2], k[0], (v[0], v[1])) for k, v in self.pointers.iterator())) if self.pointers.exists() else []
        g = dict(zip(_GESTURE, self.gesture.get(), strict=True)) if self.gesture.exists() else None
        hands = Hands(items, {k: at for _, k, at in placed}, g)
        out = _moves(hands, due)
        for k, v in hands.items.items():
            self.items.updateValue((k,), tuple(v[f] for f in _ITEM))
        self.pointers.clear()
        for place, (k, (x, y)) in enumerate(hands.pointers.items()):  # in the order of coming down
            self.pointers.updateValue((k,), (x, y, place))
        if hands.gesture:
            self.gesture.update(tuple(hands.gesture[f] for f in _GESTURE))
        else:
            self.gesture.clear()
        rest = [tuple(e[f] for f in _FIELDS) for e in held if e not in due]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self.until.update((int(now) + self.idle,))
        self.handle.registerTimer(int(now) + self.idle)
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def board_stream(events: DataFrame, late: str = "10 seconds", idle_minutes: int = 60) -> DataFrame:
    """MOVES of a stream of EVENTS, each once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy("board").transformWithStateInPandas(BoardHands(idle_minutes), MOVES, "Append", "EventTime")
