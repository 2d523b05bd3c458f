"""Streams and their batch forms: still streaks (N1, N2, G3), rate limits (N3, N4, F2), debounce (N5), intake (A4, A5).

The batch forms take a bounded table; the stream forms keep the same state per key with transformWithState and drop it by
timers in event time. Both fold one key's events in time order, so their results agree on events that come in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from quillet.operators.boxes import quad_error

FILES = "path string, modificationTime timestamp, length long, content binary"
#: A detection counts from this score; corners within this error stand still; so many still frames fire.
LEAST_SCORE, STILL_ERROR, STILL_FRAMES = 0.3, 0.015, 6


def _same(a, b) -> bool:
    """Of keys: null is null and not-a-number is itself."""
    return a is b or a == b or (a != a and b != b)


def stretches(events: DataFrame, key: str, at: str, micros: int) -> DataFrame:
    """The events with ``us`` and ``stretch``: per key, time is cut wherever nothing happens for ``micros`` or longer.

    Such a gap lies between two filled buckets of that width, so that the cuts come from the first and last time of each
    key's buckets, a map-side sum, and not from a sort of all its events.
    """
    placed = events.withColumn("us", F.unix_micros(F.col(at).cast("timestamp")))
    placed = placed.withColumn("bucket", F.floor(F.col("us") / micros))
    filled = placed.groupBy(F.col(key).alias("k"), F.col("bucket").alias("b")).agg(F.min("us").alias("first"), F.max("us").alias("last"))
    order = Window.partitionBy("k").orderBy("b")
    cut = F.when(F.coalesce(F.col("first") - F.lag("last").over(order) >= micros, F.lit(True)), F.col("b"))
    cuts = filled.withColumn("cut", cut).select("k", "b", F.last("cut", ignorenulls=True).over(order).alias("stretch"))
    met = placed.join(cuts, placed[key].eqNullSafe(cuts["k"]) & (placed["bucket"] == cuts["b"]))
    return met.drop("k", "b", "bucket")


def admit(events: DataFrame, key: str, at: str, limit: int, minutes: int) -> DataFrame:
    """Key, at, event_id, admitted. An event is admitted if fewer than ``limit`` admitted ones lie within the window
    before it (later than at - minutes). Denied ones are not recorded, so this is a fold, not a count over a range.

    A pause as long as the window empties the state, so a key's events are cut there and only what lies between two pauses
    is one fold, sorted by the shuffle, with the last ``limit`` admitted times as its state. Keys go through Arrow as they
    are; events without a key are those of one client.
    """
    span = minutes * 60 * 1_000_000
    cut = stretches(events.select(F.col(key).alias("key"), F.col(at).alias("at"), "event_id"), "key", "at", span)
    ranged = cut.select("key", "stretch", "us", "event_id").repartition("key", "stretch").sortWithinPartitions("key", "stretch", "us", "event_id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, recent = None, None, []
        for batch in batches:
            said = []
            for k, s, us in zip(*(batch.column(c).to_pylist() for c in ("key", "stretch", "us")), strict=True):
                if s != part or not _same(k, now):
                    now, part, recent = k, s, []
                recent = [t for t in recent if t > us - span]
                said.append(len(recent) < limit)
                if said[-1]:
                    recent.append(us)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.bool_())], [*batch.schema.names, "admitted"])

    out = ranged.mapInArrow(fold, StructType([*ranged.schema.fields, StructField("admitted", BooleanType())]))
    return out.select(F.col("key").alias(key), F.timestamp_micros("us").alias(at), "event_id", "admitted")


def prune(events: DataFrame, at: str, now: Column, days: int = 1) -> DataFrame:
    """Rows of the last day."""
    return events.where(F.col(at) >= now - F.make_dt_interval(F.lit(days)))


def trailing_count(events: DataFrame, key: str, at: str, seconds: int, bucket_seconds: int | None = None) -> DataFrame:
    """the events with ``n``, how many of their key lie in the ``seconds`` up to each (the start is out).

    Time is cut in buckets, of 24 spans if not said: an event is counted in its bucket, and again in the next one if it
    reaches into it, so that a hot key is many groups and 1/24 more rows.
    """
    span = seconds * 1_000_000
    size = bucket_seconds * 1_000_000 if bucket_seconds else 24 * span
    us = F.unix_micros(F.col(at).cast("timestamp"))
    own = F.floor(us / size)
    reached = F.sequence(own, F.floor((us + span - 1) / size))
    dealt = events.withColumn("_us", us).withColumn("_bucket", F.explode(reached))
    near = Window.partitionBy(key, "_bucket").orderBy("_us").rangeBetween(1 - span, 0)
    counted = dealt.withColumn("n", F.count("*").over(near)).where(F.col("_bucket") == F.floor(F.col("_us") / size))
    return counted.drop("_us", "_bucket")


class Limiter(StatefulProcessor):
    """N3 as a stream: rows (key, at) in, (key, at, admitted) out. The state is the last admitted times, and a timer in event
    time drops it once no event that the watermark lets through can lie within its window."""

    def __init__(self, limit: int, minutes: int) -> None:
        self.limit, self.span = limit, minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [r[0] for r in self.kept.get()]
        times = sorted(t for pdf in rows for t in pdf["at"])
        admitted = []
        for at in times:
            us = at.value // 1000
            kept = [t for t in kept if t > us - self.span]
            admitted.append(len(kept) < self.limit)
            if admitted[-1]:
                kept.append(us)
        self.kept.put([(t,) for t in kept])
        if kept:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer((max(kept) + self.span) // 1000 + 1)
        yield pd.DataFrame({"key": key[0], "at": times, "admitted": admitted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, limit: int, minutes: int, late: str = "0 seconds") -> DataFrame:
    """A stream of (key, at) with what was admitted; events later than ``late`` behind the newest are dropped. Keys of any
    type go as text with a mark for null, since rows of a group come as pandas, which turns long keys into floats."""
    kind = events.schema["key"].dataType
    said = events.withWatermark("at", late).select(F.when(F.col("key").isNull(), "").otherwise(F.concat(F.lit("="), F.col("key").cast("string"))).alias("key"), "at")
    out = said.groupBy("key").transformWithStateInPandas(Limiter(limit, minutes), "key string, at timestamp, admitted boolean", "Append", "EventTime")
    return out.withColumn("key", F.when(F.col("key") != "", F.expr("substring(key, 2)").cast(kind)))


class StillStreak(StatefulProcessor):
    """N1, N2 as a stream: frames in, (camera_id, ts, streak, fires) out; state: the last corners, the streak, whether fired,
    and the last time. Frames fire at once, so one that is older than what its camera has shown already is left out; a timer
    drops a camera that has shown nothing for ``idle`` minutes, which starts anew then."""

    def __init__(self, idle_minutes: int = 10) -> None:
        self.idle = idle_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "corners array<double>, streak int, fired boolean, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, streak, fired, seen = self.state.get() if self.state.exists() else (None, 0, False, None)
        frames = pd.concat(list(rows)).sort_values("ts", kind="stable")
        out = []
        for ts, corners, score in zip(frames["ts"], frames["corners"], frames["score"], strict=True):
            if seen is not None and ts < pd.Timestamp(seen):
                continue
            seen = ts
            flat = [float(v) for p in corners for v in (p["x"], p["y"])] if corners is not None and score is not None and score > LEAST_SCORE else None
            if flat is None:
                last, streak = None, 0
            else:
                streak = streak + 1 if last is not None and corner_error(flat, list(last)) < STILL_ERROR else 0
                last = flat
            fires = streak >= STILL_FRAMES and not fired
            fired = fired or fires
            out.append((key[0], ts, streak, fires))
        self.state.update((last, streak, fired, seen))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(pd.Timestamp(seen).timestamp() * 1000) + self.idle)
        yield pd.DataFrame(out, columns=["camera_id", "ts", "streak", "fires"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def corner_error(one: list[float], other: list[float]) -> float:
    """F16 of flat corners (x, y, x, y, ...): mean distance over the longer diagonal."""
    a, b = np.reshape(one, (-1, 2)), np.reshape(other, (-1, 2))
    diagonal = max(np.hypot(*(q[0] - q[2])) for q in (a, b))
    return float(np.hypot(*(a - b).T).mean() / diagonal) if diagonal else 0.0


def still_stream(frames: DataFrame, late: str = "1 second", idle_minutes: int = 10) -> DataFrame:
    """A stream of frames (camera_id, ts, corners, score) with the streak they end, and where a camera fires."""
    marked = frames.withWatermark("ts", late).groupBy("camera_id")
    return marked.transformWithStateInPandas(StillStreak(idle_minutes), "camera_id string, ts timestamp, streak int, fires boolean", "Append", "EventTime")


class LateMerge(StatefulProcessor):
    """N6 as a stream: events in, the fields as they then are out. State per field: the last edit and the last result by
    ``seq``, so that the order in which events come does not matter; a timer drops a key once the watermark has passed its
    last event by ``hours``."""

    def __init__(self, names: tuple[str, ...], hours: int) -> None:
        self.names, self.hours = names, hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = handle.getMapState("fields", "name string, kind string", "seq long, value string")
        self.last = handle.getValueState("last", "ms long, events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k: v for k, v in self.fields.iterator()} if self.fields.exists() else {}
        until, events = self.last.get() if self.last.exists() else (0, 0)
        for pdf in rows:
            events += len(pdf)
            until = max(until, int(pdf["at"].max().timestamp() * 1000) + self.hours * 3_600_000)
            for seq, kind, *values in pdf[["seq", "kind", *self.names]].itertuples(index=False):
                for name, value in zip(self.names, values, strict=True):
                    if isinstance(value, str) and (seq, value) > held.get((name, kind), (-(2**63), "")):
                        held[name, kind] = (seq, value)
        for k, v in held.items():
            self.fields.updateValue(k, tuple(v))
        self.last.update((until, events))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(until)
        shown = [(held.get((n, "edit")) or held.get((n, "result")) or (0, None))[1] for n in self.names]
        yield pd.DataFrame([(key[0], events, *shown)], columns=["key", "events", *self.names])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.fields.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def merge_stream(events: DataFrame, names: tuple[str, ...], late: str = "1 hour", hours: int = 24) -> DataFrame:
    """Of a stream (key string, at, seq, kind, and a text per field) the key, how many events it has had, and its fields,
    whenever a batch brings some; the row of most events is the last."""
    fields = ", ".join(f"{n} string" for n in names)
    return events.withWatermark("at", late).groupBy("key").transformWithStateInPandas(LateMerge(names, hours), f"key string, events long, {fields}", "Append", "EventTime")


def merge_late(events: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """Key and the fields after all events (key, seq, kind, and a column per field): a field that a user has edited holds
    the last edit, whenever results come; any other holds the last result. Null says that an event leaves a field alone; of
    events with one seq the greatest value counts."""
    last = lambda name, kind: F.max(F.when((F.col("kind") == kind) & F.col(name).isNotNull(), F.struct("seq", name)))[name]
    return events.groupBy(key).agg(*[F.coalesce(last(n, "edit"), last(n, "result")).alias(n) for n in names])


def still_frames(frames: DataFrame, *also: str) -> DataFrame:
    """camera_id, ts, what else is asked for, streak, fires. A frame within STILL_ERROR of the one before goes on with the streak; a
    moved or missed one starts it again; the camera fires at the first frame that makes STILL_FRAMES."""
    order = Window.partitionBy("camera_id").orderBy("ts")
    seen = F.coalesce(F.col("score") > LEAST_SCORE, F.lit(False))
    marked = frames.withColumn("seen", seen).withColumn("last", F.lag(F.when(F.col("seen"), F.col("corners"))).over(order))
    goes_on = F.coalesce(F.col("seen") & (quad_error(F.col("corners"), F.col("last")) < STILL_ERROR), F.lit(False))
    islands = marked.withColumn("on", goes_on).withColumn("island", F.sum((~F.col("on")).cast("int")).over(order))
    streak = islands.withColumn("streak", F.when(F.col("seen"), F.row_number().over(Window.partitionBy("camera_id", "island").orderBy("ts")) - 1).otherwise(0))
    hit = streak.withColumn("hit", (F.col("streak") >= STILL_FRAMES).cast("int"))
    return hit.select("camera_id", "ts", *also, "streak", ((F.col("hit") == 1) & (F.sum("hit").over(order) == 1)).alias("fires"))


def streaks(events: DataFrame, key: str, at: str, same: Column) -> DataFrame:
    """G3 for any condition: events with the length of the run of true ``same`` that they end."""
    order = Window.partitionBy(key).orderBy(at, "event_id")
    islands = events.withColumn("on", F.coalesce(same, F.lit(False))).withColumn("island", F.sum((~F.col("on")).cast("int")).over(order))
    return islands.withColumn("streak", F.row_number().over(Window.partitionBy(key, "island").orderBy(at, "event_id")) - 1).drop("island", "on")


def debounced(edits: DataFrame, key: str, at: str, seconds: float = 2.5) -> DataFrame:
    """One row per pause: key, first and last edit, edits, when to publish. Works on a stream with a watermark too."""
    gap = f"{int(seconds * 1000)} milliseconds"
    return edits.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("edits"), F.min(at).alias("first"), F.max(at).alias("last")).select(key, "edits", "first", "last", F.col("w.end").alias("publish_at"))


def intake(spark: SparkSession, folder: str, done: str | None = None) -> DataFrame:
    """A4, A5: files put into a folder, each once; taken files are archived or deleted."""
    clean = {"cleanSource": "archive", "sourceArchiveDir": done} if done else {"cleanSource": "delete"}
    return spark.readStream.format("binaryFile").schema(FILES).options(**clean).load(folder)
