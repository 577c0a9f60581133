"""Tracking: a device's starts, stops, fixes, activities and motions become trips, by one state machine for batch and stream.

A trip opens when it is started by hand or when a fix asks for a split; it closes by hand, by a split, or by timers: an automatic trip that stands for
DWELL seconds is paused, and RESUME seconds later it is stopped unless a drive goes on near the place. A trip that closes is
kept with its summary or deleted. Timers run on `at`, the time an event arrives: in the stream they are Spark's own
timers of the device's state, so that time alone ends a silent device's trip, without another event of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .folds import folded, table
from .ingest import INGESTOR, SECOND, Ingestor, distance, known, micros

#: Seconds of standing before the resume window, of that window, metres within which a drive goes on, metres of a heading.
DWELL, RESUME, RADIUS, HEADING = 120, 900, 500.0, 5.0
EVENTS = "device long, at timestamp, kind string, manual boolean, activity string, moving boolean, ts timestamp, lat double, lon double, acc double, speed_mps double, heading double, uuid string"
_SUMMARY = "started_at timestamp, ended_at timestamp, points long, duration_s long, distance_m double, avg_kmh double, max_kmh double, min_lat double, min_lon double, max_lat double, max_lon double"
#: row: open, point, rejected, gap, paused, resumed, close or delete.
ROWS = f"device long, trip long, at timestamp, row string, seq long, ts timestamp, lat double, lon double, speed_kmh double, heading double, reason string, manual boolean, auto_stopped boolean, {_SUMMARY}"
_OWN = "trip long, open boolean, manual boolean, started long, seq long, fix_lat double, fix_lon double, heading double, activity string, dwell long, resume long, pending boolean, stop_lat double, stop_lon double"
STATE = f"{_OWN}, {INGESTOR}"
_FIELDS = [c.split()[0] for c in _OWN.split(", ")]
_EMPTY = (0, False, False, None, 0, None, None, None, "unknown", None, None, False, None, None)
ORDER = ["at", "kind", "ts", "uuid"]


class Tracker:
    """A device's tracker. Each call gives the rows of ROWS (without the device) that it leads to; times are microseconds."""

    def __init__(self, saved: tuple | None = None):
        for name, value in zip(_FIELDS, saved[: len(_FIELDS)] if saved else _EMPTY, strict=True):
            setattr(self, name, value)
        self.ingestor = Ingestor(saved[len(_FIELDS) :] if saved else None)

    def saved(self) -> tuple:
        return (*(getattr(self, name) for name in _FIELDS), *self.ingestor.saved())

    def deadline(self) -> int | None:
        """When time alone changes something next."""
        return self.dwell + DWELL * SECOND if self.dwell is not None else self.resume

    def _row(self, at: int, row: str, seq=None, ts=None, lat=None, lon=None, kmh=None, heading=None, reason=None, auto=None, summary=(None,) * 11) -> tuple:
        return (self.trip, at, row, seq, ts, lat, lon, kmh, heading, reason, self.manual, auto, *summary)

    def _open(self, at: int, manual: bool) -> tuple:
        self.trip, self.open, self.manual, self.started, self.seq = self.trip + 1, True, manual, at, 0
        self.fix_lat = self.fix_lon = None
        self.ingestor = Ingestor()
        return self._row(at, "open")

    def _close(self, at: int, auto: bool) -> tuple:
        i = self.ingestor
        seconds, mean, keep = i.summary(self.started) if i.points else (0, 0.0, False)
        self.open = False
        if not keep:
            return self._row(at, "delete", auto=auto)
        return self._row(at, "close", auto=auto, summary=(self.started, i.ts, i.points, seconds, i.distance_m, mean, i.max_kmh, i.min_lat, i.min_lon, i.max_lat, i.max_lon))

    def _ended(self) -> None:
        self.seq, self.fix_lat, self.fix_lon, self.heading = 0, None, None, None

    def pass_time(self, now: int) -> list[tuple]:
        """What the timers do up to now, at their own times."""
        out = []
        if self.dwell is not None and now >= self.dwell + DWELL * SECOND:
            at, self.dwell = self.dwell + DWELL * SECOND, None
            self.pending, self.stop_lat, self.stop_lon, self.resume = True, self.fix_lat, self.fix_lon, at + RESUME * SECOND
            out.append(self._row(at, "paused", lat=self.fix_lat, lon=self.fix_lon))
        if self.resume is not None and now >= self.resume:
            at, self.resume, self.pending = self.resume, None, False
            if self.open:
                out.append(self._close(at, True))
                self._ended()
        return out

    def _near_stop(self, at: int) -> list[tuple]:
        if not self.pending or self.stop_lat is None or self.fix_lat is None or distance(self.stop_lat, self.stop_lon, self.fix_lat, self.fix_lon) > RADIUS:
            return []
        self.dwell = self.resume = None
        self.pending = False
        return [self._row(at, "resumed", lat=self.fix_lat, lon=self.fix_lon)]

    def _fix(self, at: int, ts: int, lat: float, lon: float, acc: float, mps: float | None, heading: float | None, uuid: str | None) -> list[tuple]:
        outcome, reason, kmh = self.ingestor.take(ts, lat, lon, acc, mps, uuid)
        if outcome == "rejected":
            return [self._row(at, outcome, ts=ts, lat=lat, lon=lon, reason=reason)]
        if outcome == "gap":
            return [self._row(at, outcome, ts=ts, lat=lat, lon=lon, kmh=kmh)]
        if outcome == "split":  # the new trip starts now, whatever the fix's own time; timers go on
            return [self._close(at, True), self._open(at, False), *self._fix(at, ts, lat, lon, acc, kmh / 3.6, None, None)]
        if heading is not None and heading >= 0:
            self.heading = heading % 360.0
        elif self.fix_lat is not None and distance(self.fix_lat, self.fix_lon, lat, lon) > HEADING:
            self.heading = bearing(self.fix_lat, self.fix_lon, lat, lon)
        self.fix_lat, self.fix_lon, self.seq = lat, lon, self.seq + 1
        i = self.ingestor
        return [self._row(at, "point", self.seq - 1, ts, lat, lon, kmh, self.heading, summary=(self.started, None, i.points, None, i.distance_m, None, i.max_kmh, i.min_lat, i.min_lon, i.max_lat, i.max_lon))]

    def take(self, r: tuple) -> list[tuple]:
        """An event of EVENTS. Events of no open trip but a start leave no row."""
        at = micros(r.at)
        out = self.pass_time(at)
        if r.kind == "start" and not self.open:
            manual = known(r.manual)
            out.append(self._open(at, True if manual is None else bool(manual)))
        elif r.kind == "stop" and self.open:  # timers end; a pause that was pending stays so
            self.dwell = self.resume = None
            out.append(self._close(at, False))
            self._ended()
        elif r.kind == "fix" and self.open:
            out += self._fix(at, micros(r.ts), r.lat, r.lon, r.acc, known(r.speed_mps), known(r.heading), known(r.uuid))
        elif r.kind == "activity":
            self.activity = known(r.activity) or "unknown"
            if self.open and not self.manual:
                if self.activity == "in_vehicle":
                    self.dwell = None
                    out += self._near_stop(at)
                elif self.dwell is None and not self.pending:
                    self.dwell = at
        elif r.kind == "motion" and known(r.moving) and self.open and self.activity == "in_vehicle":
            out += self._near_stop(at)
        return out


def bearing(a: float, b: float, c: float, d: float) -> float:
    p, q, x = math.radians(a), math.radians(c), math.radians(d - b)
    return (math.degrees(math.atan2(math.sin(x) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(x))) + 360) % 360


def _events(events: DataFrame) -> DataFrame:
    """Events that can be taken: a device, an arrival time and a kind; a fix with its own time, place and accuracy."""
    fix = F.col("ts").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("acc").isNotNull()
    return events.select(*(c.split()[0] for c in EVENTS.split(", "))).where("device is not null and at is not null and kind is not null").where((F.col("kind") != "fix") | fix)


def track(events: DataFrame, until: int | None = None) -> DataFrame:
    """A table of EVENTS -> ROWS. Timers run up to a device's last event, or up to `until` (microseconds since 1970)."""
    end = (lambda tracker: tracker.pass_time(until)) if until is not None else None
    return folded(_events(events), "device", ORDER, ROWS, Tracker, Tracker.take, end)


def recovered(rows: DataFrame, points: DataFrame) -> DataFrame:
    """After a crash: trips that ROWS left open, with their persisted points (device, trip, ts, lat, lon, acc, speed_kmh) -> their close or delete rows, not stopped by themselves.

    The points are taken again by a new ingestor; ids are unknown and a null accuracy counts as 0.
    """
    left = rows.groupBy("device", "trip").agg(F.max(F.when(F.col("row") == "open", F.col("at"))).alias("started"), F.max("manual").alias("manual"), F.bool_or(F.col("row").isin("close", "delete")).alias("over")).where("not over")
    at = points.select(F.col("device").alias("d"), F.col("trip").alias("t"), "ts", "lat", "lon", F.coalesce("acc", F.lit(0.0)).alias("acc"), (F.col("speed_kmh") / 3.6).alias("mps"))
    found = left.join(at, (F.col("device") == F.col("d")) & (F.col("trip") == F.col("t")), "left").select("device", "trip", "started", "manual", "ts", "lat", "lon", "acc", "mps")

    def step(tracker: Tracker, r: tuple) -> list[tuple]:
        tracker.trip, tracker.manual, tracker.started = int(r.trip), bool(r.manual), micros(r.started)
        if known(r.lat) is not None:
            tracker.ingestor.take(micros(r.ts), r.lat, r.lon, r.acc, known(r.mps), None)
        return []

    def end(tracker: Tracker) -> list[tuple]:
        return [tracker._close(tracker.ingestor.ts or tracker.started, False)]

    # a device has one open trip at most
    return folded(found, "device", ["trip", "ts"], ROWS, Tracker, step, end)


def open_states(rows: DataFrame, points: DataFrame) -> DataFrame:
    """The same trips as a stream's first state, so that a new stream goes on with them: (device, STATE)."""
    left = rows.groupBy("device", "trip").agg(F.max(F.when(F.col("row") == "open", F.col("at"))).alias("started"), F.max("manual").alias("manual"), F.bool_or(F.col("row").isin("close", "delete")).alias("over"))
    last = left.groupBy("device").agg(F.max(F.struct("trip", "started", "manual", "over")).alias("x")).select("device", "x.*")
    at = points.select(F.col("device").alias("d"), F.col("trip").alias("t"), "seq", "ts", "lat", "lon", F.coalesce("acc", F.lit(0.0)).alias("acc"), (F.col("speed_kmh") / 3.6).alias("mps"), "heading")
    found = last.join(at, (F.col("device") == F.col("d")) & (F.col("trip") == F.col("t")) & ~F.col("over"), "left").select("device", "trip", "started", "manual", "over", "seq", "ts", "lat", "lon", "acc", "mps", "heading")

    def step(tracker: Tracker, r: tuple) -> list[tuple]:
        tracker.trip, tracker.open, tracker.manual, tracker.started = int(r.trip), not r.over, bool(r.manual), micros(r.started)
        if known(r.lat) is not None:
            tracker.ingestor.take(micros(r.ts), r.lat, r.lon, r.acc, known(r.mps), None)
            tracker.seq, tracker.fix_lat, tracker.fix_lon, tracker.heading = int(r.seq) + 1, r.lat, r.lon, known(r.heading)
        return []

    # arrays don't pass the fold's frames: ids are unknown after a crash, so none is kept
    flat = f"device long, {STATE.replace('seen array<string>', 'seen string')}"
    states = folded(found, "device", ["seq"], flat, Tracker, step, lambda t: [tuple(None if isinstance(v, list) else v for v in t.saved())])
    return states.withColumn("seen", F.array().cast("array<string>"))


class _Processor(StatefulProcessor):
    """A device's tracker in Spark's state store, with a timer at its next deadline."""

    def __init__(self, wall: bool):
        self.wall = wall

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("tracker", STATE)

    def _tracker(self) -> Tracker:
        return Tracker(tuple(self.state.get()) if self.state.exists() else None)

    def _kept(self, key: tuple, tracker: Tracker, out: list[tuple]) -> Iterator[pd.DataFrame]:
        self.state.update(tracker.saved())
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if (due := tracker.deadline()) is not None:
            self.handle.registerTimer(-(-due // 1000))
        yield table([(key[0], *o) for o in out], ROWS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tracker = self._tracker()
        events = pd.concat(list(rows)).sort_values(ORDER)
        return self._kept(key, tracker, [o for r in events.itertuples(index=False) for o in tracker.take(r)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tracker = self._tracker()
        return self._kept(key, tracker, tracker.pass_time(expiredTimerInfo.getExpiryTimeInMs() * 1000))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        columns = [c.split() for c in STATE.split(", ")]
        row = [list(initialState[name].iloc[0]) if kind == "array<string>" else known(initialState[name].iloc[0]) for name, kind in columns]
        # a frame's longs are floats where some are null
        self.state.update(tuple(int(v) if kind == "long" and v is not None else v for v, (_, kind) in zip(row, columns, strict=True)))

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Timers need the RocksDB state store; its files are kept under the query's checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def track_stream(events: DataFrame, late: str = "0 seconds", wall_clock: bool = False, states: DataFrame | None = None) -> DataFrame:
    """A stream of EVENTS -> ROWS, appended. states (of open_states) is what the first batch finds.

    Timers run on the watermark, `late` behind the latest arrival of any device, or on the wall clock, for a live source whose `at` is the time of arrival.
    """
    use_state_store(events.sparkSession)
    rows = _events(events)
    rows = rows if wall_clock else rows.withWatermark("at", late)
    initial = states.groupBy("device") if states is not None else None
    return rows.groupBy("device").transformWithStateInPandas(_Processor(wall_clock), ROWS, "append", "ProcessingTime" if wall_clock else "EventTime", initialState=initial)
