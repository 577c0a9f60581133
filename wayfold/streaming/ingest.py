"""Ingest of location fixes: one ingestor a trip, used by the batch form, the stateful stream and the tracker."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS
from .folds import folded, table

#: Worst accuracy (m), least milliseconds between fixes, gap and split (s, m), ids remembered.
ACCURACY, RATE, GAP, SPLIT, REMEMBERED = 25.0, 900, 300, 500.0, 100
#: A trip is kept from this duration (s), length and box diagonal (m) on.
KEEP_S, KEEP_M, KEEP_BOX = 60, 100.0, 50.0
SECOND = 1_000_000
OUTCOMES = "device long, seq long, session long, outcome string, reason string, speed_kmh double"
#: An ingestor's state, times in microseconds.
INGESTOR = "ts long, lat double, lon double, seen array<string>, points long, distance_m double, gap_s long, max_kmh double, min_lat double, min_lon double, max_lat double, max_lon double"
STATE = f"session long, {INGESTOR}"


def distance(a: float, b: float, c: float, d: float) -> float:
    p, q = math.radians(a), math.radians(c)
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * EARTH_RADIUS * math.atan2(math.sqrt(x), math.sqrt(1 - x))


class Ingestor:
    """What a trip knows of its fixes. All differences of times are whole microseconds, cut to whole milliseconds or seconds by the rules."""

    FIELDS = ("ts", "lat", "lon", "seen", "points", "distance_m", "gap_s", "max_kmh", "min_lat", "min_lon", "max_lat", "max_lon")

    def __init__(self, saved: tuple | None = None):
        for name, value in zip(self.FIELDS, saved or (None, None, None, [], 0, 0.0, 0, 0.0, None, None, None, None), strict=True):
            setattr(self, name, value)
        self.seen = list(self.seen if self.seen is not None else [])

    def saved(self) -> tuple:
        return tuple(getattr(self, name) for name in self.FIELDS)

    def take(self, ts: int, lat: float, lon: float, acc: float, mps: float | None, uuid: str | None) -> tuple[str, str | None, float | None]:
        """(outcome, reason, speed in km/h): rejected, accepted, gap or split.

        Repeated ids are rejected first, then bad accuracy, then fixes too soon after the last accepted one, which holds for late ones. A
        fix that asks for a split changes nothing here: it is the first one of a new trip's ingestor, with its speed and without its id.
        """
        if uuid is not None and uuid in self.seen:
            return "rejected", "duplicate", None
        if acc > ACCURACY:
            return "rejected", "accuracy", None
        kind, moved, passed = "accepted", 0.0, 0
        if self.ts is not None:
            passed = ts - self.ts
            if passed < RATE * 1000:
                return "rejected", "rate_limit", None
            moved = distance(self.lat, self.lon, lat, lon)
            if passed > GAP * SECOND:
                kind = "split" if moved > SPLIT else "gap"
        whole = passed // SECOND
        speed = mps * 3.6 if mps is not None and mps >= 0 else moved / whole * 3.6 if whole > 0 else 0.0
        if kind == "split":
            return kind, None, speed
        if kind == "gap":
            self.gap_s += whole - 1
        if uuid is not None:
            self.seen = [*self.seen, uuid][-REMEMBERED:]
        self.distance_m += moved
        first = not self.points
        self.min_lat, self.min_lon = (lat, lon) if first else (min(self.min_lat, lat), min(self.min_lon, lon))
        self.max_lat, self.max_lon = (lat, lon) if first else (max(self.max_lat, lat), max(self.max_lon, lon))
        self.max_kmh, self.points = max(self.max_kmh, speed), self.points + 1
        self.ts, self.lat, self.lon = ts, lat, lon
        return kind, None, speed

    def summary(self, started: int) -> tuple[int, float, bool]:
        """Seconds from the trip's start to its last fix without gaps, mean km/h, and whether the trip is kept."""
        seconds = max(0, int((self.ts - started) / SECOND) - self.gap_s)
        box = distance(self.min_lat, self.min_lon, self.max_lat, self.max_lon)
        return seconds, self.distance_m / max(seconds, 1) * 3.6, seconds >= KEEP_S and self.distance_m >= KEEP_M and box >= KEEP_BOX


def known(x: object) -> object | None:
    """A frame's value, or None where it is null."""
    return None if x is None or x is pd.NA or x != x else x


def micros(t: pd.Timestamp) -> int:
    return t.value // 1000


class Sessions:
    """A device's sessions: an ingestor after the other, a new one after each split."""

    def __init__(self, saved: tuple | None = None):
        self.session, self.ingestor = (int(saved[0]), Ingestor(tuple(saved[1:]))) if saved else (0, Ingestor())

    def saved(self) -> tuple:
        return (self.session, *self.ingestor.saved())

    def take(self, r: tuple) -> list[tuple]:
        at = (micros(r.ts), r.lat, r.lon, r.acc)
        outcome, reason, speed = self.ingestor.take(*at, known(r.speed_mps), known(r.uuid))
        if outcome == "split":
            self.session, self.ingestor = self.session + 1, Ingestor()
            self.ingestor.take(*at, speed / 3.6, None)
        return [(r.seq, self.session, outcome, reason, speed)]


def _whole(fixes: DataFrame) -> DataFrame:
    return fixes.select("device", "seq", F.col("ts").cast("timestamp").alias("ts"), "lat", "lon", "acc", "speed_mps", "uuid").dropna(subset=["device", "seq", "ts", "lat", "lon", "acc"])


def ingest_batch(fixes: DataFrame) -> DataFrame:
    """(device, seq, ts, lat, lon, acc, speed_mps, uuid) -> an outcome for each fix, by device in order of ts and seq; a fix with a null but in speed or uuid isn't one."""
    return folded(_whole(fixes), "device", ["ts", "seq"], OUTCOMES, Sessions, Sessions.take)


def ingest_stream(fixes: DataFrame) -> DataFrame:
    """The same on a stream: each micro-batch's fixes are folded in order onto the device's state."""
    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        device = Sessions(state.get if state.exists else None)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        out = [(key[0], *o) for r in rows.itertuples(index=False) for o in device.take(r)]
        state.update(device.saved())
        yield table(out, OUTCOMES)

    return _whole(fixes).groupBy("device").applyInPandasWithState(run, OUTCOMES, STATE, "append", "NoTimeout")
