"""From ingest outcomes to trips: summaries, the keeper rule, replay, dwell timers and counters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from .ingest import KEEP_BOX, KEEP_M, KEEP_S, distance, ingest_batch

#: Seconds of standing before the resume window, of that window, and metres within which a drive goes on.
DWELL, RESUME, RADIUS = 120.0, 900.0, 500.0


def accepted(fixes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Fixes that count, with their session and derived speed: accepted ones, those after a gap, and those that begin a new session."""
    kept = outcomes.where("outcome <> 'rejected'").select("device", "seq", "session", "outcome", "speed_kmh")
    return fixes.drop("speed_kmh").join(kept, ["device", "seq"])


def summaries(rows: DataFrame) -> DataFrame:
    """Accepted fixes (device, session, seq, ts, lat, lon, speed_kmh, outcome) -> one row per session with the keeper rule's verdict.

    The duration is whole seconds from the first to the last fix without gaps; of a gap one second stays. avg_kmh is over one second at least.
    """
    w = W.partitionBy("device", "session").orderBy("ts", "seq")
    step = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    micros = F.unix_micros("ts")
    gap = F.when(F.col("outcome") == "gap", F.floor((micros - F.lag(micros).over(w)) / 1_000_000) - 1)
    out = rows.withColumns({"d": step, "gap": gap}).groupBy("device", "session").agg(
        F.count("*").alias("point_count"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.coalesce(F.sum("gap"), F.lit(0)).alias("gap_s"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("distance_m"), F.max("speed_kmh").alias("max_kmh"),
        F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"))
    whole = F.floor((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1_000_000)
    out = out.withColumn("duration_s", F.greatest(F.lit(0), whole - F.col("gap_s")).cast("long")).drop("gap_s")
    out = out.withColumn("avg_kmh", F.col("distance_m") / F.greatest(F.col("duration_s"), F.lit(1)) * 3.6)
    box = geo.haversine(*(F.col(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")))
    return out.withColumn("keeper", (F.col("duration_s") >= KEEP_S) & (F.col("distance_m") >= KEEP_M) & (box >= KEEP_BOX))


def trips(found: DataFrame) -> DataFrame:
    """Session summaries -> the trips that are kept, closed and waiting for road data; split sessions are trips of their own."""
    return found.where("keeper").withColumn("status", F.lit("pendingRoadData"))


def replay(points: DataFrame) -> DataFrame:
    """Persisted points (trip_id, seq, ts, lat, lon, speed_kmh, accuracy_m) of trips left open -> ingest outcomes, as after a crash.

    Ids are unknown and a null accuracy counts as 0. Times are whole seconds, as persisted.
    """
    rows = points.select(F.col("trip_id").alias("device"), "seq", F.date_trunc("second", "ts").alias("ts"), "lat", "lon", F.coalesce("accuracy_m", F.lit(0.0)).alias("acc"), (F.col("speed_kmh") / 3.6).alias("speed_mps"), F.lit(None).cast("string").alias("uuid"))
    return ingest_batch(rows)


def counters(outcomes: DataFrame) -> DataFrame:
    """By device: how many fixes had which outcome, and the last reason of a rejection."""
    n = lambda k: F.count_if(F.col("outcome") == k).alias(f"n_{k}")
    return outcomes.groupBy("device").agg(n("accepted"), n("rejected"), n("gap"), n("split"), F.max_by("reason", F.when(F.col("reason").isNotNull(), F.col("seq"))).alias("last_reason"))


def headings(fixes: DataFrame) -> DataFrame:
    """(device, seq, lat, lon, heading) -> heading: the fix's own if it isn't negative, else the bearing after 5 m at least, else the last known."""
    w = W.partitionBy("device").orderBy("seq")
    before = [F.lag(c).over(w) for c in ("lat", "lon")]
    moved = geo.haversine(*before, F.col("lat"), F.col("lon")) > 5
    own = F.when(F.col("heading") >= 0, F.pmod("heading", F.lit(360.0)))
    known = F.coalesce(own, F.when(moved, geo.bearing(*before, F.col("lat"), F.col("lon"))))
    return fixes.withColumn("_h", known).select("device", "seq", F.last("_h", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("heading"))


_STATE = "dwell double, stopped double, lat double, lon double, now_lat double, now_lon double"
_STOPS = "device long, ts double, event string"


def stop_fold(state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    """State and a device's events in order (ts in seconds, activity or null, lat, lon) -> new state and what happened: paused, resumed, stopped.

    Standing begins at the first activity that isn't driving; after DWELL seconds the trip is paused where it is, and after RESUME
    more it is stopped. Driving ends standing, and a pause if it is within RADIUS of the place.
    """
    none = math.nan
    dwell, stopped, lat, lon, a, b = state or (none,) * 6
    out = []

    def pass_time(now: float) -> None:
        nonlocal dwell, stopped, lat, lon
        if dwell == dwell and now >= dwell + DWELL:
            stopped, lat, lon, dwell = dwell + DWELL, a, b, none
            out.append((stopped, "paused"))
        if stopped == stopped and now >= stopped + RESUME:
            out.append((stopped + RESUME, "stopped"))
            stopped = none

    for r in rows.itertuples():
        pass_time(r.ts)
        if r.lat == r.lat:
            a, b = r.lat, r.lon
        if r.activity == "in_vehicle":
            dwell = none
            if stopped == stopped and a == a and lat == lat and distance(lat, lon, a, b) <= RADIUS:
                stopped = none
                out.append((r.ts, "resumed"))
        elif isinstance(r.activity, str) and dwell != dwell and stopped != stopped:
            dwell = r.ts
    return (dwell, stopped, lat, lon, a, b), out


def _stops(device: int, out: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame({"device": [device] * len(out), "ts": [float(o[0]) for o in out], "event": [o[1] for o in out]})
    return f.astype({"device": "int64", "ts": "float64", "event": "object"})


def stops(events: DataFrame) -> DataFrame:
    """(device, ts, activity, lat, lon, manual) -> pauses, resumptions and stops of automatic trips; manual ones have no timers.

    Event time drives the timers: a stop shows with the first event after it. Devices fold apart.
    """
    rows = events.where("not manual").select("device", (F.unix_micros("ts") / 1e6).alias("ts"), "activity", "lat", "lon")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        return _stops(int(f.device.iloc[0]), stop_fold(None, f.sort_values("ts", kind="stable"))[1])

    return rows.groupBy("device").applyInPandas(run, _STOPS)


def stops_stream(events: DataFrame) -> DataFrame:
    """The same on a stream, with the fold's state by device."""
    rows = events.where("not manual").select("device", (F.unix_micros("ts") / 1e6).alias("ts"), "activity", "lat", "lon")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        new, out = stop_fold(state.get if state.exists else None, pd.concat(list(frames)).sort_values("ts", kind="stable"))
        state.update(tuple(map(float, new)))
        yield _stops(int(key[0]), out)

    return rows.groupBy("device").applyInPandasWithState(run, _STOPS, _STATE, "append", "NoTimeout")
