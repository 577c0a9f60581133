"""Lifecycle of trips, intervals, caches and the fetch queue, as rewrites of tables, and the read models over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A trip's states in order; minutes to wait by attempts; most attempts; bytes at which eviction begins and ends.
STATUSES = ("recording", "pendingRoadData", "pending", "matched", "confirmed", "rejected")
BACKOFF, MOST_ATTEMPTS, HIGH, LOW = (5, 30, 120, 720, 1440), 5, 50_000_000, 40_000_000


def close_trips(trips: DataFrame, points: DataFrame, summaries: DataFrame) -> DataFrame:
    """Recording trips with a summary -> closed (pendingRoadData) with ends, count and summary; a trip that isn't kept goes. Others stay.

    summaries: (trip_id, keeper, ended_at, duration_s, distance_m, avg_kmh, max_kmh). Ends come from the first and the last point by seq.
    """
    ends = points.groupBy("trip_id").agg(F.min_by(F.struct("lat", "lon"), "seq").alias("_s"), F.max_by(F.struct("lat", "lon"), "seq").alias("_e"), F.count("*").alias("_n"))
    news = {"ended_at", "duration_s", "distance_m", "avg_kmh", "max_kmh"}
    s = summaries.select("trip_id", "keeper", *(F.col(c).alias(f"_{c}") for c in news))
    rows = trips.join(s, "trip_id", "left").join(ends, "trip_id", "left")
    now = (F.col("status") == "recording") & F.col("keeper").isNotNull()
    rows = rows.where(~now | F.col("keeper"))
    value = {c: F.col(f"_{c}") for c in news} | {"start_lat": F.col("_s.lat"), "start_lon": F.col("_s.lon"), "end_lat": F.col("_e.lat"), "end_lon": F.col("_e.lon"), "point_count": F.col("_n"), "status": F.lit("pendingRoadData")}
    return rows.select(*(F.when(now, value[c]).otherwise(F.col(c)).alias(c) if c in value else F.col(c) for c in trips.columns))


def backfill_ends(trips: DataFrame, points: DataFrame) -> DataFrame:
    """Trips with their ends taken from the points where they are null."""
    ends = points.groupBy("trip_id").agg(*(f(c, "seq").alias(f"_{n}_{c}") for n, f in (("start", F.min_by), ("end", F.max_by)) for c in ("lat", "lon")))
    rows = trips.join(ends, "trip_id", "left")
    return rows.select(*(F.coalesce(c, f"_{c}").alias(c) if c in ("start_lat", "start_lon", "end_lat", "end_lon") else F.col(c) for c in trips.columns))


def moved(trips: DataFrame, requests: DataFrame) -> DataFrame:
    """Trips after requests (trip_id, status): the state is written whatever the old one was, so a request may repeat; of several for a trip the furthest counts."""
    place = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    asked = requests.groupBy("trip_id").agg(F.max_by("status", place).alias("_to"))
    rows = trips.join(asked, "trip_id", "left")
    return rows.select(*(F.coalesce("_to", "status").alias("status") if c == "status" else F.col(c) for c in trips.columns))


def without(parents: DataFrame, children: DataFrame, deleted: DataFrame, key: str, cascade: bool) -> tuple[DataFrame, DataFrame]:
    """Parents without the deleted ones (key); their children go (cascade) or lose the key (set null)."""
    gone = deleted.select(key).distinct()
    left = parents.join(gone, key, "left_anti")
    if cascade:
        return left, children.join(gone, key, "left_anti")
    rows = children.join(gone.withColumn("_gone", F.lit(True)), key, "left")
    return left, rows.select(*(F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == key else F.col(c) for c in children.columns))


def confirm(trips: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen trips become confirmed; wayfold.operators.publish does it together with the regions that they touch."""
    return moved(trips, chosen.select("trip_id", F.lit("confirmed").alias("status")))


def discard(trips: DataFrame, points: DataFrame, intervals: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trips, points and intervals without the chosen trips; intervals are deleted here, though a plain delete would keep them without a trip."""
    left, points = without(trips, points, chosen, "trip_id", cascade=True)
    return left, points, intervals.join(chosen.select("trip_id").distinct(), "trip_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new over those of old by key; columns that new doesn't have keep their value, or are null in a new row."""
    have = [c for c in new.columns if c != key]
    n = new.select(key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_n_{c}") for c in have))
    rows = old.join(n, key, "full")
    return rows.select(*(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in have else F.col(c) for c in old.columns))


def sweepable(intervals: DataFrame, now: Column, days: int | None = 30) -> DataFrame:
    """(trip_id) of trips whose last match is older than so many days; None keeps all. Trips without an interval are never swept."""
    last = intervals.where("trip_id is not null").groupBy("trip_id").agg(F.max("matched_at").alias("last"))
    return last.where(F.lit(False) if days is None else F.col("last") < now - F.expr(f"interval {days} days")).select("trip_id")


def fresh_tiles(cache: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Tiles that aren't older than so many days, and hold a way: empty ones are purged to be asked for again."""
    return cache.where((F.col("fetched_at") >= now - F.expr(f"interval {days} days")) & (F.col("way_count") > 0))


def evicted(cache: DataFrame, by: str | None = None, high: int = HIGH, low: int = LOW) -> DataFrame:
    """The oldest tiles that go when the cache holds over `high` bytes, until `low` is left; the one that crosses the mark goes as well.

    A cache is one device's; with `by` there is one for each value of that column.
    """
    group = W.partitionBy(by) if by else W.partitionBy(F.lit(0))
    before = group.orderBy("fetched_at", "z", "x", "y").rowsBetween(W.unboundedPreceding, -1)
    rows = cache.withColumns({"_all": F.sum("payload_bytes").over(group), "_before": F.coalesce(F.sum("payload_bytes").over(before), F.lit(0))})
    return rows.where((F.col("_all") > high) & (F.col("_all") - F.col("_before") > low)).drop("_all", "_before")


def enqueue(queue: DataFrame, wanted: DataFrame) -> DataFrame:
    """The queue with wanted trips (the queue's columns but attempts and last_attempt_at) that it doesn't hold yet."""
    fresh = wanted.join(queue.select("trip_id"), "trip_id", "left_anti").dropDuplicates(["trip_id"])
    return queue.unionByName(fresh.withColumns({"attempts": F.lit(0), "last_attempt_at": F.lit(None).cast("timestamp")}))


def due(queue: DataFrame, now: Column) -> DataFrame:
    """Entries to be tried now, oldest first: fewer than MOST_ATTEMPTS attempts, and the wait after the last one over."""
    wait = F.element_at(F.array(*map(F.lit, BACKOFF)), F.greatest(F.lit(1), F.least(F.col("attempts"), F.lit(len(BACKOFF)))).cast("int"))
    ready = F.col("last_attempt_at").isNull() | (F.unix_seconds("last_attempt_at") + wait * 60 <= F.unix_seconds(now))
    return queue.where((F.col("attempts") < MOST_ATTEMPTS) & ready).orderBy("created_at", "trip_id")


def attempted(queue: DataFrame, tried: DataFrame, now: Column) -> DataFrame:
    """The queue after attempts (trip_id, ok): those that went well leave it, others count one more."""
    rows = queue.join(tried.select("trip_id", "ok"), "trip_id", "left").where("ok is null or not ok")
    failed = F.col("ok").isNotNull()
    return rows.select(*((F.col(c) + failed.cast("int")).alias(c) if c == "attempts" else F.when(failed, now).otherwise(F.col(c)).alias(c) if c == "last_attempt_at" else F.col(c) for c in queue.columns))


def orphans(trips: DataFrame, queue: DataFrame) -> DataFrame:
    """Trips that wait for road data without an entry in the queue."""
    return trips.where("status = 'pendingRoadData'").join(queue.select("trip_id"), "trip_id", "left_anti")


def rematch(trips: DataFrame, intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Before all is matched anew: matched and confirmed trips back to pending, and the intervals that no trip owns, which stay."""
    again = F.col("status").isin("matched", "confirmed")
    status = F.when(again, "pending").otherwise(F.col("status"))
    redo = trips.where(again).select("trip_id")
    return trips.withColumn("status", status), intervals.join(redo, "trip_id", "left_anti")


def newest_open(trips: DataFrame) -> DataFrame:
    """The recording trip with the largest id: one row at most."""
    return trips.where("status = 'recording'").orderBy(F.desc("trip_id")).limit(1)


def union_box(trips: DataFrame) -> DataFrame:
    """One row with the box of all matched and confirmed trips, over those that have one; all null if a side is known of none."""
    kept = trips.where(F.col("status").isin("matched", "confirmed"))
    corners = {"min_lat": F.min, "min_lon": F.min, "max_lat": F.max, "max_lon": F.max}
    whole = reduce(Column.__and__, (F.count(c) > 0 for c in corners))
    return kept.agg(*(F.when(whole, f(c)).alias(c) for c, f in corners.items()))


def payload(cache: DataFrame) -> DataFrame:
    return cache.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)).cast("long").alias("payload_bytes"))


def by_way(intervals: DataFrame) -> DataFrame:
    """A row per way with its intervals in order."""
    return intervals.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("start_m", "end_m"))).alias("intervals"))


def hit_rate(lookups: DataFrame, by: str) -> DataFrame:
    """(by, hit boolean or null) -> share of hits; null before the first lookup."""
    return lookups.groupBy(by).agg(F.try_divide(F.count_if(F.col("hit")), F.count("hit")).alias("rate"))


def p90(frames: DataFrame, by: str, last: int = 600) -> DataFrame:
    """(by, n ascending, ms) -> the element at nine tenths of the last so many frames, in ascending order."""
    newest = frames.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(F.desc("n")))).where(F.col("_k") <= last)
    sorted_ms = F.sort_array(F.collect_list("ms"))
    return newest.groupBy(by).agg(sorted_ms.alias("v")).select(by, F.get("v", F.floor(F.size("v") * 9 / 10).cast("int")).alias("p90"))


def latest(requests: DataFrame, key: str, quiet: str = "150 milliseconds") -> DataFrame:
    """(key, ts, request) -> by burst of requests, which a pause ends, only the last one: a debounce, and late results of older ones never count.

    Works on a stream as well, with a watermark on ts.
    """
    return requests.groupBy(key, F.session_window("ts", quiet).alias("w")).agg(F.max_by("request", "ts").alias("request"), F.max("ts").alias("ts")).drop("w")
