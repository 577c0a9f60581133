"""Queries of ingest and tracking over a stream of fixes that meets every rule, with recursive SQL as the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import load
from ..streaming import ingest, progress, tracking, trips
from .domain import query

_T = "timestamp_micros(us)"


def _fold(source: str) -> str:
    """SQL of the ingestor: a step takes the next fix of every device. source: (device, seq, us, lat, lon, acc, mps, uuid), in order of us and seq."""
    return f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY us, seq) AS place FROM ({source}) q),
 r AS (SELECT DISTINCT device, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS us, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, CAST([] AS VARCHAR[]) AS seen, CAST(0 AS BIGINT) AS session, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS DOUBLE) AS kmh FROM s
 UNION ALL
 SELECT device, place, seq, CASE WHEN o='rejected' THEN us0 ELSE us END, CASE WHEN o='rejected' THEN lat0 ELSE lat END, CASE WHEN o='rejected' THEN lon0 ELSE lon END,
  CASE WHEN o='split' THEN [] WHEN o='rejected' OR uuid IS NULL THEN seen ELSE list_slice(list_append(seen, uuid), -100, -1) END, session + CASE WHEN o='split' THEN 1 ELSE 0 END, o,
  CASE WHEN o='rejected' THEN why END, CASE WHEN o='rejected' THEN NULL WHEN mps>=0 THEN mps*3.6 WHEN dt>=1000000 THEN m/(dt//1000000)*3.6 ELSE 0 END
 FROM (SELECT *, CASE WHEN why IS NOT NULL THEN 'rejected' WHEN dt>300000000 AND m>500 THEN 'split' WHEN dt>300000000 THEN 'gap' ELSE 'accepted' END AS o
 FROM (SELECT *, CASE WHEN uuid IS NOT NULL AND list_contains(seen, uuid) THEN 'duplicate' WHEN acc>25 THEN 'accuracy' WHEN dt<900000 THEN 'rate_limit' END AS why, 2*6371000*atan2(sqrt(a),sqrt(1-a)) AS m
 FROM (SELECT r.seen, r.session, r.us AS us0, r.lat AS lat0, r.lon AS lon0, s.*, s.us-r.us AS dt, power(sin(radians(s.lat-r.lat)/2),2)+cos(radians(r.lat))*cos(radians(s.lat))*power(sin(radians(s.lon-r.lon)/2),2) AS a FROM r JOIN s ON s.device=r.device AND s.place=r.place+1) x) y) z)"""


_STREAM = "SELECT device, seq, us, lat, lon, acc, mps, uuid FROM d_stream"


def _fixes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "d_stream").select("device", "seq", F.expr(_T).alias("ts"), "lat", "lon", "acc", F.col("mps").alias("speed_mps"), "uuid")


@query(f"{_fold(_STREAM)} SELECT device, seq, session, outcome, reason, round(kmh,6) AS speed_kmh FROM r WHERE place>0")
def ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingest_batch(_fixes(spark, d)).withColumn("speed_kmh", F.round("speed_kmh", 6))


@query(f"{_fold(_STREAM)} SELECT device, count(*) FILTER (outcome='accepted') AS n_accepted, count(*) FILTER (outcome='rejected') AS n_rejected, count(*) FILTER (outcome='gap') AS n_gap, count(*) FILTER (outcome='split') AS n_split, max_by(reason, seq) FILTER (reason IS NOT NULL) AS last_reason FROM r WHERE place>0 GROUP BY device")
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    return trips.counters(ingest.ingest_batch(_fixes(spark, d)))


@query(f"""{_fold(_STREAM)}, g AS (SELECT *, lag(us) OVER w AS us0, power(sin(radians(lat-lag(lat) OVER w)/2),2)+cos(radians(lag(lat) OVER w))*cos(radians(lat))*power(sin(radians(lon-lag(lon) OVER w)/2),2) AS a FROM r WHERE outcome<>'rejected' WINDOW w AS (PARTITION BY device, session ORDER BY place)),
 t AS (SELECT device, session, count(*) AS n, min(us) AS b, max(us) AS e, coalesce(sum(CASE WHEN outcome='gap' THEN (us-us0)//1000000-1 END),0) AS gaps, coalesce(sum(2*6371000*atan2(sqrt(a),sqrt(1-a))),0) AS m, max(kmh) AS kmh, min(lat) AS la, max(lat) AS lb, min(lon) AS oa, max(lon) AS ob FROM g GROUP BY 1,2),
 u AS (SELECT *, greatest(0,(e-b)//1000000-gaps) AS s, power(sin(radians(lb-la)/2),2)+cos(radians(la))*cos(radians(lb))*power(sin(radians(ob-oa)/2),2) AS a FROM t)
 SELECT device, session, n AS point_count, CAST(s AS BIGINT) AS duration_s, round(m,3) AS distance_m, round(m/greatest(s,1)*3.6,6) AS avg_kmh, round(kmh,6) AS max_kmh, 'pendingRoadData' AS status FROM u WHERE s>=60 AND m>=100 AND 2*6371000*atan2(sqrt(a),sqrt(1-a))>=50""")
def kept_trips(spark: SparkSession, d: str) -> DataFrame:
    f = _fixes(spark, d)
    kept = trips.trips(trips.summaries(trips.accepted(f, ingest.ingest_batch(f))))
    return kept.select("device", "session", "point_count", "duration_s", F.round("distance_m", 3).alias("distance_m"), F.round("avg_kmh", 6).alias("avg_kmh"), F.round("max_kmh", 6).alias("max_kmh"), "status")


_PERSISTED = "SELECT device, seq, us-us%1000000 AS us, lat, lon, CAST(coalesce(CASE WHEN seq%3>0 THEN acc END,0) AS DOUBLE) AS acc, mps, CAST(NULL AS VARCHAR(9)) AS uuid FROM d_stream"


@query(f"{_fold(_PERSISTED)} SELECT device, seq, session, outcome, reason, round(kmh,6) AS speed_kmh FROM r WHERE place>0")
def replayed_outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = _fixes(spark, d).select(F.col("device").alias("trip_id"), "seq", "ts", "lat", "lon", (F.col("speed_mps") * 3.6).alias("speed_kmh"), F.when(F.col("seq") % 3 > 0, F.col("acc")).alias("accuracy_m"))
    return trips.replay(rows).withColumn("speed_kmh", F.round("speed_kmh", 6))


def events(spark: SparkSession, d: str) -> DataFrame:
    """Fixes of d_stream with starts, stops, activities and motions between them."""
    load(spark, d, "d_stream")
    null = "CAST(NULL AS BOOLEAN) AS manual, CAST(NULL AS STRING) AS activity, CAST(NULL AS BOOLEAN) AS moving"
    none = "CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, CAST(NULL AS DOUBLE) AS acc, CAST(NULL AS DOUBLE) AS speed_mps, CAST(NULL AS DOUBLE) AS heading, CAST(NULL AS STRING) AS uuid"
    return spark.sql(f"""SELECT device, timestamp_micros(us+seq%3*100000) AS at, 'fix' AS kind, {null}, {_T} AS ts, lat, lon, acc, mps AS speed_mps, CASE WHEN seq%7=0 THEN CAST(seq%400-20 AS DOUBLE) END AS heading, uuid FROM d_stream
 UNION ALL SELECT device, timestamp_micros(min(us)-1000000), 'start', device%3=0, NULL, NULL, {none} FROM d_stream GROUP BY device
 UNION ALL SELECT device, timestamp_micros(us+400000), 'activity', NULL, CASE WHEN seq%8<3 THEN 'in_vehicle' ELSE 'still' END, NULL, {none} FROM d_stream WHERE seq%6=0
 UNION ALL SELECT device, timestamp_micros(us+700000), 'motion', NULL, NULL, seq%20=3, {none} FROM d_stream WHERE seq%10=3
 UNION ALL SELECT device, timestamp_micros(us+800000), CASE WHEN seq%2=0 THEN 'stop' ELSE 'start' END, seq%3=0, NULL, NULL, {none} FROM d_stream WHERE seq%17=0""")


@query()
def tracked_trips(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the tracker, held by a brute-force version in tests/test_tracking.py."""
    return tracking.track(events(spark, d))


@query()
def recovered_trips(spark: SparkSession, d: str) -> DataFrame:
    """Trips that the events leave open, closed as after a crash."""
    rows = tracking.track(events(spark, d))
    return tracking.recovered(rows, rows.where("row = 'point'").withColumn("acc", F.lit(None).cast("double")))


@query("""SELECT device, CAST(place AS BIGINT) AS done, total FROM (SELECT device, row_number() OVER (PARTITION BY device ORDER BY seq) AS place, count(*) OVER (PARTITION BY device) AS total FROM (SELECT user_id%8 AS device, event_id AS seq FROM events) e) q WHERE place%128=0 OR place=total""")
def progress_events(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "events").select((F.col("user_id") % 8).alias("device"), F.col("event_id").alias("seq"))
    return progress.events(f, by="device")
