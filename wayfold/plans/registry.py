"""All queries of the road-coverage engine, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import coverage, matching
from ..sources.views import load, oracle
from . import domain, inbox, live, models, rules, stores  # noqa: F401  they add their queries to domain's
from .relational import _A, _HAV, _LAG, SQL, UNION, WAYS


def coverage_by_region(spark: SparkSession, d: str) -> DataFrame:
    return coverage.coverage_by_region(*load(spark, d, "d_intervals", "d_vertices", "d_region_edges"))


def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return coverage.interval_union(load(spark, d, "d_intervals")).select("way_id", "start_m", "end_m")


def way_length_centroid(spark: SparkSession, d: str) -> DataFrame:
    return coverage.way_geometry(load(spark, d, "d_vertices")).select("way_id", F.round("len_m", 3).alias("len_m"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def point_in_region(spark: SparkSession, d: str) -> DataFrame:
    v, e = load(spark, d, "d_vertices", "d_region_edges")
    return coverage.point_in_region(coverage.way_geometry(v), e, "way_id").groupBy("level", "region_id").agg(F.count("*").alias("n"))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("trip_id").orderBy("seq")
    f = load(spark, d, "d_fixes")
    return f.withColumns({"plat": F.lag("lat").over(w), "plon": F.lag("lon").over(w), "pts": F.lag("ts").over(w)}).withColumn("d", geo.haversine(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")))


def trip_distance(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d).groupBy("trip_id").agg(F.round(F.sum("d"), 1).alias("distance_m"), F.max("speed_kmh").alias("max_speed"), F.count("*").alias("n"))


def gap_split_sessions(spark: SparkSession, d: str) -> DataFrame:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    dt = micros("ts") - micros("pts")
    s = _steps(spark, d).withColumn("split", F.when((dt > 300_000_000) & (F.col("d") > 500), 1).otherwise(0))
    s = s.withColumn("session", F.sum("split").over(W.partitionBy("trip_id").orderBy("seq")))
    return s.groupBy("trip_id", "session").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def emission_logprob(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "d_fixes").select("trip_id", "seq", F.round(geo.emission(F.col("speed_kmh") / 4, F.col("acc")), 6).alias("emit"))


def segments_explode(spark: SparkSession, d: str) -> DataFrame:
    return matching.segments(load(spark, d, "d_vertices")).select("way_id", "seg_idx", "a_node", "b_node", F.round("seg_len", 3).alias("seg_len"), F.round("from_m", 3).alias("from_m"))


#: Classes and one-way rules of ways for matching.
_ROADS = """SELECT p_partkey AS way_id, CASE p_size%5 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk_link' ELSE 'residential' END AS highway, CASE p_size%7 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS oneway FROM part"""


def _matching(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Fixes, candidates, segments and vertices."""
    v = load(spark, d, "d_vertices")
    fixes = domain.walk(spark)
    segs = matching.segments(v.join(spark.sql(_ROADS), "way_id"))
    return fixes, matching.candidates(fixes, segs), segs, v


def candidates_topk(spark: SparkSession, d: str) -> DataFrame:
    near = _matching(spark, d)[1]
    return near.select("trip_id", "seq", "cand_rank", "way_id", F.round("dist", 3).alias("dist"), F.round("emit", 4).alias("emit"))


def low_confidence_drop(spark: SparkSession, d: str) -> DataFrame:
    fixes, near, _, _ = _matching(spark, d)
    return matching.subtracks(near, fixes).groupBy("trip_id").agg(F.countDistinct("seq").alias("n_fixes"), F.countDistinct("track").alias("n_tracks"))


def viterbi_steps(spark: SparkSession, d: str) -> DataFrame:
    fixes, near, segs, _ = _matching(spark, d)
    return matching.viterbi_steps(matching.subtracks(near, fixes), segs, fixes)


def driven_intervals(spark: SparkSession, d: str) -> DataFrame:
    fixes, near, segs, v = _matching(spark, d)
    near = matching.subtracks(near, fixes)
    return matching.driven_intervals(matching.viterbi_steps(near, segs, fixes), near, fixes, v)


def result_counters(spark: SparkSession, d: str) -> DataFrame:
    fixes, near, segs, _ = _matching(spark, d)
    return matching.result_counters(matching.viterbi_steps(matching.subtracks(near, fixes), segs, fixes), fixes)


def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "d_vertices").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("i", "lat", "lon"))).alias("v"))
    return v.select("way_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), F.transform("v", lambda p: F.array(F.round(p["lon"], 6), F.round(p["lat"], 6))).alias("coordinates")).alias("geometry"))).alias("feature"))


_DATAFRAME = [coverage_by_region, interval_union, way_length_centroid, point_in_region, trip_distance, gap_split_sessions, emission_logprob, segments_explode, candidates_topk, low_confidence_drop, viterbi_steps, driven_intervals, result_counters, geojson_features]

_STEP = f"s AS (SELECT *, {_HAV} AS d FROM (SELECT *, {_A} AS a FROM ({_LAG}) q) r)"
_SEG = """g AS (SELECT way_id, i AS seg_idx, node_id AS a_node, lead(node_id) OVER (PARTITION BY way_id ORDER BY i) AS b_node, lat AS alat, lon AS alon, lead(lat) OVER (PARTITION BY way_id ORDER BY i) AS blat, lead(lon) OVER (PARTITION BY way_id ORDER BY i) AS blon FROM d_vertices),
 h AS (SELECT *, sqrt(power((blon-alon)*111320*cos(radians(alat)),2)+power((blat-alat)*111320,2)) AS seg_len FROM g WHERE b_node IS NOT NULL)"""
_CAND = f"""f AS ({domain.WALK}), rd AS ({_ROADS}), c AS (SELECT f.*, h.way_id, h.seg_idx, rd.highway, (f.lon-alon)*111320*cos(radians(alat)) AS px, (f.lat-alat)*111320 AS py, (blon-alon)*111320*cos(radians(alat)) AS bx, (blat-alat)*111320 AS bq
 FROM f JOIN h ON f.lat BETWEEN least(alat,blat)-0.002 AND greatest(alat,blat)+0.002 AND f.lon BETWEEN least(alon,blon)-0.003 AND greatest(alon,blon)+0.003 JOIN rd ON rd.way_id=h.way_id),
 t AS (SELECT *, greatest(0,least(1,(px*bx+py*bq)/(bx*bx+bq*bq))) AS k FROM c), e AS (SELECT *, sqrt(power(px-k*bx,2)+power(py-k*bq,2)) AS dist FROM t),
 r AS (SELECT *, row_number() OVER (PARTITION BY trip_id, seq ORDER BY round(dist,6), way_id, seg_idx) AS cand_rank FROM e WHERE dist<=least(150,greatest(25,25+acc/2))),
 n AS (SELECT *, -0.5*power(dist/greatest(4.07,acc/2),2)-ln(greatest(4.07,acc/2)*2.5066282746310002)-CASE WHEN speed_kmh<15 AND highway IN ('motorway','trunk_link') THEN ln(1e6) ELSE 0 END AS emit FROM r WHERE cand_rank<=5)"""
_ORACLES = {
    "coverage_by_region": f"""WITH {WAYS}, {UNION}, dr AS (SELECT way_id, sum(end_m-start_m) AS d FROM u GROUP BY way_id)
 SELECT a.level, a.region_id, count(*) AS n_ways, round(sum(coalesce(d,0)),2) AS driven_m, round(sum(len),2) AS total_m, round(least(greatest(sum(coalesce(d,0))/sum(len)*100,0),100),4) AS pct
 FROM att a JOIN w ON a.way_id=w.way_id LEFT JOIN dr ON dr.way_id=a.way_id GROUP BY a.level,a.region_id""",
    "interval_union": f"WITH {UNION} SELECT way_id, start_m, end_m FROM u",
    "way_length_centroid": f"WITH {WAYS} SELECT way_id, round(len,3) AS len_m, round(clat,6) AS lat, round(clon,6) AS lon FROM w",
    "point_in_region": f"WITH {WAYS} SELECT level, region_id, count(*) AS n FROM att GROUP BY 1, 2",
    "trip_distance": f"WITH {_STEP} SELECT trip_id, round(sum(d),1) AS distance_m, max(speed_kmh) AS max_speed, count(*) AS n FROM s GROUP BY trip_id",
    "gap_split_sessions": f"WITH {_STEP}, t AS (SELECT *, sum(CASE WHEN ts-pts>INTERVAL 5 MINUTE AND d>500 THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id ORDER BY seq) AS session FROM s) SELECT trip_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(seq) AS first_seq FROM t GROUP BY 1, 2",
    "emission_logprob": "SELECT trip_id, seq, round(-0.5*power(speed_kmh/4/greatest(4.07,acc/2),2)-ln(greatest(4.07,acc/2)*2.5066282746310002),6) AS emit FROM d_fixes",
    "segments_explode": f"WITH {_SEG} SELECT way_id, seg_idx, a_node, b_node, round(seg_len,3) AS seg_len, round(coalesce(sum(seg_len) OVER (PARTITION BY way_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0),3) AS from_m FROM h",
    "candidates_topk": f"WITH {_SEG}, {_CAND} SELECT trip_id, seq, cand_rank, way_id, round(dist,3) AS dist, round(emit,4) AS emit FROM n",
    "result_counters": f"""WITH {_SEG}, {_CAND}, b AS (SELECT f.trip_id, f.seq, coalesce(max(emit)>=ln(0.001), FALSE) AS ok FROM f LEFT JOIN n ON n.trip_id=f.trip_id AND n.seq=f.seq GROUP BY 1, 2)
 SELECT trip_id, count(*) AS n, count(*) FILTER (ok) AS matched, count(*) FILTER (NOT ok) AS dropped FROM b GROUP BY trip_id""",
    "low_confidence_drop": f"""WITH {_SEG}, {_CAND}, b AS (SELECT f.trip_id, f.seq, coalesce(max(emit)>=ln(0.001), FALSE) AS ok FROM f LEFT JOIN n ON n.trip_id=f.trip_id AND n.seq=f.seq GROUP BY 1, 2),
 o AS (SELECT *, CASE WHEN ok AND (NOT coalesce(lag(ok) OVER w, FALSE) OR (seq-lag(seq) OVER w)*5>60) THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) SELECT trip_id, count(*) FILTER (ok) AS n_fixes, sum(new) AS n_tracks FROM o GROUP BY trip_id HAVING count(*) FILTER (ok)>0""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _DATAFRAME} | rules.FOUND | domain.FOUND


def oracle_sql() -> dict[str, str]:
    return {k: oracle(v) for k, v in _ORACLES.items()} | {k: oracle(v) for k, (_, v) in SQL.items()} | {k: oracle(v) for k, v in domain.ORACLES.items()}
