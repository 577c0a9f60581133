"""Queries of requests with retry, the read-through tile store and confirmed trips, each with SQL written on its own as the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage, publish
from ..sources import osm, roads
from ..sources.snapshots import Snapshots, shared_folder
from ..sources.views import load
from .domain import query
from .relational import UNION, WAYS

_SCRIPT = "SELECT event_id AS n, user_id AS region, event_id%2=1 AS turned, event_id%8 AS a, CAST(floor(CAST(event_id AS DOUBLE)/8) AS BIGINT)%8 AS b, CAST(floor(CAST(event_id AS DOUBLE)/64) AS BIGINT)%8 AS c FROM events"
#: Answers by number, and what they are worth.
_ANSWERS = [(200, '{"elements": []}'), (429, ""), (503, "x"), (404, "no"), (200, "<html>busy</html>"), (200, '{"remark": "out of memory"}'), (None, ""), (200, '{"remark": "fine"}')]
_KIND = "CASE {x} WHEN 0 THEN 'ok' WHEN 7 THEN 'ok' WHEN 3 THEN 'failed' WHEN 5 THEN 'memory' ELSE 'transient' END"
_CODE = "CASE {x} WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 WHEN 6 THEN NULL ELSE 200 END"


def _answer(request: dict, server: str, text: str, timeout: float) -> tuple[int, str]:
    """The scripted answer of the attempt: an attempt is known by its server, and the second one by the first's mark."""
    k = request["asked"] = request.get("asked", 0) + 1
    status, body = _ANSWERS[int(request["abc"[k - 1]])]
    if status is None:
        raise TimeoutError
    return status, body


@query(f"""WITH s AS ({_SCRIPT}), k AS (SELECT *, {_KIND.format(x='a')} AS ka, {_KIND.format(x='b')} AS kb, {_KIND.format(x='c')} AS kc, {_CODE.format(x='a')} AS ca, {_CODE.format(x='b')} AS cb, {_CODE.format(x='c')} AS cc FROM s),
 m AS (SELECT *, CASE WHEN ka<>'transient' THEN 1 WHEN kb<>'transient' THEN 2 ELSE 3 END AS attempts FROM k)
 SELECT n, attempts, CASE attempts WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 7 END AS waited_s, CASE attempts WHEN 1 THEN ca WHEN 2 THEN cb ELSE cc END AS http_status, CASE WHEN CASE attempts WHEN 1 THEN ka WHEN 2 THEN kb ELSE kc END='ok' THEN 'ok' ELSE 'failed' END AS outcome,
 'primary' AS server FROM m WHERE attempts<3 UNION ALL SELECT n, attempts, 7, cc, CASE WHEN kc='ok' THEN 'ok' ELSE 'failed' END, 'fallback' FROM m WHERE attempts=3""")
def request_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Every order of three answers: what is tried again, where, and after how long."""
    load(spark, d, "events")
    out = roads.fetched(spark.sql(_SCRIPT), _answer, workers=8, order=("n",), text_of=lambda r: "q", sleep=lambda s: None)
    return out.select("n", "attempts", "waited_s", "http_status", "outcome", "server")


_NOW = 960 * 86_400
_CACHED = "SELECT 12 AS z, p_partkey%16 AS x, p_partkey AS y, CAST((900+p_partkey%100)*86400 AS BIGINT) AS s FROM part WHERE p_partkey%3>0"
_WANTED = "SELECT 12 AS z, p_partkey%16 AS x, p_partkey AS y, p_size AS size FROM part WHERE p_size%4>0"


def _tile(request: dict, server: str, text: str, timeout: float) -> tuple[int, str]:
    """Tiles of every eleventh size aren't there; others have as many ways as their size's last digit."""
    if request["size"] % 11 == 0:
        return 404, ""
    way = '{{"type": "way", "id": {}, "geometry": [{{"lat": 1, "lon": 2}}, {{"lat": 1, "lon": 3}}], "tags": {{"highway": "residential"}}}}'
    return 200, '{"elements": [' + ", ".join(way.format(request["y"] * 10 + k) for k in range(request["size"] % 10)) + "]}"


@query(f"""WITH c AS ({_CACHED}), w AS ({_WANTED}), j AS (SELECT w.*, c.s FROM w LEFT JOIN c ON c.z=w.z AND c.x=w.x AND c.y=w.y)
 SELECT z, x, y, CASE WHEN s>={_NOW}-30*86400 THEN 'hit' WHEN size%11=0 THEN 'failed' ELSE 'fetched' END AS outcome,
 CASE WHEN s>={_NOW}-30*86400 THEN 99 WHEN size%11>0 THEN size%10 END AS way_count, CASE WHEN s>={_NOW}-30*86400 THEN s WHEN size%11>0 THEN {_NOW} END AS fetched_s FROM j""")
def read_through_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Fresh, stale and missing tiles through the store; failures are left out."""
    load(spark, d, "part")
    store = roads.TileStore(spark, shared_folder(spark, "tiles"))
    cached = spark.sql(_CACHED).select("z", "x", "y", F.lit("{}").alias("body"), F.lit(99).alias("way_count"), F.timestamp_seconds("s").alias("fetched_at"))
    store.put(osm.gzip(cached, "body"))
    tiles, outcomes = store.read_through(spark.sql(_WANTED), _tile, F.timestamp_seconds(F.lit(_NOW)), on_error="skip")
    return outcomes.join(tiles.select("z", "x", "y", "way_count", F.unix_seconds("fetched_at").alias("fetched_s")), ["z", "x", "y"], "left").select("z", "x", "y", "outcome", "way_count", "fetched_s")


_BOXED = """SELECT c_custkey AS trip_id, CASE c_custkey%4 WHEN 0 THEN 'matched' WHEN 1 THEN 'confirmed' ELSE 'pending' END AS status, CAST(49.5 AS DOUBLE)+CAST(c_custkey%45 AS DOUBLE)/250 AS min_lat, CAST(9.0 AS DOUBLE)+CAST(c_custkey%22 AS DOUBLE)/160 AS min_lon,
 CAST(49.5005 AS DOUBLE)+CAST(c_custkey%45 AS DOUBLE)/250 AS max_lat, CAST(9.0005 AS DOUBLE)+CAST(c_custkey%22 AS DOUBLE)/160 AS max_lon FROM customer"""
_CHOSEN, _LATER = "c_custkey%60=12", "l_shipdate>=DATE '1997-01-01'"


@query(f"""WITH b AS ({_BOXED}), p AS (SELECT min_lat AS lat, min_lon AS lon FROM b WHERE trip_id%60=12 UNION ALL SELECT min_lat, max_lon FROM b WHERE trip_id%60=12 UNION ALL SELECT max_lat, min_lon FROM b WHERE trip_id%60=12 UNION ALL SELECT max_lat, max_lon FROM b WHERE trip_id%60=12 UNION ALL SELECT (min_lat+max_lat)/2, (min_lon+max_lon)/2 FROM b WHERE trip_id%60=12),
 n AS (SELECT lat, lon, level, region_id, ord FROM p CROSS JOIN d_region_edges GROUP BY 1,2,3,4,5 HAVING sum(CASE WHEN ((yi>lat) <> (yj>lat)) AND lon < (xj-xi)*(lat-yi)/((yj-yi)+1e-30)+xi THEN 1 ELSE 0 END)%2=1),
 touched AS (SELECT DISTINCT min_by(region_id, ord) OVER (PARTITION BY lat, lon, level) AS region_id FROM n), {WAYS}, {UNION}, dn AS (SELECT way_id, sum(end_m-start_m) AS d FROM u GROUP BY way_id),
 m2 AS (SELECT *, max(end_m) OVER (PARTITION BY way_id ORDER BY start_m,end_m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM d_intervals WHERE matched_at<DATE '1997-01-01'),
 g2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_m>pe THEN 1 ELSE 0 END) OVER (PARTITION BY way_id ORDER BY start_m,end_m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM m2),
 d0 AS (SELECT way_id, sum(e-b) AS d FROM (SELECT way_id, isl, min(start_m) AS b, max(end_m) AS e FROM g2 GROUP BY way_id, isl) q GROUP BY way_id)
 SELECT a.level, a.region_id, t.region_id IS NOT NULL AS touched, round(sum(coalesce(CASE WHEN t.region_id IS NULL THEN d0.d ELSE dn.d END,0)),2) AS driven_m, (SELECT count(*) FROM b WHERE trip_id%60=12 OR status='confirmed') AS n_confirmed
 FROM att a JOIN w ON a.way_id=w.way_id LEFT JOIN touched t ON t.region_id=a.region_id LEFT JOIN dn ON dn.way_id=a.way_id LEFT JOIN d0 ON d0.way_id=a.way_id GROUP BY 1, 2, 3""")
def confirmed_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Confirming flips states, drops the touched regions' rows and computes them anew, in one version; other regions keep older rows."""
    intervals, vertices, edges, _ = load(spark, d, "d_intervals", "d_vertices", "d_region_edges", "customer")
    trips, store = spark.sql(_BOXED), Snapshots(spark, shared_folder(spark, "trips"))
    old = intervals.where("matched_at < DATE '1997-01-01'")
    store.commit(replace={"trips": trips, "intervals": old, "vertices": vertices, "edges": edges, "coverage": coverage.coverage_by_region(old, vertices, edges).limit(0).select(*publish.COVERAGE)})
    publish.recompute(store)
    store.commit(append={"intervals": intervals.where("matched_at >= DATE '1997-01-01'")})
    before = store.version()
    touched = publish.touched_regions(store.read("trips"), trips.where("trip_id % 60 = 12"), edges).withColumn("touched", F.lit(True))
    after = publish.confirm(store, trips.where("trip_id % 60 = 12"))
    assert after == before + 1
    n = store.read("trips").where("status = 'confirmed'").count()
    rows = store.read("coverage").join(touched, "region_id", "left")
    return rows.select("level", "region_id", F.coalesce("touched", F.lit(False)).alias("touched"), "driven_m", F.lit(n).alias("n_confirmed"))
