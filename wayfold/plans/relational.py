"""SQL that DuckDB runs as the check of the queries in rules.py, and parts of other queries' SQL."""

from __future__ import annotations

_HAV = "2*CAST(6371000 AS DOUBLE)*atan2(sqrt(a),sqrt(1-a))"
_LAG = """SELECT *, lag(lat) OVER (PARTITION BY trip_id ORDER BY seq) AS plat, lag(lon) OVER (PARTITION BY trip_id ORDER BY seq) AS plon, lag(ts) OVER (PARTITION BY trip_id ORDER BY seq) AS pts FROM d_fixes"""
_A = "power(sin(radians(lat-plat)/2),2)+cos(radians(plat))*cos(radians(lat))*power(sin(radians(lon-plon)/2),2)"

#: name -> (views or tables, SQL)
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "accuracy_filter": (("d_fixes",), "SELECT trip_id, count(*) AS n, sum(CASE WHEN acc<=25 THEN 1 ELSE 0 END) AS n_ok FROM d_fixes GROUP BY trip_id"),
    "tile_histogram": (("d_fixes",), """SELECT CAST(floor((lon+180)/360*4096) AS BIGINT) AS x, CAST(floor((1-ln(tan(radians(lat))+1/cos(radians(lat)))/CAST(3.141592653589793 AS DOUBLE))/2*4096) AS BIGINT) AS y, count(*) AS n FROM d_fixes GROUP BY 1, 2"""),
    "endpoints": (("d_fixes",), "SELECT trip_id, min_by(lat, seq) AS start_lat, min_by(lon, seq) AS start_lon, max_by(lat, seq) AS end_lat, max_by(lon, seq) AS end_lon, count(*) AS point_count FROM d_fixes GROUP BY trip_id"),
    "adaptive_radius": (("d_fixes",), "SELECT trip_id, seq, CASE WHEN acc>0 THEN least(CAST(150 AS DOUBLE), greatest(CAST(25 AS DOUBLE), 25+acc/2)) ELSE CAST(25 AS DOUBLE) END AS radius FROM d_fixes"),
    "surrogate_node_key": (("d_vertices",), "SELECT way_id, i, -abs(CAST(round(lat*1000000) AS BIGINT)*1000000007+CAST(round(lon*1000000) AS BIGINT))-1 AS node_key FROM d_vertices"),
    "junction_sharing": (("d_vertices",), "SELECT node_id, count(DISTINCT way_id) AS n_ways FROM d_vertices WHERE i IN (0, 3) GROUP BY node_id HAVING count(DISTINCT way_id)>1"),
    "oneway_normalise": (("part",), """SELECT way_id, tag, class, CASE WHEN tag IN ('yes','true','1') THEN 'forward' WHEN tag IN ('-1','reverse') THEN 'backward' WHEN tag IN ('no','false','0') THEN 'no' WHEN class IN ('motorway','motorway_link','trunk_link') THEN 'forward' ELSE 'no' END AS oneway
 FROM (SELECT p_partkey AS way_id, CASE p_size%7 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' WHEN 3 THEN 'reverse' WHEN 4 THEN '1' WHEN 5 THEN '0' ELSE '' END AS tag, CASE p_partkey%3 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk_link' ELSE 'primary' END AS class FROM part) t"""),
    "cascade_delete": (("d_trips", "d_intervals"), "SELECT i.way_id, i.trip_id, i.start_m, i.end_m FROM d_intervals i WHERE NOT EXISTS (SELECT 1 FROM d_trips t WHERE t.trip_id=i.trip_id AND t.status='pending')"),
    "set_null_delete": (("d_trips", "d_intervals"), "SELECT i.way_id, t.trip_id, i.start_m, i.end_m FROM d_intervals i LEFT JOIN (SELECT trip_id FROM d_trips WHERE status<>'pending') t ON t.trip_id=i.trip_id"),
    "trip_detail_fraction": (("d_intervals", "d_vertices"), f"""WITH l AS (SELECT *, lag(lat) OVER (PARTITION BY way_id ORDER BY i) AS plat, lag(lon) OVER (PARTITION BY way_id ORDER BY i) AS plon FROM d_vertices),
 w AS (SELECT way_id, sum({_HAV}) AS len FROM (SELECT way_id, {_A} AS a FROM l) h GROUP BY way_id),
 m AS (SELECT trip_id, way_id, sum(abs(end_m-start_m)) AS d FROM d_intervals GROUP BY trip_id, way_id)
 SELECT m.trip_id, count(*) AS n_ways, round(least(greatest(sum(d)/sum(len),0),1),6) AS fraction FROM m JOIN w ON w.way_id=m.way_id GROUP BY m.trip_id"""),
}

#: Ways with length, centroid and regions; union of intervals: parts of other queries' SQL.
WAYS = f"""l AS (SELECT *, lag(lat) OVER (PARTITION BY way_id ORDER BY i) AS plat, lag(lon) OVER (PARTITION BY way_id ORDER BY i) AS plon FROM d_vertices),
 w AS (SELECT way_id, sum({_HAV}) AS len, avg(lat) AS clat, avg(lon) AS clon FROM (SELECT way_id, lat, lon, {_A} AS a FROM l) h GROUP BY way_id),
 pip AS (SELECT w.way_id, e.level, e.region_id, e.ord FROM w CROSS JOIN d_region_edges e GROUP BY w.way_id, e.level, e.region_id, e.ord
 HAVING sum(CASE WHEN ((yi>clat) <> (yj>clat)) AND clon < (xj-xi)*(clat-yi)/((yj-yi)+1e-30)+xi THEN 1 ELSE 0 END)%2=1),
 att AS (SELECT way_id, level, min_by(region_id, ord) AS region_id FROM pip GROUP BY way_id, level)"""
UNION = """m AS (SELECT *, max(end_m) OVER (PARTITION BY way_id ORDER BY start_m,end_m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM d_intervals),
 g AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_m>pe THEN 1 ELSE 0 END) OVER (PARTITION BY way_id ORDER BY start_m,end_m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM m),
 u AS (SELECT way_id, isl, min(start_m) AS start_m, max(end_m) AS end_m FROM g GROUP BY way_id, isl)"""
