"""The driver's tables seen as the road-coverage domain: fixes, driven intervals, way vertices, region edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: SQL that Spark and DuckDB both take, over the tables' names.
VIEWS = {
    "d_fixes": """SELECT user_id AS trip_id, event_id AS seq, ts, CAST(49.5 AS DOUBLE)+CAST((user_id*37+event_id*13)%2000 AS DOUBLE)/10000 AS lat,
 CAST(9.0 AS DOUBLE)+CAST((user_id*53+event_id*29)%3000 AS DOUBLE)/10000 AS lon, CAST(3+event_id%40 AS DOUBLE) AS acc, value*2 AS speed_kmh FROM events""",
    "d_intervals": """SELECT l_partkey AS way_id, l_orderkey AS trip_id, CAST(l_discount*1000 AS DOUBLE) AS start_m, CAST(l_discount*1000+l_quantity AS DOUBLE) AS end_m, l_shipdate AS matched_at FROM lineitem""",
    "d_vertices": """SELECT way_id, p_size, i, CASE WHEN i=0 THEN r*1000+c+1 WHEN i=3 THEN (r+vert)*1000+(c+1-vert)+1 ELSE 10000000+way_id*10+i END AS node_id,
 CAST(49.5 AS DOUBLE)+CAST(r*3+vert*i AS DOUBLE)*4/3000 AS lat, CAST(9.0 AS DOUBLE)+CAST(c*3+(1-vert)*i AS DOUBLE)*6/3000 AS lon
 FROM (SELECT p_partkey AS way_id, p_size, p_partkey%2 AS vert, CAST(floor(CAST(p_partkey AS DOUBLE)/2) AS BIGINT)%45 AS r, CAST(floor(CAST(p_partkey AS DOUBLE)/90) AS BIGINT)%22 AS c FROM part) g
 CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) i""",
    "d_region_edges": """SELECT region_id, level, ord, CASE WHEN e<2 THEN y0 ELSE y1 END AS yi, CASE e WHEN 0 THEN xa WHEN 1 THEN xb WHEN 2 THEN xb+0.001 ELSE xa+0.001 END AS xi,
 CASE WHEN e=0 OR e=3 THEN y0 ELSE y1 END AS yj, CASE e WHEN 0 THEN xb WHEN 1 THEN xb+0.001 WHEN 2 THEN xa+0.001 ELSE xa END AS xj FROM
 (SELECT region_id, level, ord, CAST(49.5 AS DOUBLE)-0.0005+CAST(t AS DOUBLE)*0.037 AS y0, CAST(49.5 AS DOUBLE)-0.0005+CAST(t+1 AS DOUBLE)*0.037 AS y1,
 CAST(9.0 AS DOUBLE)-0.007+CAST(c0 AS DOUBLE)*0.029+CAST(t AS DOUBLE)*0.001 AS xa, CAST(9.0 AS DOUBLE)-0.007+CAST(c1 AS DOUBLE)*0.029+CAST(t AS DOUBLE)*0.001 AS xb FROM
 (SELECT 1000+n_nationkey AS region_id, 6 AS level, CAST(floor(CAST(n_nationkey AS DOUBLE)/5) AS BIGINT) AS t, n_nationkey%5 AS c0, n_nationkey%5+1 AS c1, n_nationkey AS ord FROM nation
 UNION ALL SELECT 2000+r_regionkey, 4, CAST(r_regionkey AS BIGINT), 0, 5, 100+r_regionkey FROM region) b) k CROSS JOIN (SELECT 0 AS e UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) q""",
    "d_stream": """SELECT device, seq, k, 1767225600000000+CAST(sum(step) OVER (PARTITION BY device ORDER BY seq) AS BIGINT) AS us, CAST(49.5 AS DOUBLE)+CAST(k*4+sum(jump) OVER (PARTITION BY device ORDER BY seq)*200 AS DOUBLE)/10000 AS lat,
 CAST(9.0 AS DOUBLE)+CAST(device%50 AS DOUBLE)/100 AS lon, CAST(3+seq%30 AS DOUBLE) AS acc, mps, CASE WHEN seq%5>0 THEN concat('u,', CAST(k-CASE WHEN seq%11=0 THEN 1 ELSE 0 END AS VARCHAR(20))) END AS uuid FROM
 (SELECT user_id AS device, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE WHEN event_id%26=5 THEN 1 ELSE 0 END AS jump,
 CASE event_id%13 WHEN 0 THEN 500000 WHEN 1 THEN 900000 WHEN 5 THEN 400000000 WHEN 6 THEN 300000000 ELSE 1000000*(1+event_id%20)+123456 END AS step,
 CASE WHEN event_id%4=0 THEN NULL WHEN event_id%9=0 THEN CAST(-1 AS DOUBLE) ELSE CAST(value AS DOUBLE) END AS mps FROM events) e""",
    "d_trips": """SELECT o_orderkey AS trip_id, o_custkey AS rider, CASE o_orderstatus WHEN 'F' THEN 'matched' WHEN 'O' THEN 'confirmed' ELSE 'pending' END AS status, o_orderdate AS started_at, o_totalprice AS distance_m FROM orders""",
}
_NEEDS = {"d_fixes": ["events"], "d_stream": ["events"], "d_intervals": ["lineitem"], "d_vertices": ["part"], "d_region_edges": ["nation", "region"], "d_trips": ["orders"]}


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame] | DataFrame:
    """Views or tables by name; only their own tables are opened. Names are registered for SQL text as well."""
    out = []
    for name in names:
        for table in _NEEDS.get(name, [name]):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        df = spark.sql(VIEWS[name]) if name in VIEWS else spark.table(name)
        if name in VIEWS:
            df.createOrReplaceTempView(name)
        out.append(df)
    return out[0] if len(out) == 1 else out


def oracle(sql: str) -> str:
    """The SQL with the views that it names put before it."""
    used = [f"{n} AS ({q})" for n, q in VIEWS.items() if n in sql]
    if not used:
        return sql
    if sql.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(used) + ", " + sql[15:]
    head = "WITH " + ", ".join(used)
    return f"{head}, {sql[5:]}" if sql.startswith("WITH ") else f"{head} {sql}"
