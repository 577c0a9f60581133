import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as engine
from wayfold.operators import coverage, lifecycle, matching, regions, rings
from wayfold.plans import registry
from wayfold.sources import sinks, tables
from wayfold.streaming import ingest, trips

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "as_tuple"):
        v = float(v)
    return repr(round(float(v), 3)) if isinstance(v, (int, float)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = sorted(tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect())
    r = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(df.columns) == sorted(names)
    assert got == sorted(tuple(plain(row[i]) for i in order) for row in r.fetchall())


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in registry.oracle_sql()])
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert engine.entry(spark).count() == 10


@pytest.mark.parametrize("given, merged", [
    ([(0, 5)], [(0, 5)]), ([(0, 5), (5, 9)], [(0, 9)]), ([(0, 9), (2, 3), (12, 14)], [(0, 9), (12, 14)]), ([(7, 8), (0, 1), (0.5, 2)], [(0, 2), (7, 8)]), ([], [])])
def test_interval_union(spark, given, merged):
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in given], "way_id long, start_m double, end_m double")
    assert sorted((r.start_m, r.end_m) for r in coverage.interval_union(df).collect()) == merged


def straight(spark, ways):
    rows = [(w, i, n, 49.7, 9.0 + x / 10000) for w, nodes in ways.items() for i, (n, x) in enumerate(nodes)]
    return spark.createDataFrame(rows, "way_id long, i int, node_id long, lat double, lon double")


def trace(spark, places, speed=60.0, gap=1):
    t = pd.Timestamp("2026-07-08 10:00:00")
    rows = [(7, i, (t + pd.Timedelta(seconds=i * gap)).to_pydatetime(), lat, lon, 5.0, speed) for i, (lat, lon) in enumerate(places)]
    return spark.createDataFrame(rows, "trip_id long, seq long, ts timestamp, lat double, lon double, acc double, speed_kmh double")


def match(fixes, vertices):
    segs = matching.segments(vertices)
    if "oneway" not in segs.columns:
        segs = segs.withColumn("oneway", F.lit(0))
    near = matching.subtracks(matching.candidates(fixes, segs), fixes)
    steps = matching.viterbi_steps(near, segs, fixes)
    return sorted((r.start_m, r.way_id, r.end_m, r.direction) for r in matching.driven_intervals(steps, near, fixes, vertices).collect()), steps, near


def test_straight_trip_matches_forward(spark):
    v = straight(spark, {1: [(1, 0), (2, 5), (3, 10), (4, 20)]})
    got, steps, near = match(trace(spark, [(49.7, 9.0 + x / 10000) for x in (0, 2, 4, 6, 10)]), v)
    assert [(w, d) for _, w, _, d in got] == [(1, "forward")]
    assert got[0][0] == pytest.approx(0) and got[0][2] == pytest.approx(72, abs=0.5)


def test_route_over_a_way_without_fixes(spark):
    """Sparse fixes on ways 1 and 3: way 2 between them has none, but the route leads over it, so the chain doesn't restart."""
    v = straight(spark, {1: [(1, 0), (2, 20)], 2: [(2, 20), (3, 40)], 3: [(3, 40), (4, 60)]})
    fixes = trace(spark, [(49.7, 9.0010), (49.7, 9.0050)], gap=20)
    got, steps, near = match(fixes, v)
    assert {w for _, w, _, _ in got} == {1, 3} and matching.corridor(fixes, matching.segments(v)).count() == 3


def test_unmatched_fix_breaks_run_and_track(spark):
    v = straight(spark, {1: [(1, 0), (2, 40)]})
    fixes = trace(spark, [(49.7, 9.0002), (49.7, 9.0006), (49.75, 9.0010), (49.7, 9.0020), (49.7, 9.0026)])
    got, steps, near = match(fixes, v)
    assert len(got) == 2 and steps.select("track").distinct().count() == 2
    assert {r.trip_id: (r.n, r.matched, r.dropped) for r in matching.result_counters(steps, fixes).collect()} == {7: (5, 4, 1)}


def test_slow_fix_on_a_motorway_is_penalised(spark):
    v = straight(spark, {1: [(1, 0), (2, 40)]}).withColumn("highway", F.lit("motorway"))
    fast, slow = (matching.candidates(trace(spark, [(49.7, 9.001)], speed=s), matching.segments(v)).first().emit for s in (20.0, 10.0))
    assert fast - slow == pytest.approx(math.log(1e6))


def test_pass_through_draws_connectors_whole(spark):
    v = straight(spark, {1: [(1, 0), (2, 10)], 2: [(2, 10), (3, 13)], 3: [(3, 13), (4, 30)], 4: [(2, 10), (9, 5)]})
    run = "trip_id long, run long, way_id long, start_m double, end_m double, direction string, entry long, exit long"
    rows = [(1, 1, 2, 5.0, 6.0, "forward", 1, 3), (2, 1, 2, 5.0, 6.0, "forward", 1, 4), (3, 1, 2, 5.0, 6.0, "forward", 1, 1), (4, 1, 2, 5.0, 6.0, "forward", None, 3)]
    for named in (True, False):
        w = v if named else v.withColumn("node_id", F.lit(None).cast("long"))
        out = {r.trip_id: (r.start_m, r.end_m) for r in matching.pass_through(spark.createDataFrame(rows, run), w).collect()}
        assert out[1][0] == 0 and out[1][1] == pytest.approx(21.6, abs=0.1)
        assert out[2] == out[3] == out[4] == (5.0, 6.0)


def test_rings(spark):
    square = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
    parts = [square[:2], square[2:][::-1], square[1:3]]
    (ring,) = rings.stitched(parts)
    assert len(ring) == 5 and set(ring) == set(square)
    assert rings.stitched([[(0.0, 0.0), (1.0, 1.0)], square]) == [square]
    wavy = [(0.0, 0.0), (0.00001, 2.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
    assert rings.simplified(wavy, 100.0) == [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
    assert rings.label_point(square) == pytest.approx((2.0, 2.0), abs=0.001)
    lshape = [(0.0, 0.0), (0.0, 9.0), (1.0, 9.0), (1.0, 1.0), (9.0, 1.0), (9.0, 0.0), (0.0, 0.0)]
    assert rings.inside(rings.label_point(lshape), lshape)
    hole = [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0), (1.0, 1.0)]
    shapes = spark.createDataFrame([(1, 4, 0, [[square]]), (2, 4, 1, [[square, hole]])], "region_id long, level int, ord long, polygons array<array<array<struct<lat:double,lon:double>>>>")
    road = spark.createDataFrame([(9, 0, 2.0, -1.0, 2.0, 5.0)], "way_id long, i int, alat double, alon double, blat double, blon double")
    metres = {r.region_id: r.metres for r in rings.clipped_lengths(road, shapes).collect()}
    assert metres[2] == pytest.approx(metres[1] / 2, rel=1e-3)


def test_relations_are_assembled(spark):
    body = '{"elements":[{"id":5,"tags":{"name":"A","admin_level":"8"},"members":[{"type":"way","role":"outer","geometry":[{"lat":0,"lon":0},{"lat":0,"lon":4},{"lat":4,"lon":4}]},{"type":"way","role":"outer","geometry":[{"lat":4,"lon":4},{"lat":4,"lon":0},{"lat":0,"lon":0}]},{"type":"way","role":"inner","geometry":[{"lat":1,"lon":1},{"lat":1,"lon":2},{"lat":2,"lon":2},{"lat":1,"lon":1}]},{"type":"way","role":"inner","geometry":[{"lat":7,"lon":7},{"lat":7,"lon":8},{"lat":8,"lon":8},{"lat":7,"lon":7}]}]},{"id":6,"tags":{"name":"B","admin_level":"3"},"members":[]}]}'
    (r,) = rings.assembled(tables.relation_members(spark.createDataFrame([(body,)], "body string"))).collect()
    assert (r.region_id, r.level, len(r.polygons), len(r.polygons[0])) == (5, 8, 1, 2)


def test_holes_and_short_rings(spark):
    body = '{"features":[{"properties":{"osm_id":1,"admin_level":8,"name":"A","name:de":"Ä"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]]}},{"properties":{"osm_id":2,"admin_level":8,"name":"B"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,1],[0,0]]]}},{"properties":{},"geometry":null}]}'
    r = tables.regions(spark.createDataFrame([(body,), ("junk",)], "body string"))
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 9.0, 9.0)], "k long, lat double, lon double")
    assert [(x.k, x.region_id, x.name_de) for x in regions.containing(points, r, "k").collect()] == [(1, 1, "Ä")]


def test_stops_and_stream_equal(spark, tmp_path):
    t = pd.Timestamp("2026-01-01 08:00:00")
    rows = [(1, 0, "in_vehicle", 0.0), (1, 60, "still", 0.0), (1, 200, "still", 0.0), (1, 300, "in_vehicle", 0.001), (1, 400, "walking", 0.001), (1, 2000, "still", 0.001), (2, 0, "still", 0.0), (2, 100, "in_vehicle", 0.0), (2, 3000, "in_vehicle", 0.0)]
    f = pd.DataFrame([{"device": d, "ts": t + pd.Timedelta(seconds=s), "activity": a, "lat": 50.0, "lon": 9 + x, "manual": False} for d, s, a, x in rows])
    schema = "device long, ts timestamp, activity string, lat double, lon double, manual boolean"
    df = spark.createDataFrame(f, schema)
    base = t.timestamp()
    batch = sorted((r.device, round(r.ts - base), r.event) for r in trips.stops(df).collect())
    assert batch == [(1, 180, "paused"), (1, 300, "resumed"), (1, 520, "paused"), (1, 1420, "stopped")]
    assert trips.stops(df.withColumn("manual", F.lit(True))).count() == 0
    for k, part in enumerate((f[:4], f[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    q = trips.stops_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")).writeStream.format("memory").queryName("stopped").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.device, round(r.ts - base), r.event) for r in spark.table("stopped").collect()) == batch


def test_summary_of_a_trip_with_a_gap(spark):
    schema = "device long, session long, seq long, ts timestamp, lat double, lon double, speed_kmh double, outcome string"
    t = pd.Timestamp("2026-01-01 08:00:00")
    at = lambda s: (t + pd.Timedelta(seconds=s)).to_pydatetime()
    rows = [(1, 0, 0, at(0), 50.0, 9.0, 10.0, "accepted"), (1, 0, 1, at(40), 50.0, 9.01, 30.0, "accepted"), (1, 0, 2, at(440.5), 50.01, 9.01, 20.0, "gap"), (2, 0, 0, at(0), 50.0, 9.0, 5.0, "accepted")]
    out = {r.device: r for r in trips.summaries(spark.createDataFrame(rows, schema)).collect()}
    assert (out[1].duration_s, out[1].max_kmh, out[1].keeper, out[1].point_count) == (440 - 399, 30.0, False, 3) and not out[2].keeper


def test_snapshot_and_fixture(spark, tmp_path):
    one = spark.createDataFrame([(1, "a")], "trip_id long, x string")
    all_tables = {t: one for t in sinks.TABLES}
    sinks.backup(all_tables, f"{tmp_path}/b")
    assert sinks.validate(spark, f"{tmp_path}/b") is None and sinks.validate(spark, f"{tmp_path}/none") == "no manifest"
    sinks.restore(spark, f"{tmp_path}/b", f"{tmp_path}/live")
    sinks.restore(spark, f"{tmp_path}/b", f"{tmp_path}/live")
    assert spark.read.parquet(f"{tmp_path}/live/trips").count() == spark.read.parquet(f"{tmp_path}/live-before/trips").count() == 1
    sinks.backup(all_tables, f"{tmp_path}/v", version=9)
    assert sinks.validate(spark, f"{tmp_path}/v") == "version 9"
    trip, expected = trace(spark, [(49.7, 9.0)]), spark.createDataFrame([(0, 1, "forward")], "ord int, way_id long, direction string")
    sinks.golden_fixture(trip, one, expected, str(tmp_path), "002_two")
    assert spark.read.json(f"{tmp_path}/002_two/expected_ways").first().asDict() == {"wayId": 1, "direction": "forward"}
    with pytest.raises(ValueError):
        sinks.golden_fixture(trip, one, expected, str(tmp_path), "bad")
    assert tables.first_existing(spark, f"{tmp_path}/none", f"{tmp_path}/002_two") == f"{tmp_path}/002_two"


def test_trip_is_closed_or_dropped(spark):
    schema = "trip_id long, status string, ended_at timestamp, duration_s long, distance_m double, avg_kmh double, max_kmh double, start_lat double, start_lon double, end_lat double, end_lon double, point_count long"
    t = spark.createDataFrame([(k, s, *[None] * 10) for k, s in ((1, "recording"), (2, "recording"), (3, "matched"), (4, "recording"))], schema)
    p = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 3.0, 4.0), (3, 0, 5.0, 6.0)], "trip_id long, seq long, lat double, lon double")
    s = spark.createDataFrame([(1, True, pd.Timestamp("2026-01-01").to_pydatetime(), 60, 100.0, 6.0, 9.0), (2, False, None, 1, 1.0, 1.0, 1.0)], "trip_id long, keeper boolean, ended_at timestamp, duration_s long, distance_m double, avg_kmh double, max_kmh double")
    out = {r.trip_id: r for r in lifecycle.close_trips(t, p, s).collect()}
    assert set(out) == {1, 3, 4} and out[1].status == "pendingRoadData" and (out[1].start_lat, out[1].end_lon, out[1].point_count) == (1.0, 4.0, 2) and out[4].status == "recording"
    assert {r.trip_id: r.start_lat for r in lifecycle.backfill_ends(t, p).collect()} == {1: 1.0, 2: None, 3: 5.0, 4: None}
    left, kids = lifecycle.without(t, p, t.where("trip_id = 1"), "trip_id", cascade=False)
    assert left.count() == 3 and sorted(str(r.trip_id) for r in kids.collect()) == ["3", "None", "None"]


def test_debounce_keeps_the_last_of_a_burst(spark):
    at = lambda ms: (pd.Timestamp("2026-01-01") + pd.Timedelta(milliseconds=ms)).to_pydatetime()
    r = spark.createDataFrame([(1, at(0), 1), (1, at(100), 2), (1, at(200), 3), (1, at(900), 4)], "k long, ts timestamp, request long")
    assert sorted(x.request for x in lifecycle.latest(r, "k").collect()) == [3, 4]


def fixes_frame():
    t = pd.Timestamp("2026-01-01 08:00:00")
    rows = [(0, 0, 0.0, 5, "a"), (1, 0.5, 0.0001, 5, "b"), (2, 5, 0.0002, 30, "c"), (3, 6, 0.0002, 5, "a"), (4, 7, 0.0003, 5, "d"), (5, 400, 0.0004, 5, "e"), (6, 900, 0.1, 5, "f")]
    return pd.DataFrame([{"device": 1, "seq": s, "ts": t + pd.Timedelta(seconds=dt), "lat": 50.0, "lon": 9 + x, "acc": float(acc), "speed_mps": 10.0, "uuid": u} for s, dt, x, acc, u in rows])


def test_ingest_rules_and_stream_equal_batch(spark, tmp_path):
    schema = "device long, seq long, ts timestamp, lat double, lon double, acc double, speed_mps double, uuid string"
    f = fixes_frame()
    df = spark.createDataFrame(f, schema)
    batch = {r.seq: (r.outcome, r.reason, r.session) for r in ingest.ingest_batch(df).collect()}
    assert batch == {0: ("accepted", None, 0), 1: ("rejected", "rate_limit", 0), 2: ("rejected", "accuracy", 0), 3: ("rejected", "duplicate", 0), 4: ("accepted", None, 0), 5: ("gap", None, 0), 6: ("split", None, 1)}
    for k, part in enumerate((f[:3], f[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = ingest.ingest_stream(source).writeStream.format("memory").queryName("outcomes").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r.seq: (r.outcome, r.reason, r.session) for r in spark.table("outcomes").collect()} == batch
