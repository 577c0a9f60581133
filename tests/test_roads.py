import datetime as dt
import itertools
import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from transports import body  # noqa: E402

from wayfold.functions import geo  # noqa: E402
from wayfold.operators import coverage, lifecycle, publish  # noqa: E402
from wayfold.sources import osm, roads, snapshots  # noqa: E402

OK = (200, body(1))
ANSWERS = {
    "ok": OK, "429": (429, ""), "500": (500, "x"), "599": (599, "x"), "404": (404, "no"), "html": (200, " <html>Gateway</html>"), "htmlmem": (200, "<p>out of memory</p>"), "remark": (200, '{"remark": "runtime error: timed out", "elements": []}'),
    "mem": (200, '{"remark": "query ran out of Memory"}'), "benign": (200, '{"remark": "fine", "elements": []}'), "timeout": TimeoutError(), "reset": ConnectionError("reset"),
}


def said(script, **how):
    asked, slept = [], []

    def transport(request, server, text, timeout):
        asked.append(server)
        a = ANSWERS[script[len(asked) - 1]]
        if isinstance(a, Exception):
            raise a
        return a

    return roads.post({}, "q", transport, sleep=slept.append, **how), asked, slept


def test_every_order_of_three_answers():
    """Against the rule told apart from the code: retry what may pass, at most three times, two servers, growing waits."""
    again = {"429", "500", "599", "html", "remark", "timeout", "reset"}
    for script in itertools.product(ANSWERS, repeat=3):
        n = next((i + 1 for i, a in enumerate(script) if a not in again), 3)
        last = script[n - 1]
        got, asked, slept = said(script)
        assert asked == ["primary", "primary", "fallback"][:n] and slept == [2, 5][: n - 1] and got["attempts"] == n and got["waited_s"] == sum(slept)
        assert got["outcome"] == ("ok" if last in ("ok", "benign") else "memory" if last in ("mem", "htmlmem") else "failed"), script
        assert (got["body"] is not None) == (got["outcome"] == "ok")
        assert (got["http_status"] is None) == (last in ("timeout", "reset"))
        assert said(script, fallback_first=True)[1] == ["fallback", "fallback", "primary"][:n]


def test_responses_are_judged_as_by_the_column(spark):
    rows = [(s, b) for s, b in (a for a in ANSWERS.values() if not isinstance(a, Exception))] + [(200, '  {"elements": [], "note": "memory"}'), (200, ""), (302, "<x>"), (600, ""), (200, '{"REMARK": "BUSY"}')]
    df = spark.createDataFrame(rows, "status int, body string")
    assert [r[0] for r in df.select(osm.response_class(F.col("status"), F.col("body"))).collect()] == [roads.judged(s, b) for s, b in rows]


def test_boxes_without_memory_are_cut_in_four():
    box = {"min_lat": 0.0, "min_lon": 0.0, "max_lat": 8.0, "max_lon": 8.0}

    def transport(request, server, text, timeout):
        side = request["max_lat"] - request["min_lat"]
        return ANSWERS["mem"] if side > limit else (200, body(9999, int(request["min_lat"] * 100 + request["min_lon"])))

    for limit, parts in ((8, 1), (4, 4), (2, 16), (1, 64)):
        got = roads.ask(box, roads.box_text, transport)
        assert (got["outcome"], got["parts"]) == ("ok", parts)
        ids = [e["id"] for e in json.loads(got["body"])["elements"]]
        assert len(ids) == len(set(ids)) and 9999 in ids and len(ids) == parts + 1
    limit = 0.5
    assert roads.ask(box, roads.box_text, transport)["outcome"] == "failed"


def test_requests_of_a_table(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None) for i in range(20)], "n int, extra string")

    def transport(request, server, text, timeout):
        return (200, text) if request["n"] % 5 else (418, "")

    out = roads.fetched(df, transport, workers=3, order=("n",), text_of=lambda r: f"t{r['n']} {r['extra']}", sleep=lambda s: None).collect()
    assert {(r.n, r.outcome, r.body) for r in out} == {(i, "ok", f"t{i} {'a' if i % 3 else None}") if i % 5 else (i, "failed", None) for i in range(20)}
    stopped = roads.fetched(df, transport, workers=1, order=("n",), stop_at_first=True, text_of=lambda r: "t").collect()
    assert [r.outcome for r in sorted(stopped)] == ["failed"] + ["skipped"] * 19
    assert roads.fetched(df.limit(0), transport).count() == 0


@pytest.fixture
def here(spark, monkeypatch):
    """Workers import the test's transports by name."""
    monkeypatch.syspath_prepend(str(Path(__file__).resolve().parent))
    spark.sparkContext.addPyFile(str(Path(__file__).resolve().parent / "transports.py"))


def test_data_source(spark, here):
    roads.register(spark)
    box = {"min_lat": 49.5, "min_lon": 9.0, "max_lat": 49.7, "max_lon": 9.3}
    read = lambda **o: spark.read.format("roads").options(wait="false", **{"transport": "transports:by_key"} | o).load()
    tiles = read(**{k: str(v) for k, v in box.items()})
    rows = {r.key: r for r in tiles.collect()}
    want = spark.range(1).select(F.explode(geo.box_tiles(*(F.lit(box[k]) for k in ("min_lat", "min_lon", "max_lat", "max_lon")), 12)).alias("t")).select("t.x", "t.y").collect() if hasattr(geo, "box_tiles") else None
    assert tiles.rdd.getNumPartitions() == 2 and len(rows) >= 12 and {r.outcome for r in rows.values()} == {"ok"}
    assert all((r.attempts, r.server) == ((3, "fallback") if int(k.split("/")[1]) % 2 else (1, "primary")) for k, r in rows.items())
    if want:
        assert set(rows) == {f"12/{t.x}/{t.y}" for t in want}
    levels = read(kind="boundaries", levels="4,6,8")
    assert levels.rdd.getNumPartitions() == 3 and all(f"^({k})$" in b for k, b in zip("468", sorted(r.body for r in levels.collect())))
    with pytest.raises(Exception, match="status 400"):
        read(**{k: str(v) for k, v in box.items()}, transport="transports:broken", on_error="raise").count()
    with pytest.raises(Exception, match="more tiles"):
        read(**{k: str(v) for k, v in box.items()}, most="3").count()


def test_tile_numbers_equal_the_columns(spark):
    places = [(49.5, 9.0), (-85.05, -180.0), (85.05, 179.999), (0.0, 0.0), (51.2, -0.1)]
    got = spark.createDataFrame(places, "lat double, lon double").select(geo.tile_x(F.col("lon"), 12), geo.tile_y(F.col("lat"), 12)).collect()
    assert [tuple(r) for r in got] == [roads.tile_numbers(a, b, 12) for a, b in places]


def test_read_through(spark, tmp_path, here):
    store, asked = roads.TileStore(spark, f"file://{tmp_path}/store"), tmp_path / "asked"
    asked.mkdir()
    now = dt.datetime(2026, 3, 1)

    def transport(request, server, text, timeout):
        (asked / f"{request['x']}-{request['attempt']}").touch()
        return (200, body(request["x"], request["x"] + 1000)) if request["x"] not in (4, 5) else (404, "")

    def wanted(attempt, *xs):
        return spark.createDataFrame([(12, x, 7, attempt) for x in xs], "z int, x long, y long, attempt int")

    packed = lambda rows: osm.gzip(spark.createDataFrame(rows, "z int, x long, y long, way_count int, fetched_at timestamp, body string"), "body")
    store.put(packed([(12, 0, 7, 1, now - dt.timedelta(days=29), "fresh"), (12, 1, 7, 1, now - dt.timedelta(days=31), "stale"), (12, 500, 7, 1, now, "far")]))
    at = F.lit(now)
    tiles, outcomes = store.read_through(wanted(1, 0, 1, 2), transport, at, cache_only=True)
    assert [r.x for r in tiles.collect()] == [0] and {(r.x, r.outcome) for r in outcomes.collect()} == {(0, "hit"), (1, "missing"), (2, "missing")} and not list(asked.iterdir())
    tiles, outcomes = store.read_through(wanted(2, 0, 1, 2, 4, 5, 6), transport, at, on_error="skip")
    assert {(r.x, r.outcome) for r in outcomes.collect()} == {(0, "hit"), (1, "fetched"), (2, "fetched"), (6, "fetched"), (4, "failed"), (5, "failed")}
    got = {r.x: (r.way_count, r.body) for r in osm.gunzip(tiles).collect()}
    assert set(got) == {0, 1, 2, 6} and got[0][1] == "fresh" and got[1] == (2, body(1, 1001))
    # the first failure by tile is raised, after what was fetched is published
    with pytest.raises(roads.RoadError, match="^12/4/7: status 404"):
        store.read_through(wanted(3, 3, 4, 5), transport, at, workers=1)
    assert not (asked / "5-3").exists()  # the worker stopped
    tiles, outcomes = store.read_through(wanted(4, 2, 3), transport, at)
    assert {r.outcome for r in outcomes.collect()} == {"hit"} and not (asked / "3-4").exists()
    # folders of far cells aren't read
    plan = store.get(wanted(5, 2))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters: [isnotnull(cell" in plan
    before = {r.x: bytes(r.payload_gzip) for r in store.get(wanted(6, 0, 1, 2, 3, 500)).collect()}
    store.compact()
    assert {r.x: bytes(r.payload_gzip) for r in store.get(wanted(6, 0, 1, 2, 3, 500)).collect()} == before and store.tables.read("tiles").count() == 6


def test_snapshots(spark, tmp_path):
    s = snapshots.Snapshots(spark, f"file://{tmp_path}/s")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v long")
    held = lambda t, n=None: sorted(r.v for r in s.read(t, n).collect())
    assert s.version() == 0 and s.manifest()["tables"] == {}
    s.commit(replace={"a": rows(1, 2), "b": rows()})
    s.commit(append={"a": rows(3)}, replace={"b": rows(9)})
    assert (held("a"), held("b"), held("a", 1), held("b", 1)) == ([1, 2, 3], [9], [1, 2], [])
    late = s.read("a")
    s.commit(replace={"a": s.read("a").where("v > 1")})  # from its own old rows
    assert sorted(r.v for r in late.collect()) == [1, 2, 3] and held("a") == [2, 3]
    with pytest.raises(snapshots.Conflict):
        s.commit(replace={"a": rows(0)}, expect=2)
    assert held("a") == [2, 3] and s.version() == 3
    s.forget(1)
    assert s.versions() == [3] and held("a") == [2, 3] and held("b") == [9]


def test_migrations_are_applied_once(spark, tmp_path):
    s, calls = snapshots.Snapshots(spark, f"file://{tmp_path}/m"), []
    s.commit(replace={"trips": spark.createDataFrame([(1, "matched"), (2, "recording")], "trip_id long, status string"), "intervals": spark.createDataFrame([(5, 1), (6, None)], "way_id long, trip_id long")})

    def again(store):
        calls.append(1)
        if len(calls) == 1:  # another writer comes between
            store.commit(append={"trips": spark.createDataFrame([(3, "confirmed")], "trip_id long, status string")})
        return dict(zip(("trips", "intervals"), lifecycle.rematch(store.read("trips"), store.read("intervals"))))

    def fails(store):
        raise ValueError

    with pytest.raises(ValueError):
        snapshots.migrate(s, [("again", again), ("fails", fails)])
    assert snapshots.migrate(s, [("again", again)]) == [] and len(calls) == 2
    assert {(r.trip_id, r.status) for r in s.read("trips").collect()} == {(1, "pending"), (2, "recording"), (3, "pending")} and [r.way_id for r in s.read("intervals").collect()] == [6]
    assert s.manifest()["notes"]["migrations"] == ["again"]


def square(region, level, order, a, b, side):
    p = [(a, b), (a, b + side), (a + side, b + side), (a + side, b)]
    return [(region, level, order, p[i][0], p[i][1], p[(i + 1) % 4][0], p[(i + 1) % 4][1]) for i in range(4)]


def test_confirm_is_one_visible_change(spark, tmp_path):
    s = snapshots.Snapshots(spark, f"file://{tmp_path}/c")
    edges = spark.createDataFrame(square(10, 4, 0, 0.0, 0.0, 1.0) + square(11, 4, 1, 2.0, 0.0, 1.0), "region_id long, level int, ord long, yi double, xi double, yj double, xj double")
    vertices = spark.createDataFrame([(w, i, lat, 0.2 + i * 0.01) for w, lat in ((1, 0.5), (2, 0.6), (3, 2.5)) for i in range(2)], "way_id long, i int, lat double, lon double")
    trips = spark.createDataFrame([(1, "matched", 0.4, 0.1, 0.7, 0.3), (2, "confirmed", 2.4, 0.1, 2.6, 0.3), (3, "recording", None, None, None, None)], "trip_id long, status string, min_lat double, min_lon double, max_lat double, max_lon double")
    intervals = spark.createDataFrame([(1, 1, 0.0, 100.0), (3, 2, 0.0, 200.0)], "way_id long, trip_id long, start_m double, end_m double")
    points = spark.createDataFrame([(1, 0), (2, 0)], "trip_id long, seq int")
    empty = coverage.coverage_by_region(intervals, vertices, edges).limit(0)
    s.commit(replace={"trips": trips, "points": points, "intervals": intervals, "vertices": vertices, "edges": edges, "coverage": empty})
    publish.recompute(s)
    of = lambda v=None: {r.region_id: r.driven_m for r in s.read("coverage", v).collect()}
    assert of() == {10: 100.0, 11: 200.0}
    s.commit(append={"intervals": spark.createDataFrame([(2, 1, 0.0, 50.0), (3, 9, 300.0, 400.0)], "way_id long, trip_id long, start_m double, end_m double")})
    before = s.version()
    seen = s.read("trips", before), s.read("coverage", before)
    after = publish.confirm(s, spark.createDataFrame([(1,)], "trip_id long"))
    assert after == before + 1
    # only the touched region is computed anew; the other's row stays as it was, though its interval is newer
    assert of() == {10: 150.0, 11: 200.0} and {r.trip_id: r.status for r in s.read("trips").collect()} == {1: "confirmed", 2: "confirmed", 3: "recording"}
    assert {r.trip_id: r.status for r in seen[0].collect()}[1] == "matched" and {r.region_id: r.driven_m for r in seen[1].collect()} == {10: 100.0, 11: 200.0}
    publish.discard(s, spark.createDataFrame([(1,)], "trip_id long"))
    assert of() == {10: 0.0, 11: 200.0} and sorted(r.trip_id for r in s.read("intervals").collect()) == [2, 9] and [r.trip_id for r in s.read("points").collect()] == [2]
    publish.recompute(s)
    assert of() == {10: 0.0, 11: 300.0}
    s.commit(replace={"trips": s.read("trips").where("status = 'recording'")})
    publish.recompute(s)
    assert of() == {}


def test_responses_hold_one_body_at_a_time(spark, tmp_path):
    """A body has all elements of its key, none where they are null; tiles are gathered without lists or a broadcast of ways' tags in the JVM; texts leave Python in portions."""
    from wayfold.plans import domain

    rows = spark.range(4000).selectExpr("CASE WHEN id % 7 < 6 THEN id % 7 END AS k", "CASE WHEN id % 7 <> 3 THEN CAST(id AS STRING) END AS element")
    got = {x.k: sorted(json.loads(x.body)["e"]) for x in osm.responses(rows, "k", '{"e":[', "]}").collect()}
    assert got == {None if k == 6 else k: [] if k == 3 else list(range(k, 4000, 7)) for k in range(7)}
    plan = domain._responses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow bodies" in plan and "collect_list(struct(type" not in plan
    assert "BroadcastHashJoin [way_id" not in plan
    assert [(n, len(x)) for n, x in osm._portions(["x" * (osm.PORTION // 2)] * 5 + [None])] == [(0, 2), (2, 2), (4, 2)]
