"""Operators whose work must not grow with copies: roads and fixes that lie alike."""

from pyspark.sql import functions as F

from wayfold.operators import matching


def _copies(spark, n):
    """n ways with the very same three segments between two shared nodes, and one way that goes on from there."""
    v = spark.range(1, n + 1).select(F.col("id").alias("way_id"), F.explode(F.expr("sequence(0, 3)")).alias("i"))
    node = F.when(F.col("i") == 0, F.lit(-1)).when(F.col("i") == 3, F.lit(-2)).otherwise(F.col("way_id") * 10 + F.col("i")).cast("long")
    v = v.select("way_id", "i", node.alias("node_id"), F.lit(50.0).alias("lat"), (F.lit(9.0) + F.col("i") * 0.001).alias("lon"))
    on = spark.createDataFrame([(9000, 0, -2, 50.0, 9.003), (9000, 1, -3, 50.0, 9.004)], "way_id long, i int, node_id long, lat double, lon double")
    return v.union(on).withColumns({"highway": F.lit("residential"), "oneway": F.lit(0)})


def _fixes(spark):
    rows = [(1, k, 50.00001, 9.0005 + k * 0.001, 10.0, 30.0, k) for k in range(4)]
    return spark.createDataFrame(rows, "trip_id long, seq long, lat double, lon double, acc double, speed_kmh double, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")


def test_copies_of_a_segment_do_not_meet_fixes(spark):
    segs = matching.segments(_copies(spark, 300))
    near = matching.candidates(_fixes(spark), segs)
    assert {(r.seq, r.cand_rank, r.way_id) for r in near.where("seq < 2").collect()} == {(s, k, k) for s in (0, 1) for k in range(1, 6)}
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert "alat" in below and "WindowGroupLimit" in below  # copies are left out before the join


def test_corridor_counts_ways_without_a_row_for_each(spark):
    segs = matching.segments(_copies(spark, 40))
    got = [tuple(r) for r in matching.corridor_counts(_fixes(spark), segs).collect()]
    assert got == [(1, matching.corridor(_fixes(spark), segs).count())] == [(1, 41)]


def test_equal_ways_are_one_link(spark):
    rows = {r.way_id: r.links for r in matching.links(matching.segments(_copies(spark, 30))).collect()}
    assert len({str(rows[k]) for k in range(1, 31)}) == 1 and [(x.u, x.v, len(x.lens)) for x in rows[1]] == [(-1, -2, 3)]


def test_routes_over_links_equal_routes_over_segments():
    """Searches begin and end at inner nodes, on one link, on equal ones and on a loop."""
    import random

    rng = random.Random(3)
    for _ in range(60):
        found, plain, free = [], {}, 100
        for _ in range(rng.randint(2, 9)):
            u, v = rng.randrange(5), rng.randrange(5)
            lens = tuple(rng.choice((1.1, 2.3, 0.7)) for _ in range(rng.randint(1, 4)))
            nodes = tuple(range(free, free + len(lens) - 1))
            free += len(nodes)
            found.append((u, v, lens, nodes))
            for a, b, x in zip((u, *nodes), (*nodes, v), lens, strict=True):
                plain.setdefault(a, []).append((b, x))
                plain.setdefault(b, []).append((a, x))
        roads, single = matching.Roads(found), matching.Roads.plain(plain)
        for a in plain:
            for b in plain:
                assert roads.metres(a, b, 1e9) == single.metres(a, b, 1e9)


def test_equal_places_share_one_search():
    roads = matching.Roads([(1, 2, (5.0, 5.0), (10 + k,)) for k in range(50)])
    assert {roads.metres(10 + k, 2, 100.0) for k in range(50)} == {5.0} and len(roads.searches) == 1 and len(roads.graph[1]) == 1


def test_clip_queries_take_all_driven_ways(spark):
    from wayfold.plans import registry

    for name in ("clip_stretches", "clip_driven_ways"):
        left = {r.way_id % 5 for r in registry.queries()[name](spark, "/root/testdata/sf0.001").select("way_id").distinct().collect()}
        assert left == {0, 1, 2, 3, 4} and "%5" not in registry.oracle_sql()[name].split("d_region_edges")[0].split("en AS")[1]


def test_regions_of_all_trips_are_affected(spark):
    from wayfold.plans import domain

    d = "/root/testdata/sf0.001"
    touched = {r.region_id for r in domain._touched(spark, d)[0].collect()}
    kept = {r.region_id for r in domain.invalidate_regions(spark, d).collect()}
    assert len(touched) == 10 and not touched & kept and "min(trip_id)" not in domain.ORACLES["affected_regions"] + domain.ORACLES["invalidate_regions"]


def test_places_on_a_border_fall_as_the_even_odd_test_lets_them(spark):
    """Places that lie on slanting borders up to rounding, in cells of their own corners, against the test over all edges."""
    import random

    from wayfold.operators import regionindex

    rng, edges, places = random.Random(11), [], []
    for t in range(4):
        for c in range(4):
            y0, y1, xa, xb = 49.4995 + t * 0.037, 49.4995 + (t + 1) * 0.037, 8.993 + c * 0.029 + t * 0.001, 8.993 + (c + 1) * 0.029 + t * 0.001
            p = [(xa, y0), (xb, y0), (xb + 0.001, y1), (xa + 0.001, y1)]
            edges += [(t * 4 + c, 6, t * 4 + c, *p[k], *p[(k + 1) % 4]) for k in range(4)]
    for k in range(3000):
        _, _, _, xi, yi, xj, yj = rng.choice(edges)
        u = rng.random()
        places.append((k, yi + (yj - yi) * u, xi + (xj - xi) * u))
    e = spark.createDataFrame(edges, "region_id int, level int, ord int, xi double, yi double, xj double, yj double")
    got = {(r.id, r.region_id) for r in regionindex.located(spark.createDataFrame(places, "id int, lat double, lon double"), regionindex.region_cells(e)).collect()}
    odd: dict = {}
    for k, lat, lon in places:
        for r, _, _, xi, yi, xj, yj in edges:
            if (yi > lat) != (yj > lat) and lon < (xj - xi) * (lat - yi) / ((yj - yi) + 1e-30) + xi:
                odd[k, r] = odd.get((k, r), 0) + 1
    assert got == {x for x, n in odd.items() if n % 2}


def test_synthetic_ways_hold_no_table_of_ways_in_a_task(spark):
    from wayfold.plans import registry

    df = registry.queries()["synthetic_ways"](spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() == 25 * 200 and df.where("n_points <> 4").count() == 0 and dict(df.dtypes)["n_points"] == "bigint"


def test_tile_store_writes_few_folders_for_many_cells(spark, tmp_path):
    from wayfold.sources import roads

    store = roads.TileStore(spark, f"file://{tmp_path}/tiles")
    tiles = spark.range(300).select(F.lit(12).alias("z"), (F.col("id") * 64).alias("x"), F.col("id").alias("y"), F.lit(b"x").alias("payload_gzip"), F.lit(1).alias("way_count"), F.timestamp_seconds(F.lit(0)).alias("fetched_at"))
    store.put(tiles)
    assert 1 < len(list(tmp_path.glob("tiles/tiles/*/cell=*"))) <= roads.FOLDERS
    assert store.get(tiles.select("z", "x", "y")).count() == 300


def test_runs_sort_once(spark):
    rows = [(1, k, w, float(k)) for k, w in enumerate([None, 7, 7, 7, 8, None, None, 8, 9, 9, 7])]
    found = matching.runs(spark.createDataFrame(rows, "trip_id long, seq long, way_id long, m double"))
    got = {tuple(r) for r in found.select("way_id", "start_m", "end_m", "entry", "exit").collect()}
    assert got == {(7, 1.0, 3.0, None, 8), (8, 4.0, 4.0, 7, None), (8, 7.0, 7.0, None, 9), (9, 8.0, 9.0, 8, 7), (7, 10.0, 10.0, 9, None)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "HashAggregate" not in plan


def test_pieces_beside_a_border_are_not_cut(spark):
    from wayfold.operators import regionindex

    ring = [(0.02, 0.06, 0.08, 0.06), (0.08, 0.06, 0.08, 0.09), (0.08, 0.09, 0.02, 0.09), (0.02, 0.09, 0.02, 0.06)]
    e = spark.createDataFrame([(1, 6, 1, *r) for r in ring], "region_id long, level int, ord long, xi double, yi double, xj double, yj double")
    roads = [(1, 0, 0.07, 0.03, 0.07, 0.05), (2, 0, 0.07, 0.0, 0.07, 0.01), (3, 0, 0.01, 0.03, 0.02, 0.09), (4, 0, 0.05, 0.05, 0.07, 0.05)]
    found = regionindex.clipped_metres(spark.createDataFrame(roads, "way_id long, i int, alat double, alon double, blat double, blon double"), regionindex.region_cells(e), lambda a, b, c, d: F.hypot(c - a, d - b))
    assert {r.way_id: round(r.metres, 9) for r in found.collect()} == {1: 0.02, 4: 0.01}
    assert "y1" in found._jdf.queryExecution().optimizedPlan().toString()
