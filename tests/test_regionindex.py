import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import regionindex, regions

SCHEMA = "region_id long, level int, ord long, polygons array<array<array<struct<lat:double,lon:double>>>>"


def star(r, lat, lon, reach, n):
    """A ring that is neither convex nor small, closed."""
    pts = [(lat + math.sin(a) * d, lon + math.cos(a) * d) for a, d in ((2 * math.pi * k / n, reach * r.uniform(0.35, 1)) for k in range(n))]
    return [*pts, pts[0]]


def made(seed):
    r = random.Random(seed)
    out = []
    for k in range(6):
        lat, lon = r.uniform(-1, 1), r.uniform(-1, 1)
        whole = [star(r, lat, lon, r.uniform(0.05, 0.9), r.randint(5, 40))]
        hole = [star(r, lat, lon, 0.01 + 0.2 * (k % 2), 9)] if k % 3 else []
        polygons = [[*whole, *hole]] + ([[star(r, lat + 3, lon, 0.3, 7)]] if k == 2 else [])
        out.append((k, 4 + k % 2, k, polygons))
    out.append((9, 4, 9, [[[(0.0, 0.0), (0.0, 0.3), (0.2, 0.3), (0.2, 0.0), (0.0, 0.0)]]]))  # on the lines between cells
    return out


def inside(ring, lat, lon):
    c = False
    for (y, x), (v, u) in zip(ring, ring[1:]):
        if (y > lat) != (v > lat) and lon < (u - x) * (lat - y) / (v - y) + x:
            c = not c
    return c


def holds(polygons, lat, lon):
    return sum(inside(r, lat, lon) for p in polygons for r in p) % 2 == 1


def cells(spark, rows):
    return regionindex.region_cells(regionindex.edges_of(spark.createDataFrame(rows, SCHEMA)))


@pytest.mark.parametrize("seed", [1, 2])
def test_places_equal_the_even_odd_count(spark, seed):
    rows, r = made(seed), random.Random(seed + 10)
    places = [(i, r.uniform(-2, 4.5), r.uniform(-2, 2)) for i in range(3000)] + [(5000 + i, lat + r.uniform(-1e-3, 1e-3), lon + r.uniform(-1e-3, 1e-3)) for i, (lat, lon) in enumerate(p for _, _, _, ps in rows for poly in ps for ring in poly for p in ring)]
    got = {(x.id, x.region_id) for x in regionindex.located(spark.createDataFrame(places, "id long, lat double, lon double"), cells(spark, rows)).collect()}
    assert got == {(i, k) for i, lat, lon in places for k, _, _, p in rows if holds(p, lat, lon)} and len(got) > 300


def test_no_cell_holds_more_than_its_own_edges(spark):
    rows = made(1)
    c = cells(spark, rows).collect()
    for x in c:
        for e in x.ring:
            assert min(e.xi, e.xj) <= (x.cx + 1) * 0.1 + 1e-9 and max(e.xi, e.xj) >= x.cx * 0.1 - 1e-9 and min(e.yi, e.yj) <= (x.cy + 1) * 0.1 + 1e-9 and max(e.yi, e.yj) >= x.cy * 0.1 - 1e-9
    assert any(not x.ring for x in c) and len({(x.region_id, x.cy, x.cx) for x in c}) == len(c)
    assert cells(spark, []).count() == 0


def test_clipped_metres_equal_dense_sampling(spark):
    rows, r = made(2), random.Random(3)
    roads = [(w, 0, a := r.uniform(-1, 1), b := r.uniform(-1, 1), a + r.uniform(-0.6, 0.6), b + r.uniform(-0.6, 0.6)) for w in range(25)] + [(100, 0, 0.05, 0.05, 0.15, 0.05), (101, 0, 0.1, -0.1, 0.1, 0.5), (102, 0, 0.1, 0.1, 0.1, 0.1)]
    e = spark.createDataFrame(roads, "way_id long, i int, alat double, alon double, blat double, blon double")
    got = {(x.way_id, x.region_id): x.metres for x in regionindex.clipped_metres(e, cells(spark, rows)).collect()}
    whole = {x.way_id: x.m for x in e.select("way_id", geo.ellipsoid(*(F.col(c) for c in ("alat", "alon", "blat", "blon"))).alias("m")).collect()}
    n = 4000
    for w, _, a, b, c, d in roads:
        for k, _, _, p in rows:
            share = sum(holds(p, a + (c - a) * (i + 0.5) / n, b + (d - b) * (i + 0.5) / n) for i in range(n)) / n
            assert got.get((w, k), 0.0) == pytest.approx(share * whole[w], abs=whole[w] * 0.004 + 1e-6), (w, k)
    assert whole[102] == 0.0 and got[101, 9] == pytest.approx(whole[101] / 2, rel=1e-6)


def test_ellipsoidal_lengths_equal_published_values(spark):
    """A degree of latitude at the equator and at the pole, of longitude at the equator, and the flight from Flinders Peak to Buninyon (Vincenty's own example, 54,972.271 m on GRS 80)."""
    known = [(-0.5, 0, 0.5, 0, 110574.3), (89, 0, 90, 0, 111693.9), (44.5, 0, 45.5, 0, 111131.8), (0, 0, 0, 1, 111319.49), (-37.95103342, 144.42486789, -37.65282114, 143.92649553, 54972.271), (50, 9, 50, 9, 0.0)]
    got = spark.createDataFrame([(i, *map(float, k[:4])) for i, k in enumerate(known)], "i int, a double, b double, c double, d double").select("i", geo.ellipsoid(*map(F.col, "abcd")).alias("m")).orderBy("i").collect()
    for x, k in zip(got, known):
        assert x.m == pytest.approx(k[4], rel=1e-5)


def test_containing_keeps_the_first_region_of_a_level(spark):
    rows = [(k, level, order, p) for k, level, order, p in made(1)]
    found = spark.createDataFrame([(k, level, order, f"n{k}", None, p) for k, level, order, p in rows], "region_id long, level int, ord long, name string, name_de string, polygons array<array<array<struct<lat:double,lon:double>>>>")
    r = random.Random(4)
    places = [(i, r.uniform(-1, 1), r.uniform(-1, 1)) for i in range(500)]
    got = {(x.id, x.level): (x.region_id, x["name"]) for x in regions.containing(spark.createDataFrame(places, "id long, lat double, lon double"), found, "id").collect()}
    want = {}
    for i, lat, lon in places:
        for k, level, order, p in sorted(rows, key=lambda x: x[2]):
            if holds(p, lat, lon):
                want.setdefault((i, level), (k, f"n{k}"))
    assert got == want
