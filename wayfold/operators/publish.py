"""Changes of trips that carry over to coverage, each as one visible version of the tables in a store.

Tables: trips (trip_id, status, min_lat .. max_lon), points, intervals (way_id, trip_id, start_m, end_m), vertices and edges as in
wayfold.operators.coverage, coverage (level, region_id, n_ways, driven_m, total_m, pct).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots
from . import lifecycle
from .coverage import coverage_by_region, driven, point_in_region, way_geometry
from .regions import invalidated, probes

COVERAGE = ["level", "region_id", "n_ways", "driven_m", "total_m", "pct"]


def touched_regions(trips: DataFrame, chosen: DataFrame, edges: DataFrame) -> DataFrame:
    """(region_id): the regions of every level at the corners and the middle of the chosen trips' boxes; a trip without a box touches none."""
    boxes = trips.join(chosen.select("trip_id").distinct(), "trip_id", "left_semi").dropna(subset=["min_lat", "min_lon", "max_lat", "max_lon"])
    return point_in_region(probes(boxes, "trip_id"), edges, "probe").select("region_id").distinct()


def coverage_of(touched: DataFrame, intervals: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Coverage rows of the touched regions over all their ways; other regions' rings aren't looked at, but a way's first region of a level may be another's."""
    ways = way_geometry(vertices)
    mine = point_in_region(ways, edges, "way_id").join(touched, "region_id", "left_semi")
    rows = mine.join(ways, "way_id").join(driven(intervals), "way_id", "left")
    d, t = F.sum(F.coalesce("driven_m", F.lit(0.0))), F.sum("len_m")
    percent = F.round(F.least(F.greatest(d / t * 100, F.lit(0.0)), F.lit(100.0)), 4)
    return rows.groupBy("level", "region_id").agg(F.count("*").alias("n_ways"), F.round(d, 2).alias("driven_m"), F.round(t, 2).alias("total_m"), percent.alias("pct"))


def recompute(store: Snapshots) -> int:
    """All coverage anew: the old rows go and the new ones come in one version. Without a matched or confirmed trip that has a box it is emptied."""
    at = store.version()
    trips, edges = store.read("trips", at), store.read("edges", at)
    counted = trips.where(F.col("status").isin("matched", "confirmed"))
    if lifecycle.union_box(counted).first()["min_lat"] is None:
        rows = store.read("coverage", at).limit(0)
    else:
        rows = coverage_by_region(store.read("intervals", at), store.read("vertices", at), edges)
    return store.commit(replace={"coverage": rows.select(*COVERAGE)}, expect=at)


def confirm(store: Snapshots, chosen: DataFrame) -> int:
    """Chosen trips become confirmed, and the regions that they touch have their coverage deleted and computed anew: one version.

    A reader sees the old states with the old coverage or the new ones with the new, never a confirmed trip beside invalid rows.
    """
    at = store.version()
    trips, edges, cached = store.read("trips", at), store.read("edges", at), store.read("coverage", at)
    touched = touched_regions(trips, chosen, edges)
    again = coverage_of(touched, store.read("intervals", at), store.read("vertices", at), edges)
    now = trips.join(chosen.select("trip_id", F.lit(True).alias("_c")).distinct(), "trip_id", "left")
    flipped = now.withColumn("status", F.when(F.col("_c"), "confirmed").otherwise(F.col("status"))).select(*trips.columns)
    return store.commit(replace={"trips": flipped, "coverage": invalidated(cached, touched).select(*COVERAGE).unionByName(again.select(*COVERAGE))}, expect=at)


def discard(store: Snapshots, chosen: DataFrame) -> int:
    """Chosen trips go with their points and intervals, and the regions that they touched are computed without them: one version."""
    at = store.version()
    trips, edges, cached, intervals = (store.read(t, at) for t in ("trips", "edges", "coverage", "intervals"))
    touched = touched_regions(trips, chosen, edges)
    left, points, rest = lifecycle.discard(trips, store.read("points", at), intervals, chosen)
    again = coverage_of(touched, rest, store.read("vertices", at), edges)
    return store.commit(replace={"trips": left, "points": points.select(*store.read("points", at).columns), "intervals": rest.select(*intervals.columns), "coverage": invalidated(cached, touched).select(*COVERAGE).unionByName(again.select(*COVERAGE))}, expect=at)
