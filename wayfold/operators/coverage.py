"""Interval union, way lengths, attribution of ways to regions, and coverage by region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo
from .regionindex import located, region_cells


def interval_union(intervals: DataFrame) -> DataFrame:
    """(way_id, start_m, end_m) -> maximal covered intervals by way; touching ones merge. One shuffle, by way."""
    w = W.partitionBy("way_id").orderBy("start_m", "end_m")
    seen = F.max("end_m").over(w.rowsBetween(W.unboundedPreceding, -1))
    islands = intervals.select("way_id", "start_m", "end_m", F.when(seen.isNull() | (F.col("start_m") > seen), 1).otherwise(0).alias("new"))
    islands = islands.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy("way_id", "island").agg(F.min("start_m").alias("start_m"), F.max("end_m").alias("end_m"))


def driven(intervals: DataFrame) -> DataFrame:
    """Covered metres by way."""
    return interval_union(intervals).groupBy("way_id").agg(F.sum(F.col("end_m") - F.col("start_m")).alias("driven_m"), F.count("*").alias("parts"))


def way_geometry(vertices: DataFrame) -> DataFrame:
    """(way_id, i, lat, lon) -> great-circle length and mean vertex by way, without a window: vertices are gathered by way."""
    g = vertices.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("i", "lat", "lon"))).alias("v"))
    step = lambda k: geo.haversine(F.col("v")[k - 1]["lat"], F.col("v")[k - 1]["lon"], F.col("v")[k]["lat"], F.col("v")[k]["lon"])
    length = F.when(F.size("v") > 1, F.aggregate(F.sequence(F.lit(1), F.size("v") - 1), F.lit(0.0), lambda s, k: s + step(k))).otherwise(F.lit(0.0))
    mean = lambda c: F.aggregate("v", F.lit(0.0), lambda s, p: s + p[c]) / F.size("v")
    return g.select("way_id", length.alias("len_m"), mean("lat").alias("lat"), mean("lon").alias("lon"))


def point_in_region(points: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, lat, lon) with region edges (region_id, level, ord, xi..yj) -> (key, level, region_id), the first region of each level.

    A place looks into its own cell of the regions' index, in an equality join that partitions by place (and that Spark broadcasts by itself where the
    index is small); only edges in that cell are looked at.
    """
    found = located(points.select(key, "lat", "lon"), region_cells(edges))
    return found.groupBy(key, "level").agg(F.min_by("region_id", "ord").alias("region_id"))


def coverage_by_region(intervals: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Driven and total metres and percent by region of every level; undriven ways count in the total."""
    ways = way_geometry(vertices)
    rows = point_in_region(ways, edges, "way_id").join(ways, "way_id").join(driven(intervals), "way_id", "left")
    d, t = F.sum(F.coalesce("driven_m", F.lit(0.0))), F.sum("len_m")
    percent = F.round(F.least(F.greatest(d / t * 100, F.lit(0.0)), F.lit(100.0)), 4)
    return rows.groupBy("level", "region_id").agg(F.count("*").alias("n_ways"), F.round(d, 2).alias("driven_m"), F.round(t, 2).alias("total_m"), percent.alias("pct"))
