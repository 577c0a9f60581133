"""Queries of single rules by the engine's operators; the SQL of relational.py, written on its own, is their check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import lifecycle, matching, overlay, readmodels
from ..sources import osm
from ..sources.views import load
from ..streaming.ingest import ACCURACY

FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _rule(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    FOUND[f.__name__] = f
    return f


@_rule
def accuracy_filter(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "d_fixes").groupBy("trip_id").agg(F.count("*").alias("n"), F.count_if(F.col("acc") <= ACCURACY).alias("n_ok"))


@_rule
def tile_histogram(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "d_fixes").groupBy(geo.tile_x(F.col("lon")).alias("x"), geo.tile_y(F.col("lat")).alias("y")).agg(F.count("*").alias("n"))


@_rule
def endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Ends as trips that are closed get them from their points."""
    p = load(spark, d, "d_fixes")
    none = {c: F.lit(None).cast("double") for c in ("start_lat", "start_lon", "end_lat", "end_lon")}
    t = p.groupBy("trip_id").agg(F.count("*").alias("point_count")).withColumns(none)
    return lifecycle.backfill_ends(t, p).select("trip_id", *none, "point_count")


@_rule
def adaptive_radius(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "d_fixes").select("trip_id", "seq", geo.search_radius(F.col("acc")).alias("radius"))


@_rule
def surrogate_node_key(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "d_vertices").select("way_id", "i", matching.node_key(F.col("lat"), F.col("lon")).alias("node_key"))


@_rule
def junction_sharing(spark: SparkSession, d: str) -> DataFrame:
    return overlay.junctions(load(spark, d, "d_vertices"))


@_rule
def oneway_normalise(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "part")
    rows = spark.sql("SELECT p_partkey AS way_id, CASE p_size%7 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' WHEN 3 THEN 'reverse' WHEN 4 THEN '1' WHEN 5 THEN '0' ELSE '' END AS tag, CASE p_partkey%3 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk_link' ELSE 'primary' END AS class FROM part")
    return rows.select("way_id", "tag", "class", osm.one_way(F.col("tag"), F.col("class")).alias("oneway"))


def _without(spark: SparkSession, d: str, cascade: bool) -> DataFrame:
    t, i = load(spark, d, "d_trips", "d_intervals")
    return lifecycle.without(t, i, t.where("status = 'pending'"), "trip_id", cascade)[1].select("way_id", "trip_id", "start_m", "end_m")


@_rule
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    return _without(spark, d, True)


@_rule
def set_null_delete(spark: SparkSession, d: str) -> DataFrame:
    return _without(spark, d, False)


@_rule
def trip_detail_fraction(spark: SparkSession, d: str) -> DataFrame:
    return readmodels.matched_fraction(*load(spark, d, "d_intervals", "d_vertices")).withColumn("fraction", F.round("fraction", 6))
