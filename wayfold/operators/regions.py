"""Regions: polygons with holes, who contains a place, read models of region coverage, and which regions a trip changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.formats import coverage_percent
from .coverage import driven, way_geometry
from .regionindex import edges_of, located, region_cells

#: Levels that ways are attributed to, and the order in which a coarser one stands in.
LEVELS, CHAIN = (4, 6, 8, 9, 10), (10, 9, 8, 6, 4, 2)
COUNTRY = "Deutschland"


def in_ring(ring: Column, lat: Column, lon: Column) -> Column:
    """Even-odd test of a ring [{lat, lon}], closed by its first point; false for fewer than four points."""
    def crossed(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.when(i == 0, F.size(ring) - 1).otherwise(i - 1))
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / ((b["lat"] - a["lat"]) + F.lit(1e-30)) + a["lon"])

    return (F.size(ring) >= 4) & (F.size(F.filter(F.sequence(F.lit(0), F.size(ring) - 1), crossed)) % 2 == 1)


def contains(polygons: Column, lat: Column, lon: Column) -> Column:
    """Whether a polygon's outer ring holds the place and none of its holes does."""
    return F.exists(polygons, lambda p: in_ring(p[0], lat, lon) & ~F.exists(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda hole: in_ring(hole, lat, lon)))


def containing(points: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """(key, lat, lon) and regions as wayfold.sources.tables.regions gives them -> (key, level, region_id, name, name_de), first by level."""
    met = located(points.select(key, "lat", "lon"), region_cells(edges_of(regions)))
    first = met.groupBy(key, "level").agg(F.min("ord").alias("ord"))
    return first.join(regions.select("level", "ord", "region_id", "name", "name_de"), ["level", "ord"]).select(key, "level", "region_id", "name", "name_de")


def zoom_level(zoom: Column) -> Column:
    """The level of regions that a zoom shows."""
    steps = ((6, 2), (9, 4), (11, 6), (13, 8), (15, 9))
    return reduce(lambda c, s: c.when(zoom < s[0], s[1]), steps[1:], F.when(zoom < steps[0][0], steps[0][1])).otherwise(10)


def focus(at: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, zoom, recording) and containing regions -> (key, name): of the zoom's level or the nearest coarser one, the finest while recording.

    Without one it is the country where any region of level 4 holds the place, else a dash.
    """
    top = F.when(F.col("recording"), F.lit(10)).otherwise(zoom_level(F.col("zoom")))
    named = F.max_by(F.coalesce("name_de", "name"), F.when((F.col("level") <= F.col("top")) & (F.col("level") != 2), F.col("level")))
    rows = at.withColumn("top", top).join(found, key, "left").groupBy(key).agg(named.alias("name"), F.max(F.coalesce(F.col("level") == 4, F.lit(False))).alias("inside"))
    return rows.select(key, F.coalesce("name", F.when(F.col("inside"), F.lit(COUNTRY)), F.lit("—")).alias("name"))


def ancestors(selves: DataFrame, found: DataFrame) -> DataFrame:
    """(region_id, level) and the regions that hold each one's label point (key region_id as `self`) -> (region_id, ord, name, level), coarse to fine.

    Only strictly coarser levels count, a region never twice, and the country stands first.
    """
    up = found.join(selves.select(F.col("region_id").alias("self"), F.col("level").alias("own")), "self").where("level < own and level in (4, 6, 8, 9) and region_id <> self")
    up = up.groupBy("self", "region_id").agg(F.min("level").alias("level"), F.first(F.coalesce("name_de", "name")).alias("name"))
    rows = up.select(F.col("self").alias("region_id"), "level", "name").union(selves.select("region_id", F.lit(2), F.lit(COUNTRY)))
    return rows.withColumn("ord", F.row_number().over(W.partitionBy("region_id").orderBy("level")) - 1)


def trip_places(ends: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, trip_id, side start or end) and containing regions by key -> trip_id, start_name, end_name, loop: level 8, else 10."""
    name = found.where("level in (8, 10)").groupBy(key).agg(F.min_by("name", "level").alias("name"))
    rows = ends.join(name, key, "left")
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("name"))).alias(f"{s}_name")
    return rows.groupBy("trip_id").agg(of("start"), of("end")).withColumn("loop", F.coalesce(F.col("start_name") == F.col("end_name"), F.lit(False)))


def region_list(cache: DataFrame, regions: DataFrame, search: str | None = None) -> DataFrame:
    """Coverage rows (region_id as text, driven_m, total_m, real_total_m) and regions -> the list by percent: rank, region_id, level, name, percent.

    Rows whose id isn't an integer or has no polygon, and level 2, are dropped. The real total counts where it is known.
    A search keeps names that hold the text, in any letter case; those that begin with it come first.
    """
    c = cache.withColumn("id", F.col("region_id").try_cast("long")).drop("region_id").withColumnRenamed("id", "region_id")
    rows = c.join(regions.where("level <> 2").select("region_id", "level", F.coalesce("name_de", "name").alias("name")), "region_id")
    rows = rows.withColumn("percent", coverage_percent(F.col("driven_m"), F.coalesce("real_total_m", "total_m")))
    begins = F.lit(0)
    if search:
        low = F.lower("name")
        rows = rows.where(low.contains(search.lower()))
        begins = F.when(low.startswith(search.lower()), 0).otherwise(1)
    rows = rows.withColumn("begins", begins)
    w = W.partitionBy("level").orderBy("begins", F.desc("percent"), "region_id")
    return rows.withColumn("rank", F.row_number().over(w)).select("level", "rank", "region_id", "name", "percent")


def with_totals(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Region rows with real_total_m from the totals source, null where it has none."""
    return rows.drop("real_total_m").join(totals.select("region_id", F.col("total_m").alias("real_total_m")), "region_id", "left")


def probes(boxes: DataFrame, key: str) -> DataFrame:
    """(key, min_lat .. max_lon) -> five places of each box: its corners and its middle, as (probe, key, lat, lon)."""
    corners = [("min_lat", "min_lon"), ("min_lat", "max_lon"), ("max_lat", "min_lon"), ("max_lat", "max_lon")]
    places = [F.struct(F.col(a).alias("lat"), F.col(b).alias("lon")) for a, b in corners]
    places.append(F.struct(((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("lon")))
    rows = boxes.select(key, F.posexplode(F.array(*places)).alias("k", "p"))
    return rows.select(F.concat_ws(":", F.col(key).cast("string"), F.col("k").cast("string")).alias("probe"), key, "p.lat", "p.lon")


def invalidated(cache: DataFrame, touched: DataFrame) -> DataFrame:
    """The coverage rows that stay when those of the touched regions (region_id) are deleted."""
    return cache.join(touched.select("region_id").distinct(), "region_id", "left_anti")


def recomputed(touched: DataFrame, attribution: DataFrame, intervals: DataFrame, vertices: DataFrame) -> DataFrame:
    """Driven and total metres of the touched regions over all their ways, not just over those of one trip.

    attribution: (way_id, level, region_id). Regions without metres are left out.
    """
    ways = way_geometry(vertices).select("way_id", "len_m")
    rows = attribution.join(touched.select("region_id").distinct(), "region_id", "left_semi").join(ways, "way_id").join(driven(intervals), "way_id", "left")
    out = rows.groupBy("level", "region_id").agg(F.sum(F.coalesce("driven_m", F.lit(0.0))).alias("driven_m"), F.sum("len_m").alias("total_m"))
    return out.where("total_m > 0")


def attributed_totals(lengths: DataFrame, regions: DataFrame) -> DataFrame:
    """(region_id, metres) parts and all regions -> metres by region, 0.0 for a region without any."""
    sums = lengths.groupBy("region_id").agg(F.sum("metres").alias("m"))
    return regions.select("region_id").distinct().join(sums, "region_id", "left").select("region_id", F.coalesce("m", F.lit(0.0)).alias("total_m"))
