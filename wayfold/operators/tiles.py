"""Tiles and corridors: which tiles a path touches, which are wanted, and which are new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo

#: Fixed value: metres between the places at which a path is held against tiles.
PATH_SAMPLE = 2000.0


def path_tiles(points: DataFrame, by: str = "trip_id", order: str = "seq", zoom: int = 12) -> DataFrame:
    """(by, order, lat, lon) -> the distinct (by, x, y) of tiles that the path touches; stretches over PATH_SAMPLE are sampled at equal steps."""
    w = W.partitionBy(by).orderBy(order)
    p = points.select(by, "lat", "lon", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"))
    metres = geo.plane_metres(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    steps = F.when(metres > PATH_SAMPLE, F.ceil(metres / PATH_SAMPLE).cast("int")).otherwise(F.lit(1))
    p = p.withColumn("steps", F.coalesce(steps, F.lit(1))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)))
    t = F.col("k") / F.col("steps")
    along = lambda a, b: F.when(F.col("k") == 0, F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * t)
    return p.select(by, geo.tile_x(along("lon", "lon2"), zoom).alias("x"), geo.tile_y(along("lat", "lat2"), zoom).alias("y")).distinct()


def union_box(tiles: DataFrame, zoom: int = 12) -> DataFrame:
    """(x, y) -> one row with the box of all tiles; zeros without any."""
    boxes = tiles.select(*(v.alias(k) for k, v in geo.tile_box(F.col("x"), F.col("y"), zoom).items()))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return boxes.agg(*(zero(F.min(k)).alias(k) for k in ("min_lat", "min_lon")), *(zero(F.max(k)).alias(k) for k in ("max_lat", "max_lon")))


def restrict(wanted: DataFrame, corridor: DataFrame, by: str = "trip_id") -> DataFrame:
    """Wanted tiles (by, x, y) that are in the corridor's; where a corridor has none, all that are wanted."""
    some = corridor.select(by).distinct().withColumn("_some", F.lit(True))
    rows = wanted.join(some, by, "left")
    inside = rows.where("_some").drop("_some").join(corridor.select(by, "x", "y"), [by, "x", "y"], "left_semi")
    return inside.union(rows.where("_some is null").select(*inside.columns))


def new_tiles(points: DataFrame, requested: DataFrame, lag: int = 15, by: str = "trip_id") -> DataFrame:
    """Tiles of each live path, but for its newest `lag` points, that weren't requested yet."""
    newest = F.row_number().over(W.partitionBy(by).orderBy(F.desc("seq")))
    settled = points.withColumn("_n", newest).where(F.col("_n") > lag).drop("_n")
    return path_tiles(settled, by).join(requested, [by, "x", "y"], "left_anti")
