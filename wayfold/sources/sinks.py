"""Sinks: GeoJSON texts, batched points, golden fixtures, snapshots with a manifest, and the region files' checks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Schema versions that a snapshot may have, tables that it has to hold, and the form of a fixture's name.
VERSION, TABLES = 7, ("trips", "trip_points", "driven_way_intervals", "coverage_cache", "overpass_way_cache", "pending_road_fetches", "app_prefs")
SLUG = r"^\d{3}_[a-z0-9_]+$"


def position(point: Column) -> Column:
    """A {lat, lon} as GeoJSON's [lon, lat]."""
    return F.array(point["lon"], point["lat"])


def line_feature(points: Column, properties: Column) -> Column:
    """A Feature of one LineString as JSON."""
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform(points, position).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")))


def collection(features: DataFrame, column: str, by: list[str], order: str) -> DataFrame:
    """Features (JSON texts) -> one FeatureCollection by group, in order. A group is one document, so its size is the reader's choice."""
    rows = features.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda f: f[column]), ",").alias("f"))
    return rows.select(*by, F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("f"), F.lit("]}")).alias("body"))


def outline(polygons: Column) -> Column:
    """[polygon][ring]{lat, lon} -> a region's geometry as JSON: rings of fewer than four points go, a single polygon is a Polygon; null where none is left."""
    rings = F.transform(polygons, lambda poly: F.transform(F.filter(poly, lambda r: F.size(r) >= 4), lambda r: F.transform(r, position)))
    left = F.filter(rings, lambda poly: F.size(poly) > 0)
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(left, F.lit(0)).alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), left.alias("coordinates")))
    return F.when(F.size(left) == 1, one).when(F.size(left) > 1, many)


def multi_line(lines: Column) -> Column:
    """[line]{lat, lon} -> a MultiLineString as JSON."""
    return F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.transform(lines, lambda line: F.transform(line, position)).alias("coordinates")))


def live_trail(points: Column) -> Column:
    """The line behind a moving vehicle as JSON: one fix behind, and none before there are three."""
    behind = F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0)))
    return F.when(F.size(points) >= 3, F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(behind, position).alias("coordinates"))))


def point_batches(points: DataFrame, size: int = 20) -> DataFrame:
    """(trip_id, seq, ..) -> the same with the batch that a buffer of `size` points would write it in, from 0; the rest of a trip is its last batch."""
    from pyspark.sql import Window as W

    return points.withColumn("batch", F.floor((F.row_number().over(W.partitionBy("trip_id").orderBy("seq")) - 1) / size).cast("long"))


def write_points(stream: DataFrame, path: str, checkpoint: str, seconds: int = 5) -> StreamingQuery:
    """Appends a stream of points every few seconds. A batch that is tried again replaces its own files, so no point is doubled."""
    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.trigger(processingTime=f"{seconds} seconds").option("checkpointLocation", checkpoint).foreachBatch(sink).start()


def golden_fixture(trip: DataFrame, ways: DataFrame, expected: DataFrame, path: str, slug: str) -> None:
    """Writes a trip's trace, its ways and the expected (ord, way_id, direction) as JSON lines; whole or not at all, as the folder is renamed last."""
    import re

    if not re.match(SLUG, slug):
        raise ValueError(f"not a fixture's name: {slug}")
    tmp = f"{path}/.{slug}-{uuid.uuid4().hex}"
    trip.orderBy("seq").coalesce(1).write.json(f"{tmp}/gps_trace")
    ways.write.option("compression", "gzip").json(f"{tmp}/ways")
    expected.orderBy("ord").coalesce(1).select(F.col("way_id").alias("wayId"), "direction").write.json(f"{tmp}/expected_ways")
    _rename(trip.sparkSession, tmp, f"{path}/{slug}")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _rename(spark: SparkSession, old: str, new: str) -> None:
    a, fs = _path(spark, old)
    b, _ = _path(spark, new)
    if fs.exists(b):
        fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"could not rename {old} to {new}")


def backup(tables: dict[str, DataFrame], path: str, version: int = VERSION) -> None:
    """A snapshot of all tables with a manifest of the version and the tables' row counts, which is written last."""
    spark = next(iter(tables.values())).sparkSession
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{name}").count()
    spark.createDataFrame([(json.dumps({"version": version, "rows": counts}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")


def validate(spark: SparkSession, path: str, required: tuple[str, ...] = TABLES) -> str | None:
    """None for a sound snapshot, or what is wrong: no manifest, a version that isn't known, a table that is missing or short of rows."""
    p, fs = _path(spark, f"{path}/_manifest")
    if not fs.exists(p):
        return "no manifest"
    found = json.loads(spark.read.text(f"{path}/_manifest").first()[0])
    if not 0 < found["version"] <= VERSION:
        return f"version {found['version']}"
    for name in required:
        if name not in found["rows"]:
            return f"no table {name}"
        if spark.read.parquet(f"{path}/{name}").count() != found["rows"][name]:
            return f"table {name} is damaged"
    return None


def restore(spark: SparkSession, path: str, live: str) -> None:
    """Puts a sound snapshot in the place of the live tables, of which a copy is kept beside them as `-before`."""
    if problem := validate(spark, path):
        raise ValueError(problem)
    p, fs = _path(spark, live)
    if fs.exists(p):
        _rename(spark, live, f"{live}-before")
    tmp = f"{live}-{uuid.uuid4().hex}"
    for name in TABLES:
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{tmp}/{name}")
    _rename(spark, tmp, live)


def rounded_totals(totals: DataFrame) -> DataFrame:
    """(region_id, total_m) -> metres rounded to a tenth, as the totals file holds them."""
    return totals.select("region_id", F.round("total_m", 1).alias("total_m"))


def unmatched_keys(regions: DataFrame, totals: DataFrame) -> DataFrame:
    """Region ids that only one of the two files has; none in a sound pair."""
    a, b = regions.select("region_id").distinct().withColumn("a", F.lit(1)), totals.select("region_id").distinct().withColumn("b", F.lit(1))
    return a.join(b, "region_id", "full").where("a is null or b is null").select("region_id", F.col("a").isNotNull().alias("has_shape"))
