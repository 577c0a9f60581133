"""Other sources: raw location fixes, regions from GeoJSON, region totals, relations, and scrapes of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def raw_fixes(events: DataFrame) -> DataFrame:
    """Raw fixes (device, ts as ISO text or epoch milliseconds as text, lat, lon, accuracy, speed, heading, altitude, activity, uuid) -> typed ones.

    A negative speed and a heading outside 0 to 360 are unknown (null). A time that is neither form is the time of reading.
    Works on a batch and on a stream alike.
    """
    known = F.coalesce(F.timestamp_millis(F.col("ts").try_cast("long")), F.col("ts").try_cast("timestamp"), F.current_timestamp())
    return events.select(
        "device", known.alias("ts"), F.col("lat").cast("double"), F.col("lon").cast("double"), F.col("accuracy").cast("double").alias("acc"),
        F.when(F.col("speed") >= 0, F.col("speed")).cast("double").alias("speed_mps"), F.when(F.col("heading").between(0, 360), F.col("heading")).cast("double").alias("heading"),
        F.col("altitude").cast("double"), "activity", "uuid")


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that exists, by Spark's own file systems: a refreshed file wins over the bundled one."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return path
    return None


_RING = "array<array<double>>"


def regions(bodies: DataFrame, body: str = "body") -> DataFrame:
    """GeoJSON feature collections -> region_id, level, ord, name, name_de, polygons [polygon][ring]{lat, lon} and the bounding box.

    Polygon and MultiPolygon are taken. Rings of fewer than four points go, and polygons without an outer ring; features
    without an integer osm_id and admin_level, a name or a polygon are left out. ord is the place in the collection.
    """
    feature = "struct<properties:struct<osm_id:string,admin_level:string,name:string,`name:de`:string>,geometry:struct<type:string,coordinates:string>>"
    rows = bodies.select(F.posexplode(F.from_json(F.get_json_object(F.col(body), "$.features"), f"array<{feature}>")).alias("ord", "f"))
    one = F.array(F.from_json("f.geometry.coordinates", f"array<{_RING}>"))
    many = F.from_json("f.geometry.coordinates", f"array<array<{_RING}>>")
    rows = rows.withColumn("shape", F.when(F.col("f.geometry.type") == "Polygon", one).when(F.col("f.geometry.type") == "MultiPolygon", many))
    point = lambda p: F.struct(F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lon"))
    rings = F.transform("shape", lambda poly: F.transform(F.filter(poly, lambda r: F.size(r) >= 4), lambda r: F.transform(r, point)))
    outer = lambda poly: F.size(F.get(poly, F.lit(0))) >= 4
    rows = rows.withColumn("polygons", F.filter(F.when(F.exists("shape", lambda p: outer(p)), rings), lambda p: F.size(p) > 0))
    p = lambda c: F.col(f"f.properties.{c}")
    rows = rows.select(p("osm_id").try_cast("long").alias("region_id"), p("admin_level").try_cast("int").alias("level"), "ord", p("name").alias("name"), p("`name:de`").alias("name_de"), "polygons")
    rows = rows.where((F.size("polygons") > 0) & F.col("region_id").isNotNull() & F.col("level").isNotNull() & F.col("name").isNotNull())
    every = F.flatten(F.flatten("polygons"))
    side = lambda f, c: f(F.transform(every, lambda q: q[c]))
    return rows.select("*", side(F.array_min, "lat").alias("min_lat"), side(F.array_min, "lon").alias("min_lon"), side(F.array_max, "lat").alias("max_lat"), side(F.array_max, "lon").alias("max_lon"))


def region_totals(bodies: DataFrame, body: str = "body") -> DataFrame:
    """JSON maps of region id to metres -> (region_id, total_m). Values that aren't numbers, those in quotes among them, are skipped; a damaged body gives none."""
    rows = bodies.select(F.explode(F.try_variant_get(F.try_parse_json(F.col(body)), "$", "map<string,variant>")).alias("k", "v"))
    number = F.when(F.schema_of_variant("v").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get("v", "$", "double"))
    return rows.select(F.col("k").try_cast("long").alias("region_id"), number.alias("total_m")).where("region_id is not null and total_m is not null")


def relation_query(levels: tuple[int, ...] = (2, 4, 6, 8, 9, 10), area: str = "DE", timeout: int = 900) -> str:
    """The text that asks for the boundaries of an area at the levels, members with geometry."""
    wanted = "|".join(map(str, levels))
    return f'[out:json][timeout:{timeout}];area["ISO3166-1"="{area}"]->.a;relation["boundary"="administrative"]["admin_level"~"^({wanted})$"](area.a);out geom;'


def relation_members(bodies: DataFrame, body: str = "body") -> DataFrame:
    """JSON responses -> a row per way member of a named relation: region_id, level, name, name_de, member, inner, points [lat, lon] (two at least)."""
    tags = "struct<name:string,`name:de`:string,admin_level:string>"
    element = f"struct<id:string,tags:{tags},members:array<struct<type:string,role:string,geometry:array<struct<lat:string,lon:string>>>>>"
    rows = bodies.select(F.explode(F.from_json(F.get_json_object(F.col(body), "$.elements"), f"array<{element}>")).alias("e"))
    rows = rows.select(F.col("e.id").try_cast("long").alias("region_id"), F.col("e.tags.admin_level").try_cast("int").alias("level"), F.col("e.tags.name").alias("name"), F.nullif(F.col("e.tags.`name:de`"), F.lit("")).alias("name_de"), F.posexplode("e.members").alias("member", "m"))
    rows = rows.where("region_id is not null and level in (2, 4, 6, 8, 9, 10) and name <> '' and m.type = 'way'")
    points = F.filter(F.transform("m.geometry", lambda p: F.array(p["lat"].try_cast("double"), p["lon"].try_cast("double"))), lambda p: p[0].isNotNull() & p[1].isNotNull())
    return rows.select("region_id", "level", "name", "name_de", "member", F.coalesce(F.col("m.role") == "inner", F.lit(False)).alias("inner"), points.alias("points")).where(F.size("points") >= 2)


def battery(text: Column) -> tuple[Column, Column]:
    """Battery level (percent) and estimated power use (mAh) of a device's text dump; null where a dump has none."""
    return F.regexp_extract(text, r"level:\s*(\d+)", 1).try_cast("int"), F.regexp_extract(text, r"Estimated power use \(mAh\)[^0-9]*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def line_coverage(lines: DataFrame, included: Column, least: float = 90.0) -> DataFrame:
    """lcov lines (report, line_no, line) -> by report: found and hit lines of the included files, percent, whether it passes.

    The file of a line is that of the last SF record above it. `included` is a condition on `file`.
    """
    w = W.partitionBy("report").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumn("file", F.last(F.when(F.col("line").startswith("SF:"), F.substring("line", 4, 1 << 20)), ignorenulls=True).over(w)).where(included)
    count = lambda k: F.coalesce(F.sum(F.when(F.col("line").startswith(k), F.substring("line", 4, 20).try_cast("long"))), F.lit(0).cast("long"))
    out = rows.groupBy("report").agg(count("LF:").alias("found"), count("LH:").alias("hit"))
    percent = F.when(F.col("found") > 0, F.col("hit") * 100.0 / F.col("found")).otherwise(F.lit(0.0))
    return out.withColumn("percent", percent).withColumn("passes", F.col("percent") >= least)
