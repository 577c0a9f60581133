"""Driven parts of ways as lines: sub-lines by metres, coverage paths, clipping of driven ways, and full or partial coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo

#: Fixed values (m): thorn, connector that is drawn whole, stitch to an end, snap without node ids, gap that splits a path.
THORN, CONNECTOR, STITCH, SNAP, SPLIT = 25.0, 80.0, 25.0, 20.0, 200.0
#: Buffer (m), short way (m) and its share, floor of partial coverage (m and share).
BUFFER, FLOOR, SHARE, SHORT_SHARE = 15.0, 50.0, 0.05, 0.8


def edges(vertices: DataFrame) -> DataFrame:
    """(way_id, i, lat, lon) -> edges with great-circle length d, and where they begin and end along the way (m0, m1)."""
    w = W.partitionBy("way_id").orderBy("i")
    e = vertices.select("way_id", "i", F.col("lat").alias("alat"), F.col("lon").alias("alon"), F.lead("lat").over(w).alias("blat"), F.lead("lon").over(w).alias("blon")).where("blat is not null")
    e = e.withColumn("d", geo.haversine(*(F.col(c) for c in ("alat", "alon", "blat", "blon"))))
    m1 = F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0))
    return e.withColumn("m1", m1).withColumn("m0", F.col("m1") - F.col("d"))


def sub_lines(parts: DataFrame, vertices: DataFrame) -> DataFrame:
    """parts (way_id, part, lo, hi; metres in order) -> way_id, part, line [{lat, lon}] of what lies between; lines of one point go.

    Edges that touch the stretch give its end on them; the first one also gives its beginning.
    """
    p = parts.join(edges(vertices).where("d > 0"), "way_id").where("m1 >= lo and m0 <= hi")
    t = lambda m: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(m) - F.col("m0")) / F.col("d")))
    at = lambda m: F.struct((F.col("alat") + (F.col("blat") - F.col("alat")) * t(m)).alias("lat"), (F.col("alon") + (F.col("blon") - F.col("alon")) * t(m)).alias("lon"))
    rows = p.select("way_id", "part", F.struct("i", at("lo").alias("a"), at("hi").alias("b")).alias("e"))
    rows = rows.groupBy("way_id", "part").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return rows.select("way_id", "part", F.concat(F.array(F.get("e", F.lit(0))["a"]), F.transform("e", lambda e: e["b"])).alias("line"))


def junctions(vertices: DataFrame) -> DataFrame:
    """(node_id, n_ways): nodes at which more than one way begins or ends, over ways whose vertices all have node ids."""
    g = vertices.groupBy("way_id").agg((F.count("node_id") == F.count("*")).alias("named"), F.min_by("node_id", "i").alias("first"), F.max_by("node_id", "i").alias("last"))
    ends = g.where("named").select("way_id", F.explode(F.array_distinct(F.array("first", "last"))).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count_distinct("way_id").alias("n_ways")).where("n_ways > 1")


def way_ends(vertices: DataFrame) -> DataFrame:
    """By way: length, whether all vertices have node ids, and whether its first and last node end another way as well."""
    length = edges(vertices).groupBy("way_id").agg(F.sum("d").alias("len"))
    g = vertices.groupBy("way_id").agg((F.count("node_id") == F.count("*")).alias("named"), F.min_by("node_id", "i").alias("first"), F.max_by("node_id", "i").alias("last"))
    shared = junctions(vertices).select(F.col("node_id").alias("node"))
    out = g.join(length, "way_id")
    for end in ("first", "last"):
        out = out.join(shared.select(F.col("node").alias(f"_{end}")), (F.col(end) == F.col(f"_{end}")) & F.col("named"), "left").withColumn(f"{end}_shared", F.col(f"_{end}").isNotNull()).drop(f"_{end}")
    return out.drop("first", "last")


def clip_stretches(union: DataFrame, vertices: DataFrame) -> DataFrame:
    """Union intervals (way_id, start_m, end_m) and vertices -> what is drawn of each driven way: way_id, part, lo, hi. Ways that weren't driven join nothing.

    Thorns (short, less than half, not between two ways) go; short ways between two others are drawn whole; a stretch
    near an end that another way shares reaches to it; ways without node ids snap to their ends instead. Ways without geometry go.
    """
    by = W.partitionBy("way_id")
    vertices = vertices.join(union.select("way_id").distinct(), "way_id", "left_semi")
    u = union.select("way_id", F.least("start_m", "end_m").alias("lo"), F.greatest("start_m", "end_m").alias("hi"))
    u = u.join(way_ends(vertices), "way_id").withColumns({"part": F.row_number().over(by.orderBy("lo", "hi")), "parts": F.count("*").over(by), "driven": F.sum(F.col("hi") - F.col("lo")).over(by)})
    bridges = F.col("first_shared") & F.col("last_shared")
    thorn = F.col("named") & ~bridges & (F.col("driven") < THORN) & ((F.col("len") <= 0) | (F.col("driven") / F.col("len") < 0.5))
    whole = bridges & (F.col("len") <= CONNECTOR)
    u = u.where(~thorn).where(~whole | (F.col("part") == 1))
    start = (F.col("part") == 1) & F.col("first_shared") & (F.col("lo") <= STITCH) | (~F.col("named") & (F.col("lo") <= SNAP))
    end = (F.col("part") == F.col("parts")) & F.col("last_shared") & (F.col("hi") >= F.col("len") - STITCH) | (~F.col("named") & (F.col("hi") >= F.col("len") - SNAP))
    lo = F.when(whole | start, F.lit(0.0)).otherwise(F.col("lo"))
    hi = F.when(whole | end, F.col("len")).otherwise(F.col("hi"))
    return u.select("way_id", "part", lo.alias("lo"), hi.alias("hi"))


def clip_driven_ways(union: DataFrame, vertices: DataFrame) -> DataFrame:
    """The stretches of clip_stretches as lines: way_id, part, line."""
    return sub_lines(clip_stretches(union, vertices), vertices)


def coverage_paths(located: DataFrame) -> DataFrame:
    """All fixes in order with their snapped place or none (trip_id, seq, lat, lon, snapped_lat, snapped_lon) -> trip_id, part, line.

    A fix stands at its snapped place, else where it was measured. The path splits at steps over SPLIT metres; a place that
    repeats the one before counts once; lines of one point go.
    """
    w = W.partitionBy("trip_id").orderBy("seq")
    p = located.select("trip_id", "seq", F.coalesce("snapped_lat", "lat").alias("lat"), F.coalesce("snapped_lon", "lon").alias("lon"))
    p = p.withColumns({"plat": F.lag("lat").over(w), "plon": F.lag("lon").over(w)})
    p = p.where("plat is null or plat <> lat or plon <> lon")
    far = geo.haversine(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")) > SPLIT
    p = p.withColumn("part", F.sum(F.coalesce(far, F.lit(False)).cast("int")).over(w))
    rows = p.groupBy("trip_id", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("v")).where(F.size("v") >= 2)
    return rows.select("trip_id", "part", F.transform("v", lambda q: F.struct(q["lat"], q["lon"])).alias("line"))


def coverage_class(driven: Column, length: Column) -> Column:
    """full, partial or undriven. A way is full when all but a buffer at both ends is driven, a short one from a share of it on."""
    full = F.when(length <= 2 * BUFFER, driven >= SHORT_SHARE * length).otherwise(driven >= length - 2 * BUFFER)
    floor = F.greatest(F.least(F.lit(FLOOR), length), SHARE * length)
    return F.when(length <= 0, "undriven").when(full, "full").when(driven < floor, "undriven").otherwise("partial")
