"""The regions' file: one gzip GeoJSON within a budget of bytes, simplified more until it fits.

Each task simplifies its regions and packs them as a gzip member of its own; members put one behind the other are a gzip file. Their
sizes are summed before anything is gathered, so only what fits the budget comes together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rings import TOLERANCE, simplified
from .sinks import _path, position, unmatched_keys
from .snapshots import shared_folder

#: The file's budget (bytes), the scale of tolerances from which on they aren't doubled any more.
BUDGET, MOST_SCALE = 15 * 1024 * 1024, 8.0
_HEAD, _TAIL = '{"type":"FeatureCollection","features":[', "]}"


class TooLarge(ValueError):
    """The file is over the budget at the last scale."""


def scaled(regions: DataFrame, scale: float) -> DataFrame:
    """Regions with every ring simplified by its level's tolerance times the scale; what isn't left with three corners stays as it was."""
    names = regions.columns

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cut = lambda ring, level: [{"lat": a, "lon": b} for a, b in simplified([(q["lat"], q["lon"]) for q in ring], TOLERANCE[level] * scale)]
            yield f.assign(polygons=[[[cut(r, level) for r in p] for p in polygons] for polygons, level in zip(f.polygons, f.level, strict=True)])[names]

    return regions.mapInPandas(rows, regions.schema)


def features(regions: DataFrame) -> DataFrame:
    """(region_id, feature): each region as a MultiPolygon feature."""
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.transform("polygons", lambda p: F.transform(p, lambda r: F.transform(r, position))).alias("coordinates"))
    properties = F.struct(F.col("region_id").alias("osm_id"), F.col("level").alias("admin_level"), "name", F.nullif("name_de", F.lit("")).alias("name:de"))
    return regions.select("region_id", F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), shape.alias("geometry"))).alias("feature"))


def _packed(text: str) -> bytes:
    z = zlib.compressobj(9, zlib.DEFLATED, 31)
    return z.compress(text.encode()) + z.flush()


def members(found: DataFrame) -> DataFrame:
    """Features -> (part, n, payload): a gzip member for each task's features, each with a comma behind it, in order of region_id."""
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z, n, first, out = zlib.compressobj(9, zlib.DEFLATED, 31), 0, None, []
        for f in frames:
            for region, feature in zip(f.region_id, f.feature, strict=True):
                first = region if first is None else first
                out.append(z.compress((feature + ",").encode()))
                n += 1
        if n:
            yield pd.DataFrame({"part": [first], "n": [n], "payload": [b"".join(out) + z.flush()]})

    return found.repartitionByRange("region_id").sortWithinPartitions("region_id").mapInPandas(rows, "part long, n long, payload binary")


def write_regions(regions: DataFrame, path: str, budget: int = BUDGET, scale: float = 1.0) -> tuple[int, float]:
    """Writes the regions' file and returns its bytes and the scale that it took: the given one, doubled while the file is too large and the scale below MOST_SCALE.

    TooLarge is raised, and no file is written, if it still doesn't fit. The last feature is followed by a null, as members end with commas; readers skip it as any feature that is none.
    """
    spark = regions.sparkSession
    head, tail = _packed(_HEAD), _packed("null" + _TAIL)
    while True:
        work = shared_folder(spark, "regions")
        members(features(scaled(regions, scale))).write.parquet(work)
        parts = spark.read.parquet(work)
        size = len(head) + len(tail) + (parts.agg(F.sum(F.length("payload"))).first()[0] or 0)
        if size <= budget:
            break
        if scale >= MOST_SCALE:
            raise TooLarge(f"{size} bytes at scale {scale:g}, over {budget}")
        scale *= 2
    target, fs = _path(spark, path)
    waiting, _ = _path(spark, f"{path}.part")
    out = fs.create(waiting, True)
    try:
        out.write(bytearray(head))
        for r in parts.orderBy("part").toLocalIterator():  # within the budget
            out.write(bytearray(r["payload"]))
        out.write(bytearray(tail))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(waiting, target)
    return size, scale


def check_keys(regions: DataFrame, totals: DataFrame) -> None:
    """Both files hold the same regions, or ValueError names one that only one of them has."""
    odd = unmatched_keys(regions, totals).first()
    if odd:
        raise ValueError(f"region {odd['region_id']} is in one file only")
