"""Geometry of region boundaries: stitching, simplification, label points, and roads clipped by polygons.

Relations, rings and roads are small, so each is worked on inside a task; Spark deals them out by their keys.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regionindex import clipped_metres, edges_of, region_cells

#: Degrees within which ends meet, metres per degree of tolerances, tolerance (m) by level, label precision (degrees).
EPSILON, PER_DEGREE, PRECISION = 1e-6, 111_000.0, 0.0005
TOLERANCE = {2: 10.0, 4: 30.0, 6: 50.0, 8: 100.0, 9: 100.0, 10: 100.0}


def _meet(a: tuple, b: tuple) -> bool:
    return abs(a[0] - b[0]) < EPSILON and abs(a[1] - b[1]) < EPSILON


def _closed(ring: list) -> bool:
    return len(ring) >= 4 and _meet(ring[0], ring[-1])


def stitched(lines: list[list[tuple]]) -> list[list[tuple]]:
    """Lines joined end to end into closed rings; what doesn't close is dropped. The last line is begun with, and later ones are tried first."""
    open_lines, rings = [list(x) for x in lines], []
    while open_lines:
        ring = open_lines.pop()
        while not _closed(ring):
            for k in reversed(range(len(open_lines))):
                line = open_lines[k]
                if _meet(ring[-1], line[0]):
                    ring = ring + line[1:]
                elif _meet(ring[-1], line[-1]):
                    ring = ring + line[-2::-1]
                elif _meet(ring[0], line[-1]):
                    ring = line[:-1] + ring
                elif _meet(ring[0], line[0]):
                    ring = line[:0:-1] + ring
                else:
                    continue
                del open_lines[k]
                break
            else:
                break
        if _closed(ring):
            rings.append(ring)
    return rings


def simplified(ring: list[tuple], metres: float) -> list[tuple]:
    """Douglas-Peucker on a ring: points nearer than the tolerance to the line (not the segment) between kept ones go. Three corners stay at least."""
    if len(ring) <= 4:
        return ring
    p = np.array(ring[:-1], float)
    keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, q = p[b] - p[a], p[a + 1 : b] - p[a]
        size = float(d @ d)
        away = q - np.outer(q @ d / size, d) if size else q
        far = np.sqrt((away * away).sum(1))
        k = int(far.argmax())
        if far[k] > metres / PER_DEGREE:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    left = [ring[i] for i in sorted(keep)]
    return [*left, left[0]] if len(left) >= 3 else ring


def inside(place: tuple, ring: list[tuple]) -> bool:
    if len(ring) < 4:
        return False
    a = np.array(ring, float)
    b = np.roll(a, 1, 0)
    cross = ((a[:, 0] > place[0]) != (b[:, 0] > place[0])) & (place[1] < (b[:, 1] - a[:, 1]) * (place[0] - a[:, 0]) / ((b[:, 0] - a[:, 0]) + 1e-30) + a[:, 1])
    return bool(cross.sum() % 2)


def assembled(members: DataFrame) -> DataFrame:
    """relation_members rows -> region_id, level, name, name_de, polygons [polygon][ring][point][lat, lon].

    Outer and inner lines are stitched apart and simplified by the level's tolerance; an inner ring belongs to the first
    polygon that holds its first point, or to none. A relation without an outer ring gives no row.
    """
    def rows(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("member")
        level = int(f.level.iloc[0])
        rings = [[simplified(r, TOLERANCE[level]) for r in stitched([[tuple(p) for p in line] for line in f.points[f.inner == side]])] for side in (False, True)]
        polygons = [[r] for r in rings[0]]
        for hole in rings[1]:
            home = next((p for p in polygons if inside(hole[0], p[0])), None)
            if home:
                home.append(hole)
        out = f[["region_id", "level", "name", "name_de"]].iloc[:1] if polygons else f[["region_id", "level", "name", "name_de"]].iloc[:0]
        return out.assign(polygons=[[[[list(map(float, q)) for q in r] for r in p] for p in polygons]] if polygons else [])

    schema = "region_id long, level int, name string, name_de string, polygons array<array<array<array<double>>>>"
    return members.groupBy("region_id").applyInPandas(rows, schema)


def _depth(place: tuple, ring: np.ndarray) -> float:
    """Distance to the ring in degrees, negative outside."""
    a, b = ring, np.roll(ring, 1, 0)
    d, q = b - a, np.array(place) - a
    size = (d * d).sum(1)
    t = np.clip((q * d).sum(1) / np.where(size > 0, size, 1), 0, 1) * (size > 0)
    gap = q - t[:, None] * d
    far = math.sqrt(float((gap * gap).sum(1).min()))
    return far if inside(place, ring.tolist()) else -far


def label_point(ring: list[tuple]) -> tuple[float, float]:
    """The place deepest inside a ring, to PRECISION: squares are halved, the most promising one first."""
    r = np.array(ring, float)
    low, high = r.min(0), r.max(0)
    side = float((high - low).min())
    middle = tuple(map(float, (low + high) / 2))
    if side <= 0:
        return middle
    a, b = r, np.roll(r, 1, 0)
    f = a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]
    area = float(f.sum()) * 3
    first = tuple(map(float, ((a + b) * f[:, None]).sum(0) / area)) if area else tuple(map(float, r[0]))
    best = max((_depth(p, r), -k, p) for k, p in enumerate((first, middle)))
    best, count, queue = (best[0], best[2]), 0, []

    def push(lat: float, lon: float, half: float) -> None:
        nonlocal count
        d = _depth((lat, lon), r)
        heapq.heappush(queue, (-(d + half * math.sqrt(2)), count, d, lat, lon, half))
        count += 1

    for lat in np.arange(low[0], high[0], side):
        for lon in np.arange(low[1], high[1], side):
            push(float(lat) + side / 2, float(lon) + side / 2, side / 2)
    while queue:
        top, _, d, lat, lon, half = heapq.heappop(queue)
        if d > best[0]:
            best = (d, (lat, lon))
        if -top - best[0] > PRECISION:
            for u in (-half / 2, half / 2):
                for v in (-half / 2, half / 2):
                    push(lat + u, lon + v, half / 2)
    return best[1]


def label_points(regions: DataFrame) -> DataFrame:
    """(region_id, polygons [polygon][ring]{lat, lon}) -> region_id, lat, lon: the label point of the outer ring with the largest box."""
    box = lambda r: (F.array_max(F.transform(r, lambda p: p["lat"])) - F.array_min(F.transform(r, lambda p: p["lat"]))) * (F.array_max(F.transform(r, lambda p: p["lon"])) - F.array_min(F.transform(r, lambda p: p["lon"])))
    outer = F.filter(F.transform("polygons", lambda p: p[0]), lambda r: F.size(r) >= 4)
    ranked = F.transform(outer, lambda r, k: F.struct(-box(r), k, r.alias("ring")))
    rows = regions.select("region_id", F.transform(F.get(F.array_sort(ranked), F.lit(0))["ring"], lambda p: F.array(p["lat"], p["lon"])).alias("ring")).where("ring is not null")

    def points(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [label_point([tuple(p) for p in ring]) for ring in f.ring]
            yield pd.DataFrame({"region_id": f.region_id, "lat": [p[0] for p in found], "lon": [p[1] for p in found]})

    return rows.mapInPandas(points, "region_id long, lat double, lon double")


def clipped_lengths(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """Road edges (way_id, i, alat .. blon) and regions -> (way_id, region_id, metres): geodesic metres of the edges inside."""
    return clipped_metres(edges, region_cells(edges_of(regions)))
