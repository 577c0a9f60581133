"""Regions by grid cells: a cell holds the border edges that touch it and whether its own corner lies inside, never a whole ring.

Edges are dealt to the cells of their own boxes. Each row of cells is cut by its middle line once: the sorted crossings say which
cells' left ends lie inside. A cell without an edge is inside or outside as a whole and needs no test; in a border cell the way from its left end to a place,
up or down and then along the place's own latitude, stays in the cell, so only the cell's own edges can change the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

#: Side of a cell in degrees, and by how much a piece must miss a border for that to be sure in spite of rounding.
CELL, MISS = 0.1, 1e-9


def _cell(c: Column) -> Column:
    return F.floor(c / F.lit(CELL)).cast("long")


def _between(a: Column, b: Column) -> Column:
    """Whole numbers from a to b, none where b is smaller."""
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))


def _cross(e: Column, at: Column) -> Column:
    """x of an edge's meeting with y = at, in the even-odd test's own order of operations, so that places on a border fall as the test lets them."""
    return (e["xj"] - e["xi"]) * (at - e["yi"]) / ((e["yj"] - e["yi"]) + F.lit(1e-30)) + e["xi"]


def _over(e: Column, at: Column) -> Column:
    return (e["yi"] > at) != (e["yj"] > at)


def _side(e: Column, at: Column, upper: bool, end: Column) -> Column:
    """Whether an edge runs right of x = end at y = at, or at its own upper or lower point where it doesn't come so far."""
    low, high = F.when(e["yi"] < e["yj"], e["xi"]).otherwise(e["xj"]), F.when(e["yi"] < e["yj"], e["xj"]).otherwise(e["xi"])
    return end < F.when(_over(e, at), _cross(e, at)).otherwise(high if upper else low)


def _middle(cy: Column) -> Column:
    return (cy + 0.5) * CELL


def region_cells(edges: DataFrame, keep: tuple[str, ...] = ("level", "ord")) -> DataFrame:
    """(region_id, *keep, xi, yi, xj, yj), all rings' edges of a region -> (cy, cx, region_id, *keep, corner, ring): the cells that a region touches.

    corner: whether the left end of the cell's middle line is inside; ring: the edges in the cell, none where it is inside as a whole. Inside is what an odd number of edges encloses, so holes need no mark.
    """
    by = ["region_id", *keep]
    e = edges.select(*by, F.struct("xi", "yi", "xj", "yj").alias("e")).withColumns({"y0": _cell(F.least("e.yi", "e.yj")), "y1": _cell(F.greatest("e.yi", "e.yj")), "x0": _cell(F.least("e.xi", "e.xj")), "x1": _cell(F.greatest("e.xi", "e.xj"))})
    rows = e.withColumn("cy", F.explode(_between(F.col("y0"), F.col("y1"))))
    border = rows.withColumn("cx", F.explode(_between(F.col("x0"), F.col("x1")))).groupBy(*by, "cy", "cx").agg(F.collect_list("e").alias("ring"))
    line = _middle(F.col("cy"))
    cuts = rows.where(_over(F.col("e"), line)).groupBy(*by, "cy").agg(F.sort_array(F.collect_list(_cross(F.col("e"), line))).alias("xs"))
    pairs = F.transform(F.filter("xs", lambda x, k: k % 2 == 0), lambda x, k: F.struct(x.alias("a"), F.get("xs", (2 * k + 1).cast("int")).alias("b")))
    within = cuts.select(*by, "cy", F.explode(pairs).alias("p")).select(*by, "cy", F.explode(_between(_cell(F.col("p.a")), _cell(F.col("p.b")))).alias("cx")).distinct()
    cells = within.join(border, [*by, "cy", "cx"], "full").join(cuts, [*by, "cy"], "left")
    left = F.size(F.filter(F.coalesce("xs", F.array().cast("array<double>")), lambda x: x <= F.col("cx") * F.lit(CELL))) % 2 == 1
    cells = cells.select("cy", "cx", *by, left.alias("corner"), F.coalesce("ring", F.array().cast("array<struct<xi:double,yi:double,xj:double,yj:double>>")).alias("ring"))
    return cells.where("corner or size(ring) > 0")


def is_inside(lat: Column, lon: Column) -> Column:
    """Whether a place in the cell of a joined row is inside its region."""
    row, end = _middle(F.col("cy")), F.col("cx") * F.lit(CELL)
    low, high = F.least(row, lat), F.greatest(row, lat)
    passed = lambda e: (F.least(e["yi"], e["yj"]) <= high) & (F.greatest(e["yi"], e["yj"]) > low)
    up = F.filter("ring", lambda e: passed(e) & (_side(e, low, False, end) != _side(e, high, True, end)))
    across = F.filter("ring", lambda e: _over(e, lat) & ((lon < _cross(e, lat)) != (end < _cross(e, lat))))
    return (F.size(across) + F.size(up) + F.col("corner").cast("int")) % 2 == 1


def located(points: DataFrame, cells: DataFrame) -> DataFrame:
    """(.., lat, lon) with region_cells -> a row for each place and region that holds it, with the region's columns."""
    at = points.withColumns({"cy": _cell(F.col("lat")), "cx": _cell(F.col("lon"))})
    return at.join(cells, ["cy", "cx"]).where(is_inside(F.col("lat"), F.col("lon"))).drop("cy", "cx", "corner", "ring")


def edges_of(regions: DataFrame, keep: tuple[str, ...] = ("level", "ord")) -> DataFrame:
    """Regions with polygons [polygon][ring]{lat, lon} -> the edges of all rings, closed by their first point."""
    ring = regions.select("region_id", *keep, F.explode(F.flatten("polygons")).alias("r")).where(F.size("r") >= 4)
    pair = F.transform("r", lambda p, k: F.struct(p["lon"].alias("xi"), p["lat"].alias("yi"), F.get("r", ((k + 1) % F.size("r")).cast("int"))["lon"].alias("xj"), F.get("r", ((k + 1) % F.size("r")).cast("int"))["lat"].alias("yj")))
    return ring.select("region_id", *keep, F.explode(pair).alias("e")).select("region_id", *keep, "e.*").where("xi <> xj or yi <> yj")


def pieces(edges: DataFrame) -> DataFrame:
    """Road edges (way_id, i, alat .. blon) -> pieces that each lie in one cell: way_id, i, alat .. blon, t0, t1, cy, cx."""
    def at_lines(a: str, b: str) -> Column:
        lines = _between(_cell(F.least(a, b)) + 1, _cell(F.greatest(a, b)))
        return F.transform(lines, lambda k: F.try_divide(k * F.lit(CELL) - F.col(a), F.col(b) - F.col(a)))

    inner = F.filter(F.concat(at_lines("alat", "blat"), at_lines("alon", "blon")), lambda t: (t > 0) & (t < 1))
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inner)))
    e = edges.select("way_id", "i", "alat", "alon", "blat", "blon", cuts.alias("c"))
    e = e.select("way_id", "i", "alat", "alon", "blat", "blon", F.explode(F.transform(F.slice("c", 1, F.size("c") - 1), lambda t, k: F.struct(t.alias("t0"), F.get("c", k + 1).alias("t1")))).alias("p")).select("*", "p.t0", "p.t1").drop("p")
    middle = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * (F.col("t0") + F.col("t1")) / 2
    return e.withColumns({"cy": _cell(middle("alat", "blat")), "cx": _cell(middle("alon", "blon"))})


def clipped_metres(edges: DataFrame, cells: DataFrame, metres=geo.ellipsoid) -> DataFrame:
    """Road edges and region_cells -> (way_id, region_id, metres): ellipsoidal metres of the edges inside, by way and region.

    An edge is cut into the pieces of its cells; in a cell that is inside as a whole a piece counts whole, in a border cell it is cut where
    it crosses the cell's edges, and what has its middle inside counts. Only cells' own edges travel, never a polygon.
    """
    low, high = lambda a, b: F.array_min(F.transform("ring", lambda e: F.least(e[a], e[b]))), lambda a, b: F.array_max(F.transform("ring", lambda e: F.greatest(e[a], e[b])))
    bounds = (low("xi", "xj").alias("x0"), low("yi", "yj").alias("y0"), high("yi", "yj").alias("y1"))
    met = pieces(edges).join(cells.select("cy", "cx", "region_id", "corner", "ring", *bounds), ["cy", "cx"])
    dx, dy = F.col("blon") - F.col("alon"), F.col("blat") - F.col("alat")
    # what lies left of the cell's edges, or above or below them where none comes to the cell's left end, is inside or outside as its corner
    ends = lambda f, a, d: f(F.col(a) + d * F.col("t0"), F.col(a) + d * F.col("t1"))
    beside = (F.col("x0") > F.col("cx") * F.lit(CELL) + MISS) & ((ends(F.greatest, "alat", dy) < F.col("y0") - MISS) | (ends(F.least, "alat", dy) > F.col("y1") + MISS))
    met = met.withColumn("known", (F.size("ring") == 0) | (ends(F.greatest, "alon", dx) < F.col("x0") - MISS) | beside).where("corner or not known")
    met = met.withColumn("ring", F.when(F.col("known"), F.slice("ring", 1, 0)).otherwise(F.col("ring")))

    def crossing(e: Column) -> Column:
        wx, wy = e["xj"] - e["xi"], e["yj"] - e["yi"]
        turn = dx * wy - dy * wx
        t = F.try_divide((e["xi"] - F.col("alon")) * wy - (e["yi"] - F.col("alat")) * wx, turn)
        s = F.try_divide((e["xi"] - F.col("alon")) * dy - (e["yi"] - F.col("alat")) * dx, turn)
        return F.when((t > F.col("t0")) & (t < F.col("t1")) & s.between(0, 1), t)

    cuts = F.array_sort(F.array_distinct(F.concat(F.array("t0", "t1"), F.filter(F.transform("ring", crossing), lambda t: t.isNotNull()))))
    met = met.withColumn("c", cuts)
    lat, lon = lambda t: F.col("alat") + dy * t, lambda t: F.col("alon") + dx * t
    parts = F.transform(F.slice("c", 1, F.size("c") - 1), lambda t, k: F.struct(t.alias("a"), F.get("c", k + 1).alias("b")))
    parts = met.select("way_id", "region_id", "cy", "cx", "corner", "ring", "alat", "alon", "blat", "blon", F.explode(parts).alias("p"))
    middle = (F.col("p.a") + F.col("p.b")) / 2
    kept = parts.where((F.size("ring") == 0) | is_inside(lat(middle), lon(middle)))
    length = metres(lat(F.col("p.a")), lon(F.col("p.a")), lat(F.col("p.b")), lon(F.col("p.b")))
    return kept.groupBy("way_id", "region_id").agg(F.sum(length).alias("metres")).where("metres > 0")
