"""Road data from servers: requests with retry and failover, a data source of tiles and boundaries, and a read-through tile store.

Nothing here knows HTTP: a transport is a function (request, server, text, timeout) -> (status, body) that may raise, given
by the caller, and so is sleeping. Requests are rows; tasks are the workers.
"""

from __future__ import annotations

import importlib
import json
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .osm import ATTEMPTS, BACKOFF, TRANSIENT, gzip, parse_ways
from .snapshots import Snapshots
from .tables import relation_query

Transport = Callable[[dict, str, str, float], tuple[int, str]]
#: Workers, seconds until a request is given up, days that a tile is fresh.
WORKERS, TIMEOUT, TTL_DAYS = 2, 60.0, 30
#: How often a box is cut in four when a server says that it lacks memory.
CUTS = 3
#: Tiles to a cell of the store, by side, and folders that cells are dealt to.
CELL, FOLDERS = 64, 32
OUTCOME = "outcome string, error string, http_status int, attempts int, server string, waited_s int, parts int, body string"
_OUT = [c.split()[0] for c in OUTCOME.split(", ")]


class RoadError(RuntimeError):
    """A request that failed for good."""


def judged(status: int, body: str) -> str:
    """ok, transient, memory or failed: what wayfold.sources.osm.response_class says, of one response."""
    if status != 200:
        return "transient" if status == 429 or 500 <= status <= 599 else "failed"
    low = body.lstrip().lower()
    markup = low.startswith("<")
    if not markup and '"remark"' not in low:
        return "ok"
    if "memory" in low:
        return "memory"
    return "transient" if markup or any(w in low for w in TRANSIENT) else "ok"


def post(request: dict, text: str, transport: Transport, fallback_first: bool = False, timeout: float = TIMEOUT, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One request in up to ATTEMPTS attempts: the first two to one server and the last to the other; waits lie between. Never raises for the transport."""
    waited, said = 0, {"http_status": None, "body": None}
    for attempt in range(ATTEMPTS):
        server = "primary" if (attempt < ATTEMPTS - 1) != fallback_first else "fallback"
        said |= {"attempts": attempt + 1, "server": server, "waited_s": waited}
        try:
            status, body = transport(request, server, text, timeout)
            said["http_status"] = int(status)
            kind = judged(status, body)
            if kind == "ok":
                return said | {"outcome": "ok", "error": None, "body": body}
            error = {"memory": "out of memory", "failed": f"status {status}", "transient": "busy or timed out" if status == 200 else f"status {status}"}[kind]
        except TimeoutError:
            kind, error, said["http_status"] = "transient", "timed out", None
        except Exception as e:  # noqa: BLE001  a transport may raise anything
            kind, error, said["http_status"] = "transient", f"{type(e).__name__}: {e}", None
        if kind != "transient" or attempt == ATTEMPTS - 1:
            return said | {"outcome": kind if kind == "memory" else "failed", "error": error}
        waited += BACKOFF[attempt]
        sleep(BACKOFF[attempt])
    return said


def box_text(box: dict, timeout: int = 25) -> str:
    """The text that asks for all roads in a box, with geometry."""
    sides = ",".join(repr(float(box[k])) for k in ("min_lat", "min_lon", "max_lat", "max_lon"))
    return f"[out:json][timeout:{timeout}];\nway[highway]({sides});\nout geom qt;"


def quarters(box: dict) -> list[dict]:
    lat, lon = (box["min_lat"] + box["max_lat"]) / 2, (box["min_lon"] + box["max_lon"]) / 2
    sides = [(a, b, c, d) for a, c in ((box["min_lat"], lat), (lat, box["max_lat"])) for b, d in ((box["min_lon"], lon), (lon, box["max_lon"]))]
    return [box | dict(zip(("min_lat", "min_lon", "max_lat", "max_lon"), s, strict=True)) for s in sides]


def _joined(bodies: list[str]) -> str:
    """Responses of parts as one, each element once: a way that crosses a cut is in several."""
    seen, out = set(), []
    for b in bodies:
        for e in json.loads(b).get("elements", []):
            key = (e.get("type"), e.get("id")) if isinstance(e, dict) else None
            if key is None or key not in seen:
                seen.add(key)
                out.append(e)
    return json.dumps({"elements": out})


def ask(request: dict, text_of: Callable[[dict], str], transport: Transport, cuts: int = CUTS, **how) -> dict:
    """post(), and where a server lacks memory for a box the same for its quarters, up to so many times."""
    said = post(request, text_of(request), transport, **how)
    if said["outcome"] != "memory" or cuts == 0 or request.get("min_lat") is None:
        return said | {"outcome": "ok" if said["outcome"] == "ok" else "failed", "parts": 1}
    parts = [ask(q, text_of, transport, cuts - 1, **how) for q in quarters(request)]
    bad = next((p for p in parts if p["outcome"] != "ok"), None)
    whole = {"attempts": said["attempts"] + sum(p["attempts"] for p in parts), "waited_s": said["waited_s"] + sum(p["waited_s"] for p in parts), "parts": sum(p["parts"] for p in parts)}
    return (bad or parts[-1]) | whole | ({} if bad else {"body": _joined([p["body"] for p in parts])})


def fetched(requests: DataFrame, transport: Transport, workers: int = WORKERS, stop_at_first: bool = False, text_of: Callable[[dict], str] = box_text, order: tuple[str, ...] = (), **how) -> DataFrame:
    """Rows to ask for -> the same with OUTCOME. Each of `workers` tasks asks for one row after the other, in order; rows of any number are taken.

    stop_at_first: after its first failure a worker leaves the rest of its rows (outcome skipped). A lost task asks again for its rows.
    """
    columns = requests.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = False
        for f in frames:
            said = []
            for request in f.astype(object).where(f.notna(), None).to_dict("records"):
                if failed and stop_at_first:
                    said.append(dict.fromkeys(_OUT) | {"outcome": "skipped", "attempts": 0, "waited_s": 0, "parts": 0})
                    continue
                said.append(ask(request, text_of, transport, **how))
                failed |= said[-1]["outcome"] != "ok"
            out = pd.DataFrame(said, columns=_OUT).astype({"http_status": "Int32", "attempts": "int32", "waited_s": "int32", "parts": "int32"})
            yield pd.concat([f.reset_index(drop=True), out], axis=1)[[*columns, *_OUT]]

    schema = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes) + ", " + OUTCOME
    spread = requests.repartition(workers, *(order or columns[:1]))
    return (spread.sortWithinPartitions(*order) if order else spread).mapInPandas(run, schema)


# ---- the data source


class _Part(InputPartition):
    def __init__(self, requests: list[dict]):
        self.requests = requests


def _named(path: str) -> Transport:
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def tile_numbers(lat: float, lon: float, zoom: int) -> tuple[int, int]:
    n, a = 1 << zoom, math.radians(lat)
    x = math.floor((lon + 180) / 360 * n)
    y = math.floor((1 - math.log(math.tan(a) + 1 / math.cos(a)) / math.pi) / 2 * n)
    return min(max(x, 0), n - 1), min(max(y, 0), n - 1)


def tile_sides(x: int, y: int, zoom: int) -> dict:
    n = 1 << zoom
    lat = lambda k: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * k / n))))
    return {"min_lat": lat(y + 1), "min_lon": x / n * 360 - 180, "max_lat": lat(y), "max_lon": (x + 1) / n * 360 - 180}


class RoadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.transport = options, _named(options["transport"])
        self.kind = options.get("kind", "tiles")

    def partitions(self) -> list[_Part]:
        o, workers = self.options, int(self.options.get("workers", WORKERS))
        if self.kind == "boundaries":
            rows = [{"key": f"level {n}", "text": relation_query((int(n),), o.get("area", "DE"))} for n in o.get("levels", "2,4,6,8,9,10").split(",")]
            return [_Part([r]) for r in rows]
        zoom = int(o.get("zoom", 12))
        (x0, y1), (x1, y0) = tile_numbers(float(o["min_lat"]), float(o["min_lon"]), zoom), tile_numbers(float(o["max_lat"]), float(o["max_lon"]), zoom)
        if (x1 - x0 + 1) * (y1 - y0 + 1) > int(o.get("most", 100_000)):
            raise ValueError("the box holds more tiles than `most`; give them as a table to fetched()")
        tiles = [(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]
        return [_Part([{"key": f"{zoom}/{x}/{y}"} | tile_sides(x, y, zoom) for x, y in tiles[k::workers]]) for k in range(min(workers, len(tiles)))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        how = {"fallback_first": self.options.get("fallback_first", "false") == "true", "sleep": time.sleep if self.options.get("wait", "true") == "true" else lambda s: None}
        for r in partition.requests:
            said = ask(r, lambda q: q.get("text") or box_text(q), self.transport, **how)
            if said["outcome"] != "ok" and self.options.get("on_error", "row") == "raise":
                raise RoadError(f"{r['key']}: {said['error']}")
            yield (r["key"], *(said.get(n) for n in _OUT))


class RoadSource(DataSource):
    """spark.read.format("roads"): tiles of a box, or boundaries by level. A partition is a worker's tiles or a level.

    Options: transport ("module:function"), kind (tiles, boundaries), min_lat .. max_lon, zoom, workers, most, levels, area, fallback_first, wait,
    on_error (row: failures are rows; raise: the first one fails the read).
    """

    @classmethod
    def name(cls) -> str:
        return "roads"

    def schema(self) -> str:
        return f"key string, {OUTCOME}"

    def reader(self, schema) -> RoadReader:
        return RoadReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RoadSource)


# ---- the read-through store


class TileStore:
    """Gzip tiles by (z, x, y) in versioned tables: what is fetched is published in one version; the latest of a tile counts."""

    SCHEMA = "z int, x long, y long, payload_gzip binary, way_count int, fetched_at timestamp, cell long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, Snapshots(spark, root)
        if "tiles" not in self.tables.manifest()["tables"]:
            self.tables.commit(replace={"tiles": spark.createDataFrame([], self.SCHEMA)}, by={"tiles": "cell"})

    @staticmethod
    def _cell() -> Column:
        """A tile's folder: the tiles of a cell share one, and a commit writes so many at most, however many cells there are."""
        return F.pmod(F.xxhash64(F.col("z").cast("long"), F.floor(F.col("x") / CELL), F.floor(F.col("y") / CELL)), F.lit(FOLDERS)).cast("long")

    def put(self, tiles: DataFrame) -> None:
        """(z, x, y, payload_gzip, way_count, fetched_at) rows, over those that are there."""
        rows = tiles.select("z", "x", "y", "payload_gzip", "way_count", "fetched_at", self._cell().cast("long").alias("cell"))
        self.tables.commit(append={"tiles": rows}, by={"tiles": "cell"})

    def get(self, wanted: DataFrame) -> DataFrame:
        """The latest row of each wanted tile (z, x, y) that is there; folders of cells without a wanted tile aren't read."""
        asked = wanted.select("z", "x", "y").distinct().withColumn("cell", self._cell())
        rows = self.tables.read("tiles").join(asked, ["cell", "z", "x", "y"], "left_semi")
        newest = F.row_number().over(W.partitionBy("z", "x", "y").orderBy(F.desc("fetched_at")))
        return rows.withColumn("_k", newest).where("_k = 1").drop("_k", "cell")

    def compact(self) -> None:
        """All tiles' latest rows in one folder; older rows stay in older versions."""
        at = self.tables.version()
        newest = F.row_number().over(W.partitionBy("z", "x", "y").orderBy(F.desc("fetched_at")))
        rows = self.tables.read("tiles", at).withColumn("_k", newest).where("_k = 1").drop("_k").withColumn("cell", self._cell())
        self.tables.commit(replace={"tiles": rows}, expect=at, by={"tiles": "cell"})

    def read_through(self, wanted: DataFrame, transport: Transport, now: Column, cache_only: bool = False, on_error: str = "raise", workers: int = WORKERS, ttl_days: int = TTL_DAYS, **how) -> tuple[DataFrame, DataFrame]:
        """(z, x, y, ..) -> (tiles, outcomes): every wanted tile that is fresh here or could be fetched, and for each wanted one hit, fetched, failed, skipped or missing.

        Stale and missing tiles are fetched by `workers` tasks and published in one version before anything is raised, so a later
        read finds what an earlier one got. cache_only fetches nothing. on_error: "raise" stops each worker at its first
        failure and raises RoadError with the first one by tile; "skip" goes on and leaves failed tiles out. wanted's other columns reach the transport.
        """
        wanted = wanted.dropDuplicates(["z", "x", "y"])
        fresh = self.get(wanted).where(F.col("fetched_at") >= now - F.expr(f"interval {ttl_days} days"))
        hits = wanted.join(fresh.select("z", "x", "y"), ["z", "x", "y"], "left_semi")
        missing = wanted.join(fresh.select("z", "x", "y"), ["z", "x", "y"], "left_anti")
        keys = ["z", "x", "y"]
        if cache_only:
            return fresh, hits.select(*keys, F.lit("hit").alias("outcome"), F.lit(None).cast("string").alias("error")).union(missing.select(*keys, F.lit("missing"), F.lit(None).cast("string")))
        n = F.pow(F.lit(2.0), F.col("z"))
        lat = lambda k: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * k / n))))
        boxes = missing.withColumns({"min_lat": lat(F.col("y") + 1), "min_lon": F.col("x") / n * 360 - 180, "max_lat": lat(F.col("y")), "max_lon": (F.col("x") + 1) / n * 360 - 180})
        got = fetched(boxes, transport, workers, on_error == "raise", order=("z", "x", "y"), **how)
        log = Snapshots(self.spark, f"{self.tables.root}/_fetches")  # asked once, whatever reads the answers
        log.commit(replace={"got": got.select(*keys, "outcome", "error", "body")})
        got = log.read("got")
        good = got.where("outcome = 'ok'")
        ways = parse_ways(good.select(*keys, "body")).groupBy(*keys).agg(F.count("*").cast("int").alias("way_count"))
        rows = gzip(good.select(*keys, "body"), "body").join(ways, keys, "left").select(*keys, "payload_gzip", F.coalesce("way_count", F.lit(0)).alias("way_count"), now.alias("fetched_at"))
        found = fresh
        if not good.isEmpty():
            self.put(rows)
            found = self.get(hits.select(*keys).unionByName(good.select(*keys)))
        outcome = F.when(F.col("outcome") == "ok", "fetched").otherwise(F.col("outcome")).alias("outcome")
        outcomes = hits.select(*keys, F.lit("hit").alias("outcome"), F.lit(None).cast("string").alias("error")).unionByName(got.select(*keys, outcome, "error"))
        if on_error == "raise":
            first = got.where("outcome = 'failed'").orderBy(*keys).first()
            if first:
                raise RoadError(f"{first['z']}/{first['x']}/{first['y']}: {first['error']}")
        return found, outcomes
