import datetime as dt
import gzip
import json
import math
import time

import pytest
from pyspark.sql import functions as F

from wayfold.sources import regionfile, tables
from wayfold.streaming import ingest, progress, trips


def regions_frame(spark, n=40):
    def ring(k):  # wavy, so that tolerances take points away bit by bit
        pts = [(50 + k * 0.2 + (0.05 + 0.0009 * math.sin(i * 1.7) + 0.0002 * math.sin(i * 5)) * math.sin(a), 9 + (0.05 + 0.0009 * math.sin(i * 1.7)) * math.cos(a)) for i, a in ((i, 2 * math.pi * i / 400) for i in range(400))]
        return [*pts, pts[0]]

    rows = [(k, [4, 6, 8][k % 3], f"R{k}", "" if k % 2 else f"D{k}", [[ring(k)]]) for k in range(n)]
    return spark.createDataFrame(rows, "region_id long, level int, name string, name_de string, polygons array<array<array<struct<lat:double,lon:double>>>>")


def test_file_is_simplified_until_it_fits(spark, tmp_path):
    r = regions_frame(spark)
    sizes = {}
    for scale in (1.0, 2.0, 4.0, 8.0):
        sizes[scale], got = regionfile.write_regions(r, f"file://{tmp_path}/{scale}.gz", scale=scale)
        assert got == scale
    assert sizes[1.0] > sizes[2.0] > sizes[4.0] > sizes[8.0]
    for budget, scale in ((sizes[1.0], 1.0), (sizes[1.0] - 1, 2.0), (sizes[4.0], 4.0), (sizes[4.0] - 1, 8.0)):
        path = tmp_path / "out.gz"
        assert regionfile.write_regions(r, f"file://{path}", budget=budget) == (sizes[scale], scale)
        assert path.stat().st_size == sizes[scale] <= budget
        body = json.loads(gzip.decompress(path.read_bytes()))
        assert [f["properties"]["osm_id"] for f in body["features"][:-1]] == list(range(40)) and body["features"][-1] is None
    with pytest.raises(regionfile.TooLarge):
        regionfile.write_regions(r, f"file://{tmp_path}/none.gz", budget=100)
    assert not (tmp_path / "none.gz").exists()
    read = tables.regions(spark.createDataFrame([(json.dumps(body),)], "body string"))
    assert read.count() == 40 and {x.name_de for x in read.collect()} == {None, *(f"D{k}" for k in range(0, 40, 2))}
    # no point is farther from the kept lines than the tolerance allows
    kept = {x.region_id: len(x.polygons[0][0]) for x in regionfile.scaled(r, 8.0).collect()}
    assert all(4 <= n < 401 for n in kept.values())


def test_keys_of_both_files(spark):
    r = regions_frame(spark, 3)
    regionfile.check_keys(r, spark.createDataFrame([(k, 1.0) for k in range(3)], "region_id long, total_m double"))
    with pytest.raises(ValueError, match="region 2"):
        regionfile.check_keys(r, spark.createDataFrame([(k, 1.0) for k in range(2)], "region_id long, total_m double"))


def test_progress_events(spark):
    f = spark.createDataFrame([(t, 7 * i) for t, n in ((1, 1), (2, 128), (3, 129), (4, 300)) for i in range(n)], "trip_id long, seq long")
    got = sorted(map(tuple, progress.events(f).collect()))
    assert got == [(1, 1, 1), (2, 128, 128), (3, 128, 129), (3, 129, 129), (4, 128, 300), (4, 256, 300), (4, 300, 300)]


def test_a_running_stream_reports_its_counters(spark, tmp_path):
    schema = "device long, seq long, ts timestamp, lat double, lon double, acc double, speed_mps double, uuid string"
    t0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(1, i, t0 + dt.timedelta(seconds=i * (400 if i % 7 == 0 else 0.5 + i % 2)), 50 + i * 0.002, 9.0, 30.0 if i % 5 == 0 else 5.0, None, None) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    listener = progress.Progress()
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = progress.observed(ingest.ingest_stream(source)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").start()
        q.processAllAvailable()
        q.stop()
        out = spark.read.parquet(f"{tmp_path}/out")
        until = time.time() + 20
        while listener.totals["n"] < 60 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    n = {f"n_{k}": v for k, v in listener.totals.items() if k != "n"}
    want = trips.counters(out).drop("device", "last_reason").first().asDict()
    assert n == want and listener.totals["n"] == 60 and len(listener.batches) == 3 and sum(v > 0 for v in want.values()) >= 3
