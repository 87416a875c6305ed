"""Rasters on another grid, and the ledger of arrivals."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelworks.operators import regions, resample
from parcelworks.streaming import ledger


def grid_of(z, tile="a"):
    return [(tile, r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)]


@pytest.fixture(scope="module")
def raster(spark):
    z = np.random.default_rng(4).random((8, 9)) * 30
    z[2, 3] = np.nan
    pixels = spark.createDataFrame(grid_of(z), "tile_id string, row int, col int, value double")
    tiles = spark.createDataFrame([("p", "a", 100.0, 200.0, 2.0, 3.0)], "parcel_id string, tile_id string, origin_x double, origin_y double, px double, py double")
    return z, pixels, tiles


def cells(spark, dx=0.0, dy=0.0, rows=8, cols=9):
    return spark.createDataFrame([("p", r, c, 100 + (c + 0.5) * 2.0 + dx, 200 - (r + 0.5) * 3.0 + dy, True) for r in range(rows) for c in range(cols)], "parcel_id string, r int, c int, x double, y double, in_parcel boolean")


@pytest.mark.parametrize("bilinear", [True, False])
def test_a_grid_on_itself_is_the_same(spark, raster, bilinear):
    z, pixels, tiles = raster
    got = {(r["r"], r["c"]): r["value"] for r in resample.resampled(cells(spark), tiles, pixels, bilinear).collect()}
    assert len(got) == 72 and got.pop((2, 3)) is None and all(v == pytest.approx(z[k]) for k, v in got.items())


def test_a_shifted_grid_weighs_its_neighbours(spark, raster):
    z, pixels, tiles = raster
    got = {(r["r"], r["c"]): r["value"] for r in resample.resampled(cells(spark, 0.5, -1.2, 10, 11), tiles, pixels).collect()}
    for (r, c), value in got.items():
        total = weight = 0.0
        for i, j, w in ((0, 0, 0.6 * 0.75), (0, 1, 0.6 * 0.25), (1, 0, 0.4 * 0.75), (1, 1, 0.4 * 0.25)):
            if r + i < 8 and c + j < 9 and not np.isnan(z[r + i, c + j]):
                total, weight = total + w * z[r + i, c + j], weight + w
        assert value == (pytest.approx(total / weight) if weight else None)
    near = {(r["r"], r["c"]): r["value"] for r in resample.resampled(cells(spark, 1.1, 0.0), tiles, pixels, False).collect()}
    assert near[0, 0] == pytest.approx(z[0, 1]) and near[0, 8] is None


def test_best_tile_and_coverage(spark, raster):
    def box(x0, y0, x1, y1):
        return [[[x0, y0], [x1, y0], [x1, y1], [x0, y1]]]

    home = spark.createDataFrame([("p", box(0.0, 0.0, 10.0, 10.0)), ("q", box(0.0, 0.0, 1.0, 1.0))], f"parcel_id string, rings {regions.RINGS}")
    tiles = spark.createDataFrame([("p", "half", box(5.0, 0.0, 99.0, 10.0)), ("p", "most", box(-9.0, -9.0, 9.0, 10.0)), ("p", "also", box(-9.0, -9.0, 9.0, 10.0)), ("q", "far", box(5.0, 5.0, 6.0, 6.0))], f"parcel_id string, tile_id string, rings {regions.RINGS}")
    assert [(r["parcel_id"], r["tile_id"], r["overlap"]) for r in resample.best_tiles(tiles, home).collect()] == [("p", "also", 90.0)]
    rows = [("full", i, 0, 1.0, True) for i in range(20)] + [("gaps", i, 0, None if i < 3 else 1.0, True) for i in range(20)] + [("edge", i, 0, None if i < 2 else 1.0, i < 20) for i in range(40)] + [("none", 0, 0, None, True)]
    table = spark.createDataFrame(rows, "parcel_id string, r int, c int, value double, in_parcel boolean")
    got = {r["parcel_id"]: (r["status"], r["nodata_pct"]) for r in resample.coverage(table).collect()}
    assert got == {"full": ("complete", 0.0), "gaps": ("incomplete", 15.0), "edge": ("complete", 10.0), "none": ("none", 100.0)}
    assert resample.required(table.where("parcel_id <> 'gaps'")).count() == 60
    with pytest.raises(Exception, match="parcel gaps is incomplete"):
        resample.required(table).collect()


ARRIVAL = "parcel_id string, source string, arrived_at timestamp, payload string"


def arrival(parcel, source, minute, payload="x"):
    return parcel, source, f"2024-01-01 00:{minute:02d}:00", payload


def arrivals(spark, rows):
    return spark.createDataFrame(rows, "parcel_id string, source string, arrived_at string, payload string").withColumn("arrived_at", F.to_timestamp("arrived_at"))


def test_ledger_over_a_stream(spark, tmp_path):
    """Late, repeated and withdrawn sources over several loads, and a load run twice."""
    source, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    names = {"required": ("dem", "soil"), "optional": ("irradiance",)}
    parcels = spark.createDataFrame([("p",), ("q",), ("silent",)], "parcel_id string")
    loads = [
        [arrival("p", "dem", 1), arrival("q", "dem", 1, None), arrival("p", "other", 1)],
        [arrival("p", "soil", 2, "old"), arrival("p", "soil", 3, "new"), arrival("q", "soil", 2)],
        [arrival("q", "dem", 4), arrival("p", "soil", 1, "late copy"), arrival("q", "irradiance", 4)],
    ]
    schema = arrivals(spark, loads[0]).schema
    for n, rows in enumerate(loads):
        arrivals(spark, rows).write.mode("append").parquet(source)
        ledger.record(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "checkpoint"))
        got = {r["parcel_id"]: (r["released"], r["missing"], r["without"]) for r in ledger.status(parcels, ledger.read(spark, path, schema), **names).collect()}
        assert got["silent"] == (False, ["dem", "soil"], ["irradiance"])
        assert got["p"] == ((False, ["soil"], ["irradiance"]) if n == 0 else (True, [], ["irradiance"]))
        assert got["q"] == [(False, ["dem", "soil"], ["irradiance"]), (False, ["dem"], ["irradiance"]), (True, [], [])][n]
    ledger.record(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "checkpoint"))  # nothing is new
    before = sorted(map(tuple, ledger.read(spark, path, schema).collect()))
    ledger.record(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "lost checkpoint"))  # all of it again
    again = ledger.read(spark, path, schema)
    assert sorted(map(tuple, ledger.latest(again).collect())) == sorted(map(tuple, ledger.latest(spark.createDataFrame(before, schema)).collect()))
    out = {(r["parcel_id"], r["source"]): r["payload"] for r in ledger.released(parcels, again, **names).collect()}
    assert out["p", "soil"] == "new" and ("silent", "dem") not in out
    gone = again.unionByName(arrivals(spark, [arrival("p", "dem", 9, None)]))
    assert {r["parcel_id"] for r in ledger.status(parcels, gone, **names).where("released").collect()} == {"q"}
    assert ledger.status(parcels, again.limit(0)).where("NOT released AND size(missing) = 12").count() == 3
