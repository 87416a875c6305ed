"""Every query with SQL gives what DuckDB gives; the others give rows."""

from __future__ import annotations

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from parcelworks.plans import catalog, land, works  # noqa: F401 - both add their queries
from parcelworks.plans import views as V

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    return round(float(v), 6) + 0.0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_duckdb(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    rows = sorted(str([plain(r[c]) for c in cols]) for r in got.collect())
    oracle = sorted(str([plain(dict(zip(names, r, strict=True))[c]) for c in cols]) for r in want.fetchall())
    assert rows == oracle


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, con, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_solar_takes_the_circular_mean_of_aspects(spark):
    """East and west cancel out or lie about south; a missing aspect says nothing, and
    canopy rules a square out."""
    from parcelworks.operators import scoring

    cells = [("p", 1.0, 1.0, 5.0, 100.0, 0.5, False), ("p", 2.0, 1.0, 5.0, 260.0, None, False), ("p", 3.0, 1.0, 5.0, None, None, False)]
    cells += [("q", 1.0, 1.0, 5.0, 180.0, 1.0, True)]
    table = spark.createDataFrame(cells, "parcel_id string, x double, y double, slope_pct double, aspect_deg double, shading_score double, canopy boolean")
    points = spark.createDataFrame([("p", 1, 2.0, 1.0, 0.0), ("q", 1, 1.0, 1.0, 0.0)], "parcel_id string, point_id int, x double, y double, production_distance double")
    got = scoring.solar_candidates(points, table).collect()
    south = scoring.solar_candidates(points, table.where("parcel_id = 'p'").fillna({"aspect_deg": 180.0}).withColumn("aspect_deg", F.lit(180.0))).collect()
    assert [r["parcel_id"] for r in got] == ["p"] and got[0]["aspect_factor"] == pytest.approx(south[0]["aspect_factor"]) and got[0]["shading_factor"] == 0.5


def test_a_year_without_rows_counts(spark):
    from parcelworks.operators import records

    rows = [("p", f"{y}-05-01", 10.0, 5.0, 100.0, 3.0, 90.0) for y in (2020, 2022)]
    table = spark.createDataFrame(rows, "parcel_id string, date string, tmax double, tmin double, precip double, wind_speed double, wind_dir double").withColumn("date", F.to_date("date"))
    assert [(r["years_analyzed"], round(r["annual_precip_mm"], 6)) for r in records.climate_summary(table).collect()] == [(3, round(200 / 3, 6))]
    assert records.climate_summary(table, span=10).first()["annual_precip_mm"] == 20.0


def test_map_units_are_of_all_orders(spark, tmp_path):
    rows = [(i, "1-URGENT", i * 3, "F") for i in (1, 4999, 5000, 123456)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    assert {r["mukey"] for r in V.mapunits(spark, str(tmp_path)).collect()} == {"1", "4999", "5000", "123456"}


def chaikin(line, rounds):
    for _ in range(rounds):
        if len(line) < 3:
            break
        mid = [tuple((1 - w) * p + w * q for p, q in zip(a, b, strict=True)) for a, b in zip(line, line[1:], strict=False) for w in (0.25, 0.75)]
        line = [line[0], *mid, line[-1]]
    return line


def test_smoothed_lines_are_whole(spark, tmp_path):
    """Every point of a parcel is in its line, in order of its id."""
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in [*range(240), 1001, 5003, 5013]]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    lines = {}
    for r in sorted(V.points(spark, str(tmp_path)).collect(), key=lambda r: r["point_id"]):
        lines.setdefault(r["parcel_id"], []).append((r["x"], r["y"]))
    want = {(k, i): p for k, line in lines.items() for i, p in enumerate(chaikin(line, 2))}
    got = {(r["parcel_id"], r["seq"]): (r["x"], r["y"]) for r in catalog.QUERIES["smoothed_lines"](spark, str(tmp_path)).collect()}
    assert len(want) == 4 * len(rows) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_soil_under_zones_of_any_shape(spark):
    from parcelworks.operators import soil

    ring = "ring_x array<double>, ring_y array<double>"
    zones = [("p", "far", [900.0, 910.0, 910.0], [0.0, 0.0, 10.0]), ("p", "ell", [0.0, 600.0, 600.0, 300.0, 300.0, 0.0], [0.0, 0.0, 300.0, 300.0, 600.0, 600.0]), ("q", "none", [0.0, 1.0, 1.0], [0.0, 0.0, 1.0])]
    units = [("p", "1", [0.0, 600.0, 600.0, 0.0], [0.0, 0.0, 300.0, 300.0]), ("p", "2", [0.0, 600.0, 600.0, 0.0], [300.0, 300.0, 450.0, 450.0]), ("p", "3", [0.0, 600.0, 600.0], [450.0, 450.0, 600.0])]
    got = soil.area_weighted_ksat(
        spark.createDataFrame(zones, f"parcel_id string, zone_id string, {ring}"), spark.createDataFrame(units, f"parcel_id string, mukey string, {ring}"),
        spark.createDataFrame([("1", "10"), ("2", "40"), ("3", "n/a")], "mukey string, ksat_r string"), bin_m=100.0,
    )
    rows = {r["zone_id"]: (r["ksat_r"], r["coverage"]) for r in got.collect()}
    assert rows["far"] == rows["none"] == (None, None)
    assert rows["ell"] == (pytest.approx((10 * 180000 + 40 * 45000) / 225000), pytest.approx(225000 / 270000))


def test_access_points_and_snapping(spark):
    from parcelworks.operators import records

    points = spark.createDataFrame([("p", 1, 5.0, 2.0), ("p", 2, 5.0, 5.0), ("q", 3, 0.0, 0.0)], "parcel_id string, anchor_id int, x double, y double")
    rings = spark.createDataFrame([("p", [0.0, 10.0, 10.0, 0.0], [0.0, 0.0, 10.0, 10.0])], "parcel_id string, ring_x array<double>, ring_y array<double>")
    assert {r["anchor_id"]: r["edge_distance"] for r in records.edge_distance(points, rings).collect()} == {1: 2.0, 2: 5.0, 3: None}
    assert records.validate_access_points(points.where("anchor_id = 1"), rings).collect() == points.where("anchor_id = 1").collect()
    for bad in (2, 3):
        with pytest.raises(Exception, match="access point"):
            records.validate_access_points(points.where(f"anchor_id = {bad}"), rings).collect()
    nan, inf = float("nan"), float("inf")
    cells = spark.createDataFrame([("p", 0, 0, inf), ("p", 0, 1, 1.0), ("p", 1, 0, 2.0), ("p", 1, 1, nan), ("p", 0, 2, None), ("q", 0, 0, inf)], "parcel_id string, r int, c int, cost double")
    got = {r["anchor_id"]: (r["r"], r["c"]) for r in records.snap_to_cells(points, cells, "anchor_id", 5.0, 5.0, 0.0, 10.0).collect()}
    assert got == {1: (1, 0), 2: (0, 1), 3: (None, None)}
