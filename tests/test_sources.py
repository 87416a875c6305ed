from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from parcelworks.functions import factors as X
from parcelworks.operators import features
from parcelworks.sources import bronze
from parcelworks.streaming import bronze_loads


def answer(request: str, limit: float) -> str:
    return json.dumps({"Table": [["mukey", "pct"], [request, "5"], [request, None]]}) if request != "bad" else json.dumps({"error": "down"})


def test_retry_waits_longer_and_raises_the_last():
    limits = []

    def fail(limit):
        limits.append(limit)
        raise OSError("x")

    with pytest.raises(OSError):
        bronze.retry(fail, pause=0)
    assert limits == [30, 60, 90]


def test_remote_tables(spark, monkeypatch):
    rows = spark.createDataFrame([(r, answer(r, 1)) for r in ("a", "b")] + [("none", "{}")], "request string, body string")
    got = bronze.table_answer(rows, ["pct", "mukey", "missing"]).orderBy("request", F.col("pct").desc_nulls_last()).collect()
    assert [(r["mukey"], r["pct"], r["missing"]) for r in got] == [("a", "5", None), ("a", None, None), ("b", "5", None), ("b", None, None)]
    with pytest.raises(Exception, match="service error"):
        bronze.checked(spark.createDataFrame([("bad", answer("bad", 1))], "request string, body string")).collect()


def test_all_layers_failing_is_an_error(spark):
    df = spark.range(3)
    assert bronze.tolerant_union([df, df], [False, True]).count() == 3
    with pytest.raises(RuntimeError):
        bronze.tolerant_union([df], [True])


def test_incremental_load_reads_each_file_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for n in (3, 2):
        spark.range(n).write.mode("append").parquet(source)
        bronze_loads.load_new(spark, source, spark.range(1).schema, target, mark)
    assert spark.read.parquet(target).count() == 5


def test_factor_knots(spark):
    g = spark.sql("SELECT * FROM VALUES (1D, 1D), (0D, 0.6D), (-5D, 0.2D), (-9D, 0.2D) AS t(v, want)")
    assert g.where(F.abs(X.gravity_feed(F.lit(0.0), F.lit(5.0), F.col("v")) - F.col("want")) > 1e-9).count() == 0
    k = spark.sql("SELECT * FROM VALUES (0.1D, 1D), (100D, 0D), (NULL, 0.5D), (3.1622776601683795D, 0.5D) AS t(v, want)")
    assert k.where(F.abs(X.water_holding(F.col("v")) - F.col("want")) > 1e-9).count() == 0
    labels = spark.sql("SELECT * FROM VALUES ('46006', 'perennial'), ('x', 'unknown'), (NULL, 'unknown'), ('46000', 'unknown') AS t(v, want)")
    assert labels.where(X.stream_label(F.col("v")) != F.col("want")).count() == 0
    assert spark.range(1).select(X.is_erosion_prone(F.lit("0.32")), X.is_erosion_prone(F.lit(None).cast("string")), X.is_erosion_prone(F.lit("?"))).first()[:] == (True, False, False)


def test_features_are_checked(spark):
    good = features.make_feature(F.lit("a"), "soil", F.lit("x"), F.lit("low"), F.lit("n"), F.lit("Point"), F.array(F.lit(1.0)))
    made = spark.range(2).select(F.lit("p").alias("parcel_id"), good.alias("feature"))
    assert json.loads(features.collection(made).first()["geojson"])["features"][0]["properties"]["layer"] == "soil"
    bad = features.make_feature(F.lit("a"), "soil", F.lit("x"), F.lit("low"), F.lit(" "), F.lit("Point"), F.array(F.lit(1.0)))
    with pytest.raises(Exception, match="confidence_notes"):
        spark.range(1).select(bad.alias("f")).collect()


def test_road_layer_numbers_each_geometry_once(spark):
    from parcelworks.operators import sinks

    rows = [("p", 31, "", "Long Lane", "g1", [[0.0, 0.0], [1.0, 1.0]]), ("p", 30, None, None, "g2", [[0.0, 0.0], [2.0, 1.0]]), ("p", 32, "again", None, "g1", [[0.0, 0.0], [1.0, 1.0]]), ("p", 30, "x", None, None, None), ("p", 7, "other layer", None, "g3", [[0.0, 0.0]])]
    table = spark.createDataFrame(rows, "parcel_id string, layer int, name string, fullname string, geometry string, coordinates array<array<double>>")
    got = {r["id"]: r for r in sinks.road_layer(table).select("feature.id", "feature.properties.*", "feature.geometry.coordinates").collect()}
    assert {k: (r["label"], r["layer"], r["confidence"]) for k, r in got.items()} == {"farm-road-0": ("Unnamed road", "farm_road", "medium"), "farm-road-1": ("Long Lane", "farm_road", "medium")}
    assert got["farm-road-1"]["coordinates"] == [[0.0, 0.0], [1.0, 1.0]]


def test_prime_farmland_flags_drop_nothing(spark):
    from parcelworks.operators import sinks

    zones = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3), (None, 4)], "parcel_id string, zone int")
    units = spark.createDataFrame([("p", "Prime farmland if drained"), ("p", None), ("q", "Not prime farmland")], "parcel_id string, farmlndcl string")
    got = {r["zone"]: r for r in sinks.prime_farmland_flags(zones, units, X.is_prime_farmland(F.col("farmlndcl"))).collect()}
    assert {k: r["prime_farmland_conflict"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False}
    assert got[1]["prime_farmland_note"] == sinks.PRIME_FOUND and got[4]["prime_farmland_note"] == sinks.PRIME_NONE
