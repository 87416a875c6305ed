"""Work on many rows: regions side by side, small files dealt, nothing through the driver."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelworks.operators import grid, lines, regions
from parcelworks.operators import polygons as P
from parcelworks.plans import catalog, land, works  # noqa: F401 - both add their queries
from parcelworks.plans import views as V


def shapes(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        a = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 9)))
        ring = rng.uniform(0, 60, 2) + rng.uniform(5, 40, (len(a), 1)) * np.stack([np.cos(a), np.sin(a)], axis=1)
        out.append(P.union([[ring]]))
    return out


def test_many_arrangements_at_once_are_each_as_alone(monkeypatch):
    a, b = [*shapes(60, 1), []], [*shapes(60, 2), *shapes(1, 3)]
    every = lambda: [P.unions([list(x) for x in zip(a, b, strict=True)]), P.differences(a, b), P.intersections(a, b), P.buffers(a, 3.0), P.buffers(a, -2.0), P.buffers_lines(a, 2.0)]
    together = every()
    monkeypatch.setattr(P, "TOGETHER", 1)
    for whole, alone in zip(together, every(), strict=True):
        for one, other in zip(whole, alone, strict=True):
            assert len(one) == len(other) and all(np.array_equal(p, q) for p, q in zip(one, other, strict=True))
    for x, y, both, less in zip(a, b, together[2], together[1], strict=True):
        assert P.area(both) + P.area(less) == pytest.approx(P.area(x), abs=1e-3)


@pytest.mark.parametrize("kinds", [("area", "area"), ("line", "area"), ("ring", "line")])
def test_distances_are_those_of_each_pair(kinds):
    a, b = [*shapes(80, 4), []], shapes(81, 5)
    assert P.distances(a, b, *kinds).tolist() == [P.distance(x, y, *kinds) for x, y in zip(a, b, strict=True)]


def test_a_point_on_an_edge_is_not_off_it_by_rounding():
    box = [np.array([(13.0, 7.0), (13.0 + 47, 7.0), (13.0 + 47, 7.0 + 31), (13.0, 7.0 + 31)])]
    points = [[np.array([[60.0, y]])] for y in np.arange(7.13, 38, 0.37)] + [[np.array([[x, 38.0]])] for x in np.arange(13.1, 60, 0.53)]
    assert (P.distances(points, [box] * len(points), "line", "area") == 0).all()


def test_equally_near_zones_give_the_smaller_id(spark):
    """A point at the right edge of one zone and inside another that comes later."""
    spot = spark.createDataFrame([("p", 1, 60.0, 20.37)], "parcel_id string, point_id int, x double, y double").select("parcel_id", "point_id", regions.from_point("x", "y").alias("rings"))
    kinds = spark.createDataFrame([("p", 1, 13, 7, 60, 38), ("p", 2, 50, 0, 80, 40)], "parcel_id string, zone_id int, a int, b int, c int, d int")
    zones = kinds.select("parcel_id", "zone_id", V.box(*map(F.col, "abcd")).alias("rings"))
    got = lines.nearest_shape(spot, zones, "point_id", "zone_id", "line", "area").first()
    assert (got["zone_id"], got["distance"]) == (1, 0.0)


def test_crowded_parcels_are_searched_near(spark):
    """Shapes a metre apart, and one far off."""
    k = F.col("id")
    crowd = spark.range(900).select(F.lit("p").alias("parcel_id"), k.alias("a"), regions.from_point((k % 30).cast("double"), F.floor(k / 30).cast("double")).alias("rings"))
    right = crowd.withColumnRenamed("a", "b").withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p[0] + 0.2, p[1]))))
    far = spark.range(1).select(F.lit("p").alias("parcel_id"), F.lit(5000).cast("long").alias("a"), regions.from_point(F.lit(9000.0), F.lit(0.0)).alias("rings"))
    got = lines.nearest_shape(crowd.unionByName(far), right, "a", "b", "line", "line").collect()
    assert len(got) == 901 and all(r["a"] == r["b"] for r in got if r["a"] < 900)
    assert [(r["b"], round(r["distance"], 6)) for r in got if r["a"] == 5000] == [(29, 8970.8)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["step1_eligible", "cost_distance", "tree_search_space", "zone_service", "zone_conductivity", "snapped_anchors"])
def test_tables_that_grow_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan_of(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_rows_of_a_small_file_are_spread(spark):
    zones = spark.range(64, numPartitions=1).select(F.col("id").cast("string").alias("parcel_id"), F.lit(0).alias("zone_id"), V.box(0, 0, 30, 20).alias("rings"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df in (regions.zone_fences(zones), regions.buffered(zones, 2.0), regions.polygons_of(zones)):
        used = df.select(F.spark_partition_id().alias("i")).distinct().count()
        assert used == n > 1
    cells = spark.range(400, numPartitions=1).select((F.col("id") % 40).cast("string").alias("parcel_id"), F.floor(F.col("id") / 40).cast("int").alias("r"), F.lit(0).alias("c"), F.lit(1.0).alias("z"))
    assert grid.looked_at(cells, list(grid.EIGHT)).select(F.spark_partition_id()).distinct().count() == n


def test_kernels_of_parcels_are_spread(spark):
    from parcelworks.operators import kernels

    cells = spark.range(400, numPartitions=1).select((F.col("id") % 40).cast("string").alias("parcel_id"), F.floor(F.col("id") / 40).cast("int").alias("r"), F.lit(0).alias("c"), F.lit(1.0).alias("z"))
    got = kernels.per_parcel(cells, lambda pdf: pdf[["r", "c"]].copy(), "r int, c int")
    assert got.count() == 400
    assert got.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_aspects_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    """Cells with equal ground to the west and east: 0 or 360 is what SQL's sums leave."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    part = pa.table({"p_partkey": np.arange(80_000), "p_size": np.random.default_rng(7).integers(1, 51, 80_000).astype(np.int32)})
    pq.write_table(part, tmp_path / "part.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = {x[:3]: x[3:] for x in con.execute(catalog.ORACLE["horn_slope_aspect"]).fetchall()}
    got = {tuple(x)[:3]: tuple(x)[3:] for x in catalog.QUERIES["horn_slope_aspect"](spark, str(tmp_path)).collect()}
    assert len(got) == 80_000 and got == want


def test_buffers_of_convex_shapes_need_no_arrangement(monkeypatch):
    """Boxes, single segments and points have their curve for an outline; it is the arrangement's."""
    boxes = [[np.array([(0, 0), (30 + k, 0), (30 + k, 20), (0, 20)], float)] for k in range(5)]
    roads = [[np.array([(0, 0), (40 + k, 7)], float)] for k in range(5)] + [[np.array([(3.0, 4.0)])]]
    twice = lambda groups: [[*g, *g] for g in groups]  # noqa: E731 - two paths go through the arrangement
    want = P.buffers(twice(boxes), 3.0), P.buffers_lines(twice(roads), 8.0)
    monkeypatch.setattr(P, "_arranged", None)
    for got, other in zip((P.buffers(boxes, 3.0), P.buffers_lines(roads, 8.0)), want, strict=True):
        for a, b in zip(got, other, strict=True):
            assert len(a) == len(b) == 1 and np.allclose(a[0], b[0], atol=1e-4)


def test_shapes_apart_stay_as_they_are(monkeypatch):
    """Two boxes that meet and one far off: only the two are united."""
    a, b, c = ([np.array([(x, 0), (x + 10, 0), (x + 10, 10), (x, 10)], float)] for x in (0, 5, 100))
    alone, met = P.apart([a, c, b, []])
    assert alone == [c] and met == [a, b]
    assert P.apart([a, [], c]) == ([a, c], []) and P.apart([[]]) == ([], [])


def test_overlaps_side_by_side_are_those_of_each_pair():
    from parcelworks.operators import kernels

    a, b = ([r[0] for r in shapes(200, seed) if r][:120] for seed in (8, 9))
    b[0], a[1] = np.zeros((2, 2)), a[1] + 1000
    got = kernels.ring_overlaps(a, b)
    assert got[:2].tolist() == [0, 0] and (got > 0).sum() > 50
    assert np.allclose(got, [kernels.ring_overlap(*p.T, *q.T) for p, q in zip(a, b, strict=True)], atol=1e-9)


def test_overlaps_of_zones_are_spread(spark):
    assert catalog.QUERIES["zone_conductivity"](spark, "/root/testdata/sf0.001").count() > 0
    text = plan_of(catalog.QUERIES["zone_conductivity"](spark, "/root/testdata/sf0.001"))
    assert "REPARTITION_BY_NUM" in text


def test_groups_are_parted_side_by_side(monkeypatch):
    some = shapes(300, 11)
    groups = [some[at : at + k % 6] for k, at in enumerate(range(0, 290, 3))] + [[], [[]], [some[0], [], some[1]]]
    want = [P.apart(g) for g in groups]
    monkeypatch.setattr(P, "apart", None)
    for (a, b), (c, d) in zip(P.aparts(groups), want, strict=True):
        assert len(a) == len(c) and len(b) == len(d) and all(x is y for x, y in zip([*a, *b], [*c, *d], strict=True))


def test_rows_alone_in_their_batch_are_not_worked_on(monkeypatch):
    """Keys once in a batch go on as they are; many shapes of one key are united a few at a time."""
    import pyarrow as pa

    box = lambda x, y: [np.array([(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)], float)]
    regions_ = [box(k % 40, k // 40) for k in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array([k if k < 500 else -1 for k in range(2000)]), regions.encoded(regions_)], names=["k", "rings"])
    real, most = P.overlays, []
    monkeypatch.setattr(P, "overlays", lambda jobs, keep: most.extend(len(x[0]) for x in jobs) or real(jobs, keep))
    got = {k: r for b in regions._early([batch], ["k"]) for k, r in zip(b.column(0).to_pylist(), regions.decoded(b.column(1)), strict=True)}
    assert len(got) == 501 and P.area(got[-1]) == pytest.approx(1500)
    assert all(np.array_equal(got[k][0], regions_[k][0]) for k in range(500))
    assert 0 < len(most) < 40 and max(most) <= regions.HELD
    monkeypatch.setattr(regions, "decoded", None)
    assert sum(b.num_rows for b in regions._early([batch.slice(0, 500)], ["k"])) == 500


def test_rows_alone_and_others_of_one_batch(spark):
    k = F.col("id")
    rows = spark.range(2000, numPartitions=1).select(F.when(k < 500, k).otherwise(-1).cast("string").alias("parcel_id"), V.box(k % 40, F.floor(k / 40), k % 40 + 1, F.floor(k / 40) + 1).alias("rings"))
    got = {r["parcel_id"]: r["area"] for r in regions.union_by(rows, ["parcel_id"]).select("parcel_id", regions.area("rings").alias("area")).collect()}
    assert len(got) == 501 and got["-1"] == pytest.approx(1500) and all(v == pytest.approx(1) for p, v in got.items() if p != "-1")


def test_masks_of_cells_come_by_one_join_each(spark):
    """A task that sorts every layer beside the cells holds them all at once."""
    cells = spark.range(400, numPartitions=1).select(F.lit("p").alias("parcel_id"), F.floor(F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).cast("int").alias("c"), F.when(F.col("id") != 45, 1.0).alias("z"))
    one = spark.range(1).select(F.lit("p").alias("parcel_id"), V.box(5, -95, 95, -5).alias("rings"))
    twice = one.select("parcel_id", V.box(0, -30, 30, -10).alias("rings")).unionByName(one.select("parcel_id", V.box(20, -30, 50, -10).alias("rings")))
    for got, name, want in (
        (regions.exclusion_cells(cells, twice, one, 5.0, 5.0), "excluded", lambda r, c, inside, hit: not inside or hit),
        (regions.production_cells(cells, twice, one, 5.0, 5.0), "on_production", lambda r, c, inside, hit: inside and hit),
    ):
        assert plan_of(got).count("SortMergeJoin") == 1
        rows = got.collect()
        assert len(rows) == 400 and set(got.columns) == {*cells.columns, name}
        for r in rows:
            inside, hit = 1 <= r["r"] <= 18 and 1 <= r["c"] <= 18, 2 <= r["r"] <= 5 and r["c"] <= 9
            assert r[name] == (r["z"] is not None and want(r["r"], r["c"], inside, hit))
