"""Contours as lines, valleys inside zones, nearest shapes, roads of several parcels."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelworks.operators import grid, lines, records, regions, sinks
from parcelworks.operators import polygons as P


def pieces(z, interval):
    """Marching squares, one cell after the other: (level, r1, c1, r2, c2)."""
    low, high = np.nanmin(z), np.nanmax(z)
    out = []
    for level in np.arange(math.ceil(low / interval) * interval, high, interval):
        for r in range(z.shape[0] - 1):
            for c in range(z.shape[1] - 1):
                ring = ((r, c), (r, c + 1), (r + 1, c + 1), (r + 1, c))
                v = [z[p] for p in ring]
                if any(map(math.isnan, v)):
                    continue
                cuts = []
                for k in range(4):
                    a, b = v[k], v[(k + 1) % 4]
                    if (a >= level) != (b >= level):
                        t = (level - a) / (b - a)
                        p, q = ring[k], ring[(k + 1) % 4]
                        cuts.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
                if len(cuts) == 4 and (np.mean(v) >= level) != (v[0] >= level):
                    cuts = cuts[1:] + cuts[:1]
                out += [(float(level), *cuts[i], *cuts[i + 1]) for i in range(0, len(cuts), 2)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_contours_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    z = np.add.accumulate(rng.normal(0, 1, (14, 17)), axis=1)
    z[rng.random(z.shape) < 0.04] = np.nan
    got, want = P.contours(z, 0.5), pieces(z, 0.5)
    count, length = {}, {}
    for level, *p in want:
        count[level] = count.get(level, 0) + 1
        length[level] = length.get(level, 0) + math.hypot(p[2] - p[0], p[3] - p[1])
    for level, line in got:
        count[level] -= len(line) - 1
        length[level] -= np.hypot(*np.diff(line, axis=0).T).sum()
    assert set(count.values()) == {0} and max(map(abs, length.values())) < 1e-9
    # An open line ends at the rim or at a gap; all others are rings.
    for _, line in got:
        if not np.array_equal(line[0], line[-1]):
            for r, c in (line[0], line[-1]):
                near = [(math.floor(r) + i, math.floor(c) + j) for i in (-1, 0, 1, 2) for j in (-1, 0, 1, 2)]
                assert any(not (0 <= a < 14 and 0 <= b < 17) or np.isnan(z[a, b]) for a, b in near)


def test_contours_of_a_cone_and_of_a_ramp():
    r, c = np.indices((21, 21))
    got = P.contours(-np.hypot(r - 10, c - 10), 3.0)
    assert all(np.array_equal(x[0], x[-1]) for level, x in got if level > -10) and len([1 for level, _ in got if level == -6.0]) == 1
    levels = {level for level, _ in P.contours(np.tile(np.arange(4.0), (3, 1)), 1.0)}
    assert {1.0, 2.0} <= levels and 3.0 not in levels
    assert P.contours(np.full((3, 3), np.nan)) == [] and P.contours(np.ones((3, 3))) == []


def shape_rows(spark, rows, id_, more=""):
    return spark.createDataFrame([(k, i, *m, [np.asarray(r, float).tolist() for r in s] if s is not None else None) for k, i, *m, s in rows], f"parcel_id string, {id_} long, {more}rings {regions.RINGS}")


def test_nearest_shape_is_that_of_brute_force(spark):
    rng = np.random.default_rng(2)

    def box(size):
        x, y = rng.uniform(0, 3000, 2)
        w, h = rng.uniform(1, size, 2)
        return [np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])]

    zones = [("p" if i % 2 else "q", i, box(200)) for i in range(30)] + [("none", 90, box(10)), ("p", 91, None)]
    roads = [("p" if i % 3 else "q", i, [rng.uniform(0, 3000, 2) + np.cumsum(rng.normal(0, 60, (6, 2)), axis=0)]) for i in range(24)] + [("p", 50, [[(1e5, 1e5), (1e5, 2e5)]]), ("q", 60, None)]
    roads += [("p", 70, roads[1][2])]  # the same line: the smaller id
    got = {(r["parcel_id"], r["zone_id"]): (r["road_id"], r["distance"], r["status"]) for r in lines.nearest_shape(shape_rows(spark, zones, "zone_id"), shape_rows(spark, roads, "road_id"), "zone_id", "road_id", "area", "line", start=5.0).collect()}
    assert len(got) == len(zones) and got["none", 90] == (None, None, "no_feature")
    for k, i, s in zones[:30]:
        want = min((P.distance(s, o, "area", "line"), j) for key, j, o in roads if key == k and o is not None)
        assert got[k, i] == (want[1], pytest.approx(want[0]), "computed")


def test_distance_of_shapes():
    box = [np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)]
    assert P.distance(box, [np.array([(5.0, 5.0)])], "area", "line") == 0 and P.distance(box, [np.array([(5.0, 5.0)])], "ring", "line") == 5
    assert P.distance(box, [np.array([(-5, 5), (20, 5)], float)], "area", "line") == 0 and P.distance(box, [], "area", "line") == math.inf
    assert P.distance([np.array([(13.0, 14.0)])], box, "line", "area") == 5
    assert P.distance(box, [np.array([(2, 2), (3, 2), (3, 3)], float)], "ring", "area") == 2


def test_keypoints_and_what_is_near(spark):
    points = shape_rows(spark, [("p", 1, 101.234, [[(0, 0)]]), ("p", 2, 90.0, [[(25, 5)]]), ("q", 3, 1.0, [[(0, 0)]])], "point_id", "elevation_m double, ")
    zones = shape_rows(spark, [("p", 7, 95.0, [[(20, 0), (30, 0), (30, 10), (20, 10)]]), ("p", 8, 80.0, [[(0, 30), (5, 30), (5, 40)]])], "zone_id", "representative_elevation_m double, ")
    got = {r["point_id"]: (r["status"], r["zone_id"], r["distance_m"], r["elevation_differential_m"]) for r in lines.feature_relationships(points, zones, "point_id", "zone_id").collect()}
    assert got == {1: ("computed", 7, 20.0, 6.23), 2: ("computed", 7, 0.0, -5.0), 3: ("no_feature", None, None, None)}


def test_valleys_inside_a_zone(spark):
    """Two branches weigh by their points; the larger watershed counts; one point or
    none says nothing."""
    at = "parcel_id string, valley_id int, max_acres double, branch_id int, seq int, r int, c int, x double, y double, z double"
    rows = [("p", 0, 4.0, 0, r, r, 1, 7.5, -(r + 0.5) * 5, 20.0 - r) for r in range(10)] + [("p", 1, 9.0, 0, r, r, 3, 17.5, -(r + 0.5) * 5, 20.0 - 2 * r) for r in range(2, 5)]
    rows += [("p", 2, 50.0, 0, 0, 4, 2, 12.5, -22.5, 3.0), ("q", 0, 1.0, 0, 0, 0, 0, 2.5, -2.5, 1.0)]
    zones = shape_rows(spark, [("p", 1, [[(0, -30), (20, -30), (20, 0), (0, 0)]]), ("p", 2, [[(100, -30), (120, -30), (120, 0)]]), ("q", 1, [[(0, -9), (9, -9), (9, 0), (0, 0)]])], "zone_id")
    got = {(r["parcel_id"], r["zone_id"]): (r["terrain_gradient"], r["contributing_acres"]) for r in lines.valley_inputs(zones, spark.createDataFrame(rows, at), 5.0, 5.0).collect()}
    assert got["p", 1] == (pytest.approx((20 * 6 + 40 * 3) / 9), 9.0) and got["p", 2] == got["q", 1] == (None, None)


def test_a_road_is_a_road_of_each_parcel(spark):
    rows = [(k, 30, "Mill Lane", None, "line 1", [[0.0, 0.0], [1.0, 1.0]]) for k in ("p", "q", "p")] + [("q", 31, "Other", None, "line 1", [[0.0, 0.0]]), ("p", 32, " ", "Full", "line 2", [[2.0, 2.0]])]
    table = spark.createDataFrame(rows, "parcel_id string, layer int, name string, fullname string, geometry string, coordinates array<array<double>>")
    got = sorted((r["parcel_id"], r["layer"], r["name"], r["geometry"]) for r in records.farm_roads(table).collect())
    assert got == [("p", 30, "Mill Lane", "line 1"), ("p", 32, "Full", "line 2"), ("q", 30, "Mill Lane", "line 1")]
    ids = sorted((r["parcel_id"], r["id"]) for r in sinks.road_layer(table).select("parcel_id", "feature.id").collect())
    assert ids == [("p", "farm-road-0"), ("p", "farm-road-1"), ("q", "farm-road-0")]


def test_components_that_have_not_settled_are_an_error(spark):
    cells = spark.createDataFrame([("p", 0, c, True) for c in range(40)], "parcel_id string, r int, c int, hit boolean")
    with pytest.raises(RuntimeError, match="settle"):
        grid.components(cells, most=2)


def test_road_footprints_leave_no_corner_to_touch(spark):
    cells = spark.createDataFrame([("p", 3, 3), ("p", 4, 4)], "parcel_id string, r int, c int")
    got = regions.road_footprints(cells, 5.0, 5.0).select(regions.area("rings").alias("a"), F.size("rings").alias("n")).first()
    assert (got["a"], got["n"]) == (14 * 25.0, 1)
