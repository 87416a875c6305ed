"""Structure sites: squares, tiers and what rules a square out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelworks.operators import polygons as P
from parcelworks.operators import regions, sites


def box(x0, y0, x1, y1):
    return [[[x0, y0], [x1, y0], [x1, y1], [x0, y1]]]


HOME = box(0.0, 0.0, 200.0, 200.0)


def region(value):
    return regions.region(value)


def test_squares_are_cut_and_kept_clear():
    got = sites.squares(region(HOME), [], [], [], None, "", 0.0, 0.1, 25.0)
    side = np.sqrt(0.1 * sites.X.SQUARE_METERS_PER_ACRE)
    assert len(got) == 49 and all(s[3] == pytest.approx(side * side) for s in got)  # points on the edge aren't inside
    water = region(box(80.0, 80.0, 120.0, 120.0))
    clear = sites.squares(region(HOME), [], water, [], None, "", 0.0, 0.1, 25.0)
    assert 0 < len(clear) < 49 and all(s[6] > 24.9 for s in clear)
    trees = sites.squares(region(HOME), [], [], water, None, "", 0.0, 0.1, 25.0)
    assert len(clear) < len(trees) < 49 and all(P.distance(s[-1], water) > 0 for s in trees)
    line = region([[[0.0, 0.0], [200.0, 0.0]]])
    near = sites.squares(region(HOME), region(box(50.0, 50.0, 90.0, 90.0)), [], [], line, "line", 15.0, 0.1, 25.0)
    assert near and all(s[4] <= 15 and s[5] is not None for s in near)
    assert sites.squares(region(HOME), [], [], [], [], "line", 15.0, 0.1, 25.0) == []


def table(spark, rows, *columns):
    return spark.createDataFrame(rows, ", ".join(["parcel_id string", *(f"{c} {regions.RINGS}" for c in columns)]))


def test_tiers(spark):
    """Corridor; corridor too steep, so a mapped road; nothing mapped; not asked; canopy."""
    keys = ["corridor", "fallback", "roadless", "unasked", "wooded"]
    parcels = table(spark, [(k, HOME, box(120.0, 20.0, 180.0, 80.0), None, None) for k in keys], "rings", "production", "water", "trees")
    cells = spark.createDataFrame(
        [(k, r, c, 60.0 if k == "fallback" and r >= 30 else 4.0, 180.0, 1.0, k == "wooded") for k in keys for r in range(40) for c in range(40)],
        "parcel_id string, r int, c int, slope_pct double, aspect_deg double, shading_score double, canopy boolean")
    corridors = table(spark, [("corridor", box(0.0, 95.0, 200.0, 105.0)), ("fallback", box(0.0, 0.0, 200.0, 10.0)), ("wooded", HOME)], "rings")
    roads = table(spark, [("corridor", [[[0.0, 0.0], [9.0, 0.0]]]), ("fallback", [[[0.0, 200.0], [200.0, 200.0]]]), ("roadless", None), ("wooded", [[[0.0, 0.0], [200.0, 0.0]]])], "rings")
    got = sites.solar_sites(parcels, cells, corridors, roads, 5.0, 5.0, 0.0, 200.0)
    rows = [r.asDict() for r in got.collect()]
    by = {}
    for r in rows:
        by.setdefault(r["parcel_id"], []).append(r)
    assert {k: {r["road_proximity_source"] for r in v} for k, v in by.items()} == {"corridor": {"selected_road_corridor"}, "fallback": {"real_mapped_road"}, "unasked": {"unavailable"}}
    assert all(sorted(r["rank"] for r in v) == [1, 2, 3, 4, 5] for v in by.values())
    assert all(r["road"] <= 15 for r in by["corridor"]) and all(10 < r["road"] <= 150 for r in by["fallback"]) and all(r["road"] is None for r in by["unasked"])
    for r in rows:
        assert r["score"] == pytest.approx(25 * (1 - r["slope_pct"] / 20 + 1 + 1 + max(0, 1 - r["production"] / 100)), abs=0.06)
        assert r["production_zone_relationship"] in ("inside", "adjacent", "outside")
    best = sites.selected_site(got).select("parcel_id", "score").collect()
    assert {r["parcel_id"]: r["score"] for r in best} == {k: max(r["score"] for r in v) for k, v in by.items()}
    assert sites.solar_sites(parcels.where(F.lit(False)), cells, corridors, roads, 5.0, 5.0).count() == 0


def test_squares_of_many_parcels_are_each_as_alone(monkeypatch):
    """Some cut by an edge, some in a hole, some beside water; a parcel without ground, one without roads."""
    homes = [region(HOME), P.difference(region(HOME), region(box(60.0, 60.0, 90.0, 90.0))), [], region([[[0.0, 0.0], [150.0, 30.0], [60.0, 160.0]]]), region(HOME)]
    rest = [region(box(50.0, 50.0, 90.0, 90.0)), [], [], region(box(0.0, 0.0, 40.0, 40.0)), []], [[], region(box(120.0, 20.0, 180.0, 80.0)), [], [], []], [region(box(10.0, 10.0, 30.0, 60.0)), [], [], [], []]
    roads = [region([[[0.0, 0.0], [200.0, 0.0]]])] * 4 + [[]]
    for way in (("line", 30.0), (None, 0.0)):
        asked = roads if way[0] else None
        alone = [sites.squares(*x, asked and asked[k], *way, 0.1, 10.0) for k, x in enumerate(zip(homes, *rest, strict=True))]
        monkeypatch.setattr(P, "distance", None)  # distances are worked out side by side
        monkeypatch.setattr(sites, "TOGETHER", 37)
        got = [[] for _ in homes]
        for k, s in sites.squares_of(homes, *rest, asked, *way, 0.1, 10.0):
            got[k].append(s)
        monkeypatch.undo()
        assert [len(x) > 0 for x in got] == [True, True, False, True, way[0] is None]
        for a, b in zip(alone, got, strict=True):
            assert [s[:-1] for s in a] == [s[:-1] for s in b] and all(np.array_equal(np.concatenate(s[-1]), np.concatenate(t[-1])) for s, t in zip(a, b, strict=True))
        for home, cut in ((home, s[-1]) for home, found in zip(homes, got, strict=True) for s in found):
            assert P.area(P.difference(cut, home)) == pytest.approx(0, abs=1e-2)


def test_parcels_are_spread_before_their_squares(spark):
    parcels = table(spark, [(str(k), HOME, None, None, None, None) for k in range(40)], "rings", "production", "water", "trees", "roads").coalesce(1)
    got = sites.placed(parcels, None, 0.0, 0.1, 25.0)
    assert got.count() == 40 * 49
    assert got.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
