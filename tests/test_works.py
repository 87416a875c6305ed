"""Water zones and road corridors against plain versions."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelworks.operators import corridors, features, regions, reports, sinks, waterzones
from parcelworks.operators import polygons as P

HOME = [np.array([(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)])]
NOWHERE = "parcel_id string, rings array<array<array<double>>>"


def box(x0, y0, x1, y1):
    return [[[x0, y0], [x1, y0], [x1, y1], [x0, y1]]]


def arrays(*boxes):
    return [np.array(r) for b in boxes for r in b]


def spread(spans):
    return {(int(r), int(c)) for r, a, b in spans for c in range(a, b + 1)}


@pytest.mark.parametrize("meters", [3.0, 7.5, 11.3, 42.5])
def test_reach_is_exact(meters):
    """Bent ground with a hole; 7.5 and 42.5 m put centres exactly at the limit."""
    ell = [np.array([(20.0, 20.0), (60.0, 20.0), (60.0, 40.0), (40.0, 40.0), (40.0, 70.0), (20.0, 70.0)]), np.array([(25.0, 25.0), (25.0, 35.0), (35.0, 35.0), (35.0, 25.0)])]
    got = spread(waterzones._in_reach(HOME, ell, meters, 5.0, 5.0, 0.0, 100.0))
    want = {(r, c) for r in range(20) for c in range(20) if P.distance([np.array([[(c + 0.5) * 5, 100 - (r + 0.5) * 5]])], ell, "line", "area") <= meters}
    assert got == want and 0 < len(want) <= 400


def test_middle_of_ground():
    holed = P.oriented(arrays(box(0.0, 0.0, 10.0, 10.0), box(1.0, 1.0, 5.0, 9.0)))
    x, y = P.centroid(holed)
    assert x == pytest.approx((100 * 5 - 32 * 3) / 68) and y == pytest.approx(5.0)
    far = [r + [5e5, 4e6] for r in holed]
    assert P.centroid(far) == pytest.approx((x + 5e5, y + 4e6), abs=1e-6)


def test_each_gate_alone(spark):
    """One cell a gate; a parcel without production has none that passes."""
    cells = [("p", r, c, None if (r, c) == (0, 0) else 1.0, 9000 if (r, c) == (1, 1) else 4, (r, c) == (2, 2)) for r in range(10) for c in range(10)]
    cells += [("q", 5, 5, 1.0, 1, False)]
    table = spark.createDataFrame(cells, "parcel_id string, r int, c int, z double, accumulation long, canopy boolean")
    homes = spark.createDataFrame([("p", box(0.0, -50.0, 45.0, 0.0)), ("q", box(0.0, -50.0, 50.0, 0.0))], NOWHERE)
    fields = spark.createDataFrame([("p", 0, box(20.0, -30.0, 30.0, -20.0), box(20.0, -30.0, 25.0, -20.0))], "parcel_id string, patch_id int, rings array<array<array<double>>>, fill array<array<array<double>>>")
    roads = spark.createDataFrame([("p", box(0.0, -50.0, 50.0, -45.0))], NOWHERE)
    got = {(r["parcel_id"], r["r"], r["c"]) for r in waterzones.gated(table, fields, homes, roads, 5.0, 5.0, service=16.0, setback=3.0).where("water_eligible").collect()}

    def far(x, y, x0, y0, x1, y1):
        return math.hypot(max(x0 - x, 0, x - x1), max(y0 - y, 0, y - y1))

    want = set()
    for p, r, c, z, n, tree in cells:
        x, y = (c + 0.5) * 5, -(r + 0.5) * 5
        ok = p == "p" and z is not None and n * 25 / 4046.8564224 <= 20 and not tree and x < 45 and y > -45
        if ok and far(x, y, 20, -30, 30, -20) <= 16 and far(x, y, 20, -30, 25, -20) >= 3:
            want.add((p, r, c))
    assert got == want and len(want) > 20


def plain_zone(eligible, total, target, floor, home, ground, service):
    """Clusters by flooding, growth by looking through the whole rim."""
    left, best = {tuple(map(int, x)) for x in np.argwhere(eligible)}, None

    def shape(cells):
        mask = np.zeros(eligible.shape, bool)
        for cell in cells:
            mask[cell] = True
        return P.intersection(P.outline(mask, 5.0, 5.0, 0.0, 100.0), home)

    def sides(cell):
        return [(cell[0] + a, cell[1] + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]

    while left:
        todo = [left.pop()]
        cluster = set(todo)
        while todo:
            for n in sides(todo.pop()):
                if n in left:
                    left.remove(n)
                    cluster.add(n)
                    todo.append(n)
        if P.area(shape(cluster)) < floor * 4046.8564224:
            continue
        grown = {max(cluster, key=lambda x: (total[x], -x[0], -x[1]))}
        while len(grown) < target:
            rim = {n for cell in grown for n in sides(cell) if n in cluster} - grown
            if not rim:
                break
            grown.add(max(rim, key=lambda x: (total[x], -x[0], -x[1])))
        x, y = P.centroid(shape(grown))
        if P.distance([np.array([[x, y]])], ground, "line", "area") <= service:
            rank = sum(total[c] for c in grown), x, y
            best = max(best, (rank, grown), key=lambda b: b[0]) if best else (rank, grown)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_best_zone_like_a_plain_one(seed):
    rng = np.random.default_rng(seed)
    eligible = rng.random((20, 20)) < 0.62
    total = rng.integers(1, 9, (20, 20)).astype(float)  # many ties
    z, slope = rng.random((20, 20)) * 10, np.where(rng.random((20, 20)) < 0.1, np.nan, 7.0)
    home, ground = arrays(box(3.0, 4.0, 93.0, 97.0)), arrays(box(70.0, 10.0, 90.0, 30.0))
    got = waterzones.best_zone(eligible, z, total, slope, home, ground, 5.0, 5.0, 0.0, 100.0, service=45.0, least_acres=0.05, target_acres=0.1)
    want = plain_zone(eligible, total, math.floor(0.1 / (25 / 4046.8564224)), 0.05, home, ground, 45.0)
    assert (got is None) == (want is None)
    if got:
        assert set(got["cells"]) == want[1] and got["rank"] == pytest.approx(want[0])
        assert P.area(got["fill"]) <= P.area(got["rings"]) + 1e-6
        assert got["representative_elevation_m"] == np.median([z[c] for c in want[1]])


def test_zone_limits():
    flat = np.ones((20, 20))
    one = np.zeros((20, 20), bool)
    one[2:6, 2:6] = True  # 400 square metres: 0.0988 acres
    near = arrays(box(40.0, 60.0, 60.0, 80.0))
    args = flat, flat, flat, HOME, near, 5.0, 5.0, 0.0, 100.0
    assert waterzones.best_zone(one, *args) is None  # below 0.1 acres
    one[6, 2] = True
    assert len(waterzones.best_zone(one, *args)["cells"]) == 17
    assert waterzones.best_zone(one, *args, service=1.0) is None
    assert waterzones.best_zone(one, flat, flat, flat, HOME, [], 5.0, 5.0, 0.0, 100.0) is None
    every = waterzones.best_zone(np.ones((20, 20), bool), *args)
    assert len(every["cells"]) == math.floor(0.5 * 4046.8564224 / 25)
    thin = np.zeros((20, 20), bool)
    thin[5] = True  # an opening leaves nothing, so the zone itself is drawn
    got = waterzones.best_zone(thin, *args)
    assert P.area(got["fill"]) == pytest.approx(P.area(got["rings"]))


def test_relationships_and_soil(spark):
    zones = spark.createDataFrame([("p", 0, 5.0, 5.0, 12.0, box(0.0, 0.0, 10.0, 10.0)[:1] + [[[2.0, 2.0], [2.0, 4.0], [4.0, 4.0], [4.0, 2.0]]]), ("q", 0, 5.0, 5.0, 1.0, box(0.0, 0.0, 10.0, 10.0))], "parcel_id string, zone_id int, x double, y double, representative_elevation_m double, rings array<array<array<double>>>")
    fields = spark.createDataFrame([("p", 0, box(0.0, 0.0, 20.0, 20.0), 11.0), ("p", 1, box(105.0, 0.0, 120.0, 20.0), 10.0), ("p", 2, box(900.0, 0.0, 920.0, 20.0), 0.0), ("p", 3, box(-20.0, 5.0, -15.0, 9.0), 10.0)], "parcel_id string, patch_id int, rings array<array<array<double>>>, median_z double")
    got = [(r["production_area_id"], r["elevation_differential_m"], r["distance_m"], r["gradient_pct"], r["above_production_area"], r["place"]) for r in waterzones.relationships(zones, fields).orderBy("place").collect()]
    assert got == [(1, 2.0, 100.0, 2.0, True, 1), (3, 2.0, 20.0, 10.0, True, 2), (0, 1.0, 0.0, 0.0, True, 3)]
    units = spark.createDataFrame([("p", "1", box(0.0, 0.0, 5.0, 10.0)), ("p", "2", box(5.0, 0.0, 7.5, 10.0)), ("p", "3", box(7.5, 0.0, 10.0, 10.0))], "parcel_id string, mukey string, rings array<array<array<double>>>")
    ksat = spark.createDataFrame([("1", "10"), ("2", "40"), ("3", "n/a")], "mukey string, ksat_r string")
    soil = {r["parcel_id"]: (r["ksat"], r["coverage"]) for r in waterzones.soil_under(zones, units, ksat).collect()}
    assert soil["p"] == (pytest.approx((46 * 10 + 25 * 40) / 71), pytest.approx(71 / 96)) and soil["q"] == (None, None)


def test_network_of_a_strip():
    """A road along one row, a steep cell on its way, production at its end."""
    shape = (3, 30)
    cost = np.full(shape, np.inf)
    cost[1] = 1.0
    z = np.zeros(shape)
    z[1, 15:] = 2.0
    slope = np.full(shape, 4.0)
    slope[1, 15] = 24.0
    demand = np.zeros(shape, bool)
    demand[1, 27:] = True
    pond = np.zeros(shape, bool)
    args = cost, z, slope, demand, pond, (0.0, 7.0), 5.0, 5.0, 0.0, 15.0
    got = corridors.network(*args, radius=10.0, per_acre=1e5)
    assert got["stop_reason"] == "all_demand_served" and len(got["branches"]) == 1
    b = got["branches"][0]
    # To the cell from which all three are within 10 m; one more would serve nothing new.
    assert b["cells"] == [(1, c) for c in range(28)] and b["length_meters"] == 135.0 and b["joins_branch_index"] is None and b["branch_role"] == "trunk"
    assert b["max_grade_pct"] == 24.0 and b["steep_meters"] == 5.0 and b["avg_grade_pct"] == pytest.approx(40 / 27) and b["production_cells_crossed"] == 1
    assert b["line"][0] == [2.5, 7.5, 0.0] and b["line"][-1] == [137.5, 7.5, 2.0]
    short = corridors.network(*args, radius=10.0, per_acre=1e5, least=200.0)
    assert short["stop_reason"] == "corridor_too_short" and short["branches"] == [] and short["unserved_acres"] == pytest.approx(3 * 25 / 4046.8564224)
    shut = corridors.network(np.full(shape, np.inf), *args[1:])
    assert shut["stop_reason"] == "no_eligible_anchor" and shut["unserved_acres"] == short["unserved_acres"]
    nobody = corridors.network(cost, z, slope, np.zeros(shape, bool), *args[4:])
    assert nobody["stop_reason"] == "no_demand" and nobody["branches"] == []


def test_network_reaches_water():
    shape = (9, 40)
    cost, flat, pond = np.ones(shape), np.zeros(shape), np.zeros(shape, bool)
    pond[6:9, 20:24] = True
    cost[pond] = np.inf
    demand = np.zeros(shape, bool)
    demand[0, 38:] = True
    got = corridors.network(cost, flat, flat, demand, pond, (0.0, 45.0), 5.0, 5.0, 0.0, 45.0, radius=10.0, per_acre=1e5)
    last = got["branches"][-1]
    assert last["branch_role"] == "water_spur" and last["newly_served_acres"] == 0.0 and last["joins_branch_index"] == 0
    r, c = last["cells"][-1]
    assert not pond[r, c] and pond[max(r - 1, 0) : r + 2, max(c - 1, 0) : c + 2].any()
    assert not any(pond[x] for x in got["cells"])


def chain(spark):
    """Three parcels: one with all, one without an anchor, one that is all shut."""
    rows = [(p, r, c, 0.1 * c, 2.0 if p != "shut" else None, 0.0, False) for p in ("all", "lost", "shut") for r in range(20) for c in range(60)]
    cells = spark.createDataFrame(rows, "parcel_id string, r int, c int, z double, slope_pct double, tpi double, canopy boolean")
    names = ["all", "lost", "shut"]
    homes = spark.createDataFrame([(p, box(0.0, 0.0, 300.0, 100.0)) for p in names], NOWHERE)
    fills = spark.createDataFrame([(p, box(250.0, 20.0, 290.0, 60.0)) for p in names], NOWHERE)
    ponds = spark.createDataFrame([("all", box(100.0, 0.0, 120.0, 20.0))], NOWHERE)
    floods = spark.createDataFrame([("all", box(40.0, 0.0, 60.0, 100.0))], NOWHERE)
    priced = corridors.priced(cells, homes, fills, ponds, floods, 5.0, 5.0, 0.0, 100.0)
    anchors = spark.createDataFrame([("all", 0.0, 50.0), ("shut", 0.0, 50.0)], "parcel_id string, x double, y double")
    return priced, corridors.networks(priced, anchors, 5.0, 5.0, 0.0, 100.0, per_acre=1e4), floods


def test_corridors_of_parcels(spark):
    priced, found, floods = chain(spark)
    marks = {(r["r"], r["c"]): r for r in priced.where("parcel_id = 'all'").collect()}
    for (r, c), row in marks.items():
        x, y = (c + 0.5) * 5, 100 - (r + 0.5) * 5
        assert row["flood"] == (40 < x < 60) and row["on_production"] == (250 < x < 290 and 20 < y < 60)
        if abs(math.hypot(max(100 - x, 0, x - 120), max(y - 20, 0)) - 25) > 0.1:
            assert row["near_pond"] == (math.hypot(max(100 - x, 0, x - 120), max(y - 20, 0)) < 25) == (row["cost"] is None)
    rows = {r["parcel_id"]: r for r in found.collect()}
    assert set(rows) == {"all", "shut"} and rows["shut"]["stop_reason"] == "no_eligible_anchor"
    assert rows["all"]["stop_reason"] == "all_demand_served" and not any(marks[c["r"], c["c"]]["near_pond"] for c in rows["all"]["cells"])
    each = corridors.branches(found, floods).orderBy("branch_index").collect()
    assert each[0]["crosses_floodplain"] and each[0]["branch_role"] == "trunk" and each[-1]["branch_role"] == "water_spur"
    ground = {r["parcel_id"]: r["a"] for r in corridors.ground(found, 5.0, 5.0, 0.0, 100.0).select("parcel_id", regions.area("rings").alias("a")).collect()}
    assert ground == {"all": pytest.approx(25.0 * len(rows["all"]["cells"]))}


def test_layers(spark):
    _, found, floods = chain(spark)
    every = corridors.branches(found, floods)
    made = every.withColumn("is_fallback", F.lit(True)).withColumn("avg_grade_pct", F.when(F.col("branch_index") == 0, 12.34).otherwise(3.0))
    got = json.loads(features.collection(sinks.corridor_layer(made)).first()["geojson"])["features"]
    first, last = got[0]["properties"], got[-1]["properties"]
    assert got[0]["id"] == "road-corridor-1" and got[0]["geometry"]["type"] == "LineString" and first["branch_role"] == "trunk"
    assert "average grade (12.3%)" in first["confidence_notes"] and "floodplain/hydric ground —" in first["confidence_notes"] and "DEM-only fallback" in first["confidence_notes"]
    assert "average grade" not in last["confidence_notes"] and last["confidence_notes"].endswith("construction-ready alignment.")
    assert first["constraints_satisfied"] == ["outside_pond_zone", "grade_within_max"] and first["length_ft"] == pytest.approx(every.orderBy("branch_index").first()["length_meters"] / 0.3048, abs=0.05)
    square = [box(0.0, 0.0, 1.0, 1.0)]
    zones = spark.createDataFrame([("p", 0, square, square, 12.345, 3.0), ("q", 0, square, square, 1.0, 1.0)], "parcel_id string, zone_id int, coordinates array<array<array<array<double>>>>, fill array<array<array<array<double>>>>, contributing_area_cells double, slope_pct double")
    served = spark.createDataFrame([("p", 0, 7, -1.0, 30.0, -3.33, False, 2), ("p", 0, 9, 2.0, 10.0, 20.0, True, 1)], "parcel_id string, zone_id int, production_area_id int, elevation_differential_m double, distance_m double, gradient_pct double, above_production_area boolean, place int")
    rows = sinks.water_zone_layer(zones, served).collect()
    assert [r["parcel_id"] for r in rows] == ["p"]
    p = rows[0]["feature"]["properties"]
    assert p["served_production_area_ids"] == [7, 9] and p["primary_production_area_relationship"]["production_area_id"] == 9 and p["contributing_area_cells"] == 12.35


def test_summaries(spark):
    _, found, floods = chain(spark)
    every = corridors.branches(found, floods)
    got = {r["parcel_id"]: r["summary"] for r in reports.corridor_summary(found, every).collect()}
    rows, whole = every.orderBy("branch_index").collect(), found.where("parcel_id = 'all'").first()
    want = [f"Road network: {len(rows)} branch(es), {whole['total_length_meters']:.0f}m total length, {whole['total_served_acres']:.2f} acres served, {whole['unserved_acres']:.2f} acres unserved (stop_reason=all_demand_served)."]
    for b in rows:
        joins = "" if b["joins_branch_index"] is None else f", joins branch {b['joins_branch_index']}"
        cross = " [crosses floodplain]" * b["crosses_floodplain"] + " [crosses production zone]" * b["crosses_production_zone"]
        want.append(f"  - Branch {b['branch_index']} ({b['branch_role']}{joins}): {b['length_meters']:.0f}m, {b['avg_grade_pct']:.1f}% avg grade, {b['newly_served_acres']:.2f} new acres served{cross}")
    assert got["all"] == "\n".join(want) and got["shut"] == "No road network generated (stop_reason=no_eligible_anchor)."
    counts = spark.createDataFrame([("p", 1, 2, 3), ("q", 0, 4, 0)], "parcel_id string, n_zones long, n_valleys long, n_patches long")
    got = {r["parcel_id"]: r["summary"] for r in reports.water_zone_summary(counts).collect()}
    assert got["p"] == "Water system candidate zones: 1 (from 2 primary valley(s) and 3 production-area candidate(s))"
    assert got["q"].startswith("4 primary valley(s) and 0 production-area candidate(s) found, but no drainage cell")
