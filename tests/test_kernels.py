"""Kernels against hand-worked grids, and against the cell-table operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelworks.operators import grid, kernels

masks = st.integers(2, 9).flatmap(lambda n: st.lists(st.lists(st.booleans(), min_size=n, max_size=n), min_size=2, max_size=9)).map(np.array)


def test_fill_raises_a_pit_to_its_rim():
    z = np.full((3, 3), 10.0)
    z[1, 1] = 1
    assert kernels.fill(z)[1, 1] == 10


def test_flow_goes_down_a_ramp():
    z = np.array([[30, 30, 30], [30, 20, 30], [30, 10, 30]], float)
    assert kernels.STEPS[kernels.directions(z, 5, 5)[1, 1]] == (1, 0)


def test_accumulation_of_a_column():
    z = np.array([[40.0], [30], [20], [10]])
    assert kernels.accumulation(z, kernels.directions(z, 5, 5)).ravel().tolist() == [1, 2, 3, 4]


def test_v_valley_is_one_primary_valley():
    r, c = np.indices((30, 30))
    assert len(kernels.valleys(2.0 * abs(29 - r - c) + 0.5 * r, 5, 5, stream=0.1, primary=0.5)) >= 1


@settings(max_examples=40, deadline=None)
@given(masks)
def test_erosion_and_dilation_are_dual(mask):
    element = grid.disc(1.5)
    inner = np.pad(mask, 2)
    dual = ~kernels.dilate(~inner, [(-a, -b) for a, b in element])
    assert (kernels.erode(inner, element)[2:-2, 2:-2] == dual[2:-2, 2:-2]).all()


@settings(max_examples=40, deadline=None)
@given(masks)
def test_labels_follow_reading_order(mask):
    labels, n = kernels.label(mask)
    firsts = [np.flatnonzero((labels == k).ravel())[0] for k in range(n)]
    assert firsts == sorted(firsts) and ((labels >= 0) == mask).all()


def test_dumbbell_splits_at_its_waist():
    mask = np.zeros((12, 30), bool)
    mask[1:11, 1:11] = mask[1:11, 19:29] = True
    mask[5:7, 11:19] = True
    parts = kernels.waist_split(mask, 5, 5, 0.1)
    assert len(parts) == 2 and sum(p.sum() for p, _ in parts) == mask.sum()
    # What is drawn leaves the waist open, and comes back to the parts by reclaiming.
    assert all(core.any() and not (core & ~part).any() for part, core in parts) and not np.logical_or(parts[0][1], parts[1][1])[:, 11:19].any()
    assert len(kernels.waist_split(mask, 5, 5, 2.0)) == 1


def test_ring_has_one_hole():
    mask = np.ones((5, 5), bool)
    mask[2, 2] = False
    assert [int(h.sum()) for h in kernels.holes(mask)] == [1]


def test_route_uses_the_gap_and_closed_walls_stop_it():
    cost = np.ones((21, 21))
    cost[:, 10] = np.inf
    cost[19, 10] = 1
    got = kernels.least_cost_path(cost, [(10, 0)], [(10, 20)], 1, 1)
    assert (19, 10) in got["cells"]
    cost[19, 10] = np.inf
    assert kernels.least_cost_path(cost, [(10, 0)], [(10, 20)], 1, 1) is None


def test_uniform_cost_is_octile_distance():
    total, _, _ = kernels.cost_field(np.ones((9, 9)), [(0, 0)], 1, 1)
    assert total[3, 7] == pytest.approx(3 * math.sqrt(2) + 4)


def test_road_serves_a_block_with_one_trunk():
    demand = np.zeros((80, 80), bool)
    demand[35:45, 22:32] = True
    got = kernels.road_network(np.ones((80, 80)), (40, 0), demand, 5, 5, radius=50, per_acre=1000)
    assert got["unserved_acres"] == 0 and got["stop_reason"] == "all_demand_served"
    assert got["branches"][0]["branch_role"] == "trunk" and got["branches"][0]["joins_branch_index"] is None
    assert got["total_length_meters"] == pytest.approx(sum(b["meters"] for b in got["branches"])) and got["total_served_acres"] == pytest.approx(100 * 25 / 4046.8564224)
    assert kernels.road_network(np.ones((80, 80)), (40, 0), demand, 5, 5, radius=50, per_acre=1000) == got


def test_why_a_road_network_stops():
    flat, none = np.ones((40, 40)), np.zeros((40, 40), bool)
    block = none.copy()
    block[18:22, 30:34] = True
    walled = flat.copy()
    walled[:, 15] = np.inf

    def stop(cost, demand, **kw):
        return kernels.road_network(cost, (20, 0), demand, 5, 5, **{"radius": 20, "per_acre": 1e6} | kw)["stop_reason"]

    assert stop(flat, none) == "no_demand" and stop(flat, block, radius=200) == "all_demand_served"
    assert stop(walled, block) == "no_reachable_demand" and stop(flat, block, per_acre=1) == "cost_per_acre_exceeded"


def test_branches_join_and_water_is_last():
    demand = np.zeros((40, 60), bool)
    demand[2:6, 50:54] = demand[34:38, 50:54] = True
    got = kernels.road_network(np.ones((40, 60)), (20, 0), demand, 5, 5, radius=20, per_acre=1e6, water=[(20, 8)])
    roles = [b["branch_role"] for b in got["branches"]]
    assert roles[0] == "trunk" and set(roles[1:-1]) == {"spur"} and roles[-1] == "water_spur"
    for b in got["branches"][1:]:
        assert b["cells"][0] in got["branches"][b["joins_branch_index"]]["cells"]
    assert got["branches"][-1]["served_acres"] == 0 and got["total_length_meters"] == pytest.approx(sum(b["meters"] for b in got["branches"]))


def test_moving_average_shrinks_at_the_ends():
    assert kernels.moving_average(np.array([1.0, 2, 3, 4]), 3).tolist() == [1.5, 2, 3, 3.5]


def test_keypoint_split_is_the_least_residual():
    rng = np.random.default_rng(3)
    for n in (12, 13, 30, 60):
        d, slope = np.cumsum(rng.random(n) + 0.5), rng.random(n) * 20
        z = np.cumsum(rng.standard_normal(n))
        best = None
        for k in range(6, n - 6):
            fall = slope[k - 6 : k].mean() - slope[k : k + 6].mean()
            if fall >= 0.1:
                sse = sum(np.polyfit(a, b, 1, full=True)[1].sum() for a, b in ((d[: k + 1], z[: k + 1]), (d[k:], z[k:])))
                if best is None or sse < best[0] - 1e-9:
                    best = sse, k, fall
        got = kernels.keypoint_split(d, z, slope, 6, 0.1)
        assert (got is None) == (best is None) and (got is None or (got[0] == best[1] and got[1] == pytest.approx(best[2])))


def test_keypoint_is_where_the_slope_breaks():
    d = np.arange(40.0)
    z = np.where(d < 20, 100 - d, 80 - 0.1 * (d - 20))
    slope = np.append(-np.diff(z), 0) * 100
    assert abs(kernels.keypoint_split(d, z, slope)[0] - 20) <= 1


def test_rings():
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    assert kernels.ring_area(square) == 16
    assert kernels.contains(square, np.array([2.0, 5]), np.array([2.0, 2])).tolist() == [True, False]
    assert kernels.distance_to_ring(square, np.array([2.0]), np.array([1.0])).tolist() == [1]
    assert kernels.ring_area(kernels.clip_convex(square + 2, square)) == 4
    assert kernels.ring_area(kernels.hull(np.vstack([square, [[1, 1], [2, 3]]]))) == 16


def test_utm_of_the_central_meridian_and_symmetry():
    x, y = kernels.utm(np.array([-81.0, -80.0, -82.0]), np.array([40.0, 40.0, 40.0]), 17)
    assert x[0] == pytest.approx(500000) and y[0] == pytest.approx(4427757.2, abs=0.5)
    assert x[1] - 500000 == pytest.approx(500000 - x[2]) and y[1] == pytest.approx(y[2])


def test_tpi_fixture_of_a_disc(spark):
    rows = [("p", r, c, 7.0 if (r, c) == (3, 3) else 66 / 9 - (7 - 66 / 9) / 8) for r in range(7) for c in range(7)]
    got = grid.tpi(spark.createDataFrame(rows, "parcel_id string, r int, c int, z double"), 5, 5, 8.0).where("r = 3 AND c = 3").first()
    assert got["tpi"] == pytest.approx(7 - 66 / 9)


def test_flow_direction_agrees_with_the_kernel(spark):
    z = np.random.default_rng(3).integers(0, 50, (8, 9)).astype(float)
    rows = [("p", r, c, float(z[r, c])) for r in range(8) for c in range(9)]
    got = grid.flow_direction(spark.createDataFrame(rows, "parcel_id string, r int, c int, z double"), 5, 5).collect()
    k = kernels.directions(z, 5, 5)
    for row in got:
        want = k[row["r"], row["c"]]
        assert (row["to_r"], row["to_c"]) == ((None, None) if want < 0 else (row["r"] + kernels.STEPS[want][0], row["c"] + kernels.STEPS[want][1]))


def test_ring_overlap():
    square = ([0, 10, 10, 0], [0, 0, 10, 10])
    ell = ([5, 20, 20, 12, 12, 5], [5, 5, 8, 8, 20, 20])
    turned = ([20, 12, 12, 5, 5, 20], [8, 8, 20, 20, 5, 5])
    diamond = ([5, 10, 5, 0], [0, 5, 10, 5])
    assert kernels.ring_overlap(*square, *square) == pytest.approx(100)
    assert kernels.ring_overlap(*square, *ell) == pytest.approx(25) == kernels.ring_overlap(*turned, *square)
    assert kernels.ring_overlap(*square, *diamond) == pytest.approx(50)
    assert kernels.ring_overlap(*ell, *diamond) == pytest.approx(12.5)
    assert kernels.ring_overlap(*square, [10, 20, 20], [0, 0, 10]) == 0 == kernels.ring_overlap(*square, [1, 2], [1, 2])


def test_ring_overlap_against_points():
    """Star-shaped rings against the share of a fine grid's points inside both."""
    rng = np.random.default_rng(5)

    def inside(ring, x, y):
        odd = np.zeros(x.shape, bool)
        for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, 0), strict=True):
            odd ^= ((y0 <= y) != (y1 <= y)) & (x < x0 + (y - y0) / (y1 - y0) * (x1 - x0))
        return odd

    side = (np.arange(600) + 0.5) / 100
    x, y = np.meshgrid(side, side)
    for _ in range(5):
        rings = []
        for _ in range(2):
            turn, out = np.sort(rng.uniform(0, 2 * np.pi, 9)), rng.uniform(0.8, 2.5, 9)
            rings.append(np.column_stack([3 + out * np.cos(turn), 3 + out * np.sin(turn)]))
        a, b = rings
        want = (inside(a, x, y) & inside(b, x, y)).mean() * 36
        assert kernels.ring_overlap(*a.T, *b.T) == pytest.approx(want, abs=0.05)
