"""Road corridors: the routed network of each parcel with its lines, grades, steep
stretches and what it crosses. A parcel's route is worked out once; branches, totals and
ground are read from its row."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, scoring
from . import polygons as P
from .grid import KEY, cell_area_acres, dealt, square
from .regions import _once, buffered, decoded, exclusion_cells, production_cells, road_footprints

# Fixed values of the reference's corridors: metres, percent.
POND, LEAST_METERS, STEEP, REACH, PER_ACRE, SPUR = 25.0, 100.0, 10.0, 100.0, 100.0, 150.0


def priced(cells: DataFrame, parcels: DataFrame, fills: DataFrame, ponds: DataFrame, floods: DataFrame, px: float, py: float, origin_x: float = 0.0, origin_y: float = 0.0) -> DataFrame:
    """``cells`` (z, slope_pct, tpi, canopy) with near_pond, on_production, flood and
    ``cost``. ``fills`` of production, ``ponds`` (the selected water zone's fill) and
    ``floods`` have rings; ponds keep ``POND`` metres clear."""
    at = (px, py, origin_x, origin_y)
    clear = buffered(ponds.select("parcel_id", "rings"), POND)
    got = production_cells(exclusion_cells(cells, clear, parcels, *at), clear, parcels, *at, name="near_pond")
    got = production_cells(production_cells(got, fills, parcels, *at), floods, parcels, *at, name="flood")
    return scoring.cost_raster(got)


def grades(points: np.ndarray) -> float:
    """Mean of the slopes between the points of a line (x, y, z), in percent; 0 where no
    two lie apart."""
    step = np.diff(points, axis=0)
    run = np.hypot(step[:, 0], step[:, 1])
    return float(np.mean(np.abs(step[run > 0, 2]) / run[run > 0] * 100)) if (run > 0).any() else 0.0


def network(
    cost: np.ndarray, z: np.ndarray, slope: np.ndarray, demand: np.ndarray, pond: np.ndarray, anchor: tuple[float, float], px: float, py: float, origin_x: float = 0.0, origin_y: float = 0.0,
    least: float = LEAST_METERS, radius: float = REACH, per_acre: float = PER_ACRE, spur: float = SPUR,
) -> dict:
    """One parcel's network from the open cell nearest to the anchor (x, y). Without an
    open cell, or shorter in all than ``least``, there is none, and all demand is unserved.
    A branch of one cell has no line, but its cell counts as ground."""
    open_ = np.argwhere(np.isfinite(cost))
    acres = float(demand.sum() * cell_area_acres(px, py))
    none = {"branches": [], "cells": [], "total_length_meters": 0.0, "total_served_acres": 0.0, "unserved_acres": acres, "max_grade_pct": 0.0, "steep_meters": 0.0}
    if not len(open_):
        return none | {"stop_reason": "no_eligible_anchor"}
    row, col = (origin_y - anchor[1]) / py - 0.5, (anchor[0] - origin_x) / px - 0.5
    start = open_[np.argmin((open_[:, 0] - row) ** 2 + (open_[:, 1] - col) ** 2)]
    shore = kernels.dilate(pond, square(1)) & ~pond & np.isfinite(cost)
    got = kernels.road_network(cost, tuple(map(int, start)), demand, px, py, radius, per_acre, water=[tuple(map(int, x)) for x in np.argwhere(shore)], spur=spur)
    if got["branches"] and got["total_length_meters"] < least:
        return none | {"stop_reason": "corridor_too_short"}
    branches = []
    for b in got["branches"]:
        at = np.array(b["cells"])
        if len(at) < 2:
            continue
        r, c = at.T
        points = np.stack([origin_x + (c + 0.5) * px, origin_y - (r + 0.5) * py, z[r, c]], axis=1)
        steep = np.nan_to_num(slope[r, c])
        run = np.hypot(np.diff(c) * px, np.diff(r) * py)
        branches.append({
            "branch_index": b["branch_id"], "branch_role": b["branch_role"], "joins_branch_index": b["joins_branch_index"], "length_meters": b["meters"], "total_cost": b["total_cost"],
            "newly_served_acres": b["served_acres"], "cells": b["cells"], "line": points.tolist(), "avg_grade_pct": grades(points), "max_grade_pct": float(steep.max()),
            # A step counts as steep by the cell that it enters.
            "steep_meters": float(run[steep[1:] > STEEP].sum()), "production_cells_crossed": int(demand[r, c].sum()),
        })
    return {
        **{k: got[k] for k in ("total_length_meters", "total_served_acres", "unserved_acres", "stop_reason")},
        "branches": branches, "cells": sorted({c for b in got["branches"] for c in b["cells"]}),
        "max_grade_pct": max((b["max_grade_pct"] for b in branches), default=0.0), "steep_meters": math.fsum(b["steep_meters"] for b in branches),
    }


_CELL = pa.struct([("r", pa.int32()), ("c", pa.int32())])
_BRANCH = pa.struct([
    ("branch_index", pa.int32()), ("branch_role", pa.string()), ("joins_branch_index", pa.int32()), ("length_meters", pa.float64()), ("total_cost", pa.float64()), ("newly_served_acres", pa.float64()),
    ("cells", pa.list_(_CELL)), ("line", pa.list_(pa.list_(pa.float64()))), ("avg_grade_pct", pa.float64()), ("max_grade_pct", pa.float64()), ("steep_meters", pa.float64()), ("production_cells_crossed", pa.int32()),
])
_NETWORK = pa.schema([
    ("parcel_id", pa.string()), ("total_length_meters", pa.float64()), ("total_served_acres", pa.float64()), ("unserved_acres", pa.float64()), ("stop_reason", pa.string()),
    ("max_grade_pct", pa.float64()), ("steep_meters", pa.float64()), ("cells", pa.list_(_CELL)), ("branches", pa.list_(_BRANCH)),
])
_DDL = (
    "parcel_id string, total_length_meters double, total_served_acres double, unserved_acres double, stop_reason string, max_grade_pct double, steep_meters double, cells array<struct<r:int,c:int>>, "
    "branches array<struct<branch_index:int,branch_role:string,joins_branch_index:int,length_meters:double,total_cost:double,newly_served_acres:double,cells:array<struct<r:int,c:int>>,"
    "line:array<array<double>>,avg_grade_pct:double,max_grade_pct:double,steep_meters:double,production_cells_crossed:int>>"
)


def networks(cells: DataFrame, anchors: DataFrame, px: float, py: float, origin_x: float = 0.0, origin_y: float = 0.0, **limits: float) -> DataFrame:
    """A row for each parcel with an anchor (parcel_id, x, y; the first in order of x, y)
    and cells: totals, why it stopped, the network's cells and its ``branches``.
    ``cells``: those of ``priced``."""
    def placed(found: list) -> list:
        return [{"r": r, "c": c} for r, c in found]

    def run(here: pa.Table, start: pa.Table) -> pa.Table:
        if not here.num_rows or not start.num_rows:
            return _NETWORK.empty_table()
        pdf = here.drop_columns(["parcel_id"]).to_pandas()
        cost, z, slope, demand, pond = (kernels.to_grid(pdf, n) for n in ("cost", "z", "slope_pct", "on_production", "near_pond"))
        anchor = min(zip(start.column("x").to_pylist(), start.column("y").to_pylist(), strict=True))
        got = network(np.where(np.isnan(cost), np.inf, cost), z, slope, demand > 0, pond > 0, anchor, px, py, origin_x, origin_y, **limits)
        got["cells"], got["branches"] = placed(got["cells"]), [b | {"cells": placed(b["cells"])} for b in got["branches"]]
        return pa.Table.from_pylist([got | {"parcel_id": here.column("parcel_id")[0].as_py()}], schema=_NETWORK)

    wanted = cells.select(*KEY, "cost", "z", "slope_pct", "on_production", "near_pond")
    places = dealt(anchors.select("parcel_id", "x", "y"), ["parcel_id"])
    return dealt(wanted, ["parcel_id"]).groupBy("parcel_id").cogroup(places.groupBy("parcel_id")).applyInArrow(run, _DDL)


def branches(found: DataFrame, floods: DataFrame) -> DataFrame:
    """A row a branch of ``networks``, with the network's totals, whether its line meets
    the parcel's wet ground (``floods``: one region a parcel) and production."""
    def meets(lines: pa.Array, grounds: pa.Array) -> pa.Array:
        return pa.array(P.distances(decoded(lines), decoded(grounds), "line", "area") == 0)

    each = found.select("parcel_id", "total_length_meters", "total_served_acres", "unserved_acres", "stop_reason", F.inline("branches"))
    flat = F.array(F.transform("line", lambda p: F.slice(p, 1, 2)))
    wet = floods.select("parcel_id", F.col("rings").alias("_wet"))
    got = each.hint("merge").join(wet, "parcel_id", "left").withColumn("crosses_floodplain", _once(meets, "boolean")(flat, F.col("_wet")))
    return got.drop("_wet").withColumn("crosses_production_zone", F.col("production_cells_crossed") > 0)


def ground(found: DataFrame, px: float, py: float, origin_x: float = 0.0, origin_y: float = 0.0) -> DataFrame:
    """parcel_id, rings: the squares of all of a network's cells, spurs too."""
    return road_footprints(found.select("parcel_id", F.inline("cells")), px, py, origin_x, origin_y, grow=0)
