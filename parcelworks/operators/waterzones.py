"""Water-system zones: gates on cells, clusters grown to a size, the one that drains
most, how it serves production areas, and its score from soil, streams and valleys."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, scoring
from . import polygons as P
from .grid import KEY, cell_area_acres, dealt, disc, neighbour_slope, waist_radius
from .regions import RINGS, _once, area, buffered, covered_cells, decoded, encoded, footprints, spread, union_by, with_regions

# Fixed values of the reference's zones: acres, metres.
DRAINS, SERVICE, LEAST_ACRES, TARGET_ACRES, OPENING, SETBACK, ROAD, CANOPY = 20.0, 800.0, 0.1, 0.5, 5.0, 5.0, 3.048, 3.048
#: Metres by which ground that is sure stays clear of what is measured.
_SLACK = 0.01
#: Nearer than this is touching: a point on an edge is off it by rounding.
_TOUCHES = 1e-6


# --- gates -------------------------------------------------------------------------------

def drainage(cells: DataFrame, px: float, py: float) -> DataFrame:
    """KEY, z, slope_pct and ``accumulation`` (cells that drain through a cell) of the
    cells with a height."""
    def run(pdf):
        z = kernels.to_grid(pdf)
        filled = kernels.fill(z)
        got = kernels.as_rows(z=z, accumulation=kernels.accumulation(filled, kernels.directions(filled, px, py)))
        return got[~np.isnan(z).ravel()].astype({"accumulation": "int64"})

    sloped = neighbour_slope(cells.select(*KEY, "z"), px, py).select(*KEY, "slope_pct")
    return kernels.per_parcel(cells.select(*KEY, "z"), run, "r int, c int, z double, accumulation long").hint("merge").join(sloped, KEY, "left")


def _in_reach(home: P.Region, ground: P.Region, meters: float, px: float, py: float, origin_x: float, origin_y: float) -> np.ndarray:
    """Spans of the cells of ``home`` whose centres lie within ``meters`` of ``ground``.
    Round joins are chords: what lies between the chords and the tangents is a thin band,
    and only its cells are measured."""
    sure = P.intersection(P.buffer(ground, meters - _SLACK), home)
    wide = P.buffer(ground, meters / math.cos(math.pi / 4 / P.QUARTER) + _SLACK)
    band = P.row_spans(P.difference(P.intersection(wide, home), sure), px, py, origin_x, origin_y)
    n = band[:, 2] - band[:, 1] + 1
    r, c = np.repeat(band[:, 0], n), np.repeat(band[:, 1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    x, y = origin_x + (c + 0.5) * px, origin_y - (r + 0.5) * py
    far = np.where(P.contains(ground, x, y), 0.0, np.inf)
    for ring in ground:
        far = np.minimum(far, kernels.distance_to_ring(ring, x, y))
    near = far <= meters
    return np.concatenate([P.row_spans(sure, px, py, origin_x, origin_y), np.stack([r, c, c], axis=1)[near]])


def cells_in_reach(shapes: DataFrame, parcels: DataFrame, meters: float, px: float, py: float, origin_x: float = 0.0, origin_y: float = 0.0, key: str = "parcel_id") -> DataFrame:
    """key, r, c: cells of a parcel within ``meters`` of one of its shapes, each once.
    A parcel's shapes are united first, so that its cells come once and not once a shape."""

    def spans(homes: pa.Array, grounds: pa.Array) -> pa.Array:
        found = [_in_reach(h, g, meters, px, py, origin_x, origin_y).astype(np.int32) for h, g in zip(decoded(homes), decoded(grounds), strict=True)]
        flat = np.concatenate([np.zeros((0, 3), np.int32), *found])
        each = pa.StructArray.from_arrays([pa.array(x) for x in flat.T], names=["r", "first", "last"])
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32), each)

    whole = union_by(shapes.select(key, "rings"), [key]).withColumnRenamed("rings", "_ground")
    both = spread(parcels.select(key, "rings").hint("merge").join(whole, key))
    each = both.select(key, F.inline(_once(spans, "array<struct<r:int,first:int,last:int>>")("rings", "_ground")))
    return each.select(key, "r", F.explode(F.sequence("first", "last")).alias("c")).distinct()


def gated(
    cells: DataFrame, patches: DataFrame, parcels: DataFrame, roads: DataFrame, px: float, py: float, origin_x: float = 0.0, origin_y: float = 0.0,
    service: float = SERVICE, setback: float = SETBACK, drains: float = DRAINS,
) -> DataFrame:
    """``cells`` (z, accumulation, canopy) with in_parcel, in_service, near_production,
    road and ``water_eligible``. ``patches``: rings (their cells' ground) and ``fill``
    (what is drawn of it); ``roads``: the ground to keep clear. How high a cell lies
    rules nothing out, and a parcel without production has no eligible cell."""
    at = (px, py, origin_x, origin_y)
    fills = union_by(patches.select("parcel_id", F.col("fill").alias("rings")), ["parcel_id"])
    marks = {
        "in_parcel": covered_cells(parcels, *at), "in_service": cells_in_reach(patches, parcels, service, *at),
        "near_production": covered_cells(buffered(fills, setback), *at), "road": covered_cells(roads, *at),
    }
    got = cells.drop(*marks)
    for name, where in marks.items():
        got = got.hint("merge").join(where.withColumn(name, F.lit(True)), KEY, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return scoring.water_eligible(got.where("z IS NOT NULL"), px, py, drains)


# --- the zone ------------------------------------------------------------------------------

def best_zone(
    eligible: np.ndarray, z: np.ndarray, total: np.ndarray, slope: np.ndarray, home: P.Region, ground: P.Region, px: float, py: float, origin_x: float = 0.0, origin_y: float = 0.0,
    service: float = SERVICE, least_acres: float = LEAST_ACRES, target_acres: float = TARGET_ACRES, opening: float = OPENING,
) -> dict | None:
    """Of one parcel's clusters of eligible cells, large enough on the parcel, each grown
    from its wettest cell to the target, the one whose cells drain most in sum (ties: the
    larger x, then y of its middle) among those with production within ``service`` of
    their middle."""
    acre = cell_area_acres(px, py)
    target = max(1, math.floor(target_acres / acre + 1e-9))
    parts, n = kernels.label(eligible, 4)
    sizes = np.bincount(parts[parts >= 0], minlength=n)
    best = None

    def drawn(mask: np.ndarray, within: P.Region) -> P.Region:
        return P.intersection(P.outline(mask, px, py, origin_x, origin_y), within)

    for k in np.flatnonzero(sizes * acre >= least_acres * (1 - 1e-9)):
        whole = drawn(parts == k, home)
        if P.area(whole) / (px * py / acre) < least_acres:
            continue
        cells = kernels.grow(parts == k, total, target)
        mask = np.zeros(eligible.shape, bool)
        mask[tuple(np.array(cells).T)] = True
        shape = drawn(mask, home)
        if not shape:
            continue
        x, y = P.centroid(shape)
        if P.distance([np.array([[x, y]])], ground, "line", "area") > service:
            continue
        rank = float(total[mask].sum()), x, y
        if best is None or rank > best["rank"]:
            best = {"rank": rank, "cells": cells, "mask": mask, "rings": shape}
    if best is None:
        return None
    mask, element = best["mask"], disc(waist_radius(px, py, opening))
    opened = kernels.dilate(kernels.erode(mask, element), element)
    steep = slope[mask & ~np.isnan(slope)]
    return best | {
        "fill": drawn(opened, best["rings"]) if opened.any() else best["rings"],
        "representative_elevation_m": float(np.median(z[mask])), "contributing_area_cells": float(np.median(total[mask])), "slope_pct": float(np.median(steep)) if len(steep) else 0.0,
    }


_ZONE = f"parcel_id string, zone_id int, x double, y double, accumulated double, representative_elevation_m double, contributing_area_cells double, slope_pct double, cells array<struct<r:int,c:int>>, rings {RINGS}, fill {RINGS}"


def selected_zones(cells: DataFrame, patches: DataFrame, parcels: DataFrame, px: float, py: float, origin_x: float = 0.0, origin_y: float = 0.0, service: float = SERVICE, **sizes: float) -> DataFrame:
    """At most one zone a parcel (zone_id 0): rings, fill, the middle x and y, median
    height, drained cells and slope, and its cells. ``cells``: those of ``gated``.

    A parcel is a group: its grid has at most 90,000 cells and its shapes are united."""
    ground = union_by(patches.select("parcel_id", "rings"), ["parcel_id"]).withColumnRenamed("rings", "ground")
    homes = parcels.select("parcel_id", "rings").hint("merge").join(ground, "parcel_id")
    kind = pa.struct([("r", pa.int32()), ("c", pa.int32())])

    def run(here: pa.Table, home: pa.Table) -> pa.Table:
        found = None
        if here.num_rows and home.num_rows:
            pdf = here.drop_columns(["parcel_id"]).to_pandas()
            grids = [kernels.to_grid(pdf, n) for n in ("water_eligible", "z", "accumulation", "slope_pct")]
            found = best_zone(grids[0] > 0, *grids[1:], *(decoded(home.column(n))[0] for n in ("rings", "ground")), px, py, origin_x, origin_y, service, **sizes)
        some = [] if found is None else [found]
        return pa.table({
            "parcel_id": pa.array([home.column("parcel_id")[0].as_py() for _ in some], pa.string()), "zone_id": pa.array([0 for _ in some], pa.int32()),
            **{n: pa.array([f["rank"][i] for f in some], pa.float64()) for n, i in (("x", 1), ("y", 2), ("accumulated", 0))},
            **{n: pa.array([f[n] for f in some], pa.float64()) for n in ("representative_elevation_m", "contributing_area_cells", "slope_pct")},
            "cells": pa.array([[{"r": r, "c": c} for r, c in f["cells"]] for f in some], pa.list_(kind)),
            **{n: encoded([f[n] for f in some]) for n in ("rings", "fill")},
        })

    wanted = cells.select(*KEY, "water_eligible", "z", "accumulation", "slope_pct")
    return dealt(wanted, ["parcel_id"]).groupBy("parcel_id").cogroup(dealt(homes, ["parcel_id"]).groupBy("parcel_id")).applyInArrow(run, _ZONE)


def relationships(zones: DataFrame, patches: DataFrame, service: float = SERVICE) -> DataFrame:
    """parcel_id, zone_id, production_area_id, elevation_differential_m (the zone above is
    positive), distance_m, gradient_pct, above_production_area, place (1 is the one most
    favourable to gravity) for the patches within ``service`` of a zone's middle."""
    def apart(x: pa.Array, y: pa.Array, rings: pa.Array) -> pa.Array:
        points = np.stack([x.to_numpy(), y.to_numpy()], axis=1)
        return pa.array(P.distances([[p[None]] for p in points], decoded(rings), "line", "area"))

    served = patches.select("parcel_id", F.col("patch_id").alias("production_area_id"), F.col("rings").alias("_ground"), F.col("median_z").alias("_z"))
    near = dealt(zones.select("parcel_id", "zone_id", "x", "y", "representative_elevation_m"), ["parcel_id"]).hint("merge").join(dealt(served, ["parcel_id"]), "parcel_id")
    pairs = near.withColumn("_d", _once(apart, "double")("x", "y", "_ground")).where(F.col("_d") <= service)
    rise = F.col("representative_elevation_m") - F.col("_z")
    got = pairs.select(
        "parcel_id", "zone_id", "production_area_id", F.round(rise, 2).alias("elevation_differential_m"), F.round("_d", 1).alias("distance_m"),
        F.round(F.when(F.col("_d") > _TOUCHES, rise / F.col("_d") * 100).otherwise(0.0), 2).alias("gradient_pct"), (rise > 0).alias("above_production_area"))
    return scoring.placed(got, ["parcel_id", "zone_id"], F.desc("elevation_differential_m"), "production_area_id")


# --- what scores it ------------------------------------------------------------------------

def soil_under(zones: DataFrame, units: DataFrame, ksat: DataFrame) -> DataFrame:
    """parcel_id, zone_id, ksat and coverage of zones (``rings`` with holes and parts):
    the mean of the units' ``ksat_r`` by what each covers, and the share that they cover.
    Null where no unit with a number meets the zone. With one zone a parcel, pairs are as
    many as units; units that overlap each other count twice."""
    from ..functions import factors as X

    known = ksat.select("mukey", X.number(F.col("ksat_r")).alias("_k")).where("_k IS NOT NULL")
    held = units.select("parcel_id", "mukey", F.col("rings").alias("_unit")).hint("merge").join(known, "mukey")
    pairs = dealt(zones.select("parcel_id", "zone_id", "rings"), ["parcel_id"]).hint("merge").join(dealt(held, ["parcel_id"]), "parcel_id")
    met = with_regions(pairs, "_both", P.intersections, "rings", "_unit").withColumn("_a", area("_both")).where("_a > 0")
    sums = met.groupBy("parcel_id", "zone_id").agg(F.sum(F.col("_k") * F.col("_a")).alias("_ka"), F.sum("_a").alias("_a"))
    got = zones.select("parcel_id", "zone_id", "rings").hint("merge").join(sums, ["parcel_id", "zone_id"], "left")
    share = F.when(F.col("_a").isNotNull(), F.least(F.lit(1.0), F.try_divide(F.col("_a"), area("rings"))))
    return got.select("parcel_id", "zone_id", F.try_divide("_ka", "_a").alias("ksat"), share.alias("coverage"))


def suitability(zones: DataFrame, served: DataFrame, soil: DataFrame, streams: DataFrame, valleys: DataFrame) -> DataFrame:
    """Zones scored by their first relationship of ``served``, by soil (``soil_under``),
    the nearest stream (fcode, stream_distance) and the valleys inside (terrain_gradient,
    contributing_acres)."""
    at = ["parcel_id", "zone_id"]
    first = served.where("place = 1").select(*at, F.col("elevation_differential_m").alias("differential"), F.col("distance_m").alias("distance"), "gradient_pct")
    ground = valleys.select(*at, "terrain_gradient", F.col("contributing_acres").alias("acres"))
    got = zones.select(*at, "rings", "fill", "representative_elevation_m").hint("merge").join(first, at, "left")
    for part in (soil, streams.select(*at, "fcode", "stream_distance"), ground):
        got = got.hint("merge").join(part, at, "left")
    return scoring.score_water_zones(got)


# --- production patches -------------------------------------------------------------------

def patch_ground(cells: DataFrame, parcels: DataFrame, px: float, py: float, origin_x: float = 0.0, origin_y: float = 0.0) -> DataFrame:
    """parcel_id, patch_id, rings, fill, median_z from the patches' cells (r, c, in_fill,
    median_z): both outlines are cut to the parcel."""
    at = ["parcel_id", "patch_id"]
    whole = footprints(cells, at, px, py, origin_x, origin_y)
    drawn = footprints(cells.where("in_fill"), at, px, py, origin_x, origin_y).withColumnRenamed("rings", "fill")
    height = cells.groupBy(*at).agg(F.first("median_z").alias("median_z"))
    got = whole.hint("merge").join(drawn, at, "left").hint("merge").join(height, at).hint("merge").join(parcels.select("parcel_id", F.col("rings").alias("_home")), "parcel_id")
    for name in ("rings", "fill"):
        got = with_regions(got, name, P.intersections, name, "_home")
    return got.drop("_home").where("rings IS NOT NULL")
