"""Structure sites: candidate squares by parcel, scored, in tiers of road nearness."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import factors as X
from . import polygons as P
from .kernels import distance_to_ring
from .regions import RINGS, covered_cells, decoded, encoded, spread
from .scoring import ranked
from .sinks import zone_relationship

# Fixed values of the reference's sites.
ACRES, LEAST_SHARE, SPACING, SLOPE, LEAST_SCORE, TOP = 0.1, 0.5, 25.0, 20.0, 0.4, 5
WATER_CLEARANCE, ADJACENT, PRODUCTION_REACH = 25.0, 15.0, 100.0
CORRIDOR_REACH, ROAD_REACH, TREE_CLEARANCE = 15.0, 150.0, 3.048

_SITE = pa.struct([("point_id", pa.int32()), ("x", pa.float64()), ("y", pa.float64()), ("area", pa.float64()), ("road", pa.float64()), ("production", pa.float64()), ("water", pa.float64()), ("touches", pa.bool_())])
_DDL = f"point_id int, x double, y double, area double, road double, production double, water double, touches boolean, rings {RINGS}"
#: Squares, and parcels, that are worked at once.
TOGETHER, PARCELS = 2048, 32


def lattice(region: P.Region, spacing: float) -> np.ndarray:
    """Points of a square lattice from the corner of a region's box, inside it."""
    corners = np.concatenate(region)
    (x0, y0), (x1, y1) = corners.min(0), corners.max(0)
    x, y = np.meshgrid(np.arange(x0, x1 + 1e-9, spacing), np.arange(y0, y1 + 1e-9, spacing))
    x, y = x.ravel(), y.ravel()
    inside = P.contains(region, x, y)
    for ring in region:  # a point on the edge isn't inside
        inside &= distance_to_ring(ring, x, y) > 1e-9
    return np.stack([x[inside], y[inside]], axis=1)


def squares(home: P.Region, production: P.Region, water: P.Region, trees: P.Region, roads: P.Region | None, road_kind: str, reach: float, acres: float, spacing: float) -> list[tuple]:
    """Squares of ``acres`` on a lattice, cut to the parcel, clear of water and trees
    and within ``reach`` of a road; no roads means none, None that nothing is asked."""
    return [s for _, s in squares_of([home], [production], [water], [trees], None if roads is None else [roads], road_kind, reach, acres, spacing)]


def squares_of(homes: list[P.Region], production: list[P.Region], water: list[P.Region], trees: list[P.Region], roads: list[P.Region] | None, road_kind: str, reach: float, acres: float, spacing: float) -> Iterator[tuple[int, tuple]]:
    """``squares`` of many parcels, with a parcel's number: ``TOGETHER`` squares at a time."""
    side, search = math.sqrt(acres * X.SQUARE_METERS_PER_ACRE), homes
    if roads is not None:
        wide = reach + side
        near = P.intersections(homes, P.buffers_lines(roads, wide) if road_kind == "line" else P.buffers(roads, wide))
        search = [(n or home) if road else [] for n, home, road in zip(near, homes, roads, strict=True)]
    banned = P.unions([list(x) for x in zip(P.buffers(water, WATER_CLEARANCE), trees, strict=True)])
    points = [lattice(region, spacing) if home and region else np.zeros((0, 2)) for home, region in zip(homes, search, strict=True)]
    row = np.repeat(np.arange(len(homes)), [len(p) for p in points])
    number = np.concatenate([np.arange(len(p)) for p in points]) if points else row
    points = np.concatenate([np.zeros((0, 2)), *points])
    for at in range(0, len(row), TOGETHER):
        mine = slice(at, at + TOGETHER)
        k, n, xy = row[mine], number[mine], points[mine]
        cut = _cut(xy, side / 2, k, homes)
        size = np.array([P.area(c) for c in cut])

        def kept(good):
            return k[good], n[good], xy[good], size[good], [c for c, ok in zip(cut, good.tolist(), strict=True) if ok]

        def off(shapes, kind="area"):
            return P.distances(cut, [shapes[i] for i in k.tolist()], "area", kind)

        k, n, xy, size, cut = kept((size > 0) & (size >= LEAST_SHARE * side * side))
        k, n, xy, size, cut = kept(off(banned) != 0)
        road = None
        if roads is not None:
            road = off(roads, road_kind)
            near = road <= reach
            k, n, xy, size, cut = kept(near)
            road = road[near].tolist()
        edge, inside, shore = off(production, "ring"), off(production) == 0, off(water)
        for i, parcel in enumerate(k.tolist()):
            yield parcel, (
                int(n[i]), float(xy[i, 0]), float(xy[i, 1]), float(size[i]), road[i] if road is not None else None, float(edge[i]) if production[parcel] else None,
                float(shore[i]) if water[parcel] else None, bool(inside[i]), cut[i])


def _cut(points: np.ndarray, half: float, parcel: np.ndarray, homes: list[P.Region]) -> list[P.Region]:
    """The squares about the points, cut to the parcels. One that no edge comes near is
    whole or nothing."""
    corners = points[:, None] + half * np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)])
    clear, held = np.zeros(len(points), bool), np.zeros(len(points), bool)
    for k in np.unique(parcel).tolist():
        mine = np.flatnonzero(parcel == k)
        p, q = (np.concatenate(x) for x in (homes[k], [np.roll(r, -1, axis=0) for r in homes[k]]))
        low, high = np.minimum(p, q) - half - 1e-3, np.maximum(p, q) + half + 1e-3
        for some in np.array_split(mine, max(1, len(mine) * len(p) // 1_000_000)):
            clear[some] = ~((points[some, None] >= low) & (points[some, None] <= high)).all(2).any(1)
        held[mine] = P.contains(homes[k], *points[mine].T)
    out = [[square] if ok else [] for square, ok in zip(corners, (clear & held).tolist(), strict=True)]
    rest = np.flatnonzero(~clear).tolist()
    for k, got in zip(rest, P.intersections([[corners[k]] for k in rest], [homes[parcel[k]] for k in rest]), strict=True):
        out[k] = got
    return out


def placed(parcels: DataFrame, road_kind: str | None, reach: float, acres: float, spacing: float, key: str = "parcel_id") -> DataFrame:
    """``squares`` as rows, parcels dealt over all tasks."""
    def sites(batches):
        for b in batches:
            values = [decoded(b.column(i)) for i in range(1, 6)]
            for at in range(0, b.num_rows, PARCELS):
                *shapes, roads = (v[at : at + PARCELS] for v in values)
                found = list(squares_of(*shapes, roads if road_kind else None, road_kind or "", reach, acres, spacing))
                one = pa.array([dict(zip(_SITE.names, s[:-1], strict=True)) for _, s in found], _SITE)
                rows = b.column(0).take(pa.array([at + k for k, _ in found], pa.int32()))
                yield pa.RecordBatch.from_arrays([rows, *one.flatten(), encoded([s[-1] for _, s in found])], names=[key, *_SITE.names, "rings"])

    # A parcel is few bytes and much work: without being dealt all of them are one task.
    asked = spread(parcels.select(key, "rings", "production", "water", "trees", "roads"))
    return asked.mapInArrow(sites, StructType([asked.schema[key], *StructType.fromDDL(_DDL)]))


def candidates(parcels: DataFrame, cells: DataFrame, px: float, py: float, origin_x: float, origin_y: float, road_kind: str | None, reach: float = 0.0, acres: float = ACRES, spacing: float = SPACING, top: int = TOP, key: str = "parcel_id") -> DataFrame:
    """The ``top`` sites a parcel. ``parcels``: rings, production, water, trees (grown
    already) and roads, of ``road_kind``, or none of them asked for with None. ``cells``:
    r, c, slope_pct, aspect_deg, shading_score, canopy."""
    where = placed(parcels, road_kind, reach, acres, spacing, key).checkpoint()
    ids = [key, "point_id"]
    under = covered_cells(where, px, py, origin_x, origin_y, tuple(ids)).hint("merge").join(cells, [key, "r", "c"])
    seen = under.groupBy(*ids).agg(
        F.avg("slope_pct").alias("slope_pct"), X.circular_mean(F.col("aspect_deg")).alias("aspect_deg"), F.coalesce(F.avg("shading_score"), F.lit(0.5)).alias("shading_factor"),
        F.max(F.coalesce("canopy", F.lit(False))).alias("canopy")).where("NOT canopy").drop("canopy")
    got = where.drop("rings").hint("merge").join(seen, ids).where(F.col("slope_pct") <= SLOPE)
    got = got.withColumns({"slope_factor": X.solar_slope_score(F.col("slope_pct"), SLOPE), "aspect_factor": X.aspect_score(F.col("aspect_deg")), "production_factor": X.production_proximity(F.col("production"), PRODUCTION_REACH)})
    whole = 0.25 * (F.col("slope_factor") + F.col("aspect_factor") + F.col("shading_factor") + F.col("production_factor"))
    got = got.withColumn("whole", whole).where(F.col("whole") >= LEAST_SCORE).withColumn("score", F.round(F.col("whole") * 100, 1)).drop("whole")
    got = got.withColumn("production_zone_relationship", zone_relationship(F.col("touches"), F.col("production"), ADJACENT)).drop("touches")
    return ranked(got.withColumn("acres", F.col("area") / X.SQUARE_METERS_PER_ACRE), "point_id", key).where(F.col("rank") <= top)


def solar_sites(parcels: DataFrame, cells: DataFrame, corridors: DataFrame, roads: DataFrame, px: float, py: float, origin_x: float = 0.0, origin_y: float = 0.0, key: str = "parcel_id", **more) -> DataFrame:
    """Sites near a parcel's own road corridor (``corridors``: rings of its ground); for
    parcels without such a site, near a mapped road (``roads``: rings of its lines, a
    null for a parcel that was asked about and has none); parcels that no one could ask
    about are free of roads. A tier sees only the parcels that earlier ones left.
    ``road_proximity_source`` tells the tier."""
    def tier(left: DataFrame, kind: str | None, reach: float, source: str) -> DataFrame:
        got = candidates(left, cells, px, py, origin_x, origin_y, kind, reach, key=key, **more)
        return got.withColumn("road_proximity_source", F.lit(source)).checkpoint()

    cells = cells.checkpoint()  # each tier reads them
    near = tier(parcels.hint("merge").join(corridors.where("rings IS NOT NULL").select(key, F.col("rings").alias("roads")), key), "area", CORRIDOR_REACH, "selected_road_corridor")
    left = parcels.hint("merge").join(near, key, "left_anti").checkpoint()
    mapped = tier(left.hint("merge").join(roads.select(key, F.col("rings").alias("roads")), key), "line", ROAD_REACH, "real_mapped_road")
    unknown = left.hint("merge").join(roads, key, "left_anti").withColumn("roads", F.lit(None).cast(RINGS))
    return near.unionByName(mapped).unionByName(tier(unknown, None, 0.0, "unavailable"))


def selected_site(sites: DataFrame) -> DataFrame:
    """The best site of each parcel that has one."""
    return sites.where("rank = 1")
