"""Polygon layers of many parcels. A region is a column ``rings``: rings of [x, y]
corners, the first of a polygon counter-clockwise, its holes clockwise, in metres of
the parcel's projection; see ``polygons`` for one region's arithmetic.

Shapes of a parcel never meet in one step: they are folded within square bins first,
and the bins' outlines then. A null or empty region is no ground.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import polygons as P
from .grid import dealt
from .kernels import lonlat

RINGS = "array<array<array<double>>>"
ARROW_RINGS = pa.list_(pa.list_(pa.list_(pa.float64())))
#: Shapes of one key that are held before they are united.
HELD = 64

# Metres of clearance of the reference's layers.
FLOODPLAIN, CONTEXT, RELEVANCE = 30.0, 200.0, 75.0
STREAM_FENCE, ZONE_FENCE, FENCE_MARGIN, LEAST_FENCE_ACRES = 10.7, 2.5, 5.0, 0.05
TREE_PRODUCTION, TREE_WATER, TREE_SETBACK, TREE_ROAD_CELLS = 5.0, 5.0, 5.0, 1
PRODUCTION_SETBACK = 3.048


def region(value) -> P.Region:
    return [] if value is None else [np.array(r, float) for r in value if len(r)]


def decoded(column: pa.Array) -> list[P.Region]:
    """Regions of a column, by its offsets: no corner becomes an object."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rings = column.values
    corners = rings.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    of_row, of_ring = column.offsets.to_numpy(), rings.offsets.to_numpy() - rings.offsets[0].as_py() if len(rings) else np.zeros(1, np.int64)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return [
        [corners[of_ring[k] : of_ring[k + 1]] for k in range(a, b) if of_ring[k] < of_ring[k + 1]] if ok else []
        for a, b, ok in zip(of_row[:-1].tolist(), of_row[1:].tolist(), known.tolist(), strict=True)
    ]


def encoded(values: list[P.Region]) -> pa.Array:
    """A column of regions; no ground is null."""
    rings = [r for v in values for r in v]
    flat = np.concatenate(rings).ravel() if rings else np.zeros(0)
    at = np.concatenate([[0], np.cumsum([len(r) for r in rings])]).astype(np.int32)
    rows = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    corners = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, 2, dtype=np.int32), flat)
    none = pa.array([not v for v in values], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(rows), pa.ListArray.from_arrays(at, corners), mask=none)


def with_region(df: DataFrame, name: str, fn: Callable[..., P.Region], *columns: str) -> DataFrame:
    """``fn`` of the regions in ``columns``, a row at a time."""
    return with_regions(df, name, lambda *values: [fn(*row) for row in zip(*values, strict=True)], *columns)


def with_regions(df: DataFrame, name: str, fn: Callable[..., list[P.Region]], *columns: str) -> DataFrame:
    """``fn`` of lists of the regions in ``columns``, some rows at a time."""

    def apply(*values: pa.Array) -> pa.Array:
        return encoded(fn(*map(decoded, values)))

    return df.withColumn(name, _once(apply, RINGS)(*columns))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all shuffle partitions, as they come, before work on each: a small file
    is one task however many corners its rows stand for."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _once(fn: Callable, kind: str):
    """As an Arrow UDF that a filter above doesn't make run again."""
    return F.arrow_udf(fn, kind, F.ArrowUDFType.SCALAR).asNondeterministic()


def from_ring(x, y) -> Column:
    """A region of one counter-clockwise ring from its arrays of x and y."""
    return F.array(F.zip_with(x, y, lambda a, b: F.array(a, b)))


def from_point(x, y) -> Column:
    return F.array(F.array(F.array(x, y)))


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("p"), F.get(ring, (i + 1) % n).alias("q")))


def _over_rings(rings, term: Callable[[Column, Column, Column], Column]) -> Column:
    zero = F.lit(0.0)

    def of_ring(ring):
        first = F.get(ring, F.lit(0))
        return F.aggregate(_edges(ring), zero, lambda s, e: s + term(e["p"], e["q"], first))

    return F.coalesce(F.aggregate(F.transform(rings, of_ring), zero, lambda s, x: s + x), zero)


def area(rings) -> Column:
    """Square metres, holes taken off; corners are taken from the ring's first."""
    def term(p, q, o):
        return ((p[0] - o[0]) * (q[1] - o[1]) - (q[0] - o[0]) * (p[1] - o[1])) / 2

    return _over_rings(rings, term)


def perimeter(rings) -> Column:
    return _over_rings(rings, lambda p, q, o: F.sqrt(F.pow(q[0] - p[0], 2) + F.pow(q[1] - p[1], 2)))


def _keyed(batch: pa.RecordBatch, keys: list[str]):
    return zip(*(batch.column(k).to_pylist() for k in keys), strict=True)


def _rows(found: list, keys: list[str], like: pa.RecordBatch) -> pa.RecordBatch:
    names = [pa.array([k[i] for k, _ in found], like.schema.field(n).type) for i, n in enumerate(keys)]
    return pa.RecordBatch.from_arrays([*names, encoded([v for _, v in found])], names=[*keys, "rings"])


def _united(groups: list[list[P.Region]], clean: bool) -> list[P.Region]:
    apart, met = zip(*P.aparts(groups), strict=True) if clean else ([[] for _ in groups], groups)
    more = [k for k, v in enumerate(met) if v]
    found = dict(zip(more, P.unions([met[k] for k in more]), strict=True))
    return [[*found.get(k, []), *(r for shape in v for r in shape)] for k, v in enumerate(apart)]


def _early(batches, keys: list[str]):
    """Batches with each key once: a row alone stays as it is, others are united."""
    for b in batches:
        met: dict = {}
        for row, key in enumerate(_keyed(b, keys)):
            met.setdefault(key, []).append(row)
        alone = [rows[0] for rows in met.values() if len(rows) == 1]
        if alone:
            rest = b.take(pa.array(alone, pa.int32()))
            yield pa.RecordBatch.from_arrays([*map(rest.column, keys), rest.column("rings").cast(ARROW_RINGS)], names=[*keys, "rings"])
        hot = {key: rows for key, rows in met.items() if len(rows) > 1}
        if not hot:
            continue
        shapes = decoded(b.column("rings"))
        groups = [[shapes[k] for k in rows] for rows in hot.values()]
        while max(map(len, groups)) > HELD:
            pieces = [(k, g[at : at + HELD]) for k, g in enumerate(groups) for at in range(0, len(g), HELD)]
            groups = [[] for _ in groups]
            for (k, _), shape in zip(pieces, _united([piece for _, piece in pieces], True), strict=True):
                groups[k].append(shape)
        yield _rows(list(zip(hot, _united(groups, True), strict=True)), keys, b)


def _fold(df: DataFrame, keys: list[str], clean: bool) -> DataFrame:
    """Shapes of equal keys united: within batches before they are dealt by key, so
    that a hot key sends outlines, and then key after key down sorted partitions,
    ``HELD`` shapes at a time, so that no key is ever held whole. Shapes that come
    ``clean`` (no ring crosses) stay as they are where they are alone."""
    schema = StructType([*(df.schema[k] for k in keys), StructField("rings", df.schema["rings"].dataType)])

    def late(batches):
        now, held, b = None, [], None
        for b in batches:
            done = []
            for key, shape in zip(_keyed(b, keys), decoded(b.column("rings")), strict=True):
                if held and key != now:
                    done.append((now, held))
                    held = []
                now = key
                held.append(shape)
                if len(held) >= HELD:
                    held = [P.union(held)]
            if done:
                yield _rows(list(zip((k for k, _ in done), _united([v for _, v in done], clean), strict=True)), keys, b)
        if held:
            yield _rows([(now, _united([held], clean)[0])], keys, b)

    few = df.select(*keys, "rings").mapInArrow(lambda batches: _early(batches, keys), schema)
    return dealt(few, keys).sortWithinPartitions(*keys).mapInArrow(late, schema)


def union_by(shapes: DataFrame, keys: list[str], bin_meters: float = 400.0, clean: bool = False) -> DataFrame:
    """One region a key: the union of its shapes. Keys without ground have no row."""
    corner = F.col("rings")[0][0]
    held = shapes.where(F.size("rings") > 0).withColumns({f"_b{k}": F.floor(corner[i] / bin_meters) for i, k in enumerate("xy")})
    near = _fold(held, [*keys, "_bx", "_by"], clean).where("rings IS NOT NULL")
    return _fold(near.select(*keys, "rings"), keys, True).where("rings IS NOT NULL")


def buffered(df: DataFrame, meters: float | Column, column: str = "rings") -> DataFrame:
    """Each row's region grown by ``meters``, one number or one a row."""
    def grown(values: pa.Array, wide: pa.Array) -> pa.Array:
        return encoded(P.buffers(decoded(values), wide.to_numpy()))

    wide = F.lit(meters).cast("double") if isinstance(meters, (int, float)) else meters
    return spread(df).withColumn(column, _once(grown, RINGS)(F.col(column), wide))


def line_buffers(df: DataFrame, meters: float, column: str = "lines") -> DataFrame:
    """``rings``: the ground within ``meters`` of a row's lines (no ground for 0)."""
    return with_regions(spread(df), "rings", lambda x: P.buffers_lines(x, meters) if meters > 0 else [[] for _ in x], column)


def road_exclusion(roads: DataFrame, meters: float = 0.0, key: str = "parcel_id") -> DataFrame:
    """The ground within ``meters`` of a parcel's roads; parcels without have no row."""
    return union_by(line_buffers(roads, meters).select(key, "rings"), [key], clean=True)


def unit_union(units: DataFrame, wanted: Column, key: str = "parcel_id") -> DataFrame:
    """The union of a parcel's map units that are ``wanted`` (prime, hydric)."""
    return union_by(units.where(F.coalesce(wanted, F.lit(False))).select(key, "rings"), [key])


def floodplain(parcels: DataFrame, lines: DataFrame, bodies: DataFrame, hydric: DataFrame, valleys: DataFrame, key: str = "parcel_id") -> DataFrame:
    """key, rings, is_fallback. Streams (``lines``) and water ``bodies`` within
    ``CONTEXT`` of a parcel, grown by ``FLOODPLAIN`` and kept within ``RELEVANCE`` of it,
    with the ground of its hydric units. A parcel with none of these gets the ground
    about its valleys' lines instead, which may be none."""
    about = parcels.select(key, F.col("rings").alias("_home"))

    def grown(shapes: list[P.Region], home: list[P.Region], of_lines: bool) -> list[P.Region]:
        near = P.buffers(home, CONTEXT)
        cut = [P.clip_lines(*x) for x in zip(shapes, near, strict=True)] if of_lines else P.intersections(shapes, near)
        wide = P.buffers_lines(cut, FLOODPLAIN) if of_lines else P.buffers(cut, FLOODPLAIN)
        return P.intersections(wide, P.buffers(home, RELEVANCE))

    streams = with_regions(spread(lines.hint("merge").join(about, key)), "rings", lambda x, home: grown(x, home, True), "lines", "_home").select(key, "rings")
    water = with_regions(spread(bodies.hint("merge").join(about, key)), "rings", lambda x, home: grown(x, home, False), "rings", "_home").select(key, "rings")
    real = union_by(streams.unionByName(water).unionByName(hydric.select(key, "rings")), [key]).withColumn("is_fallback", F.lit(False))
    rest = parcels.select(key).hint("merge").join(real, key, "left_anti")
    proxy = union_by(line_buffers(valleys.hint("merge").join(rest, key, "left_semi"), FLOODPLAIN).select(key, "rings"), [key], clean=True)
    return real.unionByName(rest.hint("merge").join(proxy, key, "left").withColumn("is_fallback", F.lit(True)))


def tree_search_space(
    parcels: DataFrame, claims: DataFrame, production: float = TREE_PRODUCTION, water: float = TREE_WATER, setback: float = TREE_SETBACK, key: str = "parcel_id",
) -> DataFrame:
    """key, rings (the land left, null if none), claimed (null if nothing is) and
    status: nothing_claimed, searchable, nothing_left. ``claims``: key, kind
    (production, water, road), rings; the first two are united, then grown; roads come
    grown. Land left is the parcel set back, without what is claimed."""
    each = union_by(claims.where("kind IN ('production', 'water', 'road')"), [key, "kind"])
    wide = F.when(F.col("kind") == "production", production).when(F.col("kind") == "water", water).otherwise(0.0).cast("double")
    sized = buffered(each, wide)
    claimed = union_by(sized.select(key, "rings"), [key], clean=True).withColumnRenamed("rings", "claimed")
    got = parcels.select(key, "rings").hint("merge").join(claimed, key, "left")
    got = with_regions(spread(got), "rings", lambda home, taken: P.differences(P.buffers(home, -setback), taken), "rings", "claimed")
    status = F.when(F.col("rings").isNull(), "nothing_left").when(F.col("claimed").isNull(), "nothing_claimed").otherwise("searchable")
    return got.withColumn("status", status)


def zone_fences(zones: DataFrame, meters: float = ZONE_FENCE) -> DataFrame:
    """``zones`` (with ``rings``: a zone's fill) with ``fence``: the outer rings of the
    grown fill, one a piece. Zones without a fill have no fence and no row."""
    some = zones.where(F.size("rings") > 0)
    return with_regions(spread(some), "fence", lambda r: [[x for x in grown if P.ring_area(x) > 0] for grown in P.buffers(r, meters)], "rings")


def stream_fences(streams: DataFrame, meters: float = STREAM_FENCE) -> DataFrame:
    """``streams`` (with ``lines``) with ``fence``: all of the edge of the ground within
    ``meters``, inner rings too. Streams without a line have no row."""
    some = streams.where(F.size("lines") > 0)
    return with_regions(spread(some), "fence", lambda x: P.buffers_lines(x, meters), "lines").where("fence IS NOT NULL")


def boundary_fences(parcels: DataFrame, developed: DataFrame, zones: DataFrame, margin: float = FENCE_MARGIN, zone: float = ZONE_FENCE, key: str = "parcel_id") -> DataFrame:
    """key, fence_number (from 1, the largest first), ring. ``developed``: production
    zones, structure site and road footprint; ``zones``: water and tree zones."""
    built = union_by(developed.select(key, "rings"), [key]).withColumnRenamed("rings", "_built")
    held = union_by(buffered(zones.select(key, "rings"), zone), [key], clean=True).withColumnRenamed("rings", "_held")
    both = parcels.select(key, "rings").hint("merge").join(built, key, "left").hint("merge").join(held, key, "left")
    got = with_region(spread(both), "_fence", lambda home, a, b: P.boundary_fence(home, a, b, margin, LEAST_FENCE_ACRES * 4046.8564224), "rings", "_built", "_held")
    return got.where("_fence IS NOT NULL").select(key, F.posexplode("_fence").alias("n", "ring")).select(key, (F.col("n") + 1).alias("fence_number"), "ring")


def closed(rings) -> Column:
    """Each ring with its first corner again at its end, as files want it."""
    return F.transform(rings, lambda r: F.concat(r, F.slice(r, 1, 1)))


def in_degrees(df: DataFrame, zone: int, south: bool = False, column: str = "rings") -> DataFrame:
    """Corners of a UTM zone in longitude and latitude."""
    def turned(r: P.Region) -> P.Region:
        return [np.stack(lonlat(x[:, 0], x[:, 1], zone, south), axis=1) for x in r]

    return with_region(df, column, turned, column)


def polygons_of(df: DataFrame, column: str = "rings") -> DataFrame:
    """``coordinates`` of a MultiPolygon: each shell with its holes, all closed."""
    def split(values: pa.Array) -> pa.Array:
        found = [P.parts(v) for v in decoded(values)]
        at = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.ListArray.from_arrays(at, encoded([part for f in found for part in f]))

    parts = spread(df).withColumn("coordinates", _once(split, f"array<{RINGS}>")(column))
    return parts.withColumn("coordinates", F.transform("coordinates", closed))


# --- cells -----------------------------------------------------------------------------

def footprints(cells: DataFrame, keys: list[str], px: float, py: float, origin_x: float = 0.0, origin_y: float = 0.0) -> DataFrame:
    """One region a key: the squares of its cells (r, c) united."""
    kinds = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)

    def run(table: pa.Table) -> pa.Table:
        r, c = (table.column(x).to_numpy() for x in ("r", "c"))
        mask = np.zeros((r.max() - r.min() + 1, c.max() - c.min() + 1), bool)
        mask[r - r.min(), c - c.min()] = True
        # Grid lines keep their own numbers, so that neighbours' corners are equal.
        lines = P.outline(mask, 1, 1)
        moved = [np.stack([origin_x + (x[:, 0] + c.min()) * px, origin_y + (x[:, 1] - r.min()) * py], axis=1) for x in lines]
        return pa.table({**{k: table.column(k)[:1] for k in keys}, "rings": encoded([moved])})

    return dealt(cells.select(*keys, "r", "c"), keys).groupBy(*keys).applyInArrow(run, f"{kinds}, rings {RINGS}")


def road_footprints(cells: DataFrame, px: float, py: float, origin_x: float = 0.0, origin_y: float = 0.0, grow: int = TREE_ROAD_CELLS, key: str = "parcel_id") -> DataFrame:
    """The ground of a road's cells (r, c), each with ``grow`` cells about it on all
    sides, so that nothing else touches it at a corner."""
    near = F.array(*[F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c")) for i in range(-grow, grow + 1) for j in range(-grow, grow + 1)])
    return footprints(cells.select(key, F.inline(near)).distinct(), [key], px, py, origin_x, origin_y)


def covered_cells(shapes: DataFrame, px: float, py: float, origin_x: float = 0.0, origin_y: float = 0.0, keys: tuple[str, ...] = ("parcel_id",)) -> DataFrame:
    """keys, r, c: the cells whose centres lie in a shape of the keys, each once. A
    shape becomes spans of rows, a span its cells: no point meets a polygon."""
    return _covered(shapes, px, py, origin_x, origin_y, keys).distinct()


def _covered(shapes: DataFrame, px: float, py: float, origin_x: float, origin_y: float, keys: tuple[str, ...] = ("parcel_id",)) -> DataFrame:
    """``covered_cells`` as often as shapes cover them."""

    def spans(values: pa.Array) -> pa.Array:
        found = [P.row_spans(v, px, py, origin_x, origin_y).astype(np.int32) for v in decoded(values)]
        flat = np.concatenate([np.zeros((0, 3), np.int32), *found])
        each = pa.StructArray.from_arrays([pa.array(x) for x in flat.T], names=["r", "first", "last"])
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32), each)

    each = shapes.select(*keys, F.inline(_once(spans, "array<struct<r:int,first:int,last:int>>")("rings")))
    return each.select(*keys, "r", F.explode(F.sequence("first", "last")).alias("c"))


def _marked(cells: DataFrame, shapes: DataFrame, parcels: DataFrame, *at: float) -> DataFrame:
    """``cells`` with _in, true in the parcel, and _hit, true in a shape; else null. Both
    come by one sum and one join: a task sorts cells twice, not once a layer."""
    yes, no = F.lit(True), F.lit(None).cast("boolean")
    held = _covered(parcels, *at).select("*", yes.alias("_in"), no.alias("_hit"))
    hit = _covered(shapes, *at).select("*", no.alias("_in"), yes.alias("_hit"))
    marks = held.unionByName(hit).groupBy("parcel_id", "r", "c").agg(F.max("_in").alias("_in"), F.max("_hit").alias("_hit"))
    return cells.hint("merge").join(marks, ["parcel_id", "r", "c"], "left")


def exclusion_cells(cells: DataFrame, shapes: DataFrame, parcels: DataFrame, px: float, py: float, origin_x: float = 0.0, origin_y: float = 0.0) -> DataFrame:
    """``cells`` (with z) with ``excluded``: outside the parcel, or in a shape. Cells
    without a height are never excluded."""
    got = _marked(cells, shapes, parcels, px, py, origin_x, origin_y)
    out = F.col("z").isNotNull() & (F.col("_in").isNull() | F.col("_hit").isNotNull())
    return got.withColumn("excluded", out).drop("_in", "_hit")


def production_cells(cells: DataFrame, shapes: DataFrame, parcels: DataFrame, px: float, py: float, origin_x: float = 0.0, origin_y: float = 0.0, name: str = "on_production") -> DataFrame:
    """``cells`` (with z) with ``name``: in the parcel and in a shape."""
    got = _marked(cells.drop(name), shapes, parcels, px, py, origin_x, origin_y)
    return got.withColumn(name, F.col("z").isNotNull() & F.col("_in").isNotNull() & F.col("_hit").isNotNull()).drop("_in", "_hit")
