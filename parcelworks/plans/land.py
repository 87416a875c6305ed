"""Queries of polygon layers, with their SQL: unions, masks, search space, fences.

``orders`` gives soil map units (rings turned by 45 degrees, so that no edge lies along
an axis), ``supplier`` shapes on the cell grid, ``customer`` parcels with claims and
lines. A turned ring is a rectangle in u = x - y, v = x + y, where SQL can unite exactly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import factors as X
from ..operators import grid, lines, regions, resample, sinks, sites, soil
from ..streaming import ledger
from . import views as V
from .catalog import _HYDRIC, _PCT, PX, PY, _checkpoints, masked_cells, query, rounded, step1, with_

# Of a circle of 64 segments: a segment's chord for radius 1, a quarter's area.
_CHORD, _SECTOR = "(2 * sin(pi() / 64))", "(8 * sin(pi() / 32))"


# --- soil ---------------------------------------------------------------------------------

def unit_rings(spark, sf):
    """Map units of ``orders`` with their rings, about fifteen a parcel."""
    k = F.col("o_orderkey")
    u, v, w, h = (x.cast("double") for x in (k * 37 % 300, k * 91 % 240, 20 + k % 30, 16 + k % 24))
    corners = F.array(*[F.array((a + b) / 2, (b - a) / 2) for a, b in ((u, v), (u + w, v), (u + w, v + h), (u, v + h))])
    ring = V.table(spark, sf, "orders").select(k.cast("string").alias("mukey"), F.col("o_custkey").cast("string").alias("parcel_id"), F.array(corners).alias("rings"))
    return ring.hint("merge").join(V.mapunits(spark, sf).select("mukey", "farmlndcl"), "mukey")


def _united(which: str) -> str:
    """Of turned rings, the length that rows of v have in common, halved."""
    return f"""spans AS (SELECT CAST(o_custkey AS VARCHAR) AS parcel_id, o_orderkey * 91 % 240 + unnest(range(16 + o_orderkey % 24)) AS v, o_orderkey * 37 % 300 AS a,
    o_orderkey * 37 % 300 + 20 + o_orderkey % 30 AS b FROM orders WHERE {which}),
  runs AS (SELECT *, max(b) OVER (PARTITION BY parcel_id, v ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans)
  SELECT parcel_id, CAST(sum(greatest(0, b - greatest(a, coalesce(before, a)))) AS DOUBLE) / 2 AS area FROM runs GROUP BY parcel_id"""


@query("prime_farmland_union", with_(V.MAPUNITS) + ", " + _united("CAST(o_orderkey AS VARCHAR) IN (SELECT mukey FROM mapunits WHERE farmlndcl LIKE 'All areas are prime farmland%' OR farmlndcl LIKE 'Prime farmland if%')"))
def prime_farmland_union(spark, sf):
    got = regions.unit_union(unit_rings(spark, sf), X.is_prime_farmland(F.col("farmlndcl")))
    return got.select("parcel_id", *rounded_area())


@query("hydric_union", with_(V.COMPONENTS) + ", " + _united(f"CAST(o_orderkey AS VARCHAR) IN (SELECT mukey FROM components WHERE {_HYDRIC} GROUP BY mukey HAVING sum({_PCT}) >= 50)"))
def hydric_union(spark, sf):
    hydric = soil.hydric_mukeys(V.components(spark, sf)).select("mukey")
    got = regions.unit_union(unit_rings(spark, sf).hint("merge").join(hydric, "mukey", "left_semi"), F.lit(True))
    return got.select("parcel_id", *rounded_area())


def rounded_area(column: str = "rings", name: str = "area", places: int = 6) -> list[F.Column]:
    return [(F.round(regions.area(column), places) + 0.0).alias(name)]


# --- masks --------------------------------------------------------------------------------

@query("cell_masks", with_(V.CELLS, V.SHAPES) + "SELECT parcel_id, r, c, outside AS excluded, on_production FROM masked")
def cell_masks(spark, sf):
    return masked_cells(spark, sf, V.cells(spark, sf)).select(*grid.KEY, "excluded", "on_production")


@query("cell_footprints", with_(V.CELLS) + f"""SELECT a.parcel_id, CAST(count(*) FILTER (side = 0) * {PX * PY} AS DOUBLE) AS area, CAST(count(*) FILTER (side > 0 AND b.z IS NULL) * {PX} AS DOUBLE) AS perimeter
  FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS side FROM cells WHERE z < 6.0) a LEFT JOIN (SELECT * FROM cells WHERE z < 6.0) b
  ON side > 0 AND a.parcel_id = b.parcel_id AND b.r = a.r + [0, 0, 0, 1, -1][side + 1] AND b.c = a.c + [0, 1, -1, 0, 0][side + 1] GROUP BY a.parcel_id""")
def cell_footprints(spark, sf):
    """The ground of low cells as rings, one region a parcel."""
    got = regions.footprints(V.cells(spark, sf).where("z < 6.0"), ["parcel_id"], PX, PY)
    return got.select("parcel_id", *rounded_area(), F.round(regions.perimeter("rings"), 6).alias("perimeter"))


# --- parcels and what is claimed on them -----------------------------------------------------

def homes(spark, sf):
    k = F.col("c_custkey")
    return V.table(spark, sf, "customer").select(k.cast("string").alias("parcel_id"), k.alias("k"), V.box(0, 0, 200 + k % 7 * 10, 150 + k % 5 * 10).alias("rings"))


def claims(spark, sf):
    """By the last digit of a parcel: 0 claims nothing, 1 all of it, 2 two production
    zones that overlap; every other one zone, a pond and a road."""
    k = F.col("k")
    kind, far = k % 10, F.col("k") * 0
    zone = F.when(kind == 1, V.box(-20, -20, 400, 400)).when(kind == 2, V.box(20, 20, 60, 50)).otherwise(V.box(20, 20, 50 + k % 20, 45 + k % 15))
    rows = F.array(
        F.struct(F.lit("production").alias("kind"), zone.alias("rings")), F.struct(F.lit("production").alias("kind"), F.when(kind == 2, V.box(40, 30, 80, 60)).alias("rings")),
        F.struct(F.lit("water").alias("kind"), V.box(100 + far, 30 + far, 110 + k % 10, 42 + k % 8).alias("rings")), F.struct(F.lit("road").alias("kind"), V.box(20 + far, 100 + far, 120 + far, 108 + k % 4).alias("rings")),
    )
    return homes(spark, sf).where(kind != 0).select("parcel_id", F.inline(rows)).where("rings IS NOT NULL")


_CLAIMED = f"""made AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS parcel_id, 200 + c_custkey % 7 * 10 AS w, 150 + c_custkey % 5 * 10 AS h, c_custkey % 10 AS kind FROM customer),
sized AS (SELECT *, CASE kind WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE
    CASE WHEN kind = 2 THEN 2000 + 200 * 5 + 6 * {_SECTOR} * 25 - 2 * 25 ELSE (30 + k % 20) * (25 + k % 15) + 2 * (55 + k % 20 + k % 15) * 5 + 4 * {_SECTOR} * 25 END
    + (10 + k % 10) * (12 + k % 8) + 2 * (22 + k % 10 + k % 8) * 5 + 4 * {_SECTOR} * 25 + 100 * (8 + k % 4) END AS taken FROM made)"""


@query("tree_search_space", with_(_CLAIMED) + """SELECT parcel_id, CASE kind WHEN 0 THEN 'nothing_claimed' WHEN 1 THEN 'nothing_left' ELSE 'searchable' END AS status,
  CASE WHEN kind = 1 THEN 0.0 ELSE round((w - 10) * (h - 10) - taken, 6) END AS area FROM sized""")
def tree_search_space(spark, sf):
    got = regions.tree_search_space(homes(spark, sf), claims(spark, sf))
    return got.select("parcel_id", "status", *rounded_area())


@query("zone_fences", with_(V.RINGS) + f"""SELECT parcel_id, zone_id, round((w * h + 2 * (w + h) * 2.5 + 4 * {_SECTOR} * 6.25) / {grid.SQUARE_METERS_PER_ACRE}, 8) AS acres,
  round(2 * (w + h) + 64 * 2.5 * {_CHORD}, 6) AS fence_meters FROM zone_rings""")
def zone_fences(spark, sf):
    zones = V.zone_rings(spark, sf).select("parcel_id", "zone_id", regions.from_ring("ring_x", "ring_y").alias("rings"))
    got = regions.zone_fences(zones)
    acres = F.round(regions.area("fence") / grid.SQUARE_METERS_PER_ACRE, 8).alias("acres")
    return got.select("parcel_id", "zone_id", acres, F.round(regions.perimeter("fence"), 6).alias("fence_meters"))


def bent_lines(spark, sf):
    k = F.col("c_custkey")
    a, b = (60 + k % 90).cast("double"), (50 + k % 70).cast("double")
    zero = F.lit(0.0)
    return V.table(spark, sf, "customer").select(k.cast("string").alias("parcel_id"), F.array(F.array(F.array(zero, zero), F.array(a, zero), F.array(a, b))).alias("lines"))


@query("stream_fences", f"""SELECT CAST(c_custkey AS VARCHAR) AS parcel_id, round(2 * (110 + c_custkey % 90 + c_custkey % 70) - 2 * 10.7 + 80 * 10.7 * {_CHORD}, 6) AS fence_meters FROM customer""")
def stream_fences(spark, sf):
    got = regions.stream_fences(bent_lines(spark, sf))
    return got.select("parcel_id", F.round(regions.perimeter("fence"), 6).alias("fence_meters"))


@query("road_exclusion_union", f"""SELECT CAST(c_custkey AS VARCHAR) AS parcel_id,
  round(16.0 * (60 + c_custkey % 90 + 100) - 256 + 8 * {_SECTOR} * 64, 6) AS area FROM customer""")
def road_exclusion_union(spark, sf):
    """The ground within 8 m of a road along x and one that crosses it."""
    k = F.col("c_custkey")
    a = (60 + k % 90).cast("double")
    zero, lo, hi, mid = F.lit(0.0), F.lit(-50.0), F.lit(50.0), F.lit(30.0)
    roads = V.table(spark, sf, "customer").select(k.cast("string").alias("parcel_id"), F.explode(F.array(
        F.array(F.array(F.array(zero, zero), F.array(a, zero))), F.array(F.array(F.array(mid, lo), F.array(mid, hi))))).alias("lines"))
    return regions.road_exclusion(roads, 8.0).select("parcel_id", *rounded_area())


@query("floodplain_union", with_(_CLAIMED) + """SELECT parcel_id, kind = 0 AS is_fallback, CASE WHEN kind = 0 THEN 0.0 WHEN kind = 1 THEN CAST((w + 150) * 60 AS DOUBLE) - 0.0 ELSE CAST(40 * 30 AS DOUBLE) END AS area FROM made""")
def floodplain_union(spark, sf):
    """Parcels of digit 1 have a stream across, others a hydric unit; digit 0 neither."""
    home = homes(spark, sf)
    lines = home.where("k % 10 = 1").select("parcel_id", F.array(F.array(F.array(F.lit(-900.0), F.lit(70.0)), F.array(F.lit(900.0), F.lit(70.0)))).alias("lines"))
    hydric = home.where("k % 10 > 1").select("parcel_id", V.box(10, 10, 50, 40).alias("rings"))
    none = home.where(F.lit(False))
    got = regions.floodplain(home, lines, none.select("parcel_id", "rings"), hydric, none.select("parcel_id", F.col("rings").alias("lines")))
    # The ends of the stream's ground are cut at the relevance border's straight side.
    return got.select("parcel_id", "is_fallback", *rounded_area(places=3))


@query("boundary_fencing")
def boundary_fencing(spark, sf):
    """Fences about the eligible ground and the low, wet ground of each grid."""
    home = V.cells(spark, sf).select("parcel_id").distinct().withColumn("rings", V.box(0, -100, 100, 0))
    built = regions.footprints(step1(spark, sf).where("eligible"), ["parcel_id"], PX, PY)
    wet = regions.footprints(V.cells(spark, sf).where("hydric AND z < 4"), ["parcel_id"], PX, PY)
    got = regions.boundary_fences(home, built, wet)
    one = F.array("ring")
    return got.select("parcel_id", "fence_number", F.size("ring").alias("n_corners"), (regions.area(one) / grid.SQUARE_METERS_PER_ACRE).alias("acres"), regions.perimeter(one).alias("fence_meters"))


# --- lines and zones -----------------------------------------------------------------------

@query("valley_inputs", with_(V.CELLS, V.SHAPES) + f"""SELECT parcel_id, zone_id, round(sum(grade * n) / sum(n), 8) AS terrain_gradient, CAST(max(acres) AS DOUBLE) AS contributing_acres
  FROM (SELECT CAST(CAST(floor(s_suppkey / 20.0) AS BIGINT) AS VARCHAR) AS parcel_id, s_suppkey AS zone_id FROM supplier) LEFT JOIN (
    SELECT parcel_id, zone_id, c, count(*) AS n, 2 + c // 5 * 1.5 AS acres, abs(arg_min(z, r) - arg_max(z, r)) / ((max(r) - min(r)) * {PY}) * 100 AS grade
    FROM cells JOIN shapes USING (parcel_id)
    WHERE c * 5 + 2.5 > x AND c * 5 + 2.5 < x + w AND r * 5 + 2.5 > top AND r * 5 + 2.5 < top + h GROUP BY parcel_id, zone_id, c HAVING count(*) >= 2) USING (parcel_id, zone_id) GROUP BY parcel_id, zone_id""")
def valley_inputs(spark, sf):
    """Zones of the grids, crossed by a branch down each column of cells."""
    c = F.col("c")
    down = V.cells(spark, sf).select(
        "parcel_id", F.floor(c / 5).alias("valley_id"), (2 + F.floor(c / 5) * 1.5).alias("max_acres"), c.alias("branch_id"), F.col("r").alias("seq"), "r", "c",
        ((c + 0.5) * PX).alias("x"), (-(F.col("r") + 0.5) * PY).alias("y"), "z")
    got = lines.valley_inputs(V.shapes(spark, sf), down, PX, PY)
    return got.select("parcel_id", "zone_id", *rounded("terrain_gradient"), "contributing_acres")


def stream_lines(spark, sf):
    k = F.col("s_suppkey")
    x, y = (k * 613 % 900).cast("double"), (k * 271 % 900).cast("double")
    return V.table(spark, sf, "supplier").select(F.floor(k / 10).cast("string").alias("parcel_id"), k.alias("stream_id"), F.array(F.array(F.array(x, y), F.array(x + 100 + k % 5 * 40, y))).alias("rings"))


@query("nearest_stream", with_(V.RINGS) + """SELECT parcel_id, zone_id, arg_min(stream_id, (d, stream_id)) AS stream_id, round(min(d), 8) + 0.0 AS distance, CASE WHEN min(d) IS NULL THEN 'no_feature' ELSE 'computed' END AS status FROM (
  SELECT z.parcel_id, z.zone_id, s.stream_id, CASE WHEN s.stream_id IS NOT NULL THEN sqrt(greatest(s.x0 - (z.x + z.w), z.x - s.x1, 0) ** 2 + greatest(s.y0 - (z.y + z.h), z.y - s.y0, 0) ** 2) END AS d
  FROM zone_rings z LEFT JOIN (SELECT CAST(CAST(floor(s_suppkey / 10.0) AS BIGINT) AS VARCHAR) AS parcel_id, s_suppkey AS stream_id, s_suppkey * 613 % 900 AS x0, s_suppkey * 613 % 900 + 100 + s_suppkey % 5 * 40 AS x1, s_suppkey * 271 % 900 AS y0 FROM supplier) s
  ON s.parcel_id = z.parcel_id) GROUP BY parcel_id, zone_id""")
def nearest_stream(spark, sf):
    _checkpoints(spark)
    zones = V.zone_rings(spark, sf).select("parcel_id", "zone_id", regions.from_ring("ring_x", "ring_y").alias("rings"))
    got = lines.nearest_shape(zones, stream_lines(spark, sf), "zone_id", "stream_id", "area", "line")
    return got.select("parcel_id", "zone_id", "stream_id", "status", *rounded("distance"))


@query("keypoint_relationships", with_(V.POINTS, V.RINGS) + """SELECT parcel_id, point_id, arg_min(zone_id, (d, zone_id)) AS zone_id, CASE WHEN min(d) IS NULL THEN 'no_feature' ELSE 'computed' END AS status,
  round(min(d), 2) + 0.0 AS distance_m, round(any_value(z) - arg_min(zone_id, (d, zone_id)) % 40, 2) + 0.0 AS elevation_differential_m FROM (
  SELECT p.parcel_id, p.point_id, p.z, z.zone_id, CASE WHEN z.zone_id IS NOT NULL THEN sqrt(greatest(z.x - p.x, p.x - (z.x + z.w), 0.0) ** 2 + greatest(z.y - p.y, p.y - (z.y + z.h), 0.0) ** 2) END AS d
  FROM points p LEFT JOIN zone_rings z ON z.parcel_id = p.parcel_id) GROUP BY parcel_id, point_id""")
def keypoint_relationships(spark, sf):
    _checkpoints(spark)
    points = V.points(spark, sf).select("parcel_id", "point_id", regions.from_point("x", "y").alias("rings"), F.col("z").alias("elevation_m"))
    k = F.col("zone_id")
    zones = V.zone_rings(spark, sf).select("parcel_id", "zone_id", regions.from_ring("ring_x", "ring_y").alias("rings"), (k % 40).cast("double").alias("representative_elevation_m"))
    got = lines.feature_relationships(points, zones, "point_id", "zone_id")
    return got.select("parcel_id", "point_id", "zone_id", "status", (F.col("distance_m") + 0.0).alias("distance_m"), (F.col("elevation_differential_m") + 0.0).alias("elevation_differential_m"))


# --- sites, rasters, arrivals ---------------------------------------------------------------

@query("solar_sites")
def solar_sites(spark, sf):
    """Sites on the grids: along the road's own ground where a parcel's number is even,
    by a mapped road for others, every seventh parcel unasked."""
    _checkpoints(spark)
    cells, number = V.cells(spark, sf), F.col("parcel_id").cast("int")
    trees = cells.select(*grid.KEY, F.coalesce(F.col("hag") >= 4.5, F.lit(False)).alias("canopy"))
    terrain = grid.horn(cells, PX, PY).select(*grid.KEY, "slope_pct", "aspect_deg").hint("merge").join(grid.shading(cells, PX, PY).select(*grid.KEY, "shading_score"), grid.KEY).hint("merge").join(trees, grid.KEY)
    shapes = regions.union_by(V.shapes(spark, sf).where("kind = 'production'").select("parcel_id", "rings"), ["parcel_id"]).withColumnRenamed("rings", "production")
    nothing = F.lit(None).cast(regions.RINGS)
    home = V.grid_parcels(spark, sf).hint("merge").join(shapes, "parcel_id", "left").withColumns({"water": V.box(60, -40, 70, -30), "trees": nothing})
    corridors = regions.road_footprints(cells.where("road").where(number % 2 == 0), PX, PY, grow=0)
    roads = V.grid_parcels(spark, sf).where(number % 7 != 0).select("parcel_id", F.when(number % 5 != 0, F.array(F.array(F.array(F.lit(17.5), F.lit(-100.0)), F.array(F.lit(17.5), F.lit(0.0))))).alias("rings"))
    return sites.solar_sites(home, terrain, corridors, roads, PX, PY, spacing=5.0).drop("area")


_SHIFTED = """asked AS (SELECT a.parcel_id, a.r, a.c, b.hag, CASE WHEN b.c = a.c THEN 0.7 ELSE 0.3 END * CASE WHEN b.r = a.r THEN 0.6 ELSE 0.4 END AS w
    FROM cells a LEFT JOIN cells b ON a.parcel_id = b.parcel_id AND b.r - a.r IN (0, 1) AND b.c - a.c IN (0, 1) AND b.hag IS NOT NULL),
  warped AS (SELECT parcel_id, r, c, sum(w * hag) / sum(w) AS value FROM asked GROUP BY parcel_id, r, c)"""


def shifted_canopy(spark, sf):
    """Each grid's canopy on a grid 0.3 cells east and 0.4 cells south of it."""
    cells = V.cells(spark, sf)
    pixels = cells.select(F.col("parcel_id").alias("tile_id"), F.col("r").alias("row"), F.col("c").alias("col"), F.col("hag").alias("value"))
    tiles = cells.select("parcel_id").distinct().select("parcel_id", F.col("parcel_id").alias("tile_id"), *[F.lit(v).alias(k) for k, v in (("origin_x", 0.0), ("origin_y", 0.0), ("px", PX), ("py", PY))])
    wanted = cells.select(*grid.KEY, "in_parcel", ((F.col("c") + 0.8) * PX).alias("x"), (-(F.col("r") + 0.9) * PY).alias("y"))
    return resample.resampled(wanted, tiles, pixels)


@query("canopy_resampled", with_(V.CELLS, _SHIFTED) + "SELECT parcel_id, r, c, round(value, 8) + 0.0 AS value FROM warped")
def canopy_resampled(spark, sf):
    return shifted_canopy(spark, sf).select(*grid.KEY, *rounded("value"))


@query("canopy_coverage", with_(V.CELLS, _SHIFTED) + """SELECT parcel_id, n_cells, round(100.0 * gaps / n_cells, 8) AS nodata_pct, CASE WHEN held = 0 THEN 'none' WHEN 100.0 * gaps / n_cells > 10 THEN 'incomplete' ELSE 'complete' END AS status FROM (
  SELECT parcel_id, count(*) FILTER (in_parcel) AS n_cells, count(*) FILTER (in_parcel AND value IS NULL) AS gaps, count(value) AS held FROM warped JOIN (SELECT parcel_id, r, c, in_parcel FROM cells) USING (parcel_id, r, c) GROUP BY parcel_id)""")
def canopy_coverage(spark, sf):
    return resample.coverage(shifted_canopy(spark, sf)).select("parcel_id", "n_cells", "status", *rounded("nodata_pct"))


@query("parcel_ledger", """SELECT parcel_id, count(*) FILTER (n = 1 AND event_id % 9 <> 0 AND source <> 'error') = 4 AS released,
  4 - count(*) FILTER (n = 1 AND event_id % 9 <> 0 AND source <> 'error') AS n_missing, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_arrival
  FROM (SELECT user_id // 3 AS parcel_id, event_type AS source, event_id, ts, row_number() OVER (PARTITION BY user_id // 3, event_type ORDER BY ts DESC, event_id % 9 <> 0 DESC, CAST(event_id AS VARCHAR) DESC) AS n FROM events) GROUP BY parcel_id""")
def parcel_ledger(spark, sf):
    """Events as arrivals: four kinds are required, one is optional."""
    events = V.table(spark, sf, "events")
    came = events.select(F.floor(F.col("user_id") / 3).alias("parcel_id"), F.col("event_type").alias("source"), F.col("ts").alias("arrived_at"), F.when(F.col("event_id") % 9 != 0, F.col("event_id").cast("string")).alias("payload"))
    got = ledger.status(came.select("parcel_id"), came, ("click", "purchase", "signup", "view"), ("error",))
    return got.select("parcel_id", "released", F.size("missing").cast("long").alias("n_missing"), F.date_format("last_arrival", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_arrival"))


# --- layers for exchange ------------------------------------------------------------------------

@query("fence_layers", """SELECT CAST(c_custkey AS VARCHAR) AS parcel_id, 'exclusion-fencing-stream-' || c_custkey AS id, 'exclusion_fencing' AS layer, 'Stream exclusion fencing (' || c_name || ')' AS label, 'medium' AS confidence, NULL AS fence_type, 1 AS n_lines FROM customer
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'perimeter-fencing-water-zone', 'perimeter_fencing', 'Water zone fencing', 'high', 'water_zone_exclusion', 1 FROM customer WHERE c_custkey % 10 > 1
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'perimeter-fencing-tree-zone-' || n, 'perimeter_fencing', 'Tree zone fencing ' || n, 'high', 'tree_zone_exclusion', 1 FROM customer, (SELECT unnest([1, 2]) AS n) WHERE c_custkey % 10 = 2""")
def fence_layers(spark, sf):
    """Fences of streams, of ponds and of two tree zones a parcel, in degrees."""
    k = F.col("c_custkey")
    named = V.table(spark, sf, "customer").select(k.cast("string").alias("parcel_id"), k.alias("source_id"), F.col("c_name").alias("label"))
    streams = regions.stream_fences(bent_lines(spark, sf)).hint("merge").join(named, "parcel_id")
    ponds = regions.zone_fences(claims(spark, sf).where("kind = 'water'").hint("merge").join(homes(spark, sf).where("k % 10 > 1").select("parcel_id"), "parcel_id"))
    trees = homes(spark, sf).where("k % 10 = 2").select("parcel_id", F.inline(F.array(
        F.struct(F.lit(1).alias("rank"), V.box(20, 20, 60, 50).alias("rings")), F.struct(F.lit(2).alias("rank"), V.box(40, 30, 80, 60).alias("rings")))))

    def there(df):  # metres from a place in zone 17
        moved = F.transform("fence", lambda r: F.transform(r, lambda p: F.array(p[0] + 583_000, p[1] + 4_498_000)))
        return regions.in_degrees(df.withColumn("fence", moved), 17, column="fence")

    def listed(layer, kind):
        at = "feature.properties."
        return layer.select("parcel_id", "feature.id", at + "layer", at + "label", at + "confidence", kind.alias("fence_type"), F.size("feature.geometry.coordinates").alias("n_lines"))

    fence_type = F.col("feature.properties.fence_type")
    out = listed(sinks.stream_fence_layer(there(streams), regions.STREAM_FENCE), F.lit(None).cast("string"))
    out = out.unionByName(listed(sinks.zone_fence_layer(there(ponds), "water", regions.ZONE_FENCE), fence_type))
    return out.unionByName(listed(sinks.zone_fence_layer(there(regions.zone_fences(trees)), "tree", regions.ZONE_FENCE), fence_type))


@query("search_space_layer", with_(_CLAIMED) + """SELECT parcel_id, 'tree-search-space' AS id, 'tree_search_space_diagnostic' AS layer, 'low' AS confidence, 1 AS n_polygons, CASE kind WHEN 0 THEN 0 ELSE 3 END AS n_holes FROM made WHERE kind <> 1""")
def search_space_layer(spark, sf):
    left = regions.tree_search_space(homes(spark, sf), claims(spark, sf)).select("parcel_id", "rings")
    got = sinks.search_space_layer(regions.polygons_of(left)).select("parcel_id", "feature.id", "feature.properties.layer", "feature.properties.confidence", F.col("feature.geometry.coordinates").alias("p"))
    return got.select("parcel_id", "id", "layer", "confidence", F.size("p").alias("n_polygons"), (F.size(F.flatten("p")) - F.size("p")).alias("n_holes"))
