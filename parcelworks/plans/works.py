"""Queries of water zones and road corridors: the chain from production patches to the
selected zone and the routed network, and its parts with SQL on the polygon views."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import corridors, features, grid, kernels, lines, regions, reports, sinks, waterzones
from . import views as V
from .catalog import PX, PY, _checkpoints, query, rounded, step1, trimmed, with_
from .land import unit_rings

SIZES = {"least_acres": 0.02, "target_acres": 0.08}


# --- parts with SQL ------------------------------------------------------------------------

@query("water_reach", with_(V.CELLS, V.SHAPES) + """, d AS (SELECT cells.parcel_id, r, c, min(sqrt(greatest(x - (c * 5 + 2.5), c * 5 + 2.5 - (x + w), 0) ** 2 + greatest(top - (r * 5 + 2.5), r * 5 + 2.5 - (top + h), 0) ** 2)) AS d
    FROM cells JOIN shapes ON shapes.parcel_id = cells.parcel_id AND kind = 'production' WHERE in_parcel GROUP BY cells.parcel_id, r, c)
  SELECT parcel_id, r, c, d <= 7.3 AS in_service, d < 5 AS near_production FROM d WHERE d <= 7.3""")
def water_reach(spark, sf):
    """Cells by how far they lie from production: a reach of 7.3 m, a setback of 5 m."""
    fields, home = V.shapes(spark, sf).where("kind = 'production'"), V.grid_parcels(spark, sf)
    got = waterzones.gated(bare(spark, sf), fields.withColumn("fill", F.col("rings")), home, home.where(F.lit(False)), PX, PY, service=7.3)
    return got.where("in_service").select(*grid.KEY, "in_service", "near_production")


def bare(spark, sf):
    """Cells that drain themselves only, without trees."""
    return V.cells(spark, sf).select(*grid.KEY, "z", F.lit(1).cast("long").alias("accumulation"), F.lit(False).alias("canopy"))


_SERVED = """pairs AS (SELECT a.parcel_id, anchor_id AS zone_id, zone_id AS production_area_id, anchor_id % 40 - zone_id % 11 AS rise,
    sqrt(greatest(s.x - a.x, a.x - (s.x + w), 0) ** 2 + greatest(top - a.y, a.y - (top + h), 0) ** 2) AS d FROM anchors a JOIN shapes s ON s.parcel_id = a.parcel_id AND kind = 'production')"""


@query("zone_service", with_(V.CELLS, V.SHAPES, V.ANCHORS, _SERVED) + """SELECT parcel_id, zone_id, production_area_id, CAST(rise AS DOUBLE) AS elevation_differential_m, round(d, 1) + 0.0 AS distance_m,
  round(CASE WHEN d > 1e-6 THEN rise / d * 100 ELSE 0 END, 2) + 0.0 AS gradient_pct, rise > 0 AS above_production_area,
  row_number() OVER (PARTITION BY parcel_id, zone_id ORDER BY rise DESC, production_area_id) AS place FROM pairs WHERE d <= 60""")
def zone_service(spark, sf):
    """Places on the grids and the production that each could serve within 60 m."""
    zones = V.anchors(spark, sf).select("parcel_id", F.col("anchor_id").alias("zone_id"), "x", (-F.col("y")).alias("y"), (F.col("anchor_id") % 40).cast("double").alias("representative_elevation_m"))
    fields = V.shapes(spark, sf).where("kind = 'production'").select("parcel_id", F.col("zone_id").alias("patch_id"), "rings", (F.col("zone_id") % 11).cast("double").alias("median_z"))
    got = waterzones.relationships(zones, fields, 60.0)
    return got.withColumns({n: F.col(n) + 0.0 for n in ("elevation_differential_m", "distance_m", "gradient_pct")}).withColumn("place", F.col("place").cast("long"))


_SHARE = """soils AS (SELECT c.c_custkey, sum(o_orderkey % 150 * a) AS ka, sum(a) AS a FROM (
    SELECT c_custkey, o_orderkey, greatest(0, least(c_custkey % 90 + 200, o_orderkey * 37 % 300 + 20 + o_orderkey % 30) - greatest(c_custkey % 90, o_orderkey * 37 % 300))
      * greatest(0, least(c_custkey % 70 + 150, o_orderkey * 91 % 240 + 16 + o_orderkey % 24) - greatest(c_custkey % 70, o_orderkey * 91 % 240)) / 2 AS a
    FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 6 <> 1 AND CAST(o_orderkey AS VARCHAR) IN (SELECT mukey FROM mapunits)) c WHERE a > 0 GROUP BY c.c_custkey)"""


@query("zone_soil", with_(V.MAPUNITS, _SHARE) + """SELECT CAST(c.c_custkey AS VARCHAR) AS parcel_id, CAST(0 AS INT) AS zone_id, round(ka / a, 6) AS ksat, round(CASE WHEN a IS NOT NULL THEN least(1.0, a / 15000.0) END, 6) AS coverage
  FROM customer c LEFT JOIN soils s ON s.c_custkey = c.c_custkey""")
def zone_soil(spark, sf):
    """The soil under a turned rectangle of 200 by 150 a parcel."""
    k = F.col("c_custkey")
    u, v = (k % 90).cast("double"), (k % 70).cast("double")
    ring = F.array(*[F.array((a + b) / 2, (b - a) / 2) for a, b in ((u, v), (u + 200, v), (u + 200, v + 150), (u, v + 150))])
    zones = V.table(spark, sf, "customer").select(k.cast("string").alias("parcel_id"), F.lit(0).alias("zone_id"), F.array(ring).alias("rings"))
    units = unit_rings(spark, sf)
    o = F.col("mukey").cast("long")
    ksat = units.select("mukey", F.when(o % 6 == 1, "n/a").otherwise((o % 150).cast("string")).alias("ksat_r"))
    got = waterzones.soil_under(zones, units, ksat)
    return got.select("parcel_id", "zone_id", *[F.round(n, 6).alias(n) for n in ("ksat", "coverage")])


# --- the chain -----------------------------------------------------------------------------

def _patches(pdf: pd.DataFrame) -> pd.DataFrame:
    found = kernels.production_clusters(kernels.to_grid(pdf.assign(one=1.0), "one") > 0, kernels.to_grid(pdf), PX, PY, least_acres=0.02)
    rows = [(p["patch_id"], int(r), int(c), bool(p["fill"][r, c]), p["median_z"]) for p in found for r, c in np.argwhere(p["cells"])]
    return pd.DataFrame(rows, columns=["patch_id", "r", "c", "in_fill", "median_z"])


def patches(spark, sf):
    """Production patches of the trimmed ground, with their outlines."""
    cells = kernels.per_parcel(trimmed(spark, sf).select(*grid.KEY, "z"), _patches, "patch_id int, r int, c int, in_fill boolean, median_z double")
    return waterzones.patch_ground(cells, V.grid_parcels(spark, sf), PX, PY)


def wet_cells(spark, sf, fields):
    roads = regions.footprints(V.cells(spark, sf).where("road"), ["parcel_id"], PX, PY)
    trees = grid.tree_root_zone(V.cells(spark, sf), PX, PY, buffer_meters=waterzones.CANOPY).select(*grid.KEY, F.col("tree_root").alias("canopy"))
    cells = waterzones.drainage(V.cells(spark, sf), PX, PY).hint("merge").join(trees, grid.KEY)
    return waterzones.gated(cells, fields, V.grid_parcels(spark, sf), regions.buffered(roads, waterzones.ROAD), PX, PY)


def zones_of(spark, sf, fields):
    """Grids here are 2.5 acres, so a zone is smaller than by default; the rest is."""
    return waterzones.selected_zones(wet_cells(spark, sf, fields), fields, V.grid_parcels(spark, sf), PX, PY, **SIZES)


@query("water_zones")
def water_zones(spark, sf):
    """The selected zone of every grid with how it serves production, scored by the soil,
    streams and valleys that the tables give."""
    _checkpoints(spark)
    fields = patches(spark, sf).checkpoint()
    zones = zones_of(spark, sf, fields).checkpoint()
    served = waterzones.relationships(zones, fields)
    units = V.shapes(spark, sf).select("parcel_id", F.col("zone_id").cast("string").alias("mukey"), "rings")
    soil = waterzones.soil_under(zones, units, units.select("mukey", (F.col("mukey").cast("long") % 150).cast("string").alias("ksat_r")))
    k = F.col("s_suppkey")
    x = (k * 13 % 95).cast("double")
    streams = V.table(spark, sf, "supplier").select(
        F.floor(k / 20).cast("string").alias("parcel_id"), k.alias("stream_id"), F.array(F.array(F.array(x, F.lit(-100.0)), F.array(x, F.lit(-60.0)))).alias("rings"), F.when(k % 3 == 0, "46006").otherwise("46003").alias("fcode"))
    near = lines.nearest_shape(zones, streams, "zone_id", "stream_id", "area", "line").hint("merge").join(streams.select("parcel_id", "stream_id", "fcode"), ["parcel_id", "stream_id"])
    down = kernels.per_parcel(V.cells(spark, sf).select(*grid.KEY, "z"), _branches, "valley_id int, max_acres double, branch_id int, seq int, r int, c int, x double, y double, z double")
    inside = lines.valley_inputs(zones, down, PX, PY)
    scored = waterzones.suitability(zones, served, soil, near.withColumnRenamed("distance", "stream_distance"), inside)
    return scored.select("parcel_id", "zone_id", "confidence", (F.round(regions.area("rings") / grid.SQUARE_METERS_PER_ACRE, 6)).alias("acres"), *rounded("score", "gravity_factor", "soil_factor", "stream_factor", "topographic_factor"))


def _branches(pdf: pd.DataFrame) -> pd.DataFrame:
    z = kernels.to_grid(pdf)
    rows = [
        (k, v["max_acres"], b, s, r, c, (c + 0.5) * PX, -(r + 0.5) * PY, z[r, c])
        for k, v in enumerate(kernels.valleys(z, PX, PY, stream=0.05, primary=0.2)) for b, cells in enumerate(v["branches"]) for s, (r, c) in enumerate(cells)]
    return pd.DataFrame(rows, columns=["valley_id", "max_acres", "branch_id", "seq", "r", "c", "x", "y", "z"])


def routed(spark, sf):
    """Networks of all grids from their anchor of smallest id, and their wet ground."""
    fields = patches(spark, sf).checkpoint()
    ponds = zones_of(spark, sf, fields).select("parcel_id", F.col("fill").alias("rings"))
    wet = regions.footprints(V.cells(spark, sf).where("hydric"), ["parcel_id"], PX, PY)
    lean = grid.tpi(V.cells(spark, sf), PX, PY).select(*grid.KEY, "tpi")
    sloped = grid.horn(V.cells(spark, sf), PX, PY).select(*grid.KEY, "z", "slope_pct").hint("merge").join(lean, grid.KEY)
    cells = sloped.hint("merge").join(step1(spark, sf).select(*grid.KEY, F.col("tree_root").alias("canopy")), grid.KEY)
    priced = corridors.priced(cells, V.grid_parcels(spark, sf), fields.select("parcel_id", F.col("fill").alias("rings")), ponds, wet, PX, PY)
    start = V.grid_parcels(spark, sf).select("parcel_id", F.lit(5.0).alias("x"), F.lit(-95.0).alias("y"))
    return corridors.networks(priced, start, PX, PY, least=20.0, radius=15.0, per_acre=5000.0), wet


@query("road_corridors")
def road_corridors(spark, sf):
    """The branches of every grid's network."""
    _checkpoints(spark)
    found, wet = routed(spark, sf)
    return corridors.branches(found, wet).drop("cells", "line")


def there(df, column):
    """Lines of [x, y, ...] of the grids as a place in zone 17, in degrees."""
    moved = F.transform(column, lambda p: F.array(p[0] + 583_000, p[1] + 4_498_000))
    return regions.in_degrees(df.withColumn(column, F.array(moved)), 17, column=column).withColumn(column, F.col(column)[0])


def shapes_there(df, column):
    moved = F.transform(column, lambda r: F.transform(r, lambda p: F.array(p[0] + 583_000, p[1] + 4_498_000)))
    return regions.in_degrees(df.withColumn(column, moved), 17, column=column)


@query("corridor_layers")
def corridor_layers(spark, sf):
    """A collection a parcel of its corridors."""
    _checkpoints(spark)
    found, wet = routed(spark, sf)
    roads = sinks.corridor_layer(there(corridors.branches(found, wet).withColumn("is_fallback", F.lit(False)), "line"))
    return features.collection(roads)


@query("water_zone_layers")
def water_zone_layers(spark, sf):
    _checkpoints(spark)
    fields = patches(spark, sf).checkpoint()
    zones = zones_of(spark, sf, fields).checkpoint()
    drawn = shapes_there(shapes_there(zones, "rings"), "fill")
    drawn = regions.polygons_of(drawn, "fill").drop("fill").withColumnRenamed("coordinates", "fill")
    drawn = regions.polygons_of(drawn)
    return features.collection(sinks.water_zone_layer(drawn, waterzones.relationships(zones, fields)))


def ring_patches(spark, sf):
    """Rectangles as patches, what is drawn of them 5 m in from their edges."""
    k, acres = F.col("zone_id"), grid.SQUARE_METERS_PER_ACRE
    got = V.zone_rings(spark, sf).select("parcel_id", k.alias("patch_id"), regions.from_ring("ring_x", "ring_y").alias("rings"), (k % 40 + 0.3).alias("median_z"))
    inner = regions.buffered(got.select("parcel_id", "patch_id", "rings"), -5.0).select("parcel_id", "patch_id", (regions.area("rings") / acres).alias("fill_acres"))
    return got.withColumn("acres", regions.area("rings") / acres).hint("merge").join(inner, ["parcel_id", "patch_id"])


_ACRES = f"round(w * h / {grid.SQUARE_METERS_PER_ACRE}, 2)"


@query("production_layer", with_(V.RINGS) + f"""SELECT parcel_id, 'production-area-' || zone_id AS id, 'Production area candidate ' || zone_id AS label, 'low' AS confidence, {_ACRES} AS area_acres,
  CAST(zone_id % 40 + 0.3 AS DOUBLE) AS representative_elevation_m, round((w - 10) * (h - 10) / {grid.SQUARE_METERS_PER_ACRE}, 2) AS render_fill_area_acres, 1 AS n_polygons FROM zone_rings""")
def production_layer(spark, sf):
    got = sinks.production_layer(regions.polygons_of(shapes_there(ring_patches(spark, sf), "rings")))
    at = "feature.properties."
    return got.select("parcel_id", "feature.id", *[at + n for n in ("label", "confidence", "area_acres", "representative_elevation_m", "render_fill_area_acres")], F.size("feature.geometry.coordinates").alias("n_polygons"))


@query("production_summaries", with_(V.RINGS) + f"""SELECT n AS parcel_id, CASE WHEN count(zone_id) = 0 THEN 'No production-area candidates identified on this property.' ELSE 'Production-area candidates found: ' || count(zone_id) || chr(10)
  || string_agg('  - Patch ' || zone_id || ': ' || {_ACRES} || ' acres, representative elevation ' || zone_id % 40 || '.3m', chr(10) ORDER BY {_ACRES} DESC, zone_id) END AS summary
  FROM (SELECT DISTINCT CAST(c_custkey // 100 AS VARCHAR) AS n FROM customer) LEFT JOIN zone_rings ON parcel_id = n GROUP BY n""")
def production_summaries(spark, sf):
    """Parcels by hundreds of customers, so that some have no patch."""
    homes = V.table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 100).cast("string").alias("parcel_id")).distinct()
    return reports.production_summary(homes, ring_patches(spark, sf))


@query("corridor_summaries")
def corridor_summaries(spark, sf):
    _checkpoints(spark)
    found, wet = routed(spark, sf)
    found = found.checkpoint()
    return reports.corridor_summary(found, corridors.branches(found, wet))
