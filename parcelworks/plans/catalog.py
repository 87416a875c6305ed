"""Every registered query of the site-planning operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import factors as X
from ..operators import features, grid, kernels, lines, records, regions, reports, scoring, sinks, soil
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PX, PY, ACRE = V.PX, V.PY, grid.cell_area_acres(V.PX, V.PY)


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def rounded(*names: str) -> list:
    """Rounded to what two engines' sums agree on; -0.0 becomes 0.0."""
    return [(F.round(n, 8) + 0.0).alias(n) for n in names]


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _checkpoints(spark: SparkSession) -> None:
    """A checkpoint folder where the session has none (single-machine runs)."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="parcelworks-"))


# --- soil --------------------------------------------------------------------------------

_PCT = "coalesce(TRY_CAST(comppct_r AS DOUBLE), 0.0)"
_HYDRIC = "lower(trim(hydricrating)) IN ('yes', 'partially hydric')"


@query("hydric_mukeys", with_(V.COMPONENTS) + f"SELECT mukey, sum({_PCT}) AS hydric_pct FROM components WHERE {_HYDRIC} GROUP BY mukey HAVING sum({_PCT}) >= 50")
def hydric_mukeys(spark, sf):
    return soil.hydric_mukeys(V.components(spark, sf))


_DOMINANT = "row_number() OVER (PARTITION BY mukey ORDER BY TRY_CAST(comppct_r AS DOUBLE) DESC NULLS LAST, compname"


@query("dominant_component", with_(V.COMPONENTS) + f"""SELECT mukey, compname, comppct_r,
  CASE WHEN TRY_CAST(comppct_r AS DOUBLE) >= 50 THEN 'high' WHEN TRY_CAST(comppct_r AS DOUBLE) >= 20 THEN 'medium' ELSE 'low' END AS confidence
  FROM (SELECT *, {_DOMINANT}) AS n FROM components) WHERE n = 1""")
def dominant_component(spark, sf):
    return soil.dominant_component(V.components(spark, sf)).select("mukey", "compname", "comppct_r", "confidence")


def _horizon_sql(value: str, more: str) -> str:
    return with_(V.COMPONENTS, V.HORIZONS) + f"""SELECT mukey, compname, {value}, {more} FROM (
  SELECT *, {_DOMINANT}, cokey) AS n FROM (
    SELECT c.mukey, c.cokey, c.compname, c.comppct_r, max(h.{value}) AS {value} FROM components c JOIN horizons h ON h.cokey = c.cokey
    WHERE h.hzdept_r = (SELECT min(hzdept_r) FROM horizons i WHERE i.cokey = c.cokey AND i.hzname NOT LIKE 'O%')
    GROUP BY ALL)) WHERE n = 1"""


@query("erosion_factor", _horizon_sql("kwfact", "coalesce(TRY_CAST(kwfact AS DOUBLE) >= 0.32, FALSE) AS erosion_prone"))
def erosion_factor(spark, sf):
    return soil.erosion_factor(V.components(spark, sf), V.horizons(spark, sf)).select("mukey", "compname", "kwfact", "erosion_prone")


_HOLD = "CASE WHEN {0} IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, 1.0 - (log10(greatest({0}, 1e-6)) - log10(0.1)) / (log10(100.0) - log10(0.1)))) END"


@query("saturated_conductivity", _horizon_sql("ksat_r", f"round({_HOLD.format('TRY_CAST(ksat_r AS DOUBLE)')}, 8) + 0.0 AS water_holding_factor"))
def saturated_conductivity(spark, sf):
    return soil.conductivity(V.components(spark, sf), V.horizons(spark, sf)).select("mukey", "compname", "ksat_r", *rounded("water_holding_factor"))


@query("farmland_classification", with_(V.MAPUNITS, V.COMPONENTS) + f"""SELECT mukey, farmlndcl AS farmland_classification,
  coalesce(farmlndcl LIKE 'All areas are prime farmland%' OR farmlndcl LIKE 'Prime farmland if%', FALSE) AS is_prime
  FROM mapunits WHERE mukey IN (SELECT mukey FROM components WHERE {_HYDRIC})""")
def farmland_classification(spark, sf):
    return soil.farmland(V.mapunits(spark, sf), V.components(spark, sf).where(X.is_hydric(F.col("hydricrating"))))


@query("soil_at_place", with_(V.MAPUNITS, V.COMPONENTS) + "SELECT mukey, cokey, compname, comppct_r FROM components WHERE mukey IN (SELECT mukey FROM mapunits WHERE o_orderstatus = 'F')")
def soil_at_place(spark, sf):
    return soil.at_place(V.components(spark, sf), V.mapunits(spark, sf).where("o_orderstatus = 'F'")).select("mukey", "cokey", "compname", "comppct_r")


@query("soil_features", with_(V.MAPUNITS, V.COMPONENTS) + f"""SELECT m.mukey, any_value(m.geometry) AS geometry, any_value(dominant) AS dominant, count(*) AS n_components
  FROM mapunits m JOIN (SELECT *, first_value(compname) OVER (PARTITION BY mukey ORDER BY TRY_CAST(comppct_r AS DOUBLE) DESC NULLS LAST, compname) AS dominant FROM components WHERE comppct_r <> 'n/a') c
  ON c.mukey = m.mukey GROUP BY m.mukey""")
def soil_features(spark, sf):
    known = V.components(spark, sf).where("comppct_r <> 'n/a'")
    got = soil.as_features(known, V.mapunits(spark, sf).select("mukey", "geometry"))
    return got.select("mukey", "geometry", "dominant", F.col("n_components").cast("long").alias("n_components"))


# --- records -----------------------------------------------------------------------------

_LABELS = "['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW']"
_WIND = "wind_dir IS NOT NULL AND wind_speed IS NOT NULL"


@query("climate_summary", with_(V.CLIMATE) + f"""SELECT parcel_id, round(wind_deg, 8) + 0.0 AS wind_deg,
  {_LABELS}[CAST(round_even(wind_deg / 22.5, 0) AS INT) % 16 + 1] AS wind_label, round(annual_precip_mm, 8) AS annual_precip_mm, max_precip_mm,
  round(avg_high_c, 8) AS avg_high_c, round(avg_low_c, 8) AS avg_low_c, record_high_c, record_low_c, years_analyzed FROM (
  SELECT parcel_id, (degrees(atan2(sum(sin(radians(wind_dir)) * wind_speed) FILTER ({_WIND}), sum(cos(radians(wind_dir)) * wind_speed) FILTER ({_WIND}))) + 360) % 360 AS wind_deg,
    sum(precip) / (max(year(date)) - min(year(date)) + 1) AS annual_precip_mm, max(precip) AS max_precip_mm, avg(tmax) AS avg_high_c, avg(tmin) AS avg_low_c,
    max(tmax) AS record_high_c, min(tmin) AS record_low_c, CAST(max(year(date)) - min(year(date)) + 1 AS BIGINT) AS years_analyzed FROM climate GROUP BY parcel_id)""")
def climate_summary(spark, sf):
    got = records.climate_summary(V.climate(spark, sf))
    return got.select("parcel_id", "wind_label", "max_precip_mm", "record_high_c", "record_low_c", "years_analyzed", *rounded("wind_deg", "annual_precip_mm", "avg_high_c", "avg_low_c"))


_PIXELS = "pixels AS (SELECT CAST(l_suppkey AS VARCHAR) AS parcel_id, l_quantity AS red, l_discount * 400 AS nir FROM lineitem)"


@query("ndvi_summary", with_(_PIXELS, "v AS (SELECT parcel_id, (nir - red) / (nir + red) AS v FROM pixels WHERE red > 0 AND nir > 0)") + """
  SELECT parcel_id, round(100.0 * count(*) FILTER (v < 0) / count(*), 8) AS water_pct, round(100.0 * count(*) FILTER (v >= 0 AND v < 0.2) / count(*), 8) AS bare_pct,
  round(100.0 * count(*) FILTER (v >= 0.2 AND v < 0.4) / count(*), 8) AS sparse_pct, round(100.0 * count(*) FILTER (v >= 0.4) / count(*), 8) AS dense_pct,
  round(avg(v), 8) + 0.0 AS avg_ndvi, round(min(v), 8) AS min_ndvi, round(max(v), 8) AS max_ndvi, count(*) AS n_pixels FROM v GROUP BY parcel_id""")
def ndvi_summary(spark, sf):
    pixels = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("parcel_id"), F.col("l_quantity").alias("red"), (F.col("l_discount") * 400).alias("nir"))
    got = records.ndvi_summary(pixels)
    return got.select("parcel_id", "n_pixels", *rounded("water_pct", "bare_pct", "sparse_pct", "dense_pct", "avg_ndvi", "min_ndvi", "max_ndvi"))


@query("newest_scene", """SELECT parcel_id, max_by(scene_id, (scene_date, scene_id)) AS scene_id, CAST(max(scene_date) AS VARCHAR) AS scene_date, date_diff('day', max(scene_date), DATE '2024-02-01') AS age_days
  FROM (SELECT CAST(user_id % 30 AS VARCHAR) AS parcel_id, event_id AS scene_id, CAST(ts AS DATE) AS scene_date, value AS cloud FROM events)
  WHERE cloud < 20 AND scene_date >= DATE '2024-02-01' - 365 GROUP BY parcel_id""")
def newest_scene(spark, sf):
    scenes = V.table(spark, sf, "events").select((F.col("user_id") % 30).cast("string").alias("parcel_id"), F.col("event_id").alias("scene_id"), F.to_date("ts").alias("scene_date"), F.col("value").alias("cloud_cover_pct"))
    got = records.newest_scene(scenes, today=F.lit("2024-02-01").cast("date"))
    return got.select("parcel_id", "scene_id", F.col("scene_date").cast("string").alias("scene_date"), F.col("age_days").cast("long").alias("age_days"))


@query("farm_roads", with_(V.ROADS) + """SELECT parcel_id, layer, geometry, coalesce(nullif(trim(name), ''), nullif(trim(fullname), ''), 'Unnamed road') AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY parcel_id, geometry ORDER BY layer, name NULLS FIRST, fullname NULLS FIRST) AS n FROM roads WHERE layer IN (30, 31, 32)) WHERE n = 1 AND geometry IS NOT NULL""")
def farm_roads(spark, sf):
    return records.farm_roads(V.roads(spark, sf))


@query("water_features", """SELECT 'nhd-' || l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_linenumber = 6 THEN 'stream' ELSE 'water_body' END AS kind,
  CASE WHEN l_returnflag <> 'N' THEN 'name ' || l_returnflag WHEN l_linenumber = 6 THEN 'Unnamed stream' ELSE 'Unnamed water body' END AS name,
  CASE 46000 + l_partkey % 9 WHEN 46006 THEN 'perennial' WHEN 46003 THEN 'intermittent' WHEN 46007 THEN 'ephemeral' ELSE 'unknown' END AS permanence
  FROM lineitem WHERE l_linenumber IN (6, 7)""")
def water_features(spark, sf):
    line = V.table(spark, sf, "lineitem")
    raw = line.select(
        F.when(F.col("l_linenumber") == 6, 6).when(F.col("l_linenumber") == 7, 12).otherwise(1).alias("layer"), F.lit(None).cast("string").alias("permanent_identifier"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("objectid"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat(F.lit("name "), "l_returnflag")).alias("gnis_name"), (46000 + F.col("l_partkey") % 9).cast("string").alias("fcode"), F.lit("x").alias("geometry"),
    )
    return records.water_features(raw).select("id", "kind", "name", "permanence")


@query("irradiance_baseline", """SELECT site, status, CASE WHEN status = 'ok' THEN round(ac / 4.0, 8) END AS kwh_per_kw FROM (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS site, l_extendedprice / 10 AS ac,
  CASE WHEN abs(l_extendedprice / 10 / 4.0 / 8760.0 * 100.0 - l_quantity / 2) > 0.5 THEN 'validation_failed' ELSE 'ok' END AS status FROM lineitem WHERE l_linenumber = 1)""")
def irradiance_baseline(spark, sf):
    rows = V.table(spark, sf, "lineitem").where("l_linenumber = 1").select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("site"), (F.col("l_extendedprice") / 10).alias("ac_annual"), (F.col("l_quantity") / 2).alias("capacity_factor"))
    return records.irradiance_baseline(rows).select("site", "status", F.round("kwh_per_kw", 8).alias("kwh_per_kw"))


@query("elevation_lattice", """SELECT n_nationkey, i, j, round(n_nationkey + i / 5.0 * 2, 8) AS lon, round(10 + j / 5.0 * n_regionkey, 8) AS lat FROM nation,
  (SELECT CAST(unnest(range(6)) AS INT) AS i), (SELECT CAST(unnest(range(6)) AS INT) AS j)""")
def elevation_lattice(spark, sf):
    boxes = V.table(spark, sf, "nation").select("n_nationkey", F.col("n_nationkey").alias("west"), F.lit(10).alias("south"), (F.col("n_nationkey") + 2).alias("east"), (10 + F.col("n_regionkey")).alias("north"))
    return records.lattice(boxes, 6).select("n_nationkey", "i", "j", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


_DIST = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)"
_NEED = "pairs AS (SELECT a.parcel_id, a.point_id AS zone_id, b.point_id AS patch_id, a.z - b.z AS differential, " + _DIST + " AS distance FROM points a JOIN points b ON a.parcel_id = b.parcel_id WHERE a.kind = 0 AND b.kind = 1)"


def _kinds(spark, sf):
    every = V.points(spark, sf)
    return every.where("kind = 0"), every.where("kind = 1")


@query("nearest_patch", with_(V.POINTS, _NEED) + "SELECT parcel_id, zone_id, arg_min(patch_id, (distance, patch_id)) AS patch_id, round(min(distance), 8) AS distance, 'computed' AS status FROM pairs GROUP BY parcel_id, zone_id")
def nearest_patch(spark, sf):
    a, b = _kinds(spark, sf)
    _checkpoints(spark)
    zones, patches_ = (t.select("parcel_id", F.col("point_id").alias(n), regions.from_point("x", "y").alias("rings")) for t, n in ((a, "zone_id"), (b, "patch_id")))
    got = lines.nearest_shape(zones, patches_, "zone_id", "patch_id", "line", "line")
    return got.select("parcel_id", "zone_id", "patch_id", "status", *rounded("distance"))


def _gravity_sql(value: str, full: float, deficit: float) -> str:
    return f"CASE WHEN {value} >= {full} THEN 1.0 WHEN {value} >= 0 THEN 0.6 + {value} / {full} * 0.4 WHEN {value} <= {deficit} THEN 0.2 ELSE 0.6 - {value} / ({deficit}) * 0.4 END"


_GRAVITY = f"CASE WHEN distance = 0 THEN {_gravity_sql('differential', 3.0, -3.0)} ELSE {_gravity_sql('gradient_pct', 1.0, -5.0)} END"


@query("service_relationships", with_(V.POINTS, _NEED, "g AS (SELECT *, coalesce(differential / nullif(distance, 0) * 100, 0.0) AS gradient_pct FROM pairs WHERE distance <= 250)") + f"""
  SELECT parcel_id, zone_id, patch_id, round(distance, 8) AS distance, round(gradient_pct, 8) + 0.0 AS gradient_pct, round({_GRAVITY}, 8) AS gravity_factor FROM g""")
def service_relationships(spark, sf):
    got = records.service_relationships(*_kinds(spark, sf), radius=250.0)
    return got.select("parcel_id", F.col("l_point_id").alias("zone_id"), F.col("r_point_id").alias("patch_id"), *rounded("distance", "gradient_pct", "gravity_factor"))


# --- terrain -----------------------------------------------------------------------------

_NEAR = """near AS (SELECT a.parcel_id, a.r, a.c, a.z, b.z AS nz, b.r - a.r AS dr, b.c - a.c AS dc, sqrt(((b.c - a.c) * 5.0) ** 2 + ((b.r - a.r) * 5.0) ** 2) AS run
  FROM cells a JOIN cells b ON a.parcel_id = b.parcel_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c))"""
_SLOPE = "slope AS (SELECT parcel_id, r, c, max(abs(nz - z) / run * 100.0) AS slope_pct FROM near GROUP BY ALL)"
_HORN = """horn0 AS (SELECT parcel_id, r, c, sum(dc * (2 - abs(dr)) * nz) / 40.0 AS dx, sum(dr * (2 - abs(dc)) * nz) / 40.0 AS dy, count(*) AS n FROM near GROUP BY ALL),
horn AS (SELECT parcel_id, r, c, CASE WHEN n = 8 THEN sqrt(dx * dx + dy * dy) * 100 END AS slope_pct,
  CASE WHEN n = 8 AND sqrt(dx * dx + dy * dy) >= 1e-6 THEN (90 - degrees(atan2(dy, -dx)) + 360) % 360 END AS aspect_deg FROM horn0)"""


@query("neighbour_slope", with_(V.CELLS, _NEAR, _SLOPE) + "SELECT parcel_id, r, c, round(slope_pct, 8) AS slope_pct FROM slope")
def neighbour_slope(spark, sf):
    return grid.neighbour_slope(V.cells(spark, sf), PX, PY).select(*grid.KEY, *rounded("slope_pct"))


@query("horn_slope_aspect", with_(V.CELLS, _NEAR, _HORN) + "SELECT parcel_id, r, c, round(slope_pct, 8) AS slope_pct, round(aspect_deg, 3) AS aspect_deg FROM horn")
def horn_slope_aspect(spark, sf):
    return grid.horn(V.cells(spark, sf), PX, PY).select(*grid.KEY, *rounded("slope_pct"), F.round("aspect_deg", 3).alias("aspect_deg"))


@query("topographic_position", with_(V.CELLS) + """SELECT a.parcel_id, a.r, a.c, CASE WHEN count(*) >= 5 THEN round(any_value(a.z) - avg(b.z), 10) + 0.0 END AS tpi
  FROM cells a JOIN cells b ON a.parcel_id = b.parcel_id AND sqrt(((b.c - a.c) * 5.0) ** 2 + ((b.r - a.r) * 5.0) ** 2) <= 25 GROUP BY ALL""")
def topographic_position(spark, sf):
    return grid.tpi(V.cells(spark, sf), PX, PY, 25.0).select(*grid.KEY, (F.round("tpi", 10) + 0.0).alias("tpi"))


@query("shading", with_(V.CELLS) + """SELECT a.parcel_id, a.r, a.c, round(1.0 - least(coalesce(max(degrees(atan2(b.z - a.z, sqrt(((b.c - a.c) * 5.0) ** 2 + ((b.r - a.r) * 5.0) ** 2)))), 0.0) / 20.0, 1.0), 8) + 0.0 AS shading_score
  FROM cells a LEFT JOIN cells b ON a.parcel_id = b.parcel_id AND (b.c - a.c) ** 2 + (b.r - a.r) ** 2 BETWEEN 1 AND 100 AND b.z > a.z
  AND (degrees(atan2(b.c - a.c, a.r - b.r)) + 360) % 360 BETWEEN 100 AND 260 GROUP BY ALL""")
def shading(spark, sf):
    return grid.shading(V.cells(spark, sf), PX, PY).select(*grid.KEY, *rounded("shading_score"))


_FLOW = """flow AS (SELECT parcel_id, r, c, arg_max(dr, ((z - nz) / run, -((dr + 1) * 3 + dc + 1))) AS dr, arg_max(dc, ((z - nz) / run, -((dr + 1) * 3 + dc + 1))) AS dc FROM near WHERE nz < z GROUP BY ALL)"""


@query("flow_direction", with_(V.CELLS, _NEAR, _FLOW) + "SELECT a.parcel_id, a.r, a.c, a.r + dr AS to_r, a.c + dc AS to_c FROM cells a LEFT JOIN flow USING (parcel_id, r, c)")
def flow_direction(spark, sf):
    return grid.flow_direction(V.cells(spark, sf), PX, PY).select(*grid.KEY, "to_r", "to_c")


def _accumulate(pdf: pd.DataFrame) -> pd.DataFrame:
    z = kernels.to_grid(pdf)
    direction = kernels.directions(kernels.fill(z), PX, PY)
    filled = kernels.fill(z)
    return kernels.as_rows(filled=filled, accumulation=kernels.accumulation(filled, direction).astype(np.int64)).dropna()


@query("flow_accumulation")
def flow_accumulation(spark, sf):
    return kernels.per_parcel(V.cells(spark, sf), _accumulate, "r int, c int, filled double, accumulation long")


def _valleys(pdf: pd.DataFrame) -> pd.DataFrame:
    found = kernels.valleys(kernels.to_grid(pdf), PX, PY, stream=0.05, primary=0.2)
    return pd.DataFrame([(v["valley_id"], v["max_acres"], b, s, r, c) for v in found for b, way in enumerate(v["branches"]) for s, (r, c) in enumerate(way)], columns=["valley_id", "max_acres", "branch_id", "seq", "r", "c"])


@query("valleys")
def valleys(spark, sf):
    return kernels.per_parcel(V.cells(spark, sf), _valleys, "valley_id int, max_acres double, branch_id int, seq int, r int, c int")


def _keypoints(pdf: pd.DataFrame) -> pd.DataFrame:
    found = kernels.keypoints(kernels.to_grid(pdf), PX, PY, run=2, drop=0.5, artefact=1.0, stream=0.05, primary=0.2)
    return pd.DataFrame(found, columns=["keypoint_id", "valley_id", "r", "c", "drop_pct"])


@query("keypoints")
def keypoints(spark, sf):
    return kernels.per_parcel(V.cells(spark, sf), _keypoints, "keypoint_id int, valley_id int, r int, c int, drop_pct double")


@query("contour_lines")
def contour_lines(spark, sf):
    return lines.contour_lines(V.cells(spark, sf)).select("parcel_id", F.round("elevation_m", 3).alias("elevation_m"), "line_id", "closed", "n_points", "rows", "cols")


@query("contour_levels", with_(V.CELLS, """sides AS (SELECT a.parcel_id, a.z AS z0, b.z AS z1, c.z AS z2, d.z AS z3 FROM cells a JOIN cells b ON a.parcel_id = b.parcel_id AND b.r = a.r AND b.c = a.c + 1
    JOIN cells c ON a.parcel_id = c.parcel_id AND c.r = a.r + 1 AND c.c = a.c + 1 JOIN cells d ON a.parcel_id = d.parcel_id AND d.r = a.r + 1 AND d.c = a.c)""",
    """levels AS (SELECT parcel_id, lo + 0.6 * unnest(range(1000)) AS level, hi FROM (SELECT parcel_id, ceil(min(z) / 0.6) * 0.6 AS lo, max(z) AS hi FROM cells GROUP BY parcel_id))""")
    + """SELECT parcel_id, round(level, 3) AS elevation_m, CAST(sum(((z0 >= level) <> (z1 >= level))::INT + ((z1 >= level) <> (z2 >= level))::INT + ((z2 >= level) <> (z3 >= level))::INT + ((z3 >= level) <> (z0 >= level))::INT) // 2 AS BIGINT) AS n_pieces
  FROM levels JOIN sides USING (parcel_id) WHERE level < hi GROUP BY parcel_id, level HAVING n_pieces > 0""")
def contour_levels(spark, sf):
    """Every piece of a level is in one of its lines, once."""
    got = lines.contour_lines(V.cells(spark, sf))
    return got.groupBy("parcel_id", F.round("elevation_m", 3).alias("elevation_m")).agg(F.sum(F.col("n_points") - 1).alias("n_pieces"))


# --- masks -------------------------------------------------------------------------------

_DISC2 = "(b.r - a.r) ** 2 + (b.c - a.c) ** 2 <= 4"


def _low(spark, sf):
    return V.cells(spark, sf).withColumn("hit", F.col("z") < 6.0)


@query("erode_disc", with_(V.CELLS) + f"SELECT a.parcel_id, a.r, a.c, count(*) FILTER (b.z < 6.0) = 13 AS eroded FROM cells a JOIN cells b ON a.parcel_id = b.parcel_id AND {_DISC2} GROUP BY ALL")
def erode_disc(spark, sf):
    return grid.erode(_low(spark, sf), grid.disc(2)).select(*grid.KEY, "eroded")


@query("dilate_disc", with_(V.CELLS) + f"SELECT a.parcel_id, a.r, a.c, bool_or(b.z < 6.0) AS dilated FROM cells a JOIN cells b ON a.parcel_id = b.parcel_id AND {_DISC2} GROUP BY ALL")
def dilate_disc(spark, sf):
    return grid.dilate(_low(spark, sf), grid.disc(2)).select(*grid.KEY, "dilated")


_TREES = "trees AS (SELECT a.parcel_id, a.r, a.c, coalesce(bool_or(b.hag >= 4.5), FALSE) AS tree_root FROM cells a JOIN cells b ON a.parcel_id = b.parcel_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL)"


@query("tree_root_zone", with_(V.CELLS, _TREES) + "SELECT parcel_id, r, c, tree_root FROM trees")
def tree_root_zone(spark, sf):
    return grid.tree_root_zone(V.cells(spark, sf), PX, PY).select(*grid.KEY, "tree_root")


@query("canopy_gate", with_(V.CELLS) + "SELECT parcel_id, count(*) AS n_cells, round(count(*) FILTER (hag IS NULL) / count(*), 8) AS nan_share FROM cells WHERE in_parcel GROUP BY parcel_id")
def canopy_gate(spark, sf):
    n = F.count(F.lit(1))
    return V.cells(spark, sf).where("in_parcel").groupBy("parcel_id").agg(n.alias("n_cells"), F.round(F.count_if(F.col("hag").isNull()) / n, 8).alias("nan_share"))


def _reach_sql(steps: str) -> str:
    return with_(V.CELLS, "hits AS (SELECT parcel_id, r, c, r * 20 + c AS id FROM cells WHERE hydric OR hag >= 4.0)").replace("WITH", "WITH RECURSIVE", 1) + f""",
    reach AS (SELECT parcel_id, id, id AS seen FROM hits UNION SELECT a.parcel_id, a.id, b.id FROM reach a JOIN hits s ON s.parcel_id = a.parcel_id AND s.id = a.seen
      JOIN hits b ON b.parcel_id = s.parcel_id AND {steps}),
    low AS (SELECT parcel_id, id, min(seen) AS label FROM reach GROUP BY ALL)
    SELECT parcel_id, id, dense_rank() OVER (PARTITION BY parcel_id ORDER BY label) - 1 AS component FROM low"""


def _labelled(spark, sf, connectivity):
    cells = V.cells(spark, sf).withColumn("hit", F.coalesce(F.col("hydric") | (F.col("hag") >= 4.0), F.lit(False)))
    _checkpoints(spark)
    got = grid.components(cells, connectivity).where("component IS NOT NULL")
    return got.select("parcel_id", (F.col("r") * 20 + F.col("c")).alias("id"), F.col("component").cast("long").alias("component"))


@query("components_4", _reach_sql("abs(s.r - b.r) + abs(s.c - b.c) = 1"))
def components_4(spark, sf):
    return _labelled(spark, sf, 4)


@query("components_8", _reach_sql("abs(s.r - b.r) <= 1 AND abs(s.c - b.c) <= 1"))
def components_8(spark, sf):
    return _labelled(spark, sf, 8)


# --- production --------------------------------------------------------------------------

_ASPECT = "coalesce((1 + cos(radians(aspect_deg - 180))) / 2, 1.0)"
_STEP1 = f"""step1 AS (SELECT cells.*, slope.slope_pct, aspect_deg, tree_root, greatest(0.0, least(1.0, 1 - slope.slope_pct / 20.0)) AS slope_factor, {_ASPECT} AS aspect_factor,
  0.55 / 0.70 * greatest(0.0, least(1.0, 1 - slope.slope_pct / 20.0)) + 0.15 / 0.70 * {_ASPECT} AS cell_score,
  slope.slope_pct <= 20 AND in_parcel AND NOT hydric AND NOT tree_root AND NOT road AS eligible
  FROM cells JOIN slope USING (parcel_id, r, c) JOIN horn USING (parcel_id, r, c) JOIN trees USING (parcel_id, r, c))"""
_BASE = (V.CELLS, _NEAR, _SLOPE, _HORN, _TREES, _STEP1)


def step1(spark, sf):
    cells = V.cells(spark, sf)
    sloped = grid.neighbour_slope(cells, PX, PY)
    aspect = grid.horn(cells, PX, PY).select(*grid.KEY, "aspect_deg")
    trees = grid.tree_root_zone(cells, PX, PY).select(*grid.KEY, "tree_root")
    return scoring.eligible_cells(sloped.hint("merge").join(aspect, grid.KEY).hint("merge").join(trees, grid.KEY), PX, PY)


@query("step1_eligible", with_(*_BASE) + "SELECT parcel_id, r, c, round(cell_score, 8) AS cell_score, eligible FROM step1")
def step1_eligible(spark, sf):
    return step1(spark, sf).select(*grid.KEY, "eligible", *rounded("cell_score"))


@query("gate_report", with_(*_BASE) + f"""SELECT parcel_id, round(count(*) FILTER (hydric) * {ACRE}, 8) AS hydric_acres, round(count(*) FILTER (hydric AND NOT tree_root AND NOT road AND NOT slope_pct > 20) * {ACRE}, 8) AS only_hydric_acres,
  round(count(*) FILTER (slope_pct > 20) * {ACRE}, 8) AS slope_acres, round(count(*) FILTER (tree_root AND NOT hydric AND NOT road AND NOT slope_pct > 20) * {ACRE}, 8) AS only_tree_root_acres FROM step1 WHERE in_parcel GROUP BY parcel_id""")
def gate_report(spark, sf):
    return scoring.gate_report(step1(spark, sf), PX, PY).select("parcel_id", *rounded("hydric_acres", "only_hydric_acres", "slope_acres", "only_tree_root_acres"))


_TRIM = f"""kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY round(cell_score, 9) DESC, r DESC, c DESC) AS n,
  least(count(*) OVER (PARTITION BY parcel_id), ceil((area * 0.3 - 1e-9) / {ACRE})) AS keep FROM (SELECT *, count(*) FILTER (in_parcel) OVER (PARTITION BY parcel_id) * {ACRE} AS area FROM step1) WHERE eligible) WHERE n <= keep)"""


def trimmed(spark, sf):
    rounded = step1(spark, sf).withColumn("cell_score", F.round("cell_score", 9))
    return scoring.trim_to_ceiling(rounded, PX, PY, 30.0)


@query("trim_to_ceiling", with_(*_BASE, _TRIM) + "SELECT parcel_id, r, c FROM kept")
def trim_to_ceiling(spark, sf):
    return trimmed(spark, sf).select(*grid.KEY)


_PATCH = "patch AS (SELECT *, CAST(floor(r / 5) * 4 + floor(c / 5) AS INT) AS patch_id FROM kept)"


def patches(spark, sf):
    return trimmed(spark, sf).withColumn("patch_id", (F.floor(F.col("r") / 5) * 4 + F.floor(F.col("c") / 5)).cast("int"))


@query("production_scores", with_(*_BASE, _TRIM, _PATCH, f"""sides AS (SELECT a.parcel_id, a.patch_id, a.r, a.c, 4 - count(b.r) AS open FROM patch a LEFT JOIN patch b ON a.parcel_id = b.parcel_id AND a.patch_id = b.patch_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY ALL),
  shape AS (SELECT parcel_id, patch_id, least(1.0, 16.0 * count(*) * 25.0 / (sum(open) * 5.0) ** 2) AS compactness FROM sides GROUP BY ALL),
  scored AS (SELECT parcel_id, patch_id, avg(slope_factor) AS sf, avg(aspect_factor) AS af, avg(slope_pct) AS avg_slope_pct, count(*) * {ACRE} AS acres, median(z) AS median_z FROM patch GROUP BY ALL)""") + """
  SELECT parcel_id, patch_id, round(avg_slope_pct, 8) AS avg_slope_pct, round(acres, 8) AS acres, round(median_z, 8) AS median_z, round(compactness, 8) AS compactness,
  round(100 * (0.55 * sf + 0.30 * (0.5 * least(1.0, acres / 10) + 0.5 * compactness) + 0.15 * af), 8) AS score FROM scored JOIN shape USING (parcel_id, patch_id)""")
def production_scores(spark, sf):
    got = scoring.score_patches(patches(spark, sf), PX, PY)
    return got.select("parcel_id", "patch_id", *rounded("avg_slope_pct", "acres", "median_z", "compactness", "score"))


@query("waist_split_flags", with_(*_BASE, _TRIM, _PATCH) + """SELECT a.parcel_id, a.patch_id, bool_or(b.patch_id IS NOT NULL) AS from_waist_split FROM patch a
  LEFT JOIN patch b ON a.parcel_id = b.parcel_id AND a.patch_id <> b.patch_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY ALL""")
def waist_split_flags(spark, sf):
    return scoring.waist_split_flags(patches(spark, sf))


def _clusters(pdf: pd.DataFrame) -> pd.DataFrame:
    z, eligible = kernels.to_grid(pdf), kernels.to_grid(pdf, "eligible") > 0
    found = kernels.production_clusters(eligible, z, PX, PY, least_acres=0.05)
    return pd.DataFrame(
        [(p["patch_id"], p["acres"], int(p["fill"].sum()), int(p["render_cells"].sum()), p["n_holes"], p["median_z"], p["source"]) for p in found],
        columns=["patch_id", "acres", "fill_cells", "render_cells", "n_holes", "median_z", "source"])


@query("production_clusters")
def production_clusters(spark, sf):
    return kernels.per_parcel(step1(spark, sf).select(*grid.KEY, "z", "eligible"), _clusters, "patch_id int, acres double, fill_cells int, render_cells int, n_holes int, median_z double, source int")


# --- water, trees, solar, roads -----------------------------------------------------------

_STREAM = "CASE WHEN stream_distance IS NULL OR stream_distance >= 300 THEN 0.5 ELSE 0.5 + 0.5 * CASE fcode WHEN '46006' THEN 1.0 WHEN '46003' THEN 0.55 WHEN '46007' THEN 0.25 ELSE 0.4 END * (1 - stream_distance / 300) END"
_TOPO = "0.5 * CASE WHEN terrain_gradient IS NULL THEN 0.5 WHEN terrain_gradient < 0.5 OR terrain_gradient > 30 THEN 0.0 WHEN terrain_gradient BETWEEN 3 AND 15 THEN 1.0 WHEN terrain_gradient < 3 THEN (terrain_gradient - 0.5) / 2.5 ELSE (30 - terrain_gradient) / 15 END + 0.5 * greatest(0.0, least(1.0, acres / 10))"
_WATER = f"water AS (SELECT *, {_GRAVITY} AS gravity_factor, CASE WHEN coverage >= 0.3 THEN {_HOLD.format('ksat')} ELSE 0.5 END AS soil_factor, {_STREAM} AS stream_factor, {_TOPO} AS topographic_factor FROM zones)"


@query("water_suitability", with_(V.ZONES, _WATER) + """SELECT zone_id, round(gravity_factor, 8) AS gravity_factor, round(soil_factor, 8) + 0.0 AS soil_factor, round(stream_factor, 8) AS stream_factor, round(topographic_factor, 8) AS topographic_factor,
  round(100 * (0.35 * gravity_factor + 0.30 * soil_factor + 0.20 * stream_factor + 0.15 * topographic_factor), 8) AS score,
  CASE (ksat IS NOT NULL AND coverage >= 0.3)::INT + (fcode IS NOT NULL)::INT WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM water""")
def water_suitability(spark, sf):
    return scoring.score_water_zones(V.zones(spark, sf)).select("zone_id", "confidence", *rounded("gravity_factor", "soil_factor", "stream_factor", "topographic_factor", "score"))


@query("selected_water_zone", with_(V.ZONES, _WATER) + """SELECT parcel_id, zone_id FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY round(100 * (0.35 * gravity_factor + 0.30 * soil_factor + 0.20 * stream_factor + 0.15 * topographic_factor), 6) DESC, zone_id) AS n FROM water) WHERE n = 1""")
def selected_water_zone(spark, sf):
    scored = scoring.score_water_zones(V.zones(spark, sf)).drop("rank").withColumn("score", F.round("score", 6))
    return scoring.selected(scored, "zone_id").select("parcel_id", "zone_id")


def _grow(pdf: pd.DataFrame) -> pd.DataFrame:
    z = kernels.to_grid(pdf)
    filled = kernels.fill(z)
    total = kernels.accumulation(filled, kernels.directions(filled, PX, PY))
    parts, n = kernels.label((total >= 3) & ~np.isnan(z), 4)
    rows = []
    for k in range(n):
        cells = kernels.grow(parts == k, total, 12)
        if len(cells) * ACRE >= 0.03:
            rows += [(k, i, r, c, int(total[r, c])) for i, (r, c) in enumerate(cells)]
    return pd.DataFrame(rows, columns=["zone_id", "seq", "r", "c", "accumulation"])


@query("water_zone_growth")
def water_zone_growth(spark, sf):
    return kernels.per_parcel(V.cells(spark, sf), _grow, "zone_id int, seq int, r int, c int, accumulation long")


_TREE = "tree AS (SELECT step1.*, 100 * (0.40 * hydric::INT + 0.30 * greatest(0.0, least(1.0, slope_pct / 50)) + 0.20 * (1 - (r % 2 = 0)::INT) + 0.10 * greatest(0.0, least(1.0, 1 - c * 5.0 / 100))) AS tree_score FROM step1)"


def tree_cells(spark, sf):
    return scoring.score_tree_cells(step1(spark, sf).withColumn("prime", F.col("r") % 2 == 0).withColumn("stream_distance", F.col("c") * 5.0))


@query("tree_scores", with_(*_BASE, _TREE) + "SELECT parcel_id, r, c, round(tree_score, 8) AS tree_score, round(tree_score, 8) >= 31 AS tree_eligible FROM tree")
def tree_scores(spark, sf):
    return tree_cells(spark, sf).select(*grid.KEY, *rounded("tree_score"), (F.round("tree_score", 8) >= 31).alias("tree_eligible"))


def _tree_labels(pdf: pd.DataFrame) -> pd.DataFrame:
    got = kernels.as_rows(component=kernels.label(kernels.to_grid(pdf, "tree_eligible") > 0)[0])
    return got[got["component"] >= 0]


@query("tree_patches")
def tree_patches(spark, sf):
    cells = tree_cells(spark, sf)
    labels = kernels.per_parcel(cells.select(*grid.KEY, "tree_eligible"), _tree_labels, "r int, c int, component int")
    return scoring.tree_patches(cells.hint("merge").join(labels, grid.KEY), PX, PY, 0.01)


@query("solar_candidates")
def solar_candidates(spark, sf):
    cells = V.cells(spark, sf)
    terrain = grid.horn(cells, PX, PY).select(*grid.KEY, "slope_pct", "aspect_deg").hint("merge").join(grid.shading(cells, PX, PY).select(*grid.KEY, "shading_score"), grid.KEY)
    placed = terrain.where("slope_pct IS NOT NULL").select("parcel_id", ((F.col("c") + 0.5) * PX).alias("x"), (-(F.col("r") + 0.5) * PY).alias("y"), "slope_pct", "aspect_deg", "shading_score")
    lattice = cells.where("r % 5 = 2 AND c % 5 = 2").select("parcel_id", (F.col("r") * 20 + F.col("c")).alias("point_id"), ((F.col("c") + 0.5) * PX).alias("x"), (-(F.col("r") + 0.5) * PY).alias("y"), (F.abs(F.col("c") - 10) * PX).alias("production_distance"))
    return scoring.solar_candidates(lattice, placed)


def masked_cells(spark, sf, cells):
    """``cells`` with ``excluded`` and ``on_production`` by the shapes of their parcel."""
    home, every = V.grid_parcels(spark, sf), V.shapes(spark, sf)
    out = regions.exclusion_cells(cells, every.where("kind = 'excluded'"), home, PX, PY)
    return regions.production_cells(out, every.where("kind = 'production'"), home, PX, PY)


_COST = """cost AS (SELECT *, CASE WHEN road OR outside OR slope_pct > 35 THEN NULL ELSE (1.0 - 0.5 * (exp(2 * tpi / 3) - 1) / (exp(2 * tpi / 3) + 1) + 0.0133 * slope_pct * slope_pct + 5 * hydric::INT + 5 * tree_root::INT) * CASE WHEN on_production THEN 3.0 ELSE 1.0 END END AS cost
  FROM step1 JOIN (SELECT parcel_id, r, c, outside, on_production FROM masked) USING (parcel_id, r, c) JOIN lean USING (parcel_id, r, c))"""
_LEAN = """lean AS (SELECT a.parcel_id, a.r, a.c, coalesce(CASE WHEN count(*) >= 5 THEN any_value(a.z) - avg(b.z) END, 0.0) AS tpi FROM cells a JOIN cells b
  ON a.parcel_id = b.parcel_id AND sqrt(((b.c - a.c) * 5.0) ** 2 + ((b.r - a.r) * 5.0) ** 2) <= 25 GROUP BY ALL)"""


def cost_cells(spark, sf):
    """Costs from what stands about a cell, and from the polygons it lies in."""
    lean = grid.tpi(V.cells(spark, sf), PX, PY, 25.0).select(*grid.KEY, "tpi")
    cells = masked_cells(spark, sf, step1(spark, sf)).hint("merge").join(lean, grid.KEY)
    return scoring.cost_raster(cells.withColumns({"excluded": F.col("excluded") | F.col("road"), "flood": F.col("hydric"), "canopy": F.col("tree_root")}))


@query("cost_raster", with_(*_BASE, V.SHAPES, _LEAN, _COST) + "SELECT parcel_id, r, c, round(cost, 8) AS cost FROM cost")
def cost_raster(spark, sf):
    return cost_cells(spark, sf).select(*grid.KEY, *rounded("cost"))


def _network(pdf: pd.DataFrame) -> pd.DataFrame:
    got = _routed(pdf)
    rows = [
        (b["branch_id"], s, r, c, b["meters"], b["served_acres"], b["branch_role"], b["joins_branch_index"], b["total_cost"], got["stop_reason"])
        for b in got["branches"] for s, (r, c) in enumerate(b["cells"])
    ]
    out = pd.DataFrame(rows, columns=["branch_id", "seq", "r", "c", "meters", "served_acres", "branch_role", "joins_branch_index", "total_cost", "stop_reason"])
    return out.astype({"joins_branch_index": "Int32"})


def _routed(pdf: pd.DataFrame) -> dict:
    cost = kernels.to_grid(pdf, "cost")
    cost = np.where(np.isnan(cost), np.inf, cost)
    demand = kernels.to_grid(pdf, "eligible") > 0
    open_ = np.argwhere(np.isfinite(cost))
    return kernels.road_network(cost, tuple(map(int, open_[-1])), demand, PX, PY, radius=20.0, per_acre=2000.0)


def _road_totals(pdf: pd.DataFrame) -> pd.DataFrame:
    got = _routed(pdf)
    return pd.DataFrame([(len(got["branches"]), got["total_length_meters"], got["total_served_acres"], got["unserved_acres"], got["stop_reason"])], columns=["n_branches", "total_length_meters", "total_served_acres", "unserved_acres", "stop_reason"])


@query("road_network")
def road_network(spark, sf):
    return kernels.per_parcel(cost_cells(spark, sf).select(*grid.KEY, "cost", "eligible"), _network, "branch_id int, seq int, r int, c int, meters double, served_acres double, branch_role string, joins_branch_index int, total_cost double, stop_reason string")


@query("road_totals")
def road_totals(spark, sf):
    """A row per parcel, those without branches too."""
    return kernels.per_parcel(cost_cells(spark, sf).select(*grid.KEY, "cost", "eligible"), _road_totals, "n_branches int, total_length_meters double, total_served_acres double, unserved_acres double, stop_reason string")


def _field(pdf: pd.DataFrame) -> pd.DataFrame:
    cost = kernels.to_grid(pdf, "cost")
    cost = np.where(np.isnan(cost), np.inf, cost)
    open_ = np.argwhere(np.isfinite(cost))
    total, before, _ = kernels.cost_field(cost, [tuple(map(int, open_[0]))], PX, PY)
    rows = [(r, c, total[r, c], *(p or (None, None))) for (r, c), p in before.items()]
    return pd.DataFrame(rows, columns=["r", "c", "cost", "parent_r", "parent_c"])


@query("cost_distance")
def cost_distance(spark, sf):
    return kernels.per_parcel(cost_cells(spark, sf).select(*grid.KEY, "cost"), _field, "r int, c int, cost double, parent_r int, parent_c int")


# --- profiles ------------------------------------------------------------------------------

_LINE = "line AS (SELECT parcel_id, point_id AS seq, x, y, z FROM points)"


def line(spark, sf):
    return V.points(spark, sf).select("parcel_id", F.col("point_id").alias("seq"), "x", "y", "z")


@query("stem_profile", with_(V.POINTS, _LINE) + """, s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0.0) AS step FROM line WINDOW w AS (PARTITION BY parcel_id ORDER BY seq)),
  f AS (SELECT *, sum(step) OVER (PARTITION BY parcel_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS distance, coalesce((z - lead(z) OVER w) / nullif(lead(step) OVER w, 0) * 100, 0.0) AS fall FROM s WINDOW w AS (PARTITION BY parcel_id ORDER BY seq))
  SELECT parcel_id, seq, round(distance, 3) AS distance, round(avg(z) OVER n, 8) + 0.0 AS z_smooth, round(avg(fall) OVER n, 3) + 0.0 AS fall_pct FROM f WINDOW n AS (PARTITION BY parcel_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def stem_profile(spark, sf):
    got = records.profile(line(spark, sf), ["parcel_id"])
    return got.select("parcel_id", "seq", F.round("distance", 3).alias("distance"), *rounded("z_smooth"), (F.round("fall_pct", 3) + 0.0).alias("fall_pct"))


@query("grade_stats", with_(V.POINTS, _LINE) + """, g AS (SELECT parcel_id, run, abs(z - pz) / nullif(run, 0) * 100 AS grade FROM (SELECT *, lag(z) OVER w AS pz, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS run FROM line WINDOW w AS (PARTITION BY parcel_id ORDER BY seq)))
  SELECT parcel_id, round(avg(grade), 3) AS avg_grade_pct, round(stddev_pop(grade), 3) AS grade_stddev, round(sum(run), 3) AS length_m, coalesce(round(sum(run) FILTER (grade > 10), 3), 0.0) AS steep_m FROM g GROUP BY parcel_id""")
def grade_stats(spark, sf):
    got = records.grade_stats(line(spark, sf), ["parcel_id"])
    return got.select("parcel_id", *[F.round(c, 3).alias(c) for c in ("avg_grade_pct", "grade_stddev", "length_m", "steep_m")])


@query("line_residual", with_(V.POINTS) + "SELECT parcel_id, round(regr_syy(z, x) - regr_sxy(z, x) ** 2 / regr_sxx(z, x), 2) AS residual FROM points GROUP BY parcel_id")
def line_residual(spark, sf):
    return records.residual_sum(V.points(spark, sf), ["parcel_id"], "x", "z").select("parcel_id", F.round("residual", 2).alias("residual"))


# --- scalars and features --------------------------------------------------------------------

@query("directions", f"""SELECT o_orderkey, {_LABELS}[CAST(round_even(d / 22.5, 0) AS INT) % 16 + 1] AS label,
  ['north','northeast','east','southeast','south','southwest','west','northwest'][CAST(round_even(d / 45.0, 0) AS INT) % 8 + 1] AS word,
  round((1 + cos(radians(d - 180))) / 2, 8) + 0.0 AS score, abs((d - 90.0 + 180 + 360) % 360 - 180) AS from_east FROM (SELECT o_orderkey, CAST(o_custkey % 360 AS DOUBLE) AS d FROM orders)""")
def directions(spark, sf):
    d = (F.col("o_custkey") % 360).cast("double")
    return V.table(spark, sf, "orders").select("o_orderkey", X.compass_label(d).alias("label"), X.compass_word(d).alias("word"), (F.round(X.aspect_score(d), 8) + 0.0).alias("score"), X.angular_difference(d, F.lit(90.0)).alias("from_east"))


@query("projection_zones", """SELECT o_orderkey, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) AS INT) + 1 AS epsg,
  CAST(least(ceil(log2(720.0 / w)), ceil(log2(720.0 / (w / 2)))) AS INT) AS zoom, round(w / 0.3048, 1) AS feet FROM (SELECT o_orderkey, o_custkey % 360 - 180.0 AS lon, o_custkey % 160 - 80.0 AS lat, o_custkey % 7 + 0.3 AS w FROM orders)""")
def projection_zones(spark, sf):
    k = F.col("o_custkey")
    lon, lat, w, zero = k % 360 - F.lit(180.0), k % 160 - F.lit(80.0), k % 7 + F.lit(0.3), F.lit(0.0)
    return V.table(spark, sf, "orders").select("o_orderkey", X.utm_epsg(lon, lat).cast("int").alias("epsg"), X.auto_zoom(zero, zero, w, w / 2).alias("zoom"), X.feet(w).alias("feet"))


@query("bounding_boxes", with_(V.POINTS) + """SELECT parcel_id, round(min(x / 100) - 150 / (111320.0 * cos(radians((min(y / 100) + max(y / 100)) / 2))), 6) AS west, round(min(y / 100) - 150 / 111320.0, 6) AS south,
  round(max(x / 100) + 150 / (111320.0 * cos(radians((min(y / 100) + max(y / 100)) / 2))), 6) AS east, round(max(y / 100) + 150 / 111320.0, 6) AS north FROM points GROUP BY parcel_id""")
def bounding_boxes(spark, sf):
    ring = F.collect_list(F.struct((F.col("x") / 100).alias("lon"), (F.col("y") / 100).alias("lat")))
    got = V.points(spark, sf).groupBy("parcel_id").agg(ring.alias("ring")).withColumn("b", X.bounding_box(F.col("ring"), 150.0))
    return got.select("parcel_id", *[F.round(f"b.{s}", 6).alias(s) for s in ("west", "south", "east", "north")])


@query("feature_problems", """SELECT id, problem FROM (SELECT id, CASE WHEN n > 1 THEN 'id is not unique' WHEN g = 'Circle' THEN 'geometry type' WHEN conf = 'sure' THEN 'confidence' WHEN notes = '' THEN 'confidence_notes is empty' END AS problem FROM (
  SELECT CAST(l_orderkey AS VARCHAR) AS id, count(*) OVER (PARTITION BY l_orderkey) AS n, CASE l_returnflag WHEN 'A' THEN 'Circle' ELSE 'Point' END AS g, CASE l_linestatus WHEN 'F' THEN 'sure' ELSE 'low' END AS conf, CASE WHEN l_tax > 0.04 THEN '' ELSE 'x' END AS notes FROM lineitem)) WHERE problem IS NOT NULL""")
def feature_problems(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("id"), F.when(F.col("l_returnflag") == "A", "Circle").otherwise("Point").alias("geometry_type"), F.lit("soil").alias("layer"),
        F.when(F.col("l_linestatus") == "F", "sure").otherwise("low").alias("confidence"), F.when(F.col("l_tax") > 0.04, " ").otherwise("x").alias("confidence_notes"))
    return features.problems(rows).select("id", "problem")


@query("feature_collections", with_(V.POINTS) + "SELECT parcel_id, count(*) AS n_features, min(CAST(point_id AS VARCHAR)) AS first_id FROM points GROUP BY parcel_id")
def feature_collections(spark, sf):
    made = features.make_feature(F.col("point_id"), "keypoint", F.concat(F.lit("Point "), F.col("point_id").cast("string")), F.lit("low"), F.lit("derived"), F.lit("Point"), F.array("x", "y"), elevation_m=F.col("z"))
    got = features.collection(V.points(spark, sf).select("parcel_id", made.alias("feature")))
    parsed = F.from_json("geojson", "type string, features array<struct<id:string>>")
    return got.select("parcel_id", F.size(parsed["features"]).cast("long").alias("n_features"), parsed["features"][0]["id"].alias("first_id"))


@query("counted_summaries", with_(V.ROADS) + """SELECT CAST(layer AS VARCHAR) AS parcel_id, sum(n) || ' roads (' || string_agg(part, '; ' ORDER BY part) || ')' AS summary FROM (
  SELECT layer, count(*) AS n, coalesce(fullname, 'none') || ': ' || count(*) AS part FROM roads WHERE layer IN (30, 31, 32) GROUP BY layer, coalesce(fullname, 'none')) GROUP BY layer""")
def counted_summaries(spark, sf):
    rows = V.roads(spark, sf).where("layer IN (30, 31, 32)").select(F.col("layer").cast("string").alias("parcel_id"), F.coalesce("fullname", F.lit("none")).alias("kind"))
    return features.counted_summary(rows, "kind", "roads")


@query("stream_exclusion", with_(V.POINTS) + "SELECT point_id, count(*) > 0 AS excluded, round(min(d), 8) + 0.0 AS distance FROM (SELECT a.point_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM points a JOIN points b ON a.parcel_id = b.parcel_id WHERE a.kind = 0 AND b.kind = 2) WHERE d <= 107 GROUP BY point_id")
def stream_exclusion(spark, sf):
    every = V.points(spark, sf)
    got = records.within(every.where("kind = 0"), every.where("kind = 2"), 107.0)
    return got.groupBy(F.col("l_point_id").alias("point_id")).agg(F.lit(True).alias("excluded"), F.min("distance").alias("distance")).select("point_id", "excluded", *rounded("distance"))


@query("smoothed_lines")
def smoothed_lines(spark, sf):
    ring = F.transform(F.array_sort(F.collect_list(F.struct("point_id", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    got = V.points(spark, sf).groupBy("parcel_id").agg(ring.alias("line"))
    return got.select("parcel_id", F.posexplode(X.chaikin(F.col("line"), 2)).alias("seq", "p")).select("parcel_id", "seq", "p.x", "p.y")


@query("water_layer", """SELECT CAST(l_suppkey AS VARCHAR) AS parcel_id, 'nhd-' || CASE WHEN l_linenumber = 6 THEN 'streams' ELSE 'water_bodies' END || '-' || l_orderkey || '-' || l_linenumber AS id,
  CASE WHEN l_linenumber = 6 THEN 'hydrology-streams' ELSE 'hydrology-water_bodies' END AS layer,
  CASE WHEN l_returnflag <> 'N' THEN 'name ' || l_returnflag WHEN l_linenumber = 6 THEN 'Unnamed stream' ELSE 'Unnamed water body' END AS label,
  'medium' AS confidence, CAST(46000 + l_partkey % 9 AS VARCHAR) AS feature_code FROM lineitem WHERE l_linenumber IN (6, 7)""")
def water_layer(spark, sf):
    raw = V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("parcel_id"), F.when(F.col("l_linenumber") == 6, 6).when(F.col("l_linenumber") == 7, 12).otherwise(1).alias("layer"), F.lit(None).cast("string").alias("permanent_identifier"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("objectid"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat(F.lit("name "), "l_returnflag")).alias("gnis_name"),
        F.lit(None).cast("string").alias("gnis_id"), (46000 + F.col("l_partkey") % 9).cast("string").alias("fcode"), F.lit(None).cast("string").alias("reachcode"),
        F.lit("Point").alias("geometry_type"), F.array(F.col("l_quantity"), F.col("l_discount")).alias("coordinates"),
    )
    got = sinks.water_layer(raw)
    return got.select("parcel_id", "feature.id", "feature.properties.layer", "feature.properties.label", "feature.properties.confidence", "feature.properties.feature_code")


@query("valley_layer")
def valley_layer(spark, sf):
    return features.collection(sinks.valley_layer(valleys(spark, sf), PX, PY))


_NEAR = "near AS (SELECT a.parcel_id, a.point_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM points a LEFT JOIN points b ON a.parcel_id = b.parcel_id AND b.kind = 2 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 107 WHERE a.kind = 0 GROUP BY a.parcel_id, a.point_id)"


@query("zone_relationships", with_(V.POINTS, _NEAR) + "SELECT point_id, CASE WHEN coalesce(d <= 40, false) THEN 'inside' WHEN coalesce(d <= 80, false) THEN 'adjacent' ELSE 'outside' END AS relationship FROM near")
def zone_relationships(spark, sf):
    """Footprints as discs of 40 m about points, zones as points of kind 2."""
    every = V.points(spark, sf)
    mine = every.where("kind = 0")
    near = records.within(mine, every.where("kind = 2"), 107.0).groupBy(F.col("l_point_id").alias("_p")).agg(F.min("distance").alias("d"))
    got = mine.hint("merge").join(near, F.col("point_id") == F.col("_p"), "left")
    return got.select("point_id", sinks.zone_relationship(F.col("d") <= 40, F.col("d"), 80.0).alias("relationship"))


@query("prime_farmland_flags", with_(V.MAPUNITS) + """SELECT CAST(c_custkey AS VARCHAR) AS parcel_id, coalesce(p, false) AS prime_farmland_conflict,
  CASE WHEN coalesce(p, false) THEN 'Prime' ELSE 'No pr' END AS note FROM customer LEFT JOIN (SELECT parcel_id, bool_or(coalesce(farmlndcl ILIKE '%prime%' AND NOT farmlndcl ILIKE 'not prime%', false)) AS p FROM mapunits GROUP BY parcel_id) u ON CAST(c_custkey AS VARCHAR) = u.parcel_id""")
def prime_farmland_flags(spark, sf):
    zones = V.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("parcel_id"))
    got = sinks.prime_farmland_flags(zones, V.mapunits(spark, sf), X.is_prime_farmland(F.col("farmlndcl")))
    return got.select("parcel_id", "prime_farmland_conflict", F.substring("prime_farmland_note", 1, 5).alias("note"))


# --- whole plans -----------------------------------------------------------------------------

@query("site_plan")
def site_plan(spark, sf):
    """Step 1 to 4 for every parcel: gates, trim, clusters, scores and ranks."""
    kept = trimmed(spark, sf)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        hit = kernels.to_grid(pdf.assign(one=1.0), "one") > 0
        found = kernels.production_clusters(hit, kernels.to_grid(pdf), PX, PY, least_acres=0.02)
        rows = [(int(r), int(c), p["patch_id"]) for p in found for r, c in np.argwhere(p["cells"])]
        return pd.DataFrame(rows, columns=["r", "c", "patch_id"])

    named = kernels.per_parcel(kept.select(*grid.KEY, "z"), cluster, "r int, c int, patch_id int")
    return scoring.score_patches(kept.hint("merge").join(named, grid.KEY), PX, PY)


# --- report sections -------------------------------------------------------------------------

@query("soil_sections", with_(V.COMPONENTS) + """SELECT mukey AS parcel_id, string_agg(line, chr(10) ORDER BY line) AS section FROM (
  SELECT DISTINCT mukey, '- ' || compname || ': ' || comppct_r || '% of map unit, hydric: ' || trim(hydricrating) AS line FROM components) GROUP BY mukey""")
def soil_sections(spark, sf):
    return reports.soil_section(V.components(spark, sf).withColumnRenamed("mukey", "parcel_id"))


@query("elevation_sections", with_(V.CELLS) + """SELECT parcel_id, 'Elevation range: ' || lo || 'ft to ' || hi || 'ft (total relief: ' || (hi - lo) || 'ft) across ' || n || ' sample points.' AS section FROM (
  SELECT parcel_id, CAST(round(min(z) / 0.3048) AS BIGINT) AS lo, CAST(round(max(z) / 0.3048) AS BIGINT) AS hi, count(*) AS n FROM cells GROUP BY parcel_id)""")
def elevation_sections(spark, sf):
    return reports.elevation_section(V.cells(spark, sf))


@query("water_sections", """SELECT CAST(l_suppkey AS VARCHAR) AS parcel_id, concat_ws(chr(10), 'Streams/waterways: ' || string_agg(DISTINCT n, ', ' ORDER BY n) FILTER (s), 'Ponds/lakes: ' || string_agg(DISTINCT n, ', ' ORDER BY n) FILTER (NOT s)) AS section
  FROM (SELECT l_suppkey, 'name ' || l_partkey % 5 AS n, l_linenumber < 3 AS s FROM lineitem) GROUP BY l_suppkey""")
def water_sections(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("parcel_id"), F.concat(F.lit("name "), (F.col("l_partkey") % 5).cast("string")).alias("name"), F.when(F.col("l_linenumber") < 3, "stream").otherwise("water_body").alias("kind"))
    return reports.water_section(rows)


@query("locative_words", with_(V.POINTS) + """, b AS (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM points WINDOW w AS (PARTITION BY parcel_id)),
  t AS (SELECT point_id, ['west', '', 'east'][least(2, CAST(floor((x - x0) / (x1 - x0) * 3) AS INT)) + 1] AS ew, ['south', '', 'north'][least(2, CAST(floor((y - y0) / (y1 - y0) * 3) AS INT)) + 1] AS ns FROM b)
  SELECT point_id, CASE WHEN ns <> '' AND ew <> '' THEN ns || ew WHEN ns || ew <> '' THEN ns || ew || '-central' ELSE 'central' END AS place FROM t""")
def locative_words(spark, sf):
    w = Window.partitionBy("parcel_id")
    box = [F.min("x").over(w), F.min("y").over(w), F.max("x").over(w), F.max("y").over(w)]
    return V.points(spark, sf).select("point_id", reports.locative(F.col("x"), F.col("y"), *box).alias("place"))


@query("site_reports")
def site_reports(spark, sf):
    """The report of every parcel: soil apart, all sections that these tables give."""
    cells = V.cells(spark, sf)
    acres = cells.where("in_parcel").groupBy("parcel_id").agg((F.count(F.lit(1)) * ACRE).alias("acres"))
    plan = reports.production_narrative(site_plan(spark, sf), acres)
    return reports.report(
        {
            "Elevation": reports.elevation_section(cells), "Climate": reports.climate_section(records.climate_summary(V.climate(spark, sf))),
            "Production areas": reports.production_section(plan), "Roads": reports.road_section(road_network(spark, sf)),
        }
    )


# --- access points and soil under zones -----------------------------------------------------

_CORNERS = ((0.0, 0.0), (100.0, 0.0), (100.0, 60.0), (40.0, 60.0), (40.0, 100.0), (0.0, 100.0))
_EDGES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(_CORNERS, _CORNERS[1:] + _CORNERS[:1], strict=True))


@query("access_points", with_(V.ANCHORS) + f"""SELECT anchor_id, round(min(d), 6) + 0.0 AS edge_distance, min(d) <= 3 AS on_boundary FROM (
  SELECT anchor_id, sqrt(pow(x - greatest(least(x0, x1), least(greatest(x0, x1), x)), 2) + pow(y - greatest(least(y0, y1), least(greatest(y0, y1), y)), 2)) AS d
  FROM anchors, (VALUES {_EDGES}) AS e(x0, y0, x1, y1)) GROUP BY anchor_id""")
def access_points(spark, sf):
    points = V.anchors(spark, sf)
    corner = [F.array(*[F.lit(p[i]) for p in _CORNERS]).alias(name) for i, name in enumerate(("ring_x", "ring_y"))]
    rings = points.select("parcel_id").distinct().select("parcel_id", *corner)
    got = records.edge_distance(points, rings)
    return got.select("anchor_id", (F.round("edge_distance", 6) + 0.0).alias("edge_distance"), (F.col("edge_distance") <= 3).alias("on_boundary"))


@query("snapped_anchors", with_(V.CELLS, V.ANCHORS) + f"""SELECT anchor_id, r, c FROM (
  SELECT anchor_id, l.r, l.c, row_number() OVER (PARTITION BY anchor_id ORDER BY pow(l.r - (({V.SIDE * V.PY} - y) / {V.PY} - 0.5), 2) + pow(l.c - (x / {V.PX} - 0.5), 2), l.r, l.c) AS n
  FROM anchors a LEFT JOIN (SELECT * FROM cells WHERE in_parcel AND NOT hydric) l USING (parcel_id)) WHERE n = 1""")
def snapped_anchors(spark, sf):
    cost = F.when(F.col("in_parcel") & ~F.col("hydric"), 1.0).otherwise(float("inf"))
    cells = V.cells(spark, sf).withColumn("cost", cost)
    return records.snap_to_cells(V.anchors(spark, sf), cells, "anchor_id", PX, PY, 0.0, V.SIDE * PY).select("anchor_id", "r", "c")


@query("zone_conductivity", with_(V.RINGS) + """SELECT z.zone_id, round(any_value(s.ka / s.a), 6) AS ksat_r, round(any_value(CASE WHEN s.a > 0 THEN least(1.0, s.a / (z.w * z.h)) END), 6) AS coverage
  FROM zone_rings z LEFT JOIN (
    SELECT zone_id, sum(ksat * a) AS ka, CAST(sum(a) AS DOUBLE) AS a FROM (
      SELECT zone_id, ksat, greatest(0, least(z.x + z.w, u.x + u.w) - greatest(z.x, u.x)) * greatest(0, least(z.y + z.h, u.y + u.h) - greatest(z.y, u.y)) AS a
      FROM zone_rings z JOIN mapunit_rings u USING (parcel_id)) WHERE a > 0 GROUP BY zone_id) s USING (zone_id) GROUP BY z.zone_id""")
def zone_conductivity(spark, sf):
    got = soil.area_weighted_ksat(V.zone_rings(spark, sf), V.mapunit_rings(spark, sf), V.mapunit_ksat(spark, sf))
    return got.select("zone_id", F.round("ksat_r", 6).alias("ksat_r"), F.round("coverage", 6).alias("coverage"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return production_scores(spark, sf_dir)
