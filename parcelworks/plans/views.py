"""The bronze tables of a site plan, derived from the general test tables.

Each has a DataFrame here and the same table as a SQL expression for the oracle:
``part`` gives parcels of 20 by 20 cells, ``lineitem`` soil components, ``orders``
horizons and map units, ``events`` daily climate, ``embeddings`` points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE, PX, PY = 20, 5.0, 5.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    idx = (k % 400).cast("int")
    r, c = F.floor(idx / SIDE).cast("int"), (idx % SIDE).cast("int")
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.floor(k / 400).cast("string").alias("parcel_id"), r.alias("r"), c.alias("c"),
        ((4100 * r + 3070 * F.abs(c - 10) + 213 * size) / 10_000).alias("z"),  # as SQL's decimals: rounded once
        F.when(size % 17 == 0, F.lit(None).cast("double")).otherwise((size * 7 % 13) * 0.4).alias("hag"),
        (size % 11 == 0).alias("hydric"), (c == 3).alias("road"), ((r > 0) & (r < 19) & (c > 0) & (c < 19)).alias("in_parcel"),
    )


CELLS = """cells AS (
  SELECT CAST(CAST(floor(p_partkey / 400.0) AS BIGINT) AS VARCHAR) AS parcel_id, r, c,
    CAST(0.41 * r + 0.307 * abs(c - 10) + 0.0213 * p_size AS DOUBLE) AS z,
    CASE WHEN p_size % 17 = 0 THEN NULL ELSE (p_size * 7 % 13) * 0.4 END AS hag,
    p_size % 11 = 0 AS hydric, c = 3 AS road, r > 0 AND r < 19 AND c > 0 AND c < 19 AS in_parcel
  FROM (SELECT *, CAST(floor((p_partkey % 400) / 20.0) AS INT) AS r, CAST(p_partkey % 20 AS INT) AS c FROM part))"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 5000).cast("string").alias("mukey"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("cokey"),
        F.concat(F.lit("soil "), F.col("l_partkey").cast("string")).alias("compname"),
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise((F.col("l_quantity") * 2).cast("int").cast("string")).alias("comppct_r"),
        F.when(F.col("l_returnflag") == "R", "Yes").when(F.col("l_returnflag") == "A", " Partially Hydric").otherwise("No").alias("hydricrating"),
    )


COMPONENTS = """components AS (
  SELECT CAST(l_orderkey % 5000 AS VARCHAR) AS mukey, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS cokey,
    'soil ' || l_partkey AS compname, CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(CAST(floor(l_quantity * 2) AS INT) AS VARCHAR) END AS comppct_r,
    CASE l_returnflag WHEN 'R' THEN 'Yes' WHEN 'A' THEN ' Partially Hydric' ELSE 'No' END AS hydricrating
  FROM lineitem)"""


def horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    step = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("h")
    rows = line.select(key.alias("cokey"), "l_partkey", "l_suppkey", step)
    n = F.col("l_partkey") + F.col("h") * 7
    return rows.select(
        "cokey", (F.col("h") * 10).cast("int").alias("hzdept_r"),
        F.when(n % 5 == 0, "Oi").when(n % 9 == 0, F.lit(None).cast("string")).otherwise("A").alias("hzname"),
        F.when(n % 8 == 0, F.lit(None).cast("string")).otherwise(((n % 60) / 100).cast("decimal(4,2)").cast("string")).alias("kwfact"),
        F.when(n % 6 == 0, F.lit(None).cast("string")).otherwise(((n % 40) * 3).cast("string")).alias("ksat_r"),
    )


HORIZONS = """horizons AS (
  SELECT cokey, CAST(h * 10 AS INT) AS hzdept_r, CASE WHEN n % 5 = 0 THEN 'Oi' WHEN n % 9 = 0 THEN NULL ELSE 'A' END AS hzname,
    CASE WHEN n % 8 = 0 THEN NULL ELSE CAST(CAST((n % 60) / 100.0 AS DECIMAL(4, 2)) AS VARCHAR) END AS kwfact,
    CASE WHEN n % 6 = 0 THEN NULL ELSE CAST(n % 40 * 3 AS VARCHAR) END AS ksat_r
  FROM (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS cokey, l_partkey + h * 7 AS n, h
        FROM lineitem, (SELECT unnest([0, 1, 2]) AS h)))"""


def mapunits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.substring("o_orderpriority", 1, 1)
    cls = F.when(p == "1", "All areas are prime farmland").when(p == "2", "Prime farmland if drained").when(p == "3", F.lit(None).cast("string")).otherwise("Not prime farmland")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("mukey"), cls.alias("farmlndcl"), (F.col("o_custkey") % 50).cast("string").alias("parcel_id"),
        F.concat(F.lit("POINT ("), F.col("o_custkey").cast("string"), F.lit(")")).alias("geometry"), "o_orderstatus",
    )


MAPUNITS = """mapunits AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS mukey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'All areas are prime farmland'
    WHEN '2' THEN 'Prime farmland if drained' WHEN '3' THEN NULL ELSE 'Not prime farmland' END AS farmlndcl,
    CAST(o_custkey % 50 AS VARCHAR) AS parcel_id, 'POINT (' || o_custkey || ')' AS geometry, o_orderstatus
  FROM orders)"""


def climate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).cast("string").alias("parcel_id"), F.to_date("ts").alias("date"), (15 + k % 20).cast("double").alias("tmax"),
        F.when(k % 13 == 0, F.lit(None).cast("double")).otherwise((k % 15).cast("double")).alias("tmin"), (F.col("value") / 10).alias("precip"),
        F.when(k % 7 == 0, F.lit(None).cast("double")).otherwise((k % 11 + 1).cast("double")).alias("wind_speed"),
        (F.col("user_id") * 37 % 180).cast("double").alias("wind_dir"),
    )


CLIMATE = """climate AS (
  SELECT CAST(user_id % 20 AS VARCHAR) AS parcel_id, CAST(ts AS DATE) AS date, CAST(15 + event_id % 20 AS DOUBLE) AS tmax,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 15 AS DOUBLE) END AS tmin, value / 10 AS precip,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 11 + 1 AS DOUBLE) END AS wind_speed, CAST(user_id * 37 % 180 AS DOUBLE) AS wind_dir
  FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 10).cast("string").alias("parcel_id"), F.col("vec_id").alias("point_id"),
        F.round(e[0].cast("double") * 3000, 2).alias("x"), F.round(e[1].cast("double") * 3000, 2).alias("y"),
        F.round(e[2].cast("double") * 40, 2).alias("z"), (F.floor(F.col("vec_id") / 10) % 3).cast("int").alias("kind"),
    )


POINTS = """points AS (
  SELECT CAST(vec_id % 10 AS VARCHAR) AS parcel_id, vec_id AS point_id, round(CAST(embedding[1] AS DOUBLE) * 3000, 2) AS x,
    round(CAST(embedding[2] AS DOUBLE) * 3000, 2) AS y, round(CAST(embedding[3] AS DOUBLE) * 40, 2) AS z,
    CAST(floor(vec_id / 10.0) AS INT) % 3 AS kind FROM embeddings)"""


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 7 + F.col("o_orderkey") % 3).cast("string").alias("parcel_id"), (30 + k % 4).cast("int").alias("layer"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.lit(None).cast("string")).otherwise(F.concat(F.lit("road "), (k % 97).cast("string"))).alias("name"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("full "), (k % 89).cast("string"))).alias("fullname"),
        F.when(k % 41 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("line "), (F.col("o_custkey") % 700).cast("string"))).alias("geometry"),
    )


ROADS = """roads AS (
  SELECT CAST(o_custkey % 7 + o_orderkey % 3 AS VARCHAR) AS parcel_id, CAST(30 + o_orderkey % 4 AS INT) AS layer, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'road ' || o_orderkey % 97 END AS name,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'full ' || o_orderkey % 89 END AS fullname,
    CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'line ' || o_custkey % 700 END AS geometry FROM orders)"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p, n = F.col("l_quantity"), F.col("l_partkey"), F.col("l_linenumber")
    nothing = F.lit(None).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 40).cast("string").alias("parcel_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), n.cast("string"), p.cast("string"), F.col("l_suppkey").cast("string"), q.cast("int").cast("string")).alias("zone_id"),
        ((q - 25) / 4).alias("differential"), F.when(n == 1, 0.0).otherwise((p % 500).cast("double")).alias("distance"), ((q - 20) / 5).alias("gradient_pct"),
        F.when(p % 9 == 0, nothing).otherwise((p % 150).cast("double") + 0.05).alias("ksat"), (F.col("l_discount") * 8).alias("coverage"),
        F.when(p % 4 == 0, "46006").when(p % 4 == 1, "46003").when(p % 4 == 2, "46007").otherwise(F.lit(None).cast("string")).alias("fcode"),
        F.when(p % 7 == 0, nothing).otherwise((p % 400).cast("double")).alias("stream_distance"),
        F.when(p % 10 == 0, nothing).otherwise(q * 0.7).alias("terrain_gradient"), (q / 4).alias("acres"),
    )


ZONES = """zones AS (
  SELECT CAST(l_orderkey % 40 AS VARCHAR) AS parcel_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS INT) AS zone_id,
    (l_quantity - 25) / 4 AS differential, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE CAST(l_partkey % 500 AS DOUBLE) END AS distance,
    (l_quantity - 20) / 5 AS gradient_pct, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_partkey % 150 AS DOUBLE) + 0.05 END AS ksat,
    l_discount * 8 AS coverage, CASE l_partkey % 4 WHEN 0 THEN '46006' WHEN 1 THEN '46003' WHEN 2 THEN '46007' ELSE NULL END AS fcode,
    CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_partkey % 400 AS DOUBLE) END AS stream_distance,
    CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity * 0.7 END AS terrain_gradient, l_quantity / 4 AS acres
  FROM lineitem)"""


def rectangle(x: F.Column, y: F.Column, w: F.Column, h: F.Column) -> list:
    x, y, w, h = (v.cast("double") for v in (x, y, w, h))
    return [F.array(x, x + w, x + w, x).alias("ring_x"), F.array(y, y, y + h, y + h).alias("ring_y")]


def zone_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.floor(k / 150).cast("string").alias("parcel_id"), k.alias("zone_id"), *rectangle(k * 37 % 1000, k * 91 % 1000, 40 + k % 120, 40 + k * 7 % 90))


def mapunit_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.floor(k / 10).cast("string").alias("parcel_id"), k.cast("string").alias("mukey"), *rectangle(k * 613 % 900, k * 271 % 900, 200 + k % 5 * 50, 200 + k % 3 * 60))


def mapunit_ksat(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.cast("string").alias("mukey"), F.when(k % 6 == 1, "n/a").otherwise((k % 150).cast("string")).alias("ksat_r"))


RINGS = """zone_rings AS (
  SELECT CAST(CAST(floor(c_custkey / 150.0) AS BIGINT) AS VARCHAR) AS parcel_id, c_custkey AS zone_id, c_custkey * 37 % 1000 AS x, c_custkey * 91 % 1000 AS y,
    40 + c_custkey % 120 AS w, 40 + c_custkey * 7 % 90 AS h FROM customer),
mapunit_rings AS (
  SELECT CAST(CAST(floor(s_suppkey / 10.0) AS BIGINT) AS VARCHAR) AS parcel_id, s_suppkey * 613 % 900 AS x, s_suppkey * 271 % 900 AS y,
    200 + s_suppkey % 5 * 50 AS w, 200 + s_suppkey % 3 * 60 AS h, CAST(s_suppkey % 150 AS DOUBLE) AS ksat FROM supplier WHERE s_suppkey % 6 <> 1)"""


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access points about a parcel of 100 by 100 metres."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.floor(k / 300).cast("string").alias("parcel_id"), k.alias("anchor_id"), (k * 37 % 1040 / 10.0 - 2).alias("x"), (k * 53 % 1040 / 10.0 - 2).alias("y"))


ANCHORS = """anchors AS (
  SELECT CAST(CAST(floor(c_custkey / 300.0) AS BIGINT) AS VARCHAR) AS parcel_id, c_custkey AS anchor_id, CAST(c_custkey * 37 % 1040 AS DOUBLE) / 10.0 - 2 AS x,
    CAST(c_custkey * 53 % 1040 AS DOUBLE) / 10.0 - 2 AS y FROM customer)"""


def box(x0, y0, x1, y1) -> F.Column:
    x0, y0, x1, y1 = (F.lit(v).cast("double") if isinstance(v, (int, float)) else v.cast("double") for v in (x0, y0, x1, y1))
    return F.array(F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1)))


def shapes(spark, sf):
    """Rectangles on the cell grids of ``part``, about twenty a parcel: every third is
    excluded ground, the others production."""
    k = F.col("s_suppkey")
    x, top = k * 13 % 60 + 0.3, -(k * 29 % 55) - 0.3
    return table(spark, sf, "supplier").select(
        F.floor(k / 20).cast("string").alias("parcel_id"), k.alias("zone_id"), F.when(k % 3 == 0, "excluded").otherwise("production").alias("kind"), box(x, top - (9 + k % 20), x + (12 + k % 25), top).alias("rings"))


def grid_parcels(spark, sf):
    """The drawn boundary of each grid: one cell in from its edge."""
    return cells(spark, sf).select("parcel_id").distinct().withColumn("rings", box(5, -95, 95, -5))


SHAPES = """shapes AS (SELECT CAST(CAST(floor(s_suppkey / 20.0) AS BIGINT) AS VARCHAR) AS parcel_id, s_suppkey AS zone_id, CASE WHEN s_suppkey % 3 = 0 THEN 'excluded' ELSE 'production' END AS kind,
    s_suppkey * 13 % 60 + 0.3 AS x, s_suppkey * 29 % 55 + 0.3 AS top, 12 + s_suppkey % 25 AS w, 9 + s_suppkey % 20 AS h FROM supplier),
  hits AS (SELECT DISTINCT parcel_id, kind, r, c FROM shapes, (SELECT unnest(range(20)) AS r), (SELECT unnest(range(20)) AS c)
    WHERE c * 5 + 2.5 > x AND c * 5 + 2.5 < x + w AND r * 5 + 2.5 > top AND r * 5 + 2.5 < top + h),
  masked AS (SELECT cells.*, NOT in_parcel OR EXISTS (FROM hits WHERE kind = 'excluded' AND hits.parcel_id = cells.parcel_id AND hits.r = cells.r AND hits.c = cells.c) AS outside,
    in_parcel AND EXISTS (FROM hits WHERE kind = 'production' AND hits.parcel_id = cells.parcel_id AND hits.r = cells.r AND hits.c = cells.c) AS on_production FROM cells)"""
