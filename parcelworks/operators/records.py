"""Climate, imagery, roads, water features and other record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import factors as X
from .grid import dealt


def climate_summary(daily: DataFrame, key: str = "parcel_id", span: int | None = None) -> DataFrame:
    """One row a parcel of its daily series (gaps are null). ``span``: the years that
    were asked for; else from the first year to the last, years without rows too."""
    pair = F.col("wind_speed").isNotNull() & F.col("wind_dir").isNotNull()
    years = (F.max(F.year("date")) - F.min(F.year("date")) + 1).cast("long") if span is None else F.max(F.lit(span)).cast("long")
    wind = X.circular_mean(F.when(pair, F.col("wind_dir")), F.when(pair, F.col("wind_speed")))
    return daily.groupBy(key).agg(
        wind.alias("wind_deg"), (F.sum("precip") / years).alias("annual_precip_mm"), F.max("precip").alias("max_precip_mm"),
        F.avg("tmax").alias("avg_high_c"), F.avg("tmin").alias("avg_low_c"), F.max("tmax").alias("record_high_c"),
        F.min("tmin").alias("record_low_c"), years.alias("years_analyzed"),
    ).withColumn("wind_label", X.compass_label(F.col("wind_deg")))


def complete_years(daily: DataFrame, years: int, today: Column) -> DataFrame:
    return daily.where(F.year("date").between(F.year(today) - years, F.year(today) - 1))


def newest_scene(scenes: DataFrame, key: str = "parcel_id", most_cloud: float = 20.0, days: int = 365, today: Column | None = None) -> DataFrame:
    today = F.current_date() if today is None else today
    fit = scenes.where((F.col("cloud_cover_pct") < most_cloud) & (F.col("scene_date") >= F.date_sub(today, days)))
    return fit.groupBy(key).agg(F.max_by("scene_id", F.struct("scene_date", "scene_id")).alias("scene_id"), F.max("scene_date").alias("scene_date")).withColumn("age_days", F.datediff(today, F.col("scene_date")))


def ndvi_summary(pixels: DataFrame, key: str = "parcel_id") -> DataFrame:
    v = X.ndvi(F.col("red"), F.col("nir"))
    valid = pixels.withColumn("v", v).where("v IS NOT NULL")
    n = F.count("v")

    def pct(condition: Column) -> Column:
        return F.count_if(condition) / n * 100.0

    return valid.groupBy(key).agg(
        pct(F.col("v") < 0).alias("water_pct"), pct((F.col("v") >= 0) & (F.col("v") < 0.2)).alias("bare_pct"),
        pct((F.col("v") >= 0.2) & (F.col("v") < 0.4)).alias("sparse_pct"), pct(F.col("v") >= 0.4).alias("dense_pct"),
        F.avg("v").alias("avg_ndvi"), F.min("v").alias("min_ndvi"), F.max("v").alias("max_ndvi"), n.alias("n_pixels"),
    )


def irradiance_baseline(rows: DataFrame, kilowatts: float = 4.0) -> DataFrame:
    """Per kilowatt; the capacity factor must agree within half a point."""
    own = F.col("ac_annual") / kilowatts / 8760.0 * 100.0
    status = (
        F.when(F.col("ac_annual").isNull(), "fetch_failed")
        .when(F.abs(own - F.col("capacity_factor")) > 0.5, "validation_failed").otherwise("ok")
    )
    got = rows.withColumn("status", status)
    return got.withColumn("kwh_per_kw", F.when(F.col("status") == "ok", F.col("ac_annual") / kilowatts))


def name_or(default: str, *columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(default))


def farm_roads(features: DataFrame, layers: tuple[int, ...] = (30, 31, 32)) -> DataFrame:
    """Roads of the layers, each geometry once a parcel (the first layer's), named."""
    w = Window.partitionBy("parcel_id", "geometry").orderBy("layer", "name", "fullname")
    # Those without a geometry would all be one group.
    real = features.where(F.col("layer").isin(*layers) & F.col("geometry").isNotNull())
    once = real.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return once.select("parcel_id", name_or("Unnamed road", "name", "fullname").alias("name"), "layer", "geometry")


def water_features(features: DataFrame) -> DataFrame:
    """Streams (layer 6), then water bodies (layer 12)."""
    kind = F.when(F.col("layer") == 6, "stream").otherwise("water_body")
    name = F.when(F.col("layer") == 6, name_or("Unnamed stream", "gnis_name")).otherwise(name_or("Unnamed water body", "gnis_name"))
    return features.where("layer IN (6, 12)").select(
        F.coalesce("permanent_identifier", F.concat(F.lit("nhd-"), F.col("objectid").cast("string"))).alias("id"), kind.alias("kind"),
        name.alias("name"), F.col("fcode").alias("feature_code"), X.stream_label(F.col("fcode")).alias("permanence"), "geometry",
    )


def in_box(features: DataFrame, box: Column) -> DataFrame:
    """Features whose bounding box (minx, miny, maxx, maxy) meets ``box``."""
    return features.where((F.col("minx") <= box["east"]) & (F.col("maxx") >= box["west"]) & (F.col("miny") <= box["north"]) & (F.col("maxy") >= box["south"]))


def lattice(boxes: DataFrame, n: int) -> DataFrame:
    """``n`` by ``n`` points over a box (west, south, east, north), ends included."""
    step = F.sequence(F.lit(0), F.lit(n - 1))
    grid = boxes.withColumn("i", F.explode(step)).withColumn("j", F.explode(step))
    share = max(n - 1, 1)
    return grid.withColumn("lon", F.col("west") + F.col("i") / share * (F.col("east") - F.col("west"))).withColumn(
        "lat", F.col("south") + F.col("j") / share * (F.col("north") - F.col("south"))
    )


# --- nearest and within ------------------------------------------------------------

def within(left: DataFrame, right: DataFrame, radius: float, key: str = "parcel_id") -> DataFrame:
    """Pairs of points (x, y) no further apart than ``radius``, by square bins of
    that size: an equi-join on bins, the left side sent to the nine around."""
    lx = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    rx = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    lx = lx.withColumn("_dx", F.explode(step)).withColumn("_dy", F.explode(step))
    lx = lx.withColumn("_bx", F.floor(F.col("l_x") / radius) + F.col("_dx")).withColumn("_by", F.floor(F.col("l_y") / radius) + F.col("_dy")).drop("_dx", "_dy")
    rx = rx.withColumn("_bx", F.floor(F.col("r_x") / radius)).withColumn("_by", F.floor(F.col("r_y") / radius))
    joined = lx.hint("merge").join(rx.withColumnRenamed(f"r_{key}", f"l_{key}"), [f"l_{key}", "_bx", "_by"])
    distance = F.sqrt(F.pow(F.col("l_x") - F.col("r_x"), 2) + F.pow(F.col("l_y") - F.col("r_y"), 2))
    return joined.withColumn("distance", distance).where(F.col("distance") <= radius).drop("_bx", "_by").withColumnRenamed(f"l_{key}", key)


def service_relationships(zones: DataFrame, patches: DataFrame, radius: float = 800.0) -> DataFrame:
    """Zone and patch pairs in reach: differential, gradient, gravity factor."""
    pairs = within(zones, patches, radius)
    rise = F.col("l_z") - F.col("r_z")
    gradient = F.coalesce(F.try_divide(rise, F.col("distance")) * 100.0, F.lit(0.0))
    got = pairs.withColumn("differential", rise).withColumn("gradient_pct", gradient)
    return got.withColumn("gravity_factor", X.gravity_feed(F.col("differential"), F.col("distance"), F.col("gradient_pct")))


# --- profiles ----------------------------------------------------------------------

def profile(points: DataFrame, keys: list[str], smooth: int = 5) -> DataFrame:
    """Points (seq, x, y, z): distance along the line, smoothed height, smoothed
    fall in percent to the next point."""
    order = Window.partitionBy(*keys).orderBy("seq")
    near = order.rowsBetween(-(smooth // 2), smooth // 2)
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(order), 2) + F.pow(F.col("y") - F.lag("y").over(order), 2))
    got = points.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    got = got.withColumn("distance", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fall = F.try_divide(F.col("z") - F.lead("z").over(order), F.lead("_step").over(order)) * 100.0
    got = got.withColumn("_fall", F.coalesce(fall, F.lit(0.0)))
    return got.withColumn("z_smooth", F.avg("z").over(near)).withColumn("fall_pct", F.avg("_fall").over(near)).drop("_step", "_fall")


def grade_stats(points: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("seq")
    run = F.sqrt(F.pow(F.col("x") - F.lag("x").over(order), 2) + F.pow(F.col("y") - F.lag("y").over(order), 2))
    grade = F.abs(F.col("z") - F.lag("z").over(order)) / F.when(run > 0, run) * 100.0
    got = points.withColumn("grade", grade).withColumn("run", run)
    return got.groupBy(*keys).agg(
        F.coalesce(F.avg("grade"), F.lit(0.0)).alias("avg_grade_pct"), F.coalesce(F.stddev_pop("grade"), F.lit(0.0)).alias("grade_stddev"),
        F.coalesce(F.sum("run"), F.lit(0.0)).alias("length_m"), F.coalesce(F.sum(F.when(F.col("grade") > 10, F.col("run"))), F.lit(0.0)).alias("steep_m"),
    )


def residual_sum(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """What a straight line leaves of y: 0 below two points."""
    syy, sxy, sxx = F.regr_syy(y, x), F.regr_sxy(y, x), F.regr_sxx(y, x)
    rest = F.when(F.count(F.lit(1)) < 2, 0.0).when(sxx == 0, syy).otherwise(syy - F.try_divide(sxy * sxy, sxx))
    return points.groupBy(*keys).agg(rest.alias("residual"))


# --- access points -----------------------------------------------------------------

def edge_distance(points: DataFrame, rings: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Points (x, y) with ``edge_distance``: to the nearest edge of their parcel's ring
    (``ring_x``, ``ring_y``: arrays of its corners, closed by itself), null where the
    parcel has none or a ring of no corners."""
    n = F.size("ring_x")

    def to_edge(i):
        ends = [F.element_at("ring_x", i + 1), F.element_at("ring_y", i + 1), F.element_at("ring_x", (i + 1) % n + 1), F.element_at("ring_y", (i + 1) % n + 1)]
        x0, y0, dx, dy = ends[0], ends[1], ends[2] - ends[0], ends[3] - ends[1]
        along = F.try_divide((F.col("x") - x0) * dx + (F.col("y") - y0) * dy, dx * dx + dy * dy)
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(along, F.lit(0.0))))
        return F.sqrt(F.pow(F.col("x") - x0 - t * dx, 2) + F.pow(F.col("y") - y0 - t * dy, 2))

    joined = points.hint("merge").join(rings.select(key, "ring_x", "ring_y"), key, "left")
    nearest_edge = F.when(n > 0, F.array_min(F.transform(F.sequence(F.lit(0), n - 1), to_edge)))
    return joined.withColumn("edge_distance", nearest_edge).drop("ring_x", "ring_y")


def validate_access_points(points: DataFrame, rings: DataFrame, tolerance: float = 3.0, key: str = "parcel_id") -> DataFrame:
    """``points`` as they are; reading one that is further than ``tolerance`` metres
    from its parcel's edge, or has no edge to be at, raises."""
    far = F.coalesce(F.col("edge_distance") > tolerance, F.lit(True))
    said = F.format_string("access point is %.1f m from the boundary (tolerance %.1f m)", F.col("edge_distance"), F.lit(tolerance))
    checked = edge_distance(points, rings, key).withColumn("x", F.when(far, F.raise_error(said).cast("double")).otherwise(F.col("x")))
    return checked.select(*points.columns)


def snap_to_cells(points: DataFrame, cells: DataFrame, id_: str, px: float, py: float, origin_x: float, origin_y: float, key: str = "parcel_id") -> DataFrame:
    """For each point (x, y) the cell (r, c) of finite ``cost`` nearest to it, counted in
    cells, the first by rows on ties; null where its parcel has none."""
    open_cells = cells.where(F.abs("cost") < float("inf")).select(key, "r", "c")
    row, col = (F.lit(origin_y) - F.col("y")) / py - 0.5, (F.col("x") - origin_x) / px - 0.5
    apart = (F.col("r") - row) * (F.col("r") - row) + (F.col("c") - col) * (F.col("c") - col)
    best = F.min(F.when(F.col("r").isNotNull(), F.struct(apart.alias("d"), "r", "c"))).alias("m")
    near = dealt(points, [key]).hint("merge").join(dealt(open_cells, [key]), key, "left")
    return near.groupBy(key, id_).agg(best).select(key, id_, F.col("m.r").alias("r"), F.col("m.c").alias("c"))
