"""Gates, scores and ranks of production areas, water, trees, solar and roads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import factors as X
from .grid import FOUR, KEY, cell_area_acres, looked_at


# --- production ----------------------------------------------------------------------

def eligible_cells(cells: DataFrame, px: float, py: float, most_slope: float = 20.0) -> DataFrame:
    """``cells`` (slope_pct, aspect_deg, and hits in_parcel, hydric, tree_root,
    road; a null hit is one that wasn't checked) with factors, score, eligible."""
    hit = [F.coalesce(F.col(h), F.lit(False)) for h in ("hydric", "tree_root", "road")]
    clear = ~hit[0] & ~hit[1] & ~hit[2]
    ok = F.col("slope_pct").isNotNull() & (F.col("slope_pct") <= most_slope) & F.coalesce(F.col("in_parcel"), F.lit(False)) & clear
    return (
        cells.withColumn("slope_factor", X.slope_factor(F.col("slope_pct"), most_slope))
        .withColumn("aspect_factor", X.aspect_score(F.col("aspect_deg")))
        .withColumn("cell_score", X.per_cell_score(F.col("slope_pct"), F.col("aspect_deg"), most_slope))
        .withColumn("eligible", ok)
    )


def gate_report(cells: DataFrame, px: float, py: float) -> DataFrame:
    """Acres that each gate takes, and that it alone takes."""
    gates = {"hydric": F.col("hydric"), "tree_root": F.col("tree_root"), "road": F.col("road"), "slope": F.col("slope_pct") > 20.0}
    gates = {k: F.coalesce(v, F.lit(False)) for k, v in gates.items()}
    acre = cell_area_acres(px, py)
    out: list[Column] = []
    for name, gate in gates.items():
        rest = F.lit(True)
        for other, g in gates.items():
            if other != name:
                rest = rest & ~g
        out += [(F.count_if(gate) * acre).alias(f"{name}_acres"), (F.count_if(gate & rest) * acre).alias(f"only_{name}_acres")]
    return cells.where("in_parcel").groupBy("parcel_id").agg(*out)


def trim_to_ceiling(cells: DataFrame, px: float, py: float, ceiling_pct: float = 80.0) -> DataFrame:
    """The eligible cells that stay when the worst go first (in reading order on
    ties) for as long as what remains covers the ceiling's share of the parcel."""
    acre = cell_area_acres(px, py)
    parcel = Window.partitionBy("parcel_id")
    sized = cells.withColumn("_area", F.count_if("in_parcel").over(parcel) * acre)
    pool = sized.where("eligible")
    keep = F.least(F.count(F.lit(1)).over(parcel), F.ceil((F.col("_area") * ceiling_pct / 100.0 - 1e-9) / acre))
    order = parcel.orderBy(F.desc("cell_score"), F.desc("r"), F.desc("c"))
    return pool.withColumn("_keep", keep).withColumn("_n", F.row_number().over(order)).where("_n <= _keep").drop("_area", "_keep", "_n")


def compactness(cells: DataFrame, px: float, py: float, keys: list[str]) -> DataFrame:
    """Per patch: area against its outline's, 1 for a square; the outline is the
    cell sides without a neighbour of the patch."""
    patch = cells.select(*keys, "r", "c").distinct().withColumn("_one", F.lit(1))
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in FOUR])
    sides = patch.select(*keys, "r", "c", F.explode(steps).alias("s"))
    other = patch.select(*keys, F.col("r").alias("nr"), F.col("c").alias("nc"), F.lit(1).alias("_there"))
    sides = sides.withColumn("nr", F.col("r") + F.col("s.dr")).withColumn("nc", F.col("c") + F.col("s.dc")).hint("merge").join(other, [*keys, "nr", "nc"], "left")
    length = F.sum(F.when(F.col("_there").isNull(), F.when(F.col("s.dr") != 0, px).otherwise(py)).otherwise(0.0))
    got = sides.groupBy(*keys).agg((F.count(F.lit(1)) / 4 * px * py).alias("area"), length.alias("perimeter"))
    return got.withColumn("compactness", X.clamp(16.0 * F.col("area") / (F.col("perimeter") * F.col("perimeter"))))


def score_patches(cells: DataFrame, px: float, py: float, reference: float = 10.0) -> DataFrame:
    """Patches (parcel_id, patch_id) of scored cells: factors, 0 to 100 score, rank."""
    keys = ["parcel_id", "patch_id"]
    got = cells.groupBy(*keys).agg(
        F.avg("slope_factor").alias("slope_factor"), F.avg("aspect_factor").alias("aspect_factor"), F.avg("slope_pct").alias("avg_slope_pct"),
        X.circular_mean(F.col("aspect_deg")).alias("aspect_deg"), (F.count(F.lit(1)) * cell_area_acres(px, py)).alias("acres"), F.median("z").alias("median_z"),
    ).hint("merge").join(compactness(cells, px, py, keys).select(*keys, "compactness"), keys)
    size = 0.5 * X.clamp(F.col("acres") / reference) + 0.5 * F.col("compactness")
    got = got.withColumn("size_factor", size)
    got = got.withColumn("score", 100.0 * (0.55 * F.col("slope_factor") + 0.30 * F.col("size_factor") + 0.15 * F.col("aspect_factor")))
    return ranked(got, "patch_id")


def ranked(rows: DataFrame, tie: str, key: str = "parcel_id", score: str = "score") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie)))


def placed(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """``place``: from 1 within the keys, in that order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def selected(rows: DataFrame, tie: str, key: str = "parcel_id", score: str = "score") -> DataFrame:
    """The best row of each parcel."""
    return ranked(rows, tie, key, score).where("rank = 1").drop("rank")


def waist_split_flags(cells: DataFrame) -> DataFrame:
    """Patches with a cell beside a cell of another patch."""
    near = looked_at(cells, list(FOUR), "patch_id").withColumnRenamed("patch_id", "_other")
    touch = near.hint("merge").join(cells.select(*KEY, "patch_id"), KEY).where("_other <> patch_id").select("parcel_id", "patch_id").distinct()
    every = cells.select("parcel_id", "patch_id").distinct()
    return every.hint("merge").join(touch.withColumn("from_waist_split", F.lit(True)), ["parcel_id", "patch_id"], "left").na.fill(False, ["from_waist_split"])


# --- water -----------------------------------------------------------------------------

def water_eligible(cells: DataFrame, px: float, py: float, most_acres: float = 20.0) -> DataFrame:
    """Cells that drain few enough acres, in the parcel, clear of canopy, roads and
    production, and in service reach."""
    no = [~F.coalesce(F.col(h), F.lit(False)) for h in ("canopy", "road", "near_production")]
    return cells.withColumn("water_eligible", (F.col("accumulation") * cell_area_acres(px, py) <= most_acres) & F.col("in_parcel") & no[0] & no[1] & no[2] & F.coalesce(F.col("in_service"), F.lit(False)))


def score_water_zones(zones: DataFrame) -> DataFrame:
    """Zones with differential, distance, gradient_pct, ksat, coverage, fcode,
    stream_distance, terrain_gradient, acres."""
    soil = F.when(F.col("coverage") >= 0.3, X.water_holding(F.col("ksat"))).otherwise(0.5)
    got = (
        zones.withColumn("gravity_factor", X.gravity_feed(F.col("differential"), F.col("distance"), F.col("gradient_pct")))
        .withColumn("soil_factor", soil)
        .withColumn("stream_factor", X.stream_permanence(F.col("fcode"), F.col("stream_distance")))
        .withColumn("topographic_factor", X.topographic(F.col("terrain_gradient"), F.col("acres")))
    )
    got = got.withColumn("score", 100.0 * (0.35 * F.col("gravity_factor") + 0.30 * F.col("soil_factor") + 0.20 * F.col("stream_factor") + 0.15 * F.col("topographic_factor")))
    sure = X.signal_confidence(F.col("ksat").isNotNull(), F.col("fcode").isNotNull(), F.col("coverage"))
    return ranked(got.withColumn("confidence", sure), "zone_id")


# --- trees -----------------------------------------------------------------------------

def score_tree_cells(cells: DataFrame, least: float = 31.0) -> DataFrame:
    """Cells with hydric, prime (null: no data), slope_pct, stream_distance."""
    hydric = F.coalesce(F.col("hydric").cast("double"), F.lit(0.5))
    marginal = F.coalesce(1.0 - F.col("prime").cast("double"), F.lit(0.5))
    score = 100.0 * (0.40 * hydric + 0.30 * X.tree_slope_factor(F.col("slope_pct")) + 0.20 * marginal + 0.10 * X.tree_stream_factor(F.col("stream_distance")))
    return cells.withColumn("tree_score", score).withColumn("tree_eligible", F.col("tree_score") >= least)


def tree_patches(cells: DataFrame, px: float, py: float, least_acres: float = 0.1) -> DataFrame:
    acre = cell_area_acres(px, py)
    got = cells.where("component IS NOT NULL").groupBy("parcel_id", F.col("component").alias("patch_id")).agg(
        (F.count(F.lit(1)) * acre).alias("acres"), F.avg("tree_score").alias("score"), F.avg("slope_pct").alias("avg_slope_pct")
    )
    return ranked(got.where(F.col("acres") >= least_acres), "patch_id")


# --- solar -----------------------------------------------------------------------------

def solar_candidates(points: DataFrame, cells: DataFrame, acres: float = 0.1, most_slope: float = 20.0, least: float = 0.4, top: int = 5) -> DataFrame:
    """Lattice points with the mean of the cells of a square about them. ``cells``
    have x, y, slope_pct, aspect_deg, shading_score and may have ``canopy``, which
    rules out each square that it touches; ``points`` point_id, x, y and
    production_distance. The aspect is the circular mean of the cells that have one, a
    square without shading has 0.5. The square is met by bins of its side: an
    equi-join."""
    from .records import within

    half = math.sqrt(acres * X.SQUARE_METERS_PER_ACRE) / 2
    near = within(points, cells, half * math.sqrt(2))
    near = near.where((F.abs(F.col("l_x") - F.col("r_x")) <= half) & (F.abs(F.col("l_y") - F.col("r_y")) <= half))
    got = near.groupBy("parcel_id", F.col("l_point_id").alias("point_id"), F.col("l_production_distance").alias("production_distance")).agg(
        F.avg("r_slope_pct").alias("slope_pct"), X.aspect_score(X.circular_mean(F.col("r_aspect_deg"))).alias("aspect_factor"),
        F.coalesce(F.avg("r_shading_score"), F.lit(0.5)).alias("shading_factor"), F.count(F.lit(1)).alias("n_cells"),
        F.max(F.coalesce(F.col("r_canopy"), F.lit(False)) if "r_canopy" in near.columns else F.lit(False)).alias("_canopy"),
    ).where("NOT _canopy").drop("_canopy")
    score = 0.25 * (X.solar_slope_score(F.col("slope_pct"), most_slope) + F.col("aspect_factor") + F.col("shading_factor") + X.production_proximity(F.col("production_distance")))
    got = got.withColumn("score", score).where((F.col("slope_pct") <= most_slope) & (F.col("score") >= least))
    return ranked(got, "point_id").where(F.col("rank") <= top)


def first_tier(tiers: list[DataFrame], key: str = "parcel_id") -> DataFrame:
    """Per parcel the rows of the first of the tables that has any there."""
    every = None
    for n, tier in enumerate(tiers, 1):
        rows = tier.withColumn("tier", F.lit(n))
        every = rows if every is None else every.unionByName(rows)
    return every.withColumn("_first", F.min("tier").over(Window.partitionBy(key))).where("tier = _first").drop("_first")


# --- roads -----------------------------------------------------------------------------

def cost_raster(
    cells: DataFrame, grade_weight: float = 0.0133, flood: float = 5.0, canopy: float = 5.0, production: float = 3.0,
    impassable: float = 35.0, tpi_strength: float = 0.5, tpi_reference: float = 3.0,
) -> DataFrame:
    """cost of entering a cell, null where no road can go. Penalties are added,
    then production multiplies. Unknown tpi is neutral, unknown slope impassable."""
    yes = {k: F.coalesce(F.col(k), F.lit(False)) for k in ("excluded", "flood", "canopy", "on_production")}
    lean = F.coalesce(F.tanh(F.col("tpi") / tpi_reference), F.lit(0.0))
    base = (1.0 - tpi_strength * lean) + grade_weight * F.col("slope_pct") * F.col("slope_pct")
    base = base + F.when(yes["flood"], flood).otherwise(0.0) + F.when(yes["canopy"], canopy).otherwise(0.0)
    cost = base * F.when(yes["on_production"], production).otherwise(1.0)
    cost = F.when(yes["excluded"] | F.col("slope_pct").isNull() | (F.col("slope_pct") > impassable), F.lit(None)).otherwise(cost)
    checked = F.when(cost <= 0, F.raise_error(F.lit("a finite cost must be above 0")).cast("double")).otherwise(cost)
    return cells.withColumn("cost", checked)
