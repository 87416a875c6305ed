"""Cells of parcel grids as rows, and neighbourhood operators over them.

A grid is a table of cells (parcel_id, r, c, ...); rows grow southwards. A
neighbourhood is a list of offsets: every cell sends its value to the cells that
look at it, and one aggregation by target cell, combined map-side, gives all of
an operator's sums at once. Grids have at most 90,000 cells, offsets some
hundreds, so skew of a parcel is bounded; parcels are many.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SQUARE_METERS_PER_ACRE = 4046.8564224
EIGHT = tuple((dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc)
FOUR = ((-1, 0), (0, -1), (0, 1), (1, 0))
KEY = ["parcel_id", "r", "c"]


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """By key over all shuffle partitions. Work on cells and corners is many times what
    their bytes say: a table of one small file is one task, and partitions of few bytes
    are merged, unless they are dealt by number."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cell_area_acres(px: float, py: float) -> float:
    return px * py / SQUARE_METERS_PER_ACRE


def pixel_center(origin_x: Column, origin_y: Column, r: Column, c: Column, px: float, py: float) -> tuple[Column, Column]:
    return origin_x + (c + 0.5) * px, origin_y - (r + 0.5) * py


def disc(radius: float, px: float = 1.0, py: float = 1.0, centre: bool = True) -> list[tuple[int, int]]:
    """Offsets within ``radius`` metres of a cell's centre."""
    rows, cols = int(radius // py), int(radius // px)
    return [
        (dr, dc)
        for dr in range(-rows, rows + 1)
        for dc in range(-cols, cols + 1)
        if math.hypot(dc * px, dr * py) <= radius and (centre or dr or dc)
    ]


def square(radius: int, centre: bool = True) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(dr, dc) for dr in span for dc in span if centre or dr or dc]


def looked_at(cells: DataFrame, offsets: list[tuple[int, int]], value: str = "z") -> DataFrame:
    """(parcel_id, r, c, dr, dc, value) of each neighbour (r+dr, c+dc) of a target
    (r, c); targets outside the grid appear too and go with a join to cells. Cells are
    dealt by parcel before they multiply, so sums by target need no other shuffle."""
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in offsets])
    held = dealt(cells.where(F.col(value).isNotNull()).select(*KEY, F.col(value).alias("_v")), ["parcel_id"])
    sent = held.select(*KEY, "_v", F.explode(steps).alias("_o"))
    return sent.select(
        "parcel_id", (F.col("r") - F.col("_o.dr")).alias("r"), (F.col("c") - F.col("_o.dc")).alias("c"),
        F.col("_o.dr").alias("dr"), F.col("_o.dc").alias("dc"), F.col("_v").alias(value),
    )


def gather(cells: DataFrame, offsets: list[tuple[int, int]], aggregates: list[Column], value: str = "z") -> DataFrame:
    """``cells`` with aggregates over their neighbours (null where none)."""
    got = looked_at(cells, offsets, value).groupBy(*KEY).agg(*aggregates)
    return cells.hint("merge").join(got, KEY, "left")


# --- terrain ------------------------------------------------------------------

def neighbour_slope(cells: DataFrame, px: float, py: float) -> DataFrame:
    """slope_pct: the steepest of the slopes to the up to 8 neighbours."""
    around = looked_at(cells, list(EIGHT)).withColumnRenamed("z", "_z")
    joined = around.hint("merge").join(cells.where("z IS NOT NULL").select(*KEY, "z"), KEY)
    run = F.sqrt(F.pow(F.col("dc") * px, 2) + F.pow(F.col("dr") * py, 2))
    steepest = joined.groupBy(*KEY).agg(F.max(F.abs(F.col("_z") - F.col("z")) / run * 100.0).alias("_s"))
    out = cells.hint("merge").join(steepest, KEY, "left")
    return out.withColumn("slope_pct", F.when(F.col("z").isNotNull(), F.coalesce("_s", F.lit(0.0)))).drop("_s")


def horn(cells: DataFrame, px: float, py: float) -> DataFrame:
    """slope_pct and aspect_deg by weighted differences of the 8 neighbours; null
    where a neighbour is missing; aspect null on flat ground. Neighbours are added in one
    order, the last in reading order first, not as they come: where west and east are
    equally high, what rounding leaves of their difference makes north 0 or 360."""
    last_first = list(enumerate(EIGHT[::-1]))
    about = [F.max(F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col("z"))).alias(f"_z{i}") for i, (dr, dc) in last_first]
    out = gather(cells, list(EIGHT), [*about, F.count("z").alias("_n")])
    out = out.withColumn("_e", sum((dc * (2 - abs(dr)) * F.col(f"_z{i}") for i, (dr, dc) in last_first if dc), F.lit(0.0)))
    out = out.withColumn("_s", sum((dr * (2 - abs(dc)) * F.col(f"_z{i}") for i, (dr, dc) in last_first if dr), F.lit(0.0)))
    out = out.drop(*[f"_z{i}" for i in range(len(EIGHT))])
    full = (F.col("_n") == 8) & F.col("z").isNotNull()
    dx, dy = F.col("_e") / (8 * px), F.col("_s") / (8 * py)
    rise = F.sqrt(dx * dx + dy * dy)
    # Past a quarter turn Java's atan2 is a bit off: from the quarter on, with what its double lacks.
    angle = F.when(dy > 0, math.pi / 2 + (F.atan2(dx, dy) + 6.123233995736766e-17)).otherwise(F.atan2(dy, -dx))
    bearing = F.pmod(90.0 - F.degrees(angle), F.lit(360.0))
    out = out.withColumn("slope_pct", F.when(full, rise * 100.0))
    return out.withColumn("aspect_deg", F.when(full & (rise >= 1e-6), bearing)).drop("_e", "_s", "_n")


def tpi(cells: DataFrame, px: float, py: float, radius: float = 50.0, least: int = 5) -> DataFrame:
    """tpi: height less the mean of the disc, itself included."""
    out = gather(cells, disc(radius, px, py), [F.avg("z").alias("_m"), F.count("z").alias("_n")])
    return out.withColumn("tpi", F.when(F.col("_n") >= least, F.col("z") - F.col("_m"))).drop("_m", "_n")


def shading_offsets(radius: int = 10, azimuth: tuple[float, float] = (100.0, 260.0)) -> list[tuple[int, int]]:
    def inside(dr: int, dc: int) -> bool:
        return azimuth[0] <= math.degrees(math.atan2(dc, -dr)) % 360.0 <= azimuth[1]

    return [(dr, dc) for dr, dc in disc(radius, centre=False) if inside(dr, dc)]


def shading(cells: DataFrame, px: float, py: float, radius: int = 10, worst: float = 20.0, azimuth: tuple[float, float] = (100.0, 260.0)) -> DataFrame:
    """shading_score: 1 under an open southern horizon, 0 at ``worst`` degrees."""
    around = looked_at(cells, shading_offsets(radius, azimuth)).withColumnRenamed("z", "_z")
    joined = around.hint("merge").join(cells.where("z IS NOT NULL").select(*KEY, "z"), KEY).where(F.col("_z") > F.col("z"))
    run = F.sqrt(F.pow(F.col("dc") * px, 2) + F.pow(F.col("dr") * py, 2))
    angle = joined.groupBy(*KEY).agg(F.max(F.degrees(F.atan2(F.col("_z") - F.col("z"), run))).alias("_a"))
    out = cells.hint("merge").join(angle, KEY, "left")
    score = 1.0 - F.least(F.coalesce("_a", F.lit(0.0)) / worst, F.lit(1.0))
    return out.withColumn("shading_score", F.when(F.col("z").isNotNull(), score)).drop("_a")


def flow_direction(cells: DataFrame, px: float, py: float) -> DataFrame:
    """to_r, to_c: the steepest way down (the first of equal ones), else null."""
    around = looked_at(cells, list(EIGHT)).withColumnRenamed("z", "_z")
    joined = around.hint("merge").join(cells.where("z IS NOT NULL").select(*KEY, "z"), KEY)
    run = F.sqrt(F.pow(F.col("dc") * px, 2) + F.pow(F.col("dr") * py, 2))
    slope = ((F.col("z") - F.col("_z")) / run).alias("s")
    index = ((F.col("dr") + 1) * 3 + F.col("dc") + 1).alias("i")
    down = joined.where(F.col("_z") < F.col("z")).groupBy(*KEY).agg(
        F.max(F.struct(slope, (-index).alias("i"), "dr", "dc")).alias("m")
    )
    out = cells.hint("merge").join(down, KEY, "left")
    return out.withColumn("to_r", F.col("r") + F.col("m.dr")).withColumn("to_c", F.col("c") + F.col("m.dc")).drop("m")


# --- morphology -----------------------------------------------------------------

def erode(cells: DataFrame, offsets: list[tuple[int, int]], mask: str = "hit") -> DataFrame:
    """eroded: all of the element's cells are hits; outside counts as none."""
    hits = cells.where(F.col(mask)).withColumn("_one", F.lit(1))
    got = looked_at(hits, offsets, "_one").groupBy(*KEY).agg(F.count("_one").alias("_n"))
    return cells.hint("merge").join(got, KEY, "left").withColumn("eroded", F.coalesce(F.col("_n") == len(offsets), F.lit(False))).drop("_n")


def dilate(cells: DataFrame, offsets: list[tuple[int, int]], mask: str = "hit") -> DataFrame:
    """dilated: any of the element's cells is a hit."""
    hits = cells.where(F.col(mask)).withColumn("_one", F.lit(1))
    got = looked_at(hits, offsets, "_one").groupBy(*KEY).agg(F.lit(True).alias("_any"))
    return cells.hint("merge").join(got, KEY, "left").withColumn("dilated", F.coalesce("_any", F.lit(False))).drop("_any")


def waist_radius(px: float, py: float, waist: float = 24.0) -> int:
    return max(1, math.ceil(waist / ((px + py) / 2) / 2))


def tree_root_zone(cells: DataFrame, px: float, py: float, height: float = 4.5, buffer_meters: float = 3.048) -> DataFrame:
    """tree_root: within a square of a cell with canopy of ``height`` or more."""
    tall = cells.withColumn("hit", F.coalesce(F.col("hag") >= height, F.lit(False)))
    if buffer_meters <= 0:
        return tall.withColumnRenamed("hit", "tree_root")
    radius = max(1, math.ceil(buffer_meters / ((px + py) / 2)))
    return dilate(tall, square(radius)).drop("hit").withColumnRenamed("dilated", "tree_root")


# --- components -----------------------------------------------------------------

def components(cells: DataFrame, connectivity: int = 8, mask: str = "hit", most: int = 2000) -> DataFrame:
    """component: of connected hits, numbered in reading order of their first
    cell; null elsewhere. Labels spread to neighbours and then jump along the
    label's own label; each turn is checkpointed, and all stop when none changes."""
    width = F.max("c").over(_parcel()) + 1
    hits = cells.where(F.col(mask)).withColumn("id", F.col("r") * width + F.col("c")).select(*KEY, "id")
    hits = hits.checkpoint()
    near = looked_at(hits, list(FOUR if connectivity == 4 else EIGHT), "id").withColumnRenamed("id", "other")
    edges = near.hint("merge").join(hits, KEY).select("parcel_id", "id", "other").checkpoint()
    labels = hits.select("parcel_id", "id", F.col("id").alias("label"))
    for _ in range(most):
        spread = edges.hint("merge").join(labels.select("parcel_id", F.col("id").alias("other"), F.col("label").alias("l")), ["parcel_id", "other"])
        low = spread.groupBy("parcel_id", "id").agg(F.min("l").alias("l"))
        new = labels.hint("merge").join(low, ["parcel_id", "id"], "left").select("parcel_id", "id", "label", F.least("label", "l").alias("m"))
        jump = new.select("parcel_id", F.col("id").alias("m"), F.col("m").alias("j"))
        new = new.hint("merge").join(jump, ["parcel_id", "m"]).select("parcel_id", "id", F.col("label").alias("old"), F.col("j").alias("label")).checkpoint()
        labels = new.drop("old")
        if new.where("old <> label").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most} turns")
    ranked = labels.withColumn("component", F.dense_rank().over(_parcel().orderBy("label")) - 1)
    named = hits.hint("merge").join(ranked.select("parcel_id", "id", "component"), ["parcel_id", "id"]).select(*KEY, "component")
    return cells.hint("merge").join(named, KEY, "left")


def _parcel():
    from pyspark.sql import Window

    return Window.partitionBy("parcel_id")
