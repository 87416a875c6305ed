"""Source rasters on a parcel's grid: the best tile, inverse mapping, coverage.

Nothing is warped whole: each target cell names the source pixels that it needs, and
an equi-join fetches them. ``pixels`` holds a row a pixel: tile_id, row, col, value,
null where the source has no data; ``tiles`` parcel_id, tile_id, origin_x, origin_y, px,
py (rows go down) and ``rings``, the tile's ground. Target cells carry their centre as
``x`` and ``y`` in the source's projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import polygons as P
from . import regions

#: Percent of the cells on the parcel without data that a raster may have.
MOST_NODATA = 10.0


def best_tiles(tiles: DataFrame, parcels: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Of each parcel (``rings``) the tile that covers most of it, the smaller id on
    ties; tiles that don't meet it are none of its own."""
    both = tiles.hint("merge").join(parcels.select(key, F.col("rings").alias("_home")), key)
    shared = regions.with_region(both, "_shared", P.intersection, "rings", "_home").where("_shared IS NOT NULL").withColumn("overlap", regions.area("_shared"))
    first = Window.partitionBy(key).orderBy(F.desc("overlap"), "tile_id")
    return shared.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_home", "_shared")


def resampled(cells: DataFrame, tiles: DataFrame, pixels: DataFrame, bilinear: bool = True, key: str = "parcel_id") -> DataFrame:
    """``cells`` (r, c, x, y) with ``value`` from their parcel's tile. Bilinear weighs the
    four pixels about a centre, those without data left out and the rest made whole;
    else the pixel that holds it. No pixel with data, no value."""
    at = [key, "r", "c"]
    held = cells.hint("merge").join(tiles.select(key, "tile_id", "origin_x", "origin_y", "px", "py"), key)
    u, v = (F.col("x") - F.col("origin_x")) / F.col("px"), (F.col("origin_y") - F.col("y")) / F.col("py")
    if bilinear:
        u, v = u - 0.5, v - 0.5
    col, row = F.floor(u).cast("int"), F.floor(v).cast("int")
    a, b = (u - col, v - row) if bilinear else (F.lit(0.0), F.lit(0.0))
    near = [F.struct((row + i).alias("row"), (col + j).alias("col"), ((b if i else 1 - b) * (a if j else 1 - a)).alias("weight")) for i in (0, 1) for j in (0, 1)]
    asked = held.select(*at, "tile_id", F.inline(F.array(*near[: 4 if bilinear else 1]))).where("weight > 0")
    found = asked.hint("merge").join(pixels.where("value IS NOT NULL AND NOT isnan(value)"), ["tile_id", "row", "col"])
    value = found.groupBy(*at).agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("value"))
    return cells.hint("merge").join(value, at, "left")


def coverage(cells: DataFrame, most: float = MOST_NODATA, key: str = "parcel_id") -> DataFrame:
    """key, n_cells, nodata_pct of the cells ``in_parcel``, and status: complete,
    incomplete (more than ``most`` percent without data), none (all of them)."""
    got = cells.groupBy(key).agg(F.count_if("in_parcel").alias("n_cells"), F.count_if(F.col("in_parcel") & F.col("value").isNull()).alias("_gaps"), F.count("value").alias("_any"))
    share = F.coalesce(F.try_divide(F.col("_gaps"), F.col("n_cells")) * 100.0, F.lit(0.0))
    status = F.when(F.col("_any") == 0, "none").when(F.col("nodata_pct") > most, "incomplete").otherwise("complete")
    return got.withColumn("nodata_pct", share).withColumn("status", status).drop("_gaps", "_any")


def required(cells: DataFrame, most: float = MOST_NODATA, key: str = "parcel_id") -> DataFrame:
    """``cells``; reading a parcel whose coverage is incomplete raises. One without any
    coverage has no rows: that is an answer, not a failure."""
    state = coverage(cells, most, key)
    said = F.format_string("coverage of parcel %s is incomplete: %.1f %% without data", F.col(key).cast("string"), F.col("nodata_pct"))
    checked = state.where("status <> 'none'").select(key, F.when(F.col("status") == "incomplete", F.raise_error(said).cast("boolean")).otherwise(F.lit(True)).alias("_ok"))
    return cells.hint("merge").join(checked, key).where("_ok").drop("_ok")
