"""Lines against zones: valleys inside a zone, the nearest shape, contours as lines."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from . import polygons as P
from .grid import dealt
from .regions import _once, covered_cells, decoded


def valley_inputs(zones: DataFrame, branches: DataFrame, px: float, py: float, origin_x: float = 0.0, origin_y: float = 0.0) -> DataFrame:
    """parcel_id, zone_id, terrain_gradient, contributing_acres of each zone (with
    ``rings``). ``branches``: valley_id, max_acres, branch_id, seq, r, c, x, y, z down
    each branch. Of a branch's points in a zone the first and the last give its fall;
    branches weigh by their points; two points or more at different places count. The
    largest watershed of the valleys that count is the zone's; null where none does.

    Branch points are cell centres, so a zone meets them as cells: an equi-join."""
    at = covered_cells(zones, px, py, origin_x, origin_y, ("parcel_id", "zone_id"))
    place = F.struct("x", "y", "z")
    ends = branches.hint("merge").join(at, ["parcel_id", "r", "c"]).groupBy("parcel_id", "zone_id", "valley_id", "branch_id").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(place, "seq").alias("a"), F.max_by(place, "seq").alias("b"), F.max("max_acres").alias("acres"))
    run = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    real = ends.withColumn("run", run).where("n >= 2 AND run > 0").withColumn("grade", F.abs(F.col("a.z") - F.col("b.z")) / F.col("run") * 100)
    got = real.groupBy("parcel_id", "zone_id").agg(
        (F.sum(F.col("grade") * F.col("n")) / F.sum("n")).alias("terrain_gradient"), F.max("acres").alias("contributing_acres"))
    return zones.select("parcel_id", "zone_id").hint("merge").join(got, ["parcel_id", "zone_id"], "left")


def _boxed(df: DataFrame, prefix: str, size: Column, reach: Column) -> DataFrame:
    """A row for each bin of ``size`` that a shape's box, widened by ``reach``, meets."""
    corners = F.flatten(prefix + "shape")
    for axis, pick in (("x", lambda p: p[0]), ("y", lambda p: p[1])):
        v = F.transform(corners, pick)
        low, high = F.floor((F.array_min(v) - reach) / size), F.floor((F.array_max(v) + reach) / size)
        df = df.withColumn(f"_b{axis}", F.explode(F.sequence(low, high)))
    return df


def nearest_shape(left: DataFrame, right: DataFrame, id_left: str, id_right: str, left_kind: str = "area", right_kind: str = "area", start: float = 200.0, key: str = "parcel_id") -> DataFrame:
    """key, id_left, id_right, distance, status: for each shape of ``left`` the nearest of
    its parcel in ``right`` (the smaller id on ties), 0 where they meet; ``no_feature``
    where the parcel has none. Both have ``rings``; kinds as in ``polygons.distance``.

    A search by bins in turns: two shapes meet if their boxes are within the turn's
    reach, which is also the bins' size. A shape is settled once what it found is within
    reach, since whatever it didn't meet is further; the others go on with the reach
    doubled. The first reach is how far a parcel's shapes lie apart, ``start`` at most,
    so that a bin holds a few of them however dense they are. Turns grow with the
    logarithm of the parcel's extent, and their pairs with what is near."""
    spark = left.sparkSession
    ones = left.select(key, id_left, F.col("rings").alias("l_shape")).where(F.size("l_shape") > 0)
    others = right.select(key, F.col(id_right).alias("r_id"), F.col("rings").alias("r_shape")).where(F.size("r_shape") > 0)
    corners = F.flatten("r_shape")
    box = [f(F.transform(corners, pick)) for pick in (lambda p: p[0], lambda p: p[1]) for f in (F.array_min, F.array_max)]
    span = [F.max(box[2 * k + 1]) - F.min(box[2 * k]) for k in (0, 1)]
    # Along a line the mean gap counts, over an area the side of each one's share.
    n = F.count(F.lit(1))
    gap = F.greatest(F.sqrt(span[0] * span[1] / n), F.greatest(*span) / n)
    known = others.groupBy(key).agg(F.when(gap > 0, F.least(F.lit(start), F.greatest(gap, F.lit(start / 1024)))).otherwise(start).alias("reach"))
    others = others.hint("merge").join(known, key).checkpoint()

    def apart(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(P.distances(decoded(a), decoded(b), left_kind, right_kind))

    open_ = ones.hint("merge").join(known, key).checkpoint()
    found, turn = None, 1
    while not open_.isEmpty():
        reach = F.col("reach") * turn
        near = _boxed(dealt(open_, [key, id_left]), "l_", reach, reach).withColumnRenamed("reach", "_reach")
        pairs = dealt(near, [key, "_bx", "_by"]).hint("merge").join(dealt(_boxed(others, "r_", reach, F.lit(0.0)), [key, "_bx", "_by"]), [key, "_bx", "_by"])
        far = dealt(pairs, [key, id_left]).dropDuplicates([key, id_left, "r_id"]).withColumn("d", _once(apart, "double")("l_shape", "r_shape"))
        best = far.groupBy(key, id_left).agg(F.min(F.struct("d", F.col("r_id").alias("i"))).alias("m"), F.first("_reach").alias("_reach"))
        best = best.where(F.col("m.d") <= F.col("_reach") * turn).drop("_reach").checkpoint()
        found = best if found is None else found.unionByName(best)
        open_ = open_.hint("merge").join(best, [key, id_left], "left_anti").checkpoint()
        turn *= 2
    every = left.select(key, id_left)
    if found is None:
        found = spark.createDataFrame([], every.schema).withColumn("m", F.struct(F.lit(None).cast("double").alias("d"), F.lit(None).cast(right.schema[id_right].dataType).alias("i")))
    status = F.when(F.col("m").isNull(), "no_feature").otherwise("computed")
    return every.hint("merge").join(found, [key, id_left], "left").select(key, id_left, F.col("m.i").alias(id_right), F.col("m.d").alias("distance"), status.alias("status"))


def feature_relationships(points: DataFrame, shapes: DataFrame, id_point: str, id_shape: str, key: str = "parcel_id") -> DataFrame:
    """Each point (rings of one corner, ``elevation_m``) with the nearest drawn shape:
    status, distance_m and elevation_differential_m (above it positive), rounded to
    centimetres. ``shapes``: rings, ``representative_elevation_m``."""
    near = nearest_shape(points, shapes, id_point, id_shape, left_kind="line", key=key)
    got = near.hint("merge").join(points.select(key, id_point, "elevation_m"), [key, id_point]).hint("merge").join(shapes.select(key, id_shape, "representative_elevation_m"), [key, id_shape], "left")
    rise = F.round(F.col("elevation_m") - F.col("representative_elevation_m"), 2)
    return got.select(key, id_point, id_shape, "status", F.round("distance", 2).alias("distance_m"), rise.alias("elevation_differential_m"))


CONTOURS = "elevation_m double, line_id int, closed boolean, n_points int, rows array<double>, cols array<double>"


def contour_lines(cells: DataFrame, interval: float = 0.6) -> DataFrame:
    """Contours of each parcel's heights as lines: corners in rows and columns of cell
    centres, from one end to the other or round."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = P.contours(kernels.to_grid(pdf), interval)
        rows = [(level, k, bool((p[0] == p[-1]).all()) and len(p) > 2, len(p), p[:, 0].tolist(), p[:, 1].tolist()) for k, (level, p) in enumerate(found)]
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in CONTOURS.split(", ")])

    return kernels.per_parcel(cells, run, CONTOURS)
