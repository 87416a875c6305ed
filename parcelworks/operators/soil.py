"""Soil components, horizons and map units."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import factors as X
from . import kernels
from .grid import dealt


def hydric_mukeys(components: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Map units whose hydric components make up ``threshold`` percent or more."""
    share = F.sum(F.coalesce(X.number(F.col("comppct_r")), F.lit(0.0)))
    return components.where(X.is_hydric(F.col("hydricrating"))).groupBy("mukey").agg(share.alias("hydric_pct")).where(F.col("hydric_pct") >= threshold)


def dominant_component(components: DataFrame) -> DataFrame:
    """Of each map unit the component of the largest share, by name on ties."""
    w = Window.partitionBy("mukey").orderBy(X.number(F.col("comppct_r")).desc_nulls_last(), "compname")
    top = components.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return top.withColumn("confidence", X.component_confidence(F.col("comppct_r")))


def shallowest_mineral(components: DataFrame, horizons: DataFrame, value: str) -> DataFrame:
    """``value`` of the horizons that start where a component's first mineral one
    does (its name not ``O...``; nulls don't count), one row a map unit: the
    component of the largest share."""
    first = F.min(F.when(~F.col("hzname").like("O%"), F.col("hzdept_r"))).over(Window.partitionBy("cokey"))
    at = horizons.withColumn("_first", first).where("hzdept_r = _first").groupBy("cokey").agg(F.max(value).alias(value))
    w = Window.partitionBy("mukey").orderBy(X.number(F.col("comppct_r")).desc_nulls_last(), "compname", "cokey")
    joined = components.hint("merge").join(at, "cokey")
    return joined.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("mukey", "compname", "comppct_r", value)


def erosion_factor(components: DataFrame, horizons: DataFrame) -> DataFrame:
    got = shallowest_mineral(components, horizons, "kwfact")
    return got.withColumn("erosion_prone", X.is_erosion_prone(F.col("kwfact")))


def conductivity(components: DataFrame, horizons: DataFrame) -> DataFrame:
    got = shallowest_mineral(components, horizons, "ksat_r")
    return got.withColumn("water_holding_factor", X.water_holding(X.number(F.col("ksat_r"))))


def farmland(mapunits: DataFrame, hits: DataFrame) -> DataFrame:
    """Classes of the map units that a parcel meets (a semi-join)."""
    found = mapunits.hint("merge").join(hits.select("mukey"), "mukey", "left_semi")
    return found.select("mukey", F.col("farmlndcl").alias("farmland_classification"), X.is_prime_farmland(F.col("farmlndcl")).alias("is_prime"))


def at_place(components: DataFrame, hits: DataFrame) -> DataFrame:
    """Components of the map units that a point or polygon meets."""
    return components.hint("merge").join(hits.select("mukey"), "mukey", "left_semi")


def as_features(components: DataFrame, geometries: DataFrame) -> DataFrame:
    """A row a map unit with a geometry: its components, the largest first."""
    each = F.struct((-X.number(F.col("comppct_r"))).alias("o"), "compname", "comppct_r", "hydricrating")
    listed = components.groupBy("mukey").agg(F.array_sort(F.collect_list(each)).alias("components"))
    top = F.element_at("components", 1)
    return listed.hint("merge").join(geometries, "mukey").select(
        "mukey", "geometry", top["compname"].alias("dominant"), X.component_confidence(top["comppct_r"]).alias("confidence"),
        F.size("components").alias("n_components"),
        F.transform("components", lambda c: F.struct(c["compname"].alias("compname"), c["comppct_r"].alias("comppct_r"))).alias("components"),
    )


# --- map units under a zone --------------------------------------------------------

@F.pandas_udf(DoubleType())
def _overlap_area(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
    rings = ([np.column_stack(r) for r in zip(*xy, strict=True)] for xy in ((ax, ay), (bx, by)))
    return pd.Series(kernels.ring_overlaps(*rings), dtype=float)


#: A filter above must not make it run a second time, before pairs are dealt.
overlap_area = _overlap_area.asNondeterministic()


def ring_area(xs: str, ys: str) -> F.Column:
    """Area of a ring given as two arrays, taken from its first corner."""
    x, y, n = F.col(xs), F.col(ys), F.size(xs)

    def at(i):
        return F.get(x, i) - F.get(x, F.lit(0)), F.get(y, i) - F.get(y, F.lit(0))

    def add(total, i):
        (x0, y0), (x1, y1) = at(i), at((i + 1) % n)
        return total + x0 * y1 - x1 * y0

    return F.when(n > 2, F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), add)) / 2).otherwise(0.0)


def _binned(rings: DataFrame, bin_m: float, side: str) -> DataFrame:
    """Rings with their lower left corner, once in each bin their boxes meet."""
    got = rings
    for axis, of in (("x", "ring_x"), ("y", "ring_y")):
        low, high = F.array_min(of), F.array_max(of)
        got = got.withColumn(f"{side}_{axis}", low).withColumn(f"_b{axis}", F.explode(F.sequence(F.floor(low / bin_m), F.floor(high / bin_m))))
    return got.withColumnsRenamed({"ring_x": f"{side}_ring_x", "ring_y": f"{side}_ring_y"})


def area_weighted_ksat(zones: DataFrame, mapunits: DataFrame, ksat: DataFrame, bin_m: float = 250.0, key: str = "parcel_id") -> DataFrame:
    """The mean ``ksat_r`` of the map units under each zone, by the area each covers,
    and the share of the zone that they cover (1 at most); both null where no map unit
    with a number meets the zone.

    ``zones`` (key, zone_id) and ``mapunits`` (key, mukey) have rings as ``ring_x`` and
    ``ring_y``; ``ksat`` has a row a mukey; ids are unique within a parcel. Rings meet by an equi-join on bins of
    ``bin_m`` metres; the bin of the lower left corner of both boxes' common part keeps
    the pair, so no pair comes twice."""
    known = ksat.select("mukey", X.number(F.col("ksat_r")).alias("_k")).where("_k IS NOT NULL")
    units = _binned(mapunits.select(key, "mukey", "ring_x", "ring_y").hint("merge").join(known, "mukey"), bin_m, "u")
    pairs = _binned(zones.select(key, "zone_id", "ring_x", "ring_y"), bin_m, "z").hint("merge").join(units, [key, "_bx", "_by"])
    for axis in "xy":
        pairs = pairs.where(F.floor(F.greatest(f"z_{axis}", f"u_{axis}") / bin_m) == F.col(f"_b{axis}"))
    spread = dealt(pairs, [key, "zone_id"])  # pairs of few bytes would be few tasks, and their rings are the work
    met = spread.withColumn("_a", overlap_area("z_ring_x", "z_ring_y", "u_ring_x", "u_ring_y")).where("_a > 0")
    sums = met.groupBy(key, "zone_id").agg(F.sum(F.col("_k") * F.col("_a")).alias("_ka"), F.sum("_a").alias("_a"))
    area = ring_area("ring_x", "ring_y")
    return zones.hint("merge").join(sums, [key, "zone_id"], "left").select(
        key, "zone_id", F.try_divide("_ka", "_a").alias("ksat_r"), F.when(F.col("_a").isNotNull(), F.least(F.lit(1.0), F.try_divide(F.col("_a"), area))).alias("coverage"),
    )
