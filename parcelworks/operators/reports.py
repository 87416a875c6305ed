"""Report sections: one text a parcel and subject, and the whole report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import factors as X

MM_PER_INCH = 25.4


def listed(parts: Column, separator: str = "\n") -> Column:
    """Aggregate: the distinct texts in order, joined."""
    return F.array_join(F.sort_array(F.collect_set(parts)), separator)


def number(x: Column) -> Column:
    """One decimal, as text."""
    return F.format_string("%.1f", x)


def soil_section(components: DataFrame, key: str = "parcel_id") -> DataFrame:
    line = F.concat(F.lit("- "), F.coalesce("compname", F.lit("Unknown")), F.lit(": "), F.coalesce("comppct_r", F.lit("?")), F.lit("% of map unit, hydric: "), F.coalesce(F.trim("hydricrating"), F.lit("unknown")))
    return components.groupBy(key).agg(listed(line).alias("section"))


def elevation_section(points: DataFrame, key: str = "parcel_id") -> DataFrame:
    """The relief is the difference of the rounded ends."""
    low, high = (F.round(f("z") / X.METERS_PER_FOOT).cast("long") for f in (F.min, F.max))
    text = F.format_string("Elevation range: %dft to %dft (total relief: %dft) across %d sample points.", low, high, high - low, F.count("z"))
    return points.where("z IS NOT NULL").groupBy(key).agg(text.alias("section"))


def water_section(features: DataFrame, key: str = "parcel_id") -> DataFrame:
    """``features``: kind and name; the lines of the kinds that are there."""
    names = [listed(F.when(F.col("kind") == k, F.col("name")), ", ") for k in ("stream", "water_body")]
    lines = [F.when(n != "", F.concat(F.lit(h), n)) for h, n in zip(("Streams/waterways: ", "Ponds/lakes: "), names, strict=True)]
    return features.groupBy(key).agg(F.concat_ws("\n", *lines).alias("section"))


def climate_section(summary: DataFrame, key: str = "parcel_id") -> DataFrame:
    def inches(c: str) -> Column:
        return number(F.col(c) / MM_PER_INCH)

    def fahrenheit(c: str) -> Column:
        return number(X.celsius_to_fahrenheit(F.col(c)))

    text = F.concat(
        F.lit("Prevailing wind direction: "), "wind_label", F.lit(" ("), number(F.col("wind_deg")), F.lit("°)\nAverage annual precipitation: "), inches("annual_precip_mm"),
        F.lit(" in\nHeaviest single day: "), inches("max_precip_mm"), F.lit(" in\nAverage high/low: "), fahrenheit("avg_high_c"), F.lit("°F / "), fahrenheit("avg_low_c"),
        F.lit("°F\nRecord high/low: "), fahrenheit("record_high_c"), F.lit("°F / "), fahrenheit("record_low_c"), F.lit("°F"),
    )
    return summary.select(key, text.alias("section"))


def locative(x: Column, y: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The third of a box that a place lies in, as words; places outside count as
    in the nearest third, and a box without extent has only a middle."""
    def third(v: Column, lo: Column, hi: Column) -> Column:
        share = F.coalesce(F.try_divide(v - lo, F.when(hi > lo, hi - lo)), F.lit(0.5))
        return F.least(F.lit(2), F.floor(X.clamp(share) * 3)).cast("int")

    column, row = third(x, minx, maxx), third(y, miny, maxy)
    ns = F.element_at(F.array(*map(F.lit, ("south", "", "north"))), row + 1)
    ew = F.element_at(F.array(*map(F.lit, ("west", "", "east"))), column + 1)
    both = F.concat(ns, ew)
    return F.when((ns != "") & (ew != ""), both).when(both != "", F.concat(both, F.lit("-central"))).otherwise("central")


def production_narrative(patches: DataFrame, parcel_acres: DataFrame, key: str = "parcel_id") -> DataFrame:
    """A struct a parcel: its totals and its ranked patches."""
    each = F.struct("rank", "patch_id", F.round("acres", 2).alias("acres"), F.round("score", 1).alias("score"), F.round("avg_slope_pct", 1).alias("avg_slope_pct"), X.compass_word(F.col("aspect_deg")).alias("faces"))
    got = patches.groupBy(key).agg(F.sum("acres").alias("_acres"), F.sort_array(F.collect_list(each)).alias("patches"))
    share = F.try_divide(F.col("_acres"), F.col("acres")) * 100
    return got.hint("merge").join(parcel_acres, key).select(key, F.struct(F.round("_acres", 2).alias("total_acres"), F.round(share, 1).alias("pct_of_parcel"), F.size("patches").alias("n_patches"), "patches").alias("narrative"))


def production_section(narratives: DataFrame, key: str = "parcel_id") -> DataFrame:
    n = F.col("narrative")
    lines = F.transform(n["patches"], lambda p: F.format_string("Area %d: %.2f acres, score %.1f, average slope %.1f%%, facing %s", p["rank"], p["acres"], p["score"], p["avg_slope_pct"], F.coalesce(p["faces"], F.lit("no one way"))))
    head = F.format_string("%d production areas, %.2f acres (%.1f%% of the parcel)", n["n_patches"], n["total_acres"], n["pct_of_parcel"])
    return narratives.select(key, F.concat_ws("\n", head, F.array_join(lines, "\n")).alias("section"))


def road_section(branches: DataFrame, key: str = "parcel_id") -> DataFrame:
    """``branches``: branch_id, meters, served_acres, stop_reason, a row a cell; an
    unknown reason is an error."""
    words = {"no_demand": "there is no production to serve", "all_demand_served": "all production is served", "no_reachable_demand": "the rest can't be reached", "cost_per_acre_exceeded": "the next branch would be too long for what it serves"}
    why = None
    for k, v in words.items():
        why = F.when(F.col("stop_reason") == k, v) if why is None else why.when(F.col("stop_reason") == k, v)
    why = why.otherwise(F.raise_error(F.concat(F.lit("unknown stop_reason: "), "stop_reason")).cast("string"))
    once = branches.select(key, "branch_id", "meters", "served_acres", "stop_reason").distinct()
    got = once.groupBy(key, "stop_reason").agg(F.count(F.lit(1)).alias("n"), F.sum("meters").alias("m"), F.sum("served_acres").alias("a"))
    text = F.format_string("%d road branches, %.0f ft, serving %.2f acres: %s", F.col("n"), F.col("m") / X.METERS_PER_FOOT, F.col("a"), why)
    return got.select(key, text.alias("section"))


def _lined(parcels: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Parcels with ``_lines``: their rows' lines in order of ``_at``, null without any;
    a parcel has no more rows than its grid has patches or branches."""
    held = F.sort_array(F.collect_list(F.struct("_at", "_line")))
    got = rows.groupBy(key).agg(F.transform(held, lambda x: x["_line"]).alias("_lines"))
    return parcels.hint("merge").join(got, key, "left")


def production_summary(parcels: DataFrame, patches: DataFrame, key: str = "parcel_id") -> DataFrame:
    """A text a parcel: its patches (patch_id, acres, median_z), the largest first."""
    acres = F.round("acres", 2)
    line = F.concat(F.lit("  - Patch "), F.col("patch_id").cast("string"), F.lit(": "), acres.cast("string"), F.format_string(" acres, representative elevation %.1fm", F.col("median_z").cast("double")))
    got = _lined(parcels.select(key), patches.select(key, F.struct((-acres).alias("a"), "patch_id").alias("_at"), line.alias("_line")), key)
    first = F.format_string("Production-area candidates found: %d", F.size("_lines"))
    text = F.when(F.col("_lines").isNull(), "No production-area candidates identified on this property.").otherwise(F.array_join(F.concat(F.array(first), F.col("_lines")), "\n"))
    return got.select(key, text.alias("summary"))


def water_zone_summary(counts: DataFrame, key: str = "parcel_id") -> DataFrame:
    """A text a parcel of its counts (n_zones, n_valleys, n_patches)."""
    none = F.format_string(
        "%d primary valley(s) and %d production-area candidate(s) found, but no drainage cell falls within the service-distance/boundary-setback thresholds — no "
        "water system candidate zones identified.", "n_valleys", "n_patches")
    some = F.format_string("Water system candidate zones: %d (from %d primary valley(s) and %d production-area candidate(s))", "n_zones", "n_valleys", "n_patches")
    return counts.select(key, F.when(F.col("n_zones") == 0, none).otherwise(some).alias("summary"))


def corridor_summary(networks: DataFrame, branches: DataFrame, key: str = "parcel_id") -> DataFrame:
    """A text a network: its totals, then its branches in order, with what they join and
    cross."""
    joins = F.when(F.col("joins_branch_index").isNotNull(), F.concat(F.lit(", joins branch "), F.col("joins_branch_index").cast("string"))).otherwise("")
    crossing = F.concat(F.when(F.col("crosses_floodplain"), " [crosses floodplain]").otherwise(""), F.when(F.col("crosses_production_zone"), " [crosses production zone]").otherwise(""))
    line = F.concat(
        F.lit("  - Branch "), F.col("branch_index").cast("string"), F.lit(" ("), "branch_role", joins,
        F.format_string("): %.0fm, %.1f%% avg grade, %.2f new acres served", "length_meters", "avg_grade_pct", "newly_served_acres"), crossing)
    totals = networks.select(key, "total_length_meters", "total_served_acres", "unserved_acres", "stop_reason")
    got = _lined(totals, branches.select(key, F.col("branch_index").alias("_at"), line.alias("_line")), key)
    first = F.format_string("Road network: %d branch(es), %.0fm total length, %.2f acres served, %.2f acres unserved (stop_reason=%s).", F.size("_lines"), "total_length_meters", "total_served_acres", "unserved_acres", "stop_reason")
    none = F.concat(F.lit("No road network generated (stop_reason="), "stop_reason", F.lit(")."))
    return got.select(key, F.when(F.col("_lines").isNull(), none).otherwise(F.array_join(F.concat(F.array(first), F.col("_lines")), "\n")).alias("summary"))


def report(sections: dict[str, DataFrame], key: str = "parcel_id") -> DataFrame:
    """All sections of each parcel in the order given, with their headings; a
    parcel without a section is told so by that section's absence text."""
    every, order = None, list(sections)
    for i, (title, rows) in enumerate(sections.items()):
        part = rows.select(key, F.struct(F.lit(i).alias("i"), F.concat(F.lit(f"## {title}\n"), "section").alias("t")).alias("s"))
        every = part if every is None else every.unionByName(part)
    got = every.groupBy(key).agg(F.sort_array(F.collect_list("s")).alias("s"))
    missing = F.array_except(F.array(*[F.lit(i) for i in range(len(order))]), F.transform("s", lambda x: x["i"]))
    absent = F.transform(missing, lambda i: F.concat(F.element_at(F.array(*map(F.lit, order)), i + 1), F.lit(": no data available")))
    return got.select(key, F.concat_ws("\n\n", F.array_join(F.transform("s", lambda x: x["t"]), "\n\n"), F.nullif(F.array_join(absent, "\n"), F.lit(""))).alias("report"), F.size("s").alias("n_sections"))
