"""Scalar functions of the site plan as columns: predicates, factors, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
COMPASS_16 = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
COMPASS_8 = ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")
PRIME_PREFIXES = ("All areas are prime farmland", "Prime farmland if")
HYDRIC_RATINGS = ("yes", "partially hydric")
HYDRIC_REASON = "hydric/wetland soil (SSURGO hydricrating)"
STREAM_CODES = {46006: "perennial", 46003: "intermittent", 46007: "ephemeral"}
STREAM_WEIGHTS = {"perennial": 1.0, "intermittent": 0.55, "ephemeral": 0.25, "unknown": 0.4}
SQUARE_METERS_PER_ACRE = 4046.8564224
METERS_PER_FOOT = 0.3048
METERS_PER_DEGREE = 111_320.0


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def number(x: Column) -> Column:
    """A double of whatever the source sent, null where it is none."""
    return x.try_cast("double")


# --- soil -------------------------------------------------------------------

def is_prime_farmland(classification: Column) -> Column:
    starts = F.lit(False)
    for prefix in PRIME_PREFIXES:
        starts = starts | classification.startswith(prefix)
    return F.coalesce(starts, F.lit(False))


def is_hydric(rating: Column) -> Column:
    return F.coalesce(F.lower(F.trim(rating)).isin(*HYDRIC_RATINGS), F.lit(False))


def disqualifying_reason(rating: Column) -> Column:
    return F.when(is_hydric(rating), F.lit(HYDRIC_REASON))


def is_erosion_prone(kwfact: Column, threshold: float = 0.32) -> Column:
    return F.coalesce(number(kwfact) >= threshold, F.lit(False))


def component_confidence(comppct: Column) -> Column:
    pct = number(comppct)
    return F.when(pct >= 50, "high").when(pct >= 20, "medium").otherwise("low")


# --- directions -------------------------------------------------------------

def compass_label(degrees: Column) -> Column:
    """The nearest of 16 points; halves go to the even one."""
    index = F.pmod(F.rint(F.pmod(degrees, F.lit(360.0)) / 22.5), F.lit(16.0)).cast("int")
    return F.element_at(F.array(*map(F.lit, COMPASS_16)), index + 1)


def compass_word(degrees: Column) -> Column:
    index = F.pmod(F.rint(F.pmod(degrees, F.lit(360.0)) / 45.0), F.lit(8.0)).cast("int")
    return F.when(degrees.isNotNull(), F.element_at(F.array(*map(F.lit, COMPASS_8)), index + 1))


def circular_mean(degrees: Column, weight: Column | None = None) -> Column:
    """Aggregate: the weighted mean direction, null without rows."""
    w = F.lit(1.0) if weight is None else weight
    angle = F.radians(degrees)
    mean = F.pmod(F.degrees(F.atan2(F.sum(F.sin(angle) * w), F.sum(F.cos(angle) * w))), F.lit(360.0))
    return F.when(F.count(degrees) > 0, mean)


def angular_difference(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def aspect_score(aspect: Column) -> Column:
    """1 for due south and flat ground (null), 0 for due north."""
    return F.coalesce((1.0 + F.cos(F.radians(aspect - 180.0))) / 2.0, F.lit(1.0))


# --- production -------------------------------------------------------------

def slope_factor(slope_pct: Column, most: float = 20.0) -> Column:
    return clamp(1.0 - slope_pct / most)


def per_cell_score(slope_pct: Column, aspect: Column, most: float = 20.0, slope_weight: float = 0.55, aspect_weight: float = 0.15) -> Column:
    total = slope_weight + aspect_weight
    return slope_weight / total * slope_factor(slope_pct, most) + aspect_weight / total * aspect_score(aspect)


# --- water ------------------------------------------------------------------

def scaled_gravity(value: Column, full: float, deficit: float, level: float = 0.6, least: float = 0.2) -> Column:
    """1 from ``full`` on, ``level`` at 0, ``least`` down from ``deficit``."""
    return (
        F.when(value >= full, 1.0)
        .when(value >= 0, level + value / full * (1.0 - level))
        .when(value <= deficit, least)
        .otherwise(level - value / deficit * (level - least))
    )


def gravity_feed(elevation_differential: Column, distance: Column, gradient_pct: Column) -> Column:
    return F.when(distance == 0, scaled_gravity(elevation_differential, 3.0, -3.0)).otherwise(scaled_gravity(gradient_pct, 1.0, -5.0))


def water_holding(ksat: Column, good: float = 0.1, poor: float = 100.0, unknown: float = 0.5) -> Column:
    """Logarithmic from 1 at ``good`` to 0 at ``poor`` (micrometres a second)."""
    share = (F.log10(F.greatest(ksat, F.lit(1e-6))) - F.log10(F.lit(good))) / (F.log10(F.lit(poor)) - F.log10(F.lit(good)))
    return F.coalesce(F.when(ksat.isNotNull(), clamp(1.0 - share)), F.lit(unknown))


def stream_label(fcode: Column) -> Column:
    code = fcode.try_cast("int")
    label = None
    for value, name in STREAM_CODES.items():
        label = F.when(code == value, name) if label is None else label.when(code == value, name)
    return label.otherwise("unknown")


def stream_permanence(fcode: Column, distance: Column, reference: float = 300.0, neutral: float = 0.5) -> Column:
    weight = None
    for name, value in STREAM_WEIGHTS.items():
        hit = stream_label(fcode) == name
        weight = F.when(hit, value) if weight is None else weight.when(hit, value)
    near = F.greatest(F.lit(0.0), 1.0 - distance / reference)
    return F.when(distance.isNull() | (near <= 0), neutral).otherwise(neutral + (1.0 - neutral) * weight * near)


def gradient_steepness(gradient: Column) -> Column:
    """A trapezoid: 0 outside 0.5 to 30 percent, 1 from 3 to 15."""
    return (
        F.when(gradient.isNull(), 0.5)
        .when((gradient < 0.5) | (gradient > 30.0), 0.0)
        .when(gradient.between(3.0, 15.0), 1.0)
        .when(gradient < 3.0, (gradient - 0.5) / 2.5)
        .otherwise((30.0 - gradient) / 15.0)
    )


def contributing_area(acres: Column, reference: float = 10.0) -> Column:
    return F.coalesce(F.when(acres.isNotNull(), clamp(acres / reference)), F.lit(0.5))


def topographic(gradient: Column, acres: Column) -> Column:
    return 0.5 * gradient_steepness(gradient) + 0.5 * contributing_area(acres)


def signal_confidence(soil_available: Column, stream_available: Column, coverage: Column) -> Column:
    n = (soil_available & (coverage >= 0.3)).cast("int") + stream_available.cast("int")
    return F.when(n == 2, "high").when(n == 1, "medium").otherwise("low")


# --- trees and solar ----------------------------------------------------------

def tree_slope_factor(slope_pct: Column, reference: float = 50.0) -> Column:
    return F.when(F.lit(reference) <= 0, 0.0).otherwise(clamp(slope_pct / reference))


def tree_stream_factor(distance: Column, reference: float = 100.0) -> Column:
    return F.coalesce(F.when(distance.isNotNull(), clamp(1.0 - distance / reference)), F.lit(0.0))


def solar_slope_score(slope_pct: Column, most: float = 20.0) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - slope_pct / most)


def production_proximity(distance: Column, reference: float = 100.0) -> Column:
    return F.coalesce(F.when(distance.isNotNull(), F.greatest(F.lit(0.0), 1.0 - distance / reference)), F.lit(0.5))


def footprint_side(acres: Column) -> Column:
    return F.sqrt(acres * SQUARE_METERS_PER_ACRE)


# --- imagery, units, places ---------------------------------------------------

def ndvi(red: Column, nir: Column) -> Column:
    return F.when((red > 0) & (nir > 0), (nir - red) / (nir + red))


def celsius_to_fahrenheit(celsius: Column) -> Column:
    return F.round(celsius * 9 / 5 + 32, 1)


def feet(meters: Column) -> Column:
    return F.round(meters / METERS_PER_FOOT, 1)


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + F.floor((lon + 180.0) / 6.0).cast("int") + 1


def auto_zoom(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.least(F.ceil(F.log2(720.0 / (east - west))), F.ceil(F.log2(720.0 / (north - south)))).cast("int")


def position_in_parcel(dx: Column, dy: Column, parcel_area: Column, inner: float = 0.2) -> Column:
    """``center``, or the bearing of an offset from the parcel's centre."""
    radius = F.sqrt(parcel_area / F.lit(3.141592653589793))
    bearing = F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))
    return F.when(F.sqrt(dx * dx + dy * dy) <= inner * radius, "center").otherwise(compass_word(bearing))


def bounding_box(points: Column, buffer_meters: float = 0.0) -> Column:
    """Of an array of (lon, lat) structs: west, south, east, north, widened."""
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    middle = (F.array_min(lat) + F.array_max(lat)) / 2
    dlat = F.lit(buffer_meters / METERS_PER_DEGREE)
    dlon = buffer_meters / (METERS_PER_DEGREE * F.cos(F.radians(middle)))
    return F.struct(
        (F.array_min(lon) - dlon).alias("west"), (F.array_min(lat) - dlat).alias("south"),
        (F.array_max(lon) + dlon).alias("east"), (F.array_max(lat) + dlat).alias("north"),
    )


def closed_ring(points: Column) -> Column:
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    return F.when(first == last, points).otherwise(F.array_append(points, first))


def wkt_polygon(points: Column) -> Column:
    text = F.transform(closed_ring(points), lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))
    return F.concat(F.lit("polygon(("), F.array_join(text, ", "), F.lit("))"))


def chaikin(points: Column, rounds: int = 1) -> Column:
    """Corner cutting of an open line of (x, y) structs; the ends stay."""
    for _ in range(rounds):
        n = F.size(points)
        pairs = F.arrays_zip(F.slice(points, 1, n - 1).alias("a"), F.slice(points, 2, n - 1).alias("b"))

        def mix(p, w: float):
            return F.struct(((1 - w) * p["a"]["x"] + w * p["b"]["x"]).alias("x"), ((1 - w) * p["a"]["y"] + w * p["b"]["y"]).alias("y"))

        cut = F.flatten(F.transform(pairs, lambda p: F.array(mix(p, 0.25), mix(p, 0.75))))
        inner = F.concat(F.array(F.element_at(points, 1)), cut, F.array(F.element_at(points, -1)))
        points = F.when(n < 3, points).otherwise(inner)
    return points
