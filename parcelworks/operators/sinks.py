"""Layers as exchange features: a struct column ``feature`` a row, ready for
``features.collection``. Geometries come as GeoJSON type and coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import features
from .records import farm_roads, name_or
from .regions import closed

# The notes that each layer carries.
WATER_NOTES = (
    "USGS NHD stream and water body geometry is compiled at roughly 1:24,000 scale (1:100,000 in some areas). Small, seasonal, or "
    "recently changed features may be missing, mislocated, or simplified relative to what's actually on the ground \u2014 treat this as a starting "
    "map for design purposes, not a survey-grade boundary."
)
ROAD_NOTES = (
    "Road geometry is USGS National Map Transportation data \u2014 public road/right-of-way sources, not a survey of this specific property. "
    "Private farm tracks, driveways, or internal access lanes that were never captured in a public transportation dataset will not appear "
    "here; treat an absence of nearby roads as 'no mapped public road,' not necessarily 'no access.'"
)
VALLEY_NOTES = (
    "Valley lines are computed from an interpolated DEM (LiDAR-derived where flown, coarser 1/3 arc-second elsewhere \u2014 see dem_data.py) "
    "using standard D8 flow-direction/accumulation terrain analysis, not surveyed or field-verified. Flow is modeled as single-direction "
    "steepest descent between grid cells, which can't represent braided or split flow, and resolution-scale features (below the DEM's pixel "
    "size) won't appear. Treat this as a first-pass drainage network for design purposes, not a wetlands or hydrology survey. A valley line "
    "may legitimately extend past the drawn property boundary into the DEM's buffered surrounding area (see dem_data.py) \u2014 flow paths don't "
    "stop at a property line, so a branch's head or an inflection point sitting just off-parcel is real upstream/downstream context, not an "
    "error; this is intentionally NOT clipped to the boundary the way production-area and other candidate-zone layers are."
)
PRIME_FOUND = (
    "Prime (or conditionally prime) farmland soil was found in this area per SSURGO \u2014 this candidate may sit on or near land better suited to production "
    "than solar infrastructure. This is a tradeoff to weigh, not an exclusion."
)
PRIME_NONE = "No prime farmland classification found in this area per SSURGO."


STREAM_FENCE_NOTES = (
    "This is a SUGGESTED livestock-exclusion boundary, not a surveyed fence line: it's generated by buffering the mapped USGS NHD stream "
    "centerline by a fixed {meters}m ({feet}ft) distance and outputting the outline of that buffer. It inherits NHD's own scale/currency "
    "limitations (see hydrology_data.py's confidence_notes) -- actual streambank position, channel meander, and small/seasonal drainages not "
    "captured in NHD may not match what's on the ground. Walk this line and adjust before building fence on it."
)
BOUNDARY_FENCE_NOTES = (
    "This fence line encloses the property's DEVELOPED FOOTPRINT (production zones, structure site, and road corridor path), pushed out by a "
    "working margin, unioned with any water/tree exclusion-zone fences at the developed edge, simplified to its convex hull, and clipped to the "
    "drawn property boundary -- so fencing follows the land the farm actually develops rather than the full drawn parcel edge. It deliberately "
    "does NOT route around tree canopy (a fence through wooded ground is fine in practice).{split} It carries no fence type, height, or material "
    "specification (out of scope), and no legal parcel/ownership-boundary or survey data backs it -- confirm the exact line against a real "
    "survey before building on it."
)
BOUNDARY_SPLIT_NOTE = (
    " The drawn property boundary clipped the developed footprint's convex hull into {n} separate fence loops requiring {n} separate physical "
    "fence runs, not one continuous loop."
)
ZONE_FENCE_NOTES = {
    "water": (
        "This fence line fully encloses the selected water system candidate zone's own real, already-computed render footprint, buffered "
        "{meters}m ({feet}ft) outward so the line sits clear of the zone's own edge rather than flush against it. It inherits the water zone's "
        "own siting confidence and limitations already documented at that layer (water_suitability.py/water_candidate_zones.py) -- this fence "
        "line is exactly as reliable as the zone geometry it encloses, no more, no less. It is INDEPENDENT of every other fence type here -- "
        "not spliced or gated into the boundary fence or any other fence loop, and may visually overlap them near the zone's own edge; that "
        "overlap is expected, not a bug."
    ),
    "tree": (
        "This fence line fully encloses one tree zone candidate's own real, already-computed render footprint, buffered {meters}m ({feet}ft) "
        "outward so the line sits clear of the candidate's own edge rather than flush against it. Unlike production/water/road zones, there is "
        "NO selection step for tree zone candidates -- EVERY ranked candidate on this property gets its own separate fence loop here, so a "
        "property with multiple tree zone candidates will show multiple separate tree zone fence loops, not just one. It inherits that "
        "candidate's own siting confidence and limitations already documented at that layer (tree_zone_candidates.py) -- this fence line is "
        "exactly as reliable as the candidate geometry it encloses, no more, no less. It is INDEPENDENT of every other fence type here -- not "
        "spliced or gated into the boundary fence or any other fence loop, and may visually overlap them (including other tree zone candidates' "
        "own fence loops, where two candidates sit close together); that overlap is expected, not a bug."
    ),
}
SEARCH_SPACE_NOTES = (
    "Diagnostic layer only, not a deliverable candidate zone: the full property boundary, first shrunk inward by a 5.0m boundary setback, minus "
    "every current OPTIMIZED (ceiling-trimmed) production-zone candidate, each buffered by a 5.0m clearance, plus the single SELECTED "
    "water-system zone, buffered by a 5.0m clearance, and single SELECTED road corridor's own geometry (see tree_zone_candidates.py's module "
    "docstring, Step 1). Useful for checking the search space independently of the suitability scoring/thresholding built on top of it (Steps 2-3)."
)


def _feet(meters: float) -> float:
    return round(meters / 0.3048, 1)


def stream_fence_layer(fences: DataFrame, meters: float) -> DataFrame:
    """Fences (``fence``: rings in degrees) of streams with source_id and label."""
    label = name_or("Unnamed stream", "label")
    feature = features.make_feature(
        F.concat(F.lit("exclusion-fencing-stream-"), F.col("source_id").cast("string")), "exclusion_fencing", F.concat(F.lit("Stream exclusion fencing ("), label, F.lit(")")), F.lit("medium"),
        F.lit(STREAM_FENCE_NOTES.format(meters=meters, feet=_feet(meters))), F.lit("MultiLineString"), closed(F.col("fence")), source_feature_id=F.col("source_id").cast("string"), exclusion_buffer_meters=F.lit(meters),
    )
    return fences.select("parcel_id", feature.alias("feature"))


def boundary_fence_layer(fences: DataFrame) -> DataFrame:
    """Fence rings (fence_number, ``ring`` in degrees); more than one are numbered."""
    many = F.col("_n") > 1
    before, after = BOUNDARY_FENCE_NOTES.split("{split}")
    split = F.when(many, F.replace(F.lit(BOUNDARY_SPLIT_NOTE), F.lit("{n}"), F.col("_n").cast("string"))).otherwise("")
    number = F.col("fence_number").cast("string")
    feature = features.make_feature(
        F.concat(F.lit("perimeter-fencing-boundary-"), number), "perimeter_fencing", F.when(many, F.concat(F.lit("Boundary fencing "), number)).otherwise("Boundary fencing"), F.lit("high"),
        F.concat(F.lit(before), split, F.lit(after)), F.lit("MultiLineString"), closed(F.array("ring")), fence_type=F.lit("boundary"), segment_index=F.when(many, F.col("fence_number")),
    )
    counted = fences.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("parcel_id")))
    return counted.select("parcel_id", feature.alias("feature"))


def zone_fence_layer(fences: DataFrame, kind: str, meters: float) -> DataFrame:
    """Fences (``fence``: rings in degrees) of the selected water zone, or of all tree
    zones with their ``rank``."""
    tree = kind == "tree"
    place = F.col("rank").cast("string") if tree else F.lit("")
    more = {"candidate_rank": F.col("rank")} if tree else {}
    id_, label = ("perimeter-fencing-tree-zone-", "Tree zone fencing ") if tree else ("perimeter-fencing-water-zone", "Water zone fencing")
    feature = features.make_feature(
        F.concat(F.lit(id_), place), "perimeter_fencing", F.concat(F.lit(label), place), F.lit("high"), F.lit(ZONE_FENCE_NOTES[kind].format(meters=meters, feet=_feet(meters))),
        F.lit("MultiLineString"), closed(F.col("fence")), fence_type=F.lit(f"{kind}_zone_exclusion"), **more, buffer_meters=F.lit(meters),
    )
    return fences.select("parcel_id", feature.alias("feature"))


def search_space_layer(spaces: DataFrame) -> DataFrame:
    """Tree search spaces (``coordinates`` of a MultiPolygon in degrees); a parcel
    without land left has no feature."""
    feature = features.make_feature(
        F.lit("tree-search-space"), "tree_search_space_diagnostic", F.lit("Tree suitability search space (leftover, non-claimed land)"), F.lit("low"), F.lit(SEARCH_SPACE_NOTES), F.lit("MultiPolygon"), F.col("coordinates"))
    return spaces.where(F.size("coordinates") > 0).select("parcel_id", feature.alias("feature"))


def water_layer(raw: DataFrame) -> DataFrame:
    """Hydrology features of layers 6 (streams) and 12 (water bodies)."""
    stream = F.col("layer") == 6
    key = F.concat_ws("-", F.lit("nhd"), F.when(stream, "streams").otherwise("water_bodies"), name_or("None", "permanent_identifier", "objectid"))

    def made(layer: str, label: str):
        return features.make_feature(
            key, layer, name_or(label, "gnis_name"), F.lit("medium"), F.lit(WATER_NOTES), F.col("geometry_type"), F.col("coordinates"),
            gnis_id=F.col("gnis_id"), feature_code=F.col("fcode"), reach_code=F.col("reachcode"),
        )

    both = F.when(stream, made("hydrology-streams", "Unnamed stream")).otherwise(made("hydrology-water_bodies", "Unnamed water body"))
    return raw.where("layer IN (6, 12)").select("parcel_id", both.alias("feature"))


def road_layer(raw: DataFrame) -> DataFrame:
    """Roads, each geometry once, numbered from 0 in order of geometry in a parcel."""
    place = F.row_number().over(Window.partitionBy("parcel_id").orderBy("layer", "geometry")) - 1
    rows = raw.select("parcel_id", "geometry", "coordinates").where("geometry IS NOT NULL").groupBy("parcel_id", "geometry").agg(F.any_value("coordinates").alias("coordinates"))
    named = farm_roads(raw).hint("merge").join(rows, ["parcel_id", "geometry"]).withColumn("_n", place)
    feature = features.make_feature(F.concat(F.lit("farm-road-"), F.col("_n").cast("string")), "farm_road", F.col("name"), F.lit("medium"), F.lit(ROAD_NOTES), F.lit("LineString"), F.col("coordinates"))
    return named.select("parcel_id", feature.alias("feature"))


def valley_layer(branches: DataFrame, px: float, py: float) -> DataFrame:
    """Valleys of rows valley_id, max_acres, branch_id, seq, r, c as line strings."""
    at = F.array((F.col("c") + 0.5) * px, -(F.col("r") + 0.5) * py)
    line = F.transform(F.array_sort(F.collect_list(F.struct("seq", at.alias("p")))), lambda x: x["p"])
    each = branches.groupBy("parcel_id", "valley_id", "max_acres", "branch_id").agg(line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("branch_id", "line"))), lambda x: x["line"])
    whole = each.groupBy("parcel_id", "valley_id", "max_acres").agg(lines.alias("lines"), F.count(F.lit(1)).alias("n"))
    number = F.col("valley_id").cast("string")
    feature = features.make_feature(
        F.concat(F.lit("valley-"), number), "valley", F.concat(F.lit("Valley "), number), F.lit("medium"), F.lit(VALLEY_NOTES), F.lit("MultiLineString"), F.col("lines"),
        max_contributing_area_acres=F.col("max_acres"), branch_count=F.col("n"),
    )
    return whole.select("parcel_id", feature.alias("feature"))


def zone_relationship(touches, distance, adjacency: float):
    """How a footprint lies to production zones: inside if it touches one, adjacent
    within ``adjacency`` metres of an edge, else outside; nulls touch nothing."""
    return F.when(F.coalesce(touches, F.lit(False)), "inside").when(F.coalesce(distance <= adjacency, F.lit(False)), "adjacent").otherwise("outside")


def prime_farmland_flags(candidates: DataFrame, units: DataFrame, prime, key: str = "parcel_id") -> DataFrame:
    """Candidates with ``prime_farmland_conflict`` and a note: whether any map unit of
    the parcel is prime. None is dropped; no unit at all is no conflict."""
    known = units.groupBy(F.col(key).alias("_k")).agg(F.max(F.coalesce(prime, F.lit(False))).alias("_prime"))
    got = candidates.hint("merge").join(known, F.col(key) == F.col("_k"), "left").withColumn("prime_farmland_conflict", F.coalesce("_prime", F.lit(False)))
    note = F.when(F.col("prime_farmland_conflict"), PRIME_FOUND).otherwise(PRIME_NONE)
    return got.withColumn("prime_farmland_note", note).drop("_k", "_prime")


# Fixed texts of the candidate layers.
WATER_ZONE_NOTES = (
    "This identifies a general candidate zone for water-system infrastructure (keyline plowing patterns, pond/dam potential, ram pump routing) — "
    "a connected cluster of DEM cells, each individually on a genuine drainage feature and within plausible service distance of a candidate "
    "production area, outside the boundary setback. Elevation relative to that production area is NOT a generation-time filter here: a candidate "
    "sitting BELOW its nearest production area (which would need a pump to deliver water uphill) is still reported, same as one sitting comfortably "
    "above it (which could gravity-feed) — see properties.production_area_relationships for the real elevation differential/gradient this "
    "candidate was measured against, and water_suitability.py for how that's turned into a real, weighted preference score rather than a pass/fail "
    "gate. This is NOT a specific pond or dam site: actual siting requires separate, more detailed analysis (storage volume, dam wall geometry, "
    "spillway design) not covered here. It also inherits the limitations of the layers it's built on — DEM-derived flow accumulation and a "
    "slope-only production-area heuristic — so treat this as a starting area to walk and ground-truth, not a final answer."
)
CORRIDOR_NOTES = (
    "This is a TOPOGRAPHIC SUGGESTION only, not a surveyed road alignment — generated by growing a road network outward from the given real "
    "anchor point (road_network_router.route_road_network(), see road_corridors.py and road_network_router.py), one branch at a time, over a "
    "least-cost terrain surface (road_cost_path.build_cost_raster()) -- not a civil engineering design. The parcel boundary and a buffered "
    "pond/water-system zone are HARD exclusions no branch can ever cross; grade above 35.0% is now HARD-excluded too, not just penalized. "
    "Production land is a SOFT, proportionally-costlier traversal term a branch may still cross when the alternative costs more (see "
    "properties.crosses_production_zone) -- it's also what this network exists to SERVE, not merely avoid. Floodplain/hydric ground is a SOFT flat "
    "cost penalty for the same reason (see properties.crosses_floodplain). "
)
FLOOD_CROSSING = (
    "This specific branch DOES cross floodplain/hydric ground — that's intentional/expected under this model, not a caveat to apologize for; "
    "routing found crossing it was still cheaper overall than detouring around it. "
)
PRODUCTION_CROSSING = (
    "This specific branch DOES cross a production zone — that's intentional/expected under this model, not a caveat to apologize for; "
    "production crossing is a soft, proportionally-costlier traversal term, not a hard exclusion, so a branch can still cross production land when "
    "the alternative route costs more. "
)
STEEP_BRANCH = (
    "This branch's average grade (", "%) is steep enough for an unpaved farm road that real engineering consideration — surface material, "
    "drainage/culverts, water bars — is needed before construction, not just routine grading: erosion, traction, and washout risk all increase "
    "meaningfully above 10%, especially under heavy rainfall or freeze-thaw conditions. "
)
FLOOD_FALLBACK = (
    "Floodplain/wet-ground cost scoring used a DEM-only fallback (buffered delineated valley lines), not real NHD/SSURGO data, because that data "
    "wasn't available for this run. "
)
CORRIDOR_END = "Treat this as a starting point for a site visit and real survey, not a construction-ready alignment."


def water_zone_layer(zones: DataFrame, served: DataFrame) -> DataFrame:
    """Water zones (``coordinates`` of their ground in degrees, ``fill`` likewise) with
    their relationships, the most favourable first. At most as many as a parcel has
    patches are listed in a feature. Zones that serve nothing have no feature."""
    fields = ("production_area_id", "elevation_differential_m", "distance_m", "gradient_pct", "above_production_area")
    each = F.sort_array(F.collect_list(F.struct("place", F.struct(*fields).alias("of"))))
    every = served.groupBy("parcel_id", "zone_id").agg(F.transform(each, lambda x: x["of"]).alias("_all"))
    number = F.col("zone_id").cast("string")
    feature = features.make_feature(
        F.concat(F.lit("water-system-candidate-"), number), "water_system_candidate", F.concat(F.lit("Water system candidate zone "), number), F.lit("low"), F.lit(WATER_ZONE_NOTES),
        F.lit("MultiPolygon"), F.col("coordinates"), served_production_area_ids=F.sort_array(F.transform("_all", lambda x: x["production_area_id"])), production_area_relationships=F.col("_all"),
        primary_production_area_relationship=F.col("_all")[0], contributing_area_cells=F.round("contributing_area_cells", 2), slope_pct=F.round("slope_pct", 2),
        render_fill_geometry_wgs84=F.struct(F.lit("MultiPolygon").alias("type"), F.col("fill").alias("coordinates")),
    )
    return zones.hint("merge").join(every, ["parcel_id", "zone_id"]).select("parcel_id", feature.alias("feature"))


def corridor_layer(branches: DataFrame) -> DataFrame:
    """Branches of ``corridors`` (``line`` in degrees, ``is_fallback``: wet ground was
    guessed from valleys) as lines, each with the notes that fit it."""
    steep = F.when(F.col("avg_grade_pct") > 10, F.concat(F.lit(STEEP_BRANCH[0]), F.format_string("%.1f", F.round("avg_grade_pct", 1)), F.lit(STEEP_BRANCH[1]))).otherwise("")
    notes = F.concat(
        F.lit(CORRIDOR_NOTES), F.when(F.col("crosses_floodplain"), FLOOD_CROSSING).otherwise(""), F.when(F.col("crosses_production_zone"), PRODUCTION_CROSSING).otherwise(""),
        steep, F.when(F.coalesce("is_fallback", F.lit(False)), FLOOD_FALLBACK).otherwise(""), F.lit(CORRIDOR_END),
    )
    feet = {n: F.round(F.col(m) / 0.3048, 1) for n, m in (("length_ft", "length_meters"), ("steep_ft", "steep_meters"), ("total_length_ft", "total_length_meters"))}
    feature = features.make_feature(
        F.concat(F.lit("road-corridor-"), (F.col("branch_index") + 1).cast("string")), "suggested_road_corridor", F.lit("Suggested road corridor"), F.lit("low"), notes, F.lit("LineString"), F.col("line"),
        branch_index=F.col("branch_index"), branch_role=F.col("branch_role"), joins_branch_index=F.col("joins_branch_index"), **feet,
        avg_grade_pct=F.round("avg_grade_pct", 1), max_grade_pct=F.round("max_grade_pct", 1), newly_served_acres=F.round("newly_served_acres", 3), crosses_floodplain=F.col("crosses_floodplain"),
        crosses_production_zone=F.col("crosses_production_zone"), total_served_acres=F.round("total_served_acres", 3), stop_reason=F.col("stop_reason"),
        constraints_satisfied=F.array(F.lit("outside_pond_zone"), F.lit("grade_within_max")),
    )
    return branches.select("parcel_id", feature.alias("feature"))


PRODUCTION_NOTES = (
    "This is a slope + hydric-soil + woody-vegetation + existing-road heuristic (contiguous ground at or below 20.0% grade, with hydric/wetland soil "
    "excluded cell-by-cell before clustering -- see soil_data.hydric_disqualifying_mukeys() -- tree-root-zone cells excluded cell-by-cell via USGS "
    "3DEP lidar height-above-ground, see canopy_height_data.py -- and existing mapped road right-of-way excluded cell-by-cell, see "
    "farm_roads_data.get_road_exclusion_union_utm()), not a validated production-area determination. Cells within 3.0m of the real parcel boundary "
    "are also excluded (a fixed inward setback, not derived from any of the above). Unlike the soil and road checks, the woody-vegetation check is "
    "mandatory: identify_production_areas() refuses to return any candidate at all if USGS 3DEP lidar HAG coverage couldn't be fetched or was too "
    "sparse to trust, rather than returning geometry that was never actually checked for tree cover -- see canopy_height_data.py. Road exclusion "
    "degrades gracefully like the soil check: if USGS National Map road data couldn't be fetched, this candidate's geometry may still include ground "
    "within existing road right-of-way that wasn't caught -- see farm_roads_data.py, which is itself a known-incomplete (public-ROW-only) signal even "
    "when the fetch succeeds. It doesn't account for soil quality beyond the hard hydric exclusion, drainage, existing land use, or the property "
    "owner's actual crop/grazing plans — see soil_data.py and the Land Shape section of the full Scale of Permanence report for those factors."
)


def production_layer(patches: DataFrame) -> DataFrame:
    """Production patches (patch_id, acres, fill_acres, median_z, ``coordinates`` of
    their ground in degrees) that have ground."""
    number = F.col("patch_id").cast("string")
    feature = features.make_feature(
        F.concat(F.lit("production-area-"), number), "production_area_candidate", F.concat(F.lit("Production area candidate "), number), F.lit("low"), F.lit(PRODUCTION_NOTES), F.lit("MultiPolygon"), F.col("coordinates"),
        area_acres=F.round("acres", 2), representative_elevation_m=F.round("median_z", 1), render_fill_area_acres=F.round(F.coalesce("fill_acres", F.lit(0.0)), 2),
    )
    return patches.where(F.size("coordinates") > 0).select("parcel_id", feature.alias("feature"))
