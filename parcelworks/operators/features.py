"""Exchange features: build, check, write; and plain-text summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the exchange contract.
CONFIDENCES = ("high", "medium", "low")
GEOMETRIES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")


def make_feature(id_: Column, layer: str, label: Column, confidence: Column, notes: Column, geometry_type: Column, coordinates: Column, **extra: Column) -> Column:
    """A GeoJSON feature struct; breaking the contract raises when it is read."""
    broken = (
        F.when(~F.coalesce(confidence.isin(*CONFIDENCES), F.lit(False)), "confidence")
        .when(F.coalesce(F.trim(notes), F.lit("")) == "", "confidence_notes")
        .when(~F.coalesce(geometry_type.isin(*GEOMETRIES), F.lit(False)), "geometry")
        .when(coordinates.isNull(), "coordinates")
    )
    sure = F.when(broken.isNotNull(), F.raise_error(F.concat(F.lit("invalid feature: "), broken)).cast("string")).otherwise(confidence)
    properties = [F.lit(layer).alias("layer"), label.alias("label"), sure.alias("confidence"), notes.alias("confidence_notes")]
    return F.struct(
        F.lit("Feature").alias("type"), id_.cast("string").alias("id"),
        F.struct(geometry_type.alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        F.struct(*properties, *[v.alias(k) for k, v in extra.items()]).alias("properties"),
    )


def collection(rows: DataFrame, feature: str = "feature", key: str = "parcel_id") -> DataFrame:
    """One FeatureCollection a parcel as JSON."""
    body = F.struct(F.lit("FeatureCollection").alias("type"), F.sort_array(F.collect_list(F.struct(F.col(f"{feature}.id").alias("id"), F.col(feature).alias("f")))).alias("l"))
    got = rows.groupBy(key).agg(body.alias("b"))
    return got.select(key, F.to_json(F.struct(F.col("b.type").alias("type"), F.transform("b.l", lambda x: x["f"]).alias("features"))).alias("geojson"))


def problems(rows: DataFrame) -> DataFrame:
    """Rows (id, geometry_type, layer, confidence, confidence_notes) that break the
    contract, each with its first problem; nothing if all is well."""
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    found = (
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "id is empty")
        .when(n > 1, "id is not unique")
        .when(~F.coalesce(F.col("geometry_type").isin(*GEOMETRIES), F.lit(False)), "geometry type")
        .when(F.coalesce(F.trim("layer"), F.lit("")) == "", "layer is empty")
        .when(~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False)), "confidence")
        .when(F.coalesce(F.trim("confidence_notes"), F.lit("")) == "", "confidence_notes is empty")
    )
    return rows.withColumn("problem", found).where("problem IS NOT NULL")


def counted_summary(rows: DataFrame, group: str, what: str, key: str = "parcel_id") -> DataFrame:
    """A sentence a parcel: how many of each group, in order."""
    n = rows.groupBy(key, group).count()
    part = F.format_string("%s: %d", F.col(group).cast("string"), F.col("count"))
    listed = n.groupBy(key).agg(F.sum("count").alias("n"), F.sort_array(F.collect_list(part)).alias("parts"))
    return listed.select(key, F.concat(F.col("n").cast("string"), F.lit(f" {what} ("), F.array_join("parts", "; "), F.lit(")")).alias("summary"))
