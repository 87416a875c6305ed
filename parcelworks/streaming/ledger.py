"""A ledger of what has arrived for each parcel, and the parcels that it releases.

Each arrival names a parcel, a source and when it came; a payload of null says that the
source had nothing, which doesn't do for a required one. The latest arrival of a source
counts. A parcel is released when every required source is there; until then it stands
in the ledger with the names of what is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed names: the layers that a site plan needs, and the one that it can do without.
REQUIRED = (
    "dem", "soil_components", "farmland_classification", "erosion_factor", "saturated_hydraulic_conductivity", "soil_geometries", "water_features",
    "farm_roads", "climate_summary", "elevation_grid", "canopy_height", "imagery_summary",
)
OPTIONAL = ("irradiance",)


def record(arrivals: DataFrame, path: str, checkpoint: str) -> None:
    """Append what is new in the stream ``arrivals`` (parcel_id, source, arrived_at,
    payload) to the ledger's table. A batch writes a folder of its own name: one that
    is run again after a failure overwrites what it left."""
    def keep(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    arrivals.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def latest(arrivals: DataFrame) -> DataFrame:
    """One row a parcel and source: the arrival of the latest time, of equal ones the
    larger payload. Old copies combine before the shuffle."""
    at = F.struct(F.col("arrived_at"), F.col("payload").isNotNull(), F.col("payload"))
    return arrivals.groupBy("parcel_id", "source").agg(F.max(at).alias("m")).select("parcel_id", "source", F.col("m.arrived_at").alias("arrived_at"), F.col("m.payload").alias("payload"))


def status(parcels: DataFrame, arrivals: DataFrame, required: tuple[str, ...] = REQUIRED, optional: tuple[str, ...] = OPTIONAL) -> DataFrame:
    """parcel_id, released, missing (required sources, in name order), without (optional
    ones), last_arrival; a row for every parcel, heard of or not."""
    names = [*required, *optional]
    now = latest(arrivals.where(F.col("source").isin(*names)))
    held = now.groupBy("parcel_id").agg(F.collect_set(F.when(F.col("payload").isNotNull(), F.col("source"))).alias("_held"), F.max("arrived_at").alias("last_arrival"))  # a name a source at most
    got = parcels.select("parcel_id").distinct().join(held, "parcel_id", "left").withColumn("_held", F.coalesce("_held", F.array().cast("array<string>")))

    def lacking(of: tuple[str, ...]):
        return F.array_sort(F.array_except(F.array(*map(F.lit, of)).cast("array<string>"), F.col("_held")))

    got = got.withColumn("missing", lacking(required)).withColumn("without", lacking(optional))
    return got.select("parcel_id", (F.size("missing") == 0).alias("released"), "missing", "without", "last_arrival")


def released(parcels: DataFrame, arrivals: DataFrame, **names) -> DataFrame:
    """parcel_id, source, payload of the parcels that are complete."""
    ready = status(parcels, arrivals, **names).where("released").select("parcel_id")
    return latest(arrivals).join(ready, "parcel_id", "left_semi").select("parcel_id", "source", "payload")
