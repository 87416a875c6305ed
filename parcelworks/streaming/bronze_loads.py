"""Incremental loads of bronze tables: what is new since the last run, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def load_new(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, clean: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Append the new files of ``source``, cleaned, to ``target``; each file counts
    once, since the checkpoint records which were read."""
    rows = clean(spark.readStream.schema(schema).parquet(source))
    done = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done.awaitTermination()


def daily_climate(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Daily sums and extremes of a stream of readings (parcel_id, ts, value), each
    day final once readings are ``late`` past it."""
    from pyspark.sql import functions as F

    day = F.window("ts", "1 day")
    got = events.withWatermark("ts", late).groupBy("parcel_id", day).agg(F.sum("value").alias("total"), F.max("value").alias("most"), F.count(F.lit(1)).alias("n"))
    return got.select("parcel_id", F.col("window.start").alias("day"), "total", "most", "n")
