"""Bronze tables: readers of what remote services send, with retries.

Ingestion is apart from planning: a Python data source fetches pages and keeps the
bodies, so that everything after reads Parquet. The fetch function is an option,
so tests need no network.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def retry(fetch: Callable[[float], str], attempts: int = 3, first: float = 30.0, pause: float = 2.0) -> str:
    """``fetch`` with a growing time limit; the last failure is raised."""
    for n in range(attempts):
        try:
            return fetch(first * (n + 1))
        except Exception:
            if n == attempts - 1:
                raise
            time.sleep(pause)
    raise AssertionError("attempts must be at least 1")


class RemoteBodies(DataSource):
    """(request, body) of requests; option ``fetch`` is ``module:function`` that
    takes a request and a time limit, ``requests`` are separated by new lines."""

    @classmethod
    def name(cls) -> str:
        return "remote_bodies"

    def schema(self) -> str:
        return "request string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in self.options.get("requests", "").split("\n") if x]

    def read(self, partition) -> Iterator[tuple[str, str]]:
        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        pause = float(self.options.get("pause", 2))
        yield partition.value, retry(lambda limit: fetch(partition.value, limit), pause=pause)


def bodies(spark: SparkSession, requests: list[str], fetch: str, **options) -> DataFrame:
    spark.dataSource.register(RemoteBodies)
    reader = spark.read.format("remote_bodies").option("requests", "\n".join(requests)).option("fetch", fetch)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def checked(rows: DataFrame) -> DataFrame:
    """Bodies without an error answer; one raises when it is read."""
    message = F.get_json_object("body", "$.error")
    return rows.withColumn("body", F.when(message.isNotNull(), F.raise_error(F.concat(F.lit("service error: "), message)).cast("string")).otherwise(F.col("body")))


def table_answer(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``{"Table": [[header], [row], ...]}`` answers; none without Table."""
    parsed = F.from_json("body", "Table array<array<string>>")["Table"]
    got = rows.select("request", parsed.alias("t")).where("t IS NOT NULL")
    each = got.select("request", F.element_at("t", 1).alias("h"), F.explode(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0)))).alias("r"))
    picked = [F.try_element_at("r", F.nullif(F.array_position("h", F.lit(c)), F.lit(0)).cast("int")).alias(c) for c in columns]
    return each.where(F.size("h") > 0).select("request", *picked)


def feature_rows(rows: DataFrame, fields: list[str]) -> DataFrame:
    """A row a feature of answers with ``features``: its fields and geometry."""
    parsed = F.from_json("body", "features array<struct<attributes:map<string,string>,geometry:string>>")["features"]
    each = rows.select("request", F.explode(parsed).alias("f"))
    return each.select("request", *[F.col("f.attributes")[c].alias(c) for c in fields], F.col("f.geometry").alias("geometry"))


def tolerant_union(parts: list[DataFrame], failed: list[bool]) -> DataFrame:
    """The parts that didn't fail; all failing is an error."""
    if all(failed):
        raise RuntimeError("every layer failed")
    every = None
    for part, bad in zip(parts, failed, strict=True):
        if not bad:
            every = part if every is None else every.unionByName(part)
    return every


def height_cells(rows: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """Raster values as heights: nodata and depths below 1,000 m become null."""
    z = F.col("z")
    return rows.withColumn("z", F.when((F.abs(z - nodata) <= 1e-8 + 1e-5 * abs(nodata)) | (z <= -1000) | F.isnan(z), F.lit(None)).otherwise(z))
