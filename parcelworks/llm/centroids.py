"""Centroid clustering by sort-means.

Components become integers, so every distance is exact and reruns agree bit for
bit. Each round orders, for each centroid, the others by their distance from it. A
vector starts at the centroid it was assigned to and scans the others in that
order; by the triangle inequality none that lies strictly beyond twice the
vector's distance to its own centroid can be nearer, and there the scan stops.

A round is one pass over a written table of vectors and labels, and one
aggregation of component sums with map-side partial sums: one row a centroid comes
back to the driver, whatever the corpus. A lost executor costs a re-read.

Defined results: rows whose vector is null, of another length, or holds null or
non-finite components take no part; repeated rows are separate vectors; a null id
is assigned like any other and is the last to seed; equal ids seed in the order of
their components; fewer rows than ``k`` are all seeds; ties go to the smaller number;
an empty table gives an empty one; extra columns are ignored. Components of 2**27 or
more after scaling raise a ValueError: distances would not fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, read

SCALE, DIM, K, ROUNDS, SEED = 256, 64, 40, 5, "2"
#: Centroids of a scan step whose distances are taken at once.
STEP = 8


def finite(vector) -> F.Column:
    """No component is null, NaN or infinite (null for a null vector)."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(vector, scale: int) -> F.Column:
    return F.transform(vector, lambda x: F.floor(x * scale).cast("long"))


def largest(table: DataFrame) -> int:
    """Size of the largest component of the column ``v``; 0 without rows."""
    got = table.agg(F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    return max((abs(x) for x in got if x is not None), default=0)


def exact_type(bound: int, dim: int) -> type:
    """Numbers in which sums of ``dim`` squared differences of components up to
    ``bound`` are exact."""
    most = 4 * max(dim, 1) * bound * bound
    if bound >= 1 << 27 or most >= 1 << 62:
        raise ValueError("components are too large: distances would not fit a long")
    return np.float64 if most < 1 << 50 else np.int64


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between rows of ``a`` and ``b``, exactly."""
    return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)


def sort_means(points: np.ndarray, centres: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each point, its squared distance, and the number of
    distances that were taken. ``last``: where each point's scan starts."""
    gap = squared(centres, centres)
    np.fill_diagonal(gap, -1)
    order = np.argsort(gap, axis=1, kind="stable")
    label, best, taken = last.astype(np.int64), np.zeros(len(points), np.int64), len(points)
    for c in np.unique(last):
        rows = np.flatnonzero(last == c)
        own = squared(points[rows], centres[c : c + 1])[:, 0]
        best[rows] = own
        # Twice the distance, squared; equality is still scanned.
        stop = np.searchsorted(gap[c, order[c]], 4 * own, side="right")
        turn = np.argsort(-stop, kind="stable")
        rows, stop = rows[turn], stop[turn]
        for at in range(1, int(stop.max(initial=1)), STEP):
            rows = rows[: np.searchsorted(-stop, -at)]
            stop = stop[: len(rows)]
            scanned = order[c, at : at + STEP]
            by_number = np.argsort(scanned)
            place, scanned = (at + np.arange(len(scanned)))[by_number], scanned[by_number]
            far = squared(points[rows], centres[scanned])
            open_ = place < stop[:, None]
            taken += int(open_.sum())
            far[~open_] = np.iinfo(np.int64).max
            k = far.argmin(1)  # the first of equals has the smaller number
            d, n = far[np.arange(len(rows)), k], scanned[k]
            better = (d < best[rows]) | (d == best[rows]) & (n < label[rows])
            label[rows[better]], best[rows[better]] = n[better], d[better]
    return label, best, taken


def assign(table: DataFrame, centres: np.ndarray, kind: type) -> DataFrame:
    """vec_id, v, cluster, distance; ``table``: vec_id, v, cluster."""
    centres = centres.astype(kind)

    def run(batches):
        for b in batches:
            v = b.column("v")
            points = v.flatten().to_numpy().reshape(len(v), -1).astype(kind)
            label, best, _ = sort_means(points, centres, b.column("cluster").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), v, pa.array(label.astype(np.int32)), pa.array(best)], names=["vec_id", "v", "cluster", "distance"]
            )

    return table.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id long, v array<int>, cluster int, distance long")


def means(table: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """The floor of each cluster's mean; empty clusters keep their centroid."""
    sums = table.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(len(centres[0]))])
    out = list(centres)
    for r in sums.collect():  # one row a centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(len(centres[0]))]
    return out


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of long).
    ``vectors``: vec_id, embedding."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.size("e") == dim).where(finite(F.col("e")))
    whole = rows.select("vec_id", integers(F.col("e"), scale).alias("v"))
    kind = exact_type(largest(whole), dim)
    table = materialise(whole.select("vec_id", F.col("v").cast("array<int>").alias("v"), F.lit(0).alias("cluster")), "vectors")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = table.orderBy(F.asc_nulls_last(place), "v").select("v").limit(k).collect()  # k rows
    centres = [list(r["v"]) for r in first]
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<bigint>"
    if not centres:
        return spark.createDataFrame([], schema)
    for turn in range(rounds + 1):
        after = materialise(assign(table, np.array(centres), kind), "clusters")
        discard(table)
        table = after
        if turn < rounds:
            centres = means(table, centres)
    per = {r["cluster"]: r["d"] for r in table.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(per.values())
    facts = spark.createDataFrame([(c, d, total, centres[c]) for c, d in sorted(per.items())], "cluster int, cluster_inertia long, inertia long, centroid array<bigint>")
    return table.join(F.broadcast(facts), "cluster").select(*[x.split(" ")[0] for x in schema.split(", ")])  # k rows at most


def digest(numbers) -> str:
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    got = cluster(read(spark, sf_dir, "embeddings"))
    sha = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", sha.alias("centroid_sha256"))


def _sql(k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, seed: str = SEED) -> str:
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {dim} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        "parts AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept)",
        f"""seeds AS (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS c FROM kept)""",
        f"c0 AS MATERIALIZED (SELECT c, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM seeds WHERE c < {k})",
    ]
    for t in range(rounds + 1):
        steps.append(f"d{t} AS (SELECT r, c, sum((x - y) * (x - y)) AS d FROM parts JOIN c{t} USING (i) GROUP BY r, c)")
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, CAST(min(d) AS BIGINT) AS d, arg_min(c, d * {k} + c) AS c FROM d{t} GROUP BY r)")
        if t < rounds:
            # floor of an exact quotient: integer division rounds towards zero
            mean = "CAST(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS BIGINT)"
            steps.append(f"m{t} AS (SELECT c, i, {mean} AS y FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM parts JOIN a{t} USING (r) GROUP BY c, i))")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c, i, coalesce(m{t}.y, c{t}.y) AS y FROM c{t} LEFT JOIN m{t} USING (c, i))")
    last = rounds
    steps.append(f"shas AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS sha FROM c{last} GROUP BY c)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a{last} JOIN kept USING (r) JOIN shas USING (c)"""


SQL = _sql()
