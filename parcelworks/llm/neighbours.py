"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector less the corpus mean, as a unit vector, is rotated by a random
orthogonal matrix; its code is the packed signs of the components. With the code
go two scalars: the length of the residual and the inner product of the unit
vector with its code. An inner product with a query is estimated from the bits
and the scalars, with an error bound of ``EPSILON`` standard deviations. The best
estimates are ranked exactly first; then every vector whose upper bound reaches
the worst exact score kept so far is ranked exactly too.

Queries and vectors meet in blocks of bounded size; each block pair returns its
best ``k`` per query, and a last step ranks those. Every vector is encoded.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part; neither do null ids; a query never finds rows of its own
id; equal scores go to the smaller id; repeated rows count once, as queries and as
neighbours; equal vectors of different ids are neighbours of their own; vectors of
different lengths aren't compared; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, read

K, EPSILON = 20, 3.0
#: Rows of a block of vectors at most, and of a block of queries.
BLOCK, QUERIES, LEAST = 32_768, 4_096, 4_096
#: Best estimates ranked exactly first: the k-th score among them is what bounds must reach.
FIRST = 256


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, residual lengths, and inner products of unit and code."""
    rest = vectors - centre
    length = np.linalg.norm(rest, axis=1)
    unit = rest / np.where(length > 0, length, 1)[:, None] @ turn.T
    bits = unit > 0
    dot = np.abs(unit).sum(axis=1) / math.sqrt(vectors.shape[1])
    return np.packbits(bits, axis=1), length, dot


def search_block(qid, queries, vid, vectors, centre, k: int = K, epsilon: float = EPSILON):
    """The ``k`` nearest of the block for each query: query_id, vec_id, score."""
    dim = vectors.shape[1]
    turn = rotation(dim)
    codes, length, dot = encode(vectors, centre, turn)
    signs = np.unpackbits(codes, axis=1)[:, :dim].astype(np.float32) * 2 - 1
    scale = (length / np.maximum(dot, 1e-9) / math.sqrt(dim)).astype(np.float32)
    spread = (length * np.sqrt(np.maximum(1 - dot**2, 0)) / np.maximum(dot, 1e-9) * epsilon / math.sqrt(max(dim - 1, 1)) + 1e-4).astype(np.float32)
    out = []
    turned = (queries @ turn.T).astype(np.float32)
    base = queries @ centre
    reach = np.linalg.norm(queries, axis=1)
    far = np.linalg.norm(vectors, axis=1).max(initial=0)
    # One buffer for all gathers: a fresh one for each query costs more than the products.
    room, upper = np.empty_like(vectors), np.empty(len(vid), np.float32)

    def exactly(some: np.ndarray, query: np.ndarray) -> np.ndarray:
        return np.take(vectors, some, axis=0, out=room[: len(some)], mode="clip") @ query

    for at in range(0, len(queries), 128):
        rough = (turned[at : at + 128] @ signs.T) * scale + base[at : at + 128, None].astype(np.float32)
        for i, estimate in enumerate(rough, start=at):
            own = vid == qid[i]
            estimate[own] = -np.inf
            np.multiply(spread, np.float32(reach[i]), out=upper)
            upper += estimate
            chosen = np.flatnonzero(~own)
            first = max(FIRST, k)
            if len(chosen) > first:
                score = exactly(np.argpartition(estimate, len(vid) - first)[-first:], queries[i])
                chosen = chosen[~(upper[chosen] < np.partition(score, first - k)[first - k])]  # what overflowed stays
            exact = exactly(chosen, queries[i])
            if len(chosen) > 4 * k:  # all that may tie with the k-th stay
                chosen = chosen[exact >= np.partition(exact, len(exact) - k)[len(exact) - k] - 1e-9 * reach[i] * far]
            # Equal vectors must score equally, which a product of matrices doesn't promise.
            exact = np.einsum("ij,j->i", vectors[chosen], queries[i])
            order = np.lexsort((vid[chosen], -exact))[:k]
            out.append((np.full(len(order), qid[i]), vid[chosen][order], exact[order]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. Both tables: vec_id, embedding."""

    def usable(df: DataFrame) -> DataFrame:
        e = F.col("embedding").cast("array<double>")
        ok = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
        rows = df.select(F.col("vec_id").cast("long"), e.alias("v")).where(ok & F.col("vec_id").isNotNull())
        return rows.dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v"))

    spark = vectors.sparkSession
    every, asked = materialise(usable(vectors), "vectors"), materialise(usable(queries), "queries")
    sizes = every.groupBy("dim").count().collect()
    n = max([1, *(r["count"] for r in sizes)])
    blocks = max(math.ceil(n / BLOCK), min(partitions(spark), math.ceil(n / LEAST)))
    groups = max(1, math.ceil(asked.count() / QUERIES))
    means = every.select("dim", F.posexplode("v").alias("i", "x")).groupBy("dim", "i").agg(F.avg("x").alias("m")).collect()
    centre = {r["dim"]: np.zeros(r["dim"]) for r in sizes}
    for r in means:  # one number a dimension
        centre[r["dim"]][r["i"]] = r["m"]
    place = F.xxhash64("vec_id")
    left = every.withColumn("d", F.pmod(place, F.lit(blocks))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).withColumn("asks", F.lit(False))
    right = asked.withColumn("q", F.pmod(place, F.lit(groups))).withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("asks", F.lit(True))
    both = left.unionByName(right)

    def block(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        dim = table.column("dim")[0].as_py()
        values = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        order = np.argsort(ids, kind="stable")
        a, b = order[asks[order]], order[~asks[order]]
        if not len(a) or not len(b):
            got = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            got = search_block(ids[a], values[a], ids[b], values[b], centre[dim], k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), got, strict=True)))

    found = both.groupBy("dim", "q", "d").applyInArrow(block, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0"))
