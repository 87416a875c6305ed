"""Vector code compression: product codes assigned by partial-distance search.

Vectors are cut into parts; each part position has a codebook that is refined by
rounds of nearest-entry assignment and floored means, all in integers. To assign a
part, its dimensions are taken in descending variance of the codebook. After a few
of them the entry that looks best is measured whole, as is the entry of the last
round; from then on a mask drops every entry whose accumulated distance strictly
exceeds the best complete one. Entries that may tie are never dropped.

Rounds are passes over a written table (see ``centroids``); entry sums are partial
sums per task, and ``parts * entries`` rows come back to the driver.

Defined results: rows whose vector is null or holds null or non-finite components
are dropped; repeated rows are separate vectors; a null id is coded like any other
and is the last to seed; equal ids seed in the order of their components; fewer
rows than ``entries`` make a smaller codebook; null labels are one label; if lengths
differ, the commonest one (the smaller of equals) is coded and the other rows stay
with a null code and error; a length that the parts don't divide is cut as evenly as
can be; an empty table gives an empty one; extra columns are ignored. Components of
2**27 or more after scaling raise a ValueError.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centroids import digest, exact_type, finite, integers, largest
from .common import discard, materialise, read

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Dimensions before the first mask; one entry in so many left ends whole rows of sums.
PROBE, FEW = 3, 16
#: Rows of a slice, of a batch.
ROWS, BATCH = 128, 4096


def cuts(dim: int, parts: int) -> list[int]:
    return [dim * p // parts for p in range(parts + 1)]


def partial_distance(points: np.ndarray, book: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each point, its squared distance, and the number of terms
    (squared differences) that were taken. ``last``: an entry to start from."""
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    x, y = np.ascontiguousarray(points[:, order]), np.ascontiguousarray(book[:, order])
    out = [_slice(x[at : at + ROWS], y, last[at : at + ROWS]) for at in range(0, len(x), ROWS)]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    entry, far, taken = zip(*out, strict=True)
    return np.concatenate(entry), np.concatenate(far), sum(taken)


def _slice(x: np.ndarray, y: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Few enough rows that the table of sums stays in a core's cache. A whole row of
    sums is added to at memory speed; a list of what the mask leaves costs far more an
    entry, so the list is made once few entries are left."""
    (n, dim), m = x.shape, len(y)

    def whole(entry: np.ndarray) -> np.ndarray:
        return ((x - y[entry]) ** 2).sum(1)

    best, taken = whole(last), n * dim
    sums, step = np.zeros((n, m), x.dtype), np.empty((n, m), x.dtype)
    for done in range(1, dim + 1):
        np.subtract(x[:, done - 1, None], y[None, :, done - 1], out=step)
        step *= step
        sums += step
        taken += n * m
        if done == min(PROBE, dim) or done > PROBE and done % 2 == 0:
            best = np.minimum(best, whole(sums.argmin(1)))
            taken += n * dim
            alive = sums <= best[:, None]
            if np.count_nonzero(alive) * FEW < alive.size:
                break
    else:
        alive = sums <= best[:, None]
    row, entry = np.nonzero(alive)
    total = sums[row, entry]
    for j in range(done, dim):
        term = x[row, j] - y[entry, j]
        total += term * term
        taken += len(row)
        stays = total <= best[row]
        row, entry, total = row[stays], entry[stays], total[stays]
    # Rows come in order, entries within a row too: the first of the least wins.
    least = np.minimum.reduceat(total, np.searchsorted(row, np.arange(n)))
    at = np.flatnonzero(total == least[row])
    at = at[np.searchsorted(row[at], np.arange(n))]
    return entry[at], least.astype(np.int64), taken


def assign(table: DataFrame, books: list[np.ndarray], kind: type) -> DataFrame:
    """vec_id, label, v, code, error; ``table``: vec_id, label, v, code."""
    books = [b.astype(kind) for b in books]
    ends = np.concatenate([[0], np.cumsum([b.shape[1] for b in books])])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                b = batch.slice(at, BATCH)
                v = b.column("v")
                x = v.flatten().to_numpy().reshape(len(v), -1).astype(kind)
                last = b.column("code").flatten().to_numpy().reshape(len(v), -1)
                code, error = np.empty((len(v), len(books)), np.int32), np.zeros(len(v), np.int64)
                for p, book in enumerate(books):
                    code[:, p], far, _ = partial_distance(x[:, ends[p] : ends[p + 1]], book, last[:, p])
                    error += far
                codes = pa.ListArray.from_arrays(np.arange(0, code.size + 1, len(books), dtype=np.int32), code.ravel())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), v, codes, pa.array(error)], names=["vec_id", "label", "v", "code", "error"])

    label = table.schema["label"].dataType.simpleString()
    return table.select("vec_id", "label", "v", "code").mapInArrow(run, f"vec_id long, label {label}, v array<int>, code array<int>, error long")


def means(table: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The floor of the mean of each entry's parts; unused entries stay."""
    wide = [b.shape[1] for b in books]
    start = np.cumsum([0, *wide]).tolist()
    cut = [F.slice("v", a + 1, w) if w else F.array().cast("array<int>") for a, w in zip(start, wide, strict=False)]
    each = F.arrays_zip(F.col("code").alias("entry"), F.array(*cut).alias("part"))
    rows = table.select(F.posexplode(each).alias("p", "x")).select("p", F.col("x.entry").alias("entry"), F.col("x.part").alias("part"))
    sums = rows.groupBy("p", "entry").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("part", F.lit(i))).alias(f"s{i}") for i in range(max(wide))])
    out = [b.copy() for b in books]
    for r in sums.collect():  # parts x entries rows
        out[r["p"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(wide[r["p"]])]
    return out


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code (array of entry numbers, in part order), error; and the
    codebooks. ``vectors``: vec_id, embedding, label."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("e")).where(F.col("e").isNotNull()).where(finite(F.col("e")))
    whole = rows.select("vec_id", "label", integers(F.col("e"), scale).alias("v"))
    dims = whole.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return whole.select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error")), []
    dim = dims["dim"]
    coded, other = whole.where(F.size("v") == dim), whole.where(F.size("v") != dim)
    ends = cuts(dim, parts)
    bound, widest = largest(coded), max(b - a for a, b in zip(ends, ends[1:], strict=False))
    kind = np.int32 if 4 * widest * bound * bound < 1 << 31 else exact_type(bound, dim)
    zero = F.array_repeat(F.lit(0), parts)
    table = materialise(coded.select("vec_id", "label", F.col("v").cast("array<int>").alias("v"), zero.alias("code")), "vectors")
    first = [r["v"] for r in table.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()]
    books = [np.array([v[a:b] for v in first], np.int64).reshape(len(first), -1) for a, b in zip(ends, ends[1:], strict=False)]
    for turn in range(rounds + 1):
        after = materialise(assign(table, books, kind), "codes")
        discard(table)
        table = after
        if turn < rounds:
            books = means(table, books)
    nothing = other.select("vec_id", "label", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
    return table.select("vec_id", "label", "code", "error").unionByName(nothing), books


def decompress(coded: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """vec_id, embedding (array of double): the entries that each code names."""
    flat = F.array(*[F.array(*[F.array(*[F.lit(int(x) / scale) for x in entry]) for entry in book]) for book in books])
    return coded.select("vec_id", F.flatten(F.transform("code", lambda c, p: F.get(F.get(flat, p), c))).alias("embedding"))


def op13_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(read(spark, sf_dir, "embeddings"))
    sha = digest(int(x) for book in books for entry in book for x in entry)
    per = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    both = coded.join(per, F.col("label").eqNullSafe(F.col("of")), "left")
    return both.select("vec_id", code.alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, dim: int = 64) -> str:
    wide = dim // parts
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"comps AS MATERIALIZED (SELECT r, (i - 1) // {wide} AS p, (i - 1) % {wide} AS j, x FROM (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept))",
        "seeds AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept)",
        f"b0 AS MATERIALIZED (SELECT e, p, j, x AS y FROM comps JOIN seeds USING (r) WHERE e < {entries})",
    ]
    for t in range(rounds + 1):
        steps.append(f"d{t} AS (SELECT r, p, e, sum((x - y) * (x - y)) AS d FROM comps JOIN b{t} USING (p, j) GROUP BY r, p, e)")
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, p, CAST(min(d) AS BIGINT) AS d, arg_min(e, d * {entries} + e) AS e FROM d{t} GROUP BY r, p)")
        if t < rounds:
            mean = "CAST(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS BIGINT)"
            steps.append(f"m{t} AS (SELECT e, p, j, {mean} AS y FROM (SELECT e, p, j, sum(x) AS s, count(*) AS n FROM comps JOIN a{t} USING (r, p) GROUP BY e, p, j))")
            steps.append(f"b{t + 1} AS MATERIALIZED (SELECT e, p, j, coalesce(m{t}.y, b{t}.y) AS y FROM b{t} LEFT JOIN m{t} USING (e, p, j))")
    steps.append(f"sha AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, j)) AS s FROM b{rounds})")
    steps.append(f"per AS (SELECT r, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT s FROM sha) AS codebooks_sha256
FROM per JOIN kept USING (r)"""


SQL = _sql()
