"""Mixing sources to target weights by a time-varying curriculum (native).

Every source has a target number of words and a weight schedule over training
time t in [0, 1], ``1 + tilt * (2t - 1)``, whose integral is 1. A source's
documents form a stream in a fixed pseudo-random order, repeated as often as the
target needs. The stream offset ``c`` of a document is its cumulative token
demand; inverting ``target * (t + tilt * (t*t - t)) = c`` gives its training
position, and documents are range-sorted by it.

Targets: the budget (``share`` times all words) is dealt by weight; a target
stops at ``cap`` times its source's size and the excess is dealt again by weight.
The fixed point is a water level ``min(cap * size, level * weight)``, found with
one window over the table of sources.

Defined results: null text has size 0; null source is a source of its own, last
in order; a null doc_id is a document like others; a document of size 0 takes 0
words and has no position; empty tables give empty results; repeated rows are
separate documents (only equal ones tie); extra columns of any name stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, packed_row, unpacked, word_count

#: Buckets of the pseudo-random order of a source (by its first bits); each is summed
#: on its own, so that a source with most of the rows is still spread over many tasks.
LEAST_BITS, BUCKET_ROWS = 10, 100_000
#: Tables of sources up to this many rows (tens of bytes each) are broadcast.
BROADCAST_SOURCES = 20_000
#: Tables of the sizes of buckets up to this many rows (about 30 bytes each) are too.
BROADCAST_BUCKETS = 200_000
TILTS = (-0.5, 0.0, 0.5)


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """(source) -> source_size, weight, tilt, target. ``sizes``: source, size."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.row_number().over(order) - 1
    table = by_source.withColumn("_r", pick)
    for name, values in (("weight", weights), ("tilt", [TILTS[i % 3] for i in range(len(weights))])):
        table = table.withColumn(
            name, F.element_at(F.array(*map(F.lit, values)), (F.col("_r") % len(values) + 1).cast("int"))
        )
    table = table.withColumn("_cap", cap * F.col("source_size"))
    # Sources that reach their cap first come first; before each of them, what is
    # left of the budget over what is left of the weights is a water level. The
    # level rises while sources are capped and falls after: the highest holds.
    rising = Window.orderBy(F.col("_cap") / F.col("weight"), "_r")
    before, every = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    zero = F.lit(0.0)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), zero)) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)
    )
    table = table.withColumn("_level", level)
    return table.select(
        "source", "source_size", "weight", "tilt",
        F.least("_cap", F.max("_level").over(every) * F.col("weight")).cast("double").alias("target"),
    )


def position(offset, target, tilt) -> F.Column:
    """Training time at which a source's cumulative demand reaches ``offset``."""
    q = F.least(F.lit(1.0), F.try_divide(offset, target))
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * q)
    return F.when(tilt == 0, q).otherwise((root - (1 - tilt)) / F.when(tilt != 0, 2 * tilt))


def _sized(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, source, size and the place ``_h`` in a source's order of every row, and
    the row itself with ``carry``."""
    mine = docs.select(packed_row(docs))
    cols = [F.col("_doc.doc_id"), F.col("_doc.source"), word_count("_doc.text").alias("size"), F.xxhash64("_doc.doc_id", "_doc.text").alias("_h")]
    return mine.select(*cols, *(["_doc"] if carry else []))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    carry: bool = False,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken,
    copies (whole copies nearest to ``taken``), stream_offset, position (of the
    first copy; null if none), tilt; with ``carry`` also the document as ``_doc``."""
    sizes = materialise(_sized(docs), "sizes")
    targets = materialise(source_targets(sizes, weights, share, cap), "targets")
    bits = max(LEAST_BITS, (sizes.count() // BUCKET_ROWS).bit_length())

    def bucketed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_b", F.shiftrightunsigned("_h", 64 - bits))

    per = bucketed(sizes).groupBy("source", "_b").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        F.col("source").alias("_s"), F.col("_b").alias("_pb"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead")
    )
    per = materialise(per, "buckets")
    if per.count() <= BROADCAST_BUCKETS:
        per = F.broadcast(per)
    within = (
        Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = bucketed(_sized(docs, True) if carry else sizes).withColumn("_o", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(per, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_pb"))).withColumn(
        "stream_offset", F.col("_o") + F.col("_ahead")
    )
    side = targets.withColumnRenamed("source", "_t")
    if targets.count() <= BROADCAST_SOURCES:
        side = F.broadcast(side)
    full = placed.join(side, F.col("source").eqNullSafe(F.col("_t")))
    passes = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    rest = F.round(F.col("target") - passes * F.col("source_size")) - F.col("stream_offset")
    part = F.greatest(F.lit(0), F.least(rest, F.col("size"))).cast("long")
    full = full.withColumn("_part", part).withColumn("taken", (passes * F.col("size") + F.col("_part")).cast("long"))
    copies = passes + F.when((F.col("_part") > 0) & (2 * F.col("_part") >= F.col("size")), 1).otherwise(0)
    first = F.col("stream_offset") + F.least(F.col("size"), F.col("taken")) / 2
    return full.select(
        "doc_id", "source", "size", "source_size", "target", "taken", copies.cast("int").alias("copies"),
        "stream_offset",
        F.when(F.col("taken") > 0, position(first, F.col("target"), F.col("tilt"))).alias("position"),
        "tilt", "_h", *(["_doc"] if carry else []),
    )


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    from .common import read

    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(
        F.col("position").asc_nulls_last(), "doc_id"
    )


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents in training order, each as often as the mix takes it whole
    (a part of a document counts as a whole copy from half its words on). A row is
    carried through as it is, so repeated rows and null ids are rows of their own."""
    mixed = mix(docs, carry=True, **params).where("copies > 0")
    spots = mixed.withColumn("_e", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = F.col("_e") * F.col("source_size") + F.col("stream_offset") + F.col("size") / 2
    spots = spots.select("_doc", "_h", position(at, F.col("target"), F.col("tilt")).alias("_p"))
    return unpacked(spots.orderBy("_p", "_h"), docs.columns)
