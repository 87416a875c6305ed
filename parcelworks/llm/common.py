"""Shared pieces: materialised intermediates, word hashes, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Python workers live on between tasks: what a task frees should go back to the
# system, not stay with an allocator. Arrow and glibc keep large pieces otherwise.
pa.set_memory_pool(pa.system_memory_pool())
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD: such pieces are unmapped when freed
    _libc.mallopt(-1, 1 << 18)  # M_TRIM_THRESHOLD
except OSError:  # another C library
    pass

#: Whitespace that separates words; ``bytes.split()`` splits at exactly these.
WORD_RE = r"[^\x20\x09-\x0D]+"

#: Bytes of a row group of intermediates, which a writer holds in memory.
ROW_GROUP = 16 << 20
#: Rows and bytes of a batch between Spark and Python.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where that
    is unset (tests on one machine) a temporary folder is chosen and set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="parcelworks-checkpoint-")
    spark.sparkContext.setCheckpointDir(at)
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def _clean() -> None:
    for spark, path in _written:
        try:
            drop_table(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it: lineage is
    cut, and a lost executor costs only a re-read."""
    spark = df.sparkSession
    if not _written:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove what ``materialise`` wrote, once nothing reads it any more."""
    for at in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        drop_table(table.sparkSession, at)


def arrow_bounds(spark: SparkSession) -> None:
    """Batches of texts that go to Python are kept small: texts may be long, and both
    sides hold a batch whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    arrow_bounds(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed_row(docs: DataFrame, name: str = "_doc") -> F.Column:
    """All columns as one struct, so that no column of a table clashes with ours;
    ``unpacked`` gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias(name)


def unpacked(df: DataFrame, columns: list[str], name: str = "_doc") -> DataFrame:
    return df.select(*[F.col(f"{name}.`" + c.replace("`", "``") + "`").alias(c) for c in columns])


# --- word hashes -----------------------------------------------------------

class _Names(dict):
    """Word to 64-bit name; emptied when full, so that memory stays bounded."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        name = self[word] = xxhash.xxh3_64_intdigest(word)
        return name


_names = _Names()
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _S33)
    x = x * _MIX1
    x ^= x >> _S33
    x *= _MIX2
    x ^= x >> _S33
    return x


def _odd(k: int) -> np.ndarray:
    return mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_COEF = _odd(64)


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_names.__getitem__, words), np.uint64, len(words))


def window_hashes(names: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each window of ``k`` consecutive names."""
    n = len(names) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = names[:n] * _COEF[0]
    for j in range(1, k):
        out += names[j : j + n] * _COEF[j]
    return mix64(out)


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def map_rows(
    df: DataFrame,
    fn: Callable[[dict[str, list]], dict[str, list]],
    schema: str,
    rows: int = 256,
) -> DataFrame:
    """``mapInArrow`` over slices of ``rows`` rows, as Python lists by column."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                if got is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow
                    )

    return df.mapInArrow(run, fields)


def word_count(text) -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")
