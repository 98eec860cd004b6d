"""Shared pieces of the corpus operators: words as bytes, Arrow helpers, the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte tables: A-Z become a-z; what is no word byte becomes a space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in LOWER)


#: Rows and bytes in a batch that goes to a Python worker (one row at least).
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session within one process may leave it unset; on a cluster that is an error."""
    if not (where := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftwell-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of what stored() returned."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/siftwell-" in path:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def frugal(spark: SparkSession) -> None:
    """Bounds what an executor holds for its Python workers: Arrow batches of `BATCH_ROWS` rows and `BATCH_BYTES` at most."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(str(spark.conf.get(f"spark.sql.execution.arrow.{key}")).removesuffix("b")) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def returned() -> None:
    """Hands memory that a worker no longer uses back to the system, as workers stay for the next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with memory handed back when the task's rows are through."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        returned()

    return wrapped


def in_thirds(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3: the held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding them."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, most: int):
    """The batch in runs of rows whose texts hold about `most` bytes together (one row at least)."""
    texts = batch.column(column)
    wide = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(wide.astype(np.int64))
    first = 0
    while first < len(wide):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices whose texts hold about `most` bytes: small batches are put together."""
    held: list[pa.RecordBatch] = []
    size = 0

    def whole() -> Iterator[pa.RecordBatch]:
        for batch in pa.Table.from_batches(held).combine_chunks().to_batches() if len(held) > 1 else held:
            yield from slices(batch, column, most)

    for batch in batches:
        own = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and size + own > most:
            yield from whole()
            held, size = [], 0
        held.append(batch)
        size += own
    yield from whole()
