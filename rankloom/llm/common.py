"""Shared plumbing: the cluster's shared folder, bounded id filters, text column access."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the largest id bitmap that is ever broadcast (8 MB); past it the bitmap only lets more rows through.
MAX_FILTER_BITS = 1 << 26
#: Bytes of texts that a task hands to Python at once, or one longer row: the executor holds a batch several times over, outside the heap.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: 64-bit words of a bitmap that travel in one row.
_PIECE = 1 << 14


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of an Arrow batch to BATCH_BYTES; a lower one stays."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rankloom-"))
        root = context._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/rankloom-{name}-{uuid.uuid4().hex[:12]}"


def write_shared(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder, or in a folder of scratch(), and reads it back: later stages don't depend on earlier shuffles."""
    spark = df.sparkSession
    bound_batches(spark)
    path = shared_path(spark, name) if folder is None else f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared one for tables that nothing reads after the block, which deletes them."""
    path = shared_path(spark, "scratch")
    try:
        yield path
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside are deleted as soon as its result is there, not when the driver next collects garbage."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bitmap_bits(n: int) -> int:
    return 1 << int(np.clip(np.ceil(np.log2(max(n, 1) * 16)), 10, np.log2(MAX_FILTER_BITS)))


def key_bitmap(keys: DataFrame, column: str) -> tuple[Broadcast, np.int64]:
    """A broadcast bitmap of 64-bit words with the bits of all values in keys set, and the mask that makes a value its bit's number.

    The values are hashes. It has at most MAX_FILTER_BITS bits whatever the number of keys, so it may be broadcast. It only thins out what a
    following exact join has to shuffle.
    """
    spark = keys.sparkSession
    n = keys.count()
    bits = _bitmap_bits(n)
    words = (
        keys.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    if words.num_rows:
        bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return spark.sparkContext.broadcast(bitmap), np.int64(bits - 1)


def dense_bitmap(keys: DataFrame, column: str) -> tuple[Broadcast, np.int64]:
    """key_bitmap, for many keys: each task sets the bits of its own in a bitmap of bounded size, and compressed pieces of these are shuffled, not keys."""
    spark = keys.sparkSession
    bits = _bitmap_bits(keys.count())
    piece = min(_PIECE, bits // 64)

    def rows(pieces):
        at, packed = zip(*pieces, strict=True) if pieces else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(packed, pa.binary())], names=["piece", "packed"])

    def own(batches):
        found = np.zeros(bits // 64, np.uint64)
        for b in batches:
            slots = np.sort(b["slot"].to_numpy().view(np.uint64))
            if len(slots):
                words = slots >> np.uint64(6)
                first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
                found[words[first]] |= np.bitwise_or.reduceat(np.uint64(1) << (slots & np.uint64(63)), first)
        for i, part in enumerate(found.reshape(-1, piece)):
            if part.any():
                yield rows([(i, zlib.compress(part.tobytes(), 1))])

    def merged(batches):
        held = {}
        for b in batches:
            for i, packed in zip(b["piece"].to_pylist(), b["packed"].to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(packed), np.uint64)
                held[i] = held[i] | part if i in held else part
        yield rows([(i, zlib.compress(part.tobytes(), 1)) for i, part in held.items()])

    schema = "piece int, packed binary"
    slots = keys.select(F.col(column).bitwiseAND(F.lit(bits - 1)).alias("slot"))
    found = slots.mapInArrow(own, schema).repartition("piece").mapInArrow(merged, schema).toArrow()
    bitmap = np.zeros((bits // 64 // piece, piece), np.int64)
    for i, packed in zip(found["piece"].to_pylist(), found["packed"].to_pylist(), strict=True):
        bitmap[i] = np.frombuffer(zlib.decompress(packed), np.int64)
    return spark.sparkContext.broadcast(bitmap.reshape(-1)), np.int64(bits - 1)


def id_bitmap(ids: DataFrame, column: str) -> tuple[Broadcast, Callable[[Column], Column]]:
    """key_bitmap of the hashes of any bigint column, and the expression of a value's bit."""
    shared, mask = key_bitmap(ids.select(F.xxhash64(F.col(column).cast("bigint")).alias("slot")), "slot")
    return shared, lambda value: F.xxhash64(value.cast("bigint")).bitwiseAND(F.lit(int(mask)))


def in_bitmap(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 6] >> (slots & 63)) & 1 == 1


def id_filter(ids: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test on a bigint column by id_bitmap: true for every value in ids (and for few or, past the size bound, many others)."""
    shared, slot = id_bitmap(ids, column)

    @F.pandas_udf("boolean")
    def present(slots):
        import pandas as pd

        return pd.Series(in_bitmap(shared.value, slots.to_numpy(dtype=np.int64)))

    return lambda value: present(slot(value))


def hash_filter(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test on a column of 64-bit hashes by key_bitmap: true for every value in keys (and for few or, past the size bound, many others)."""
    shared, mask = key_bitmap(keys, column)

    @F.pandas_udf("boolean")
    def present(values):
        import pandas as pd

        return pd.Series(in_bitmap(shared.value, values.to_numpy(dtype=np.int64) & mask))

    return present
