"""What the operators share: cutting lineage, and passes over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citeframe.llm import kernel
from citeframe.shared import HOT, discard, frequent, hot_join, settle, shared_folder  # noqa: F401  the operators take these from here
from citeframe.shipping import ship

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 500
#: An id filter has about this many slots for each id, and MOST_SLOTS, 8 MB as bits, at most.
SLOTS_PER_ID = 16
MOST_SLOTS = 1 << 26
_PAGE = 1 << 15  # slots of one row of a filter


def refuse(columns: Iterable[str], made: Iterable[str]) -> None:
    """A column that is asked for mustn't have the name of one that an operator makes: the result would have two."""
    clash = sorted({c.lower() for c in columns} & {c.lower() for c in made})
    if clash:
        raise ValueError(f"names of results: {', '.join(clash)}; rename these columns first")


def prepare(spark: SparkSession) -> None:
    """Send the package."""
    ship(spark)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python hold BATCH_ROWS rows, as rows are whole texts; a setting of the user's own stays."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))


def give_back() -> None:
    """Return the memory that a Python worker no longer uses; it waits for its next task otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_pass(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str, text: str = "text") -> DataFrame:
    """mapInArrow over parts of a few MB of text each."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernel.slices(batch, text):
                yield work(part)
            give_back()

    return df.mapInArrow(run, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, text: str | None = None) -> Iterator[pa.RecordBatch]:
    """Batches sorted by `key`, cut anew so that none parts a group; with `text`, into parts of a few MB of text or one group."""

    def joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]
        if text is None:
            yield got
            return
        at = np.concatenate([starts(got.column(key)), [got.num_rows]])
        size = kernel.buffers(got.column(text))[1][at]
        i = 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(size, size[i] + kernel.SLICE_BYTES, side="right")) - 1)
            yield got.slice(at[i], at[j] - at[i])
            i = j

    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        start = starts(batch.column(key))
        if kept and batch.column(key)[0].as_py() != last:
            yield from joined(kept)
            kept = []
        if len(start) > 1:
            yield from joined([*kept, batch.slice(0, start[-1])])
            kept = []
        kept.append(batch.slice(start[-1]))
        last = batch.column(key)[batch.num_rows - 1].as_py()
    if kept:
        yield from joined(kept)


def starts(column: pa.Array) -> np.ndarray:
    """Where the groups of a sorted column begin."""
    k = column.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])


def read(spark: SparkSession, sf_dir: str, table: str, spread: bool = False) -> DataFrame:
    """A table.  `spread` deals out the rows of one that is stored in fewer splits than there are cores, as few large row groups are, so that Python work on them uses all cores."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def dealt(key: Column | str, parts: int) -> Column:
    """crc32 of a key as text (null: empty), modulo parts."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(parts))


@dataclass
class IdFilter:
    """Hashed ids as bits, in rows of _PAGE bits."""

    bits: DataFrame
    slots: int

    def place(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(5)), F.lit(self.slots))


def id_filter(ids: DataFrame, column: str) -> IdFilter:
    """A filter of distinct ids (null is one too), of bounded size and cut off from its lineage."""
    known = IdFilter(ids, min(MOST_SLOTS, 1 << max(16, (ids.count() * SLOTS_PER_ID).bit_length())))
    at = ids.select(known.place(F.col(column)).alias("__at")).withColumn("__page", F.floor(F.col("__at") / _PAGE)).repartition("__page")
    known.bits = settle(at.groupBy("__page").agg(F.bitmap_construct_agg(F.pmod("__at", F.lit(_PAGE))).alias("__bits")))
    return known


def split_by(df: DataFrame, key: Column, known: IdFilter) -> DataFrame:
    """df and __maybe: false where the key is surely none of the ids of `known`, true for all of these and a few others.

    The filter is broadcast, its size being bounded.  Beyond that size it lets more and more others through, so what
    follows must look at those exactly.
    """
    at = F.pmod("__at", F.lit(_PAGE)).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.coalesce(F.call_function("getbit", byte, at % 8) == 1, F.lit(False))
    have = df.withColumn("__at", known.place(key)).withColumn("__page", F.floor(F.col("__at") / _PAGE))
    return have.join(F.broadcast(known.bits), "__page", "left").withColumn("__maybe", on).drop("__at", "__page", "__bits")


def grown(df: DataFrame, columns: list[str], extra: str) -> StructType:
    """The schema of some columns of df, followed by the fields of a DDL string; none may have the name of another."""
    made = StructType.fromDDL(extra)
    refuse(columns, made.fieldNames())
    return StructType([*[df.schema[c] for c in columns], *made.fields])
