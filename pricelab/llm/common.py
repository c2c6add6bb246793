"""Shared helpers of the training-data operators: tables, scratch tables, byte and word arrays.

Texts reach Python as Arrow columns; the helpers look at their buffers as numpy arrays, in chunks of
whole documents, so that memory follows the chunk and not the Arrow batch.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelab.plans.session import drop_scratch, scratch_path

#: Bytes of text handled at once; a longer document forms a chunk of its own.
CHUNK_BYTES = 1 << 21

#: Fixed value: the white space that separates words (space, \t, \n, \v, \f, \r).
WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(WHITE_SPACE)] = True

_RNG = np.random.default_rng(20240229)
_BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_VALUE[IS_SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read back.

    Later steps depend on files that all executors share, so a lost executor
    costs a re-read and not a recomputation of the whole history.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables of one operator that can go as soon as its last stored result no longer reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"{name}-{uuid.uuid4().hex}")
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep_last: int = 0) -> None:
        """Remove the stored tables, but for the last ``keep_last``."""
        gone = self.paths[: len(self.paths) - keep_last]
        self.paths = self.paths[len(gone) :]
        for path in gone:
            drop_scratch(self.spark, path)


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def hash_share(key: Column, share: float) -> Column:
    """True for about ``share`` of the keys, the same ones in every run."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 20)) < F.lit(int(min(1.0, share) * (1 << 20)) + 1)


def _bit_place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def bit_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(bucket, bitmap): one bit for the hash of each key; at most ``bits`` / 32768 rows of 4 KiB."""
    at = _bit_place(F.col(key), bits)
    return keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))


def marked(rows: DataFrame, key: Column, filter_: DataFrame, bits: int, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: whether the filter may hold the key."""
    at = _bit_place(key, bits)
    joined = rows.withColumn("_at", at).join(F.broadcast(filter_.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bits"))), F.bitmap_bucket_number("_at") == F.col("_bucket"), "left")
    place = F.bitmap_bit_position("_at").cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))), F.lit(2)) == 1
    return joined.withColumn(name, F.coalesce(bit, F.lit(False))).drop("_at", "_bucket", "_bits")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _trim() -> Callable[[int], int] | None:
    """glibc's malloc_trim where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def give_back() -> None:
    """Hand what this Python worker has freed back to the system.

    Spark keeps workers for the tasks of later stages; what one stage has freed would stay theirs beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker gives freed memory back when a task ends."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, UTF-8 bytes, offsets into them) for runs of whole rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_bounds(data: np.ndarray, off: np.ndarray, separators: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and for each document the index of its first word (plus the total)."""
    word = ~separators[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[off[:-1]] = True
    first[off[1:]] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | first[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of ``data`` (white space adds nothing to it)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.zeros(len(data), dtype=np.int64)
    place[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(place)
    values = _BYTE_VALUE[data] * powers(int(place.max()) + 1)[place]
    return mix(np.add.reduceat(values, starts) + _STEP)
