"""Helpers the training-data operators share: table reading, word arrays over Arrow text, hashing."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions that run in tasks travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

LAST_ID = 2**63 - 1
CHUNK_BYTES = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def likely(df: DataFrame, key: str, keys: DataFrame, buckets: int = 256) -> DataFrame:
    """Rows whose 64-bit ``key`` may be among those of ``keys``; drops most others before a shuffle.

    ``keys`` becomes a bitmap of ``buckets`` rows of 4 KiB, a size that no input exceeds, and that is
    what is broadcast. A full bitmap lets every row through, so a join on the key must follow.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(buckets * 32768)) + 1
    bits = keys.select(F.bitmap_bucket_number(slot).alias("_bucket"), F.bitmap_bit_position(slot).alias("_at"))
    bits = bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = df.withColumn("_bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "_bucket")
    return marked.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*df.columns)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``CHUNK_BYTES`` of text each, so temporaries stay small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > CHUNK_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text array (null: empty) and the offsets of its rows in them."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of ``solid`` bytes; default: all but space, tab to carriage
    return), and where each row's words begin (one entry more than rows)."""
    n = len(data)
    if solid is None:
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = solid.copy(), solid.copy()
    if n:
        edges = offsets[(offsets > 0) & (offsets < n)]
        first[1:] &= ~solid[:-1]
        first[edges] = solid[edges]
        last[:-1] &= ~solid[1:]
        last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, seed: int, inverse: bool) -> np.ndarray:
    key = (seed, inverse)
    if key not in _POWERS or len(_POWERS[key]) < n:
        base = pow(_BASES[seed], -1, 1 << 64) if inverse else _BASES[seed]
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS[key][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of values[start:end] for many spans: differences of one running sum modulo 2^64."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(n, seed, False), out=total[1:])
    return mix((total[ends] - total[starts]) * _powers(n + 1, seed, True)[starts] + (ends - starts).astype(np.uint64))


def gram_starts(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all k-word grams inside rows, and the row of each."""
    per_row = np.maximum(np.diff(bounds) - k + 1, 0)
    row = np.repeat(np.arange(len(per_row)), per_row)
    skipped = bounds[:-1] - np.concatenate(([0], np.cumsum(per_row)[:-1])) if len(per_row) else bounds[:0]
    return np.arange(int(per_row.sum())) + skipped[row], row


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
