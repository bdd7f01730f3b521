"""Document fingerprints from modular prefix hashes.

The prefix array of a text holds P[i] = sum of (c_j + 1) * B^j for j < i, modulo the prime 2^61 - 1, over its
code points c. Two spans are equal when their differences of P are, after multiplying with the power
of B that moves one to the other; a longest common extension is found by binary search over spans.

A fingerprint keeps the number of code points, the hash of the whole text and samples of two prefix
arrays, of the text and of the text backwards, at multiples of the smallest power of two that gives at
most ``SAMPLES``. The likeness of two fingerprints is the share of the longer text that lies in spans found
equal at the same distance from the start or from the end: from each sample on, the longest common
extension is searched, then one block is skipped.

Null texts are empty. Equal texts have equal fingerprints; the likeness of equal fingerprints is 1, that of
an empty and another text 0. Texts are read in blocks of ``BLOCK`` code points beyond their own size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm import common

PRIME = (1 << 61) - 1
BASE = 0x1F3D_5B79_A2C4_E687 % PRIME
SAMPLES = 32
BLOCK = 1 << 16
_M = np.uint64(PRIME)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _M) + (x >> np.uint64(61))
    return np.where(x >= _M, x - _M, x)


def _times(small: np.ndarray, x: np.ndarray) -> np.ndarray:
    """small * x modulo the prime, for small below 2^22 and x below the prime."""
    high, low = (x >> np.uint64(31)) * small, (x & np.uint64(0x7FFFFFFF)) * small
    turned = ((high & np.uint64(0x3FFFFFFF)) << np.uint64(31)) + (high >> np.uint64(30))
    return _reduced(turned + low)


def _summed(x: np.ndarray) -> np.ndarray:
    """Running sums modulo the prime of up to ``BLOCK`` numbers below it."""
    high, low = np.cumsum(x >> np.uint64(32)), np.cumsum(x & np.uint64(0xFFFFFFFF))
    turned = ((high & np.uint64(0x1FFFFFFF)) << np.uint64(32)) + (high >> np.uint64(29))
    return _reduced(_reduced(turned) + low)


def _powers() -> np.ndarray:
    out, x = np.empty(BLOCK, np.uint64), 1
    for i in range(BLOCK):
        out[i] = x
        x = x * BASE % PRIME
    return out


_POWERS: list[np.ndarray] = []


def powers() -> np.ndarray:
    if not _POWERS:
        _POWERS.append(_powers())
    return _POWERS[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefixes(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """P at the ascending positions ``at``, computed block by block."""
    out, carry, shift = np.zeros(len(at), np.uint64), 0, 1
    step = pow(BASE, BLOCK, PRIME)
    for start in range(0, len(codes), BLOCK):
        part = codes[start : start + BLOCK].astype(np.uint64) + np.uint64(1)
        sums = _summed(_times(part, powers()[: len(part)]))
        i, j = np.searchsorted(at, [start + 1, start + len(part) + 1])
        inner = sums[at[i:j] - start - 1]
        out[i:j] = inner if start == 0 else np.array([(carry + int(s) * shift) % PRIME for s in inner], np.uint64)
        carry = (carry + int(sums[-1]) * shift) % PRIME
        shift = shift * step % PRIME
    return out


class PrefixArray:
    """All prefix hashes of one text: equality of any two spans, and longest common extensions."""

    def __init__(self, text: str):
        self.codes = code_points(text)
        self.p = prefixes(self.codes, np.arange(len(self.codes) + 1)).tolist()

    def __len__(self) -> int:
        return len(self.codes)

    def equal(self, i: int, other: PrefixArray, j: int, n: int) -> bool:
        """Whether the spans of n code points from i here and from j there have the same hash."""
        if i + n > len(self) or j + n > len(other):
            return False
        mine, theirs = self.p[i + n] - self.p[i], other.p[j + n] - other.p[j]
        return (mine * pow(BASE, max(j - i, 0), PRIME) - theirs * pow(BASE, max(i - j, 0), PRIME)) % PRIME == 0

    def extension(self, i: int, other: PrefixArray, j: int) -> int:
        """Length of the longest common extension from i here and j there, by binary search."""
        low, high = 0, min(len(self) - i, len(other) - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low


def stride(n: int) -> int:
    """The smallest power of two that fits at most ``SAMPLES`` times into n."""
    return 1 << (n // (SAMPLES + 1)).bit_length()


def sample(codes: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Length, whole hash, and the samples of both prefix arrays, with P[0] = 0 first."""
    n = len(codes)
    at = np.arange(0, n + 1, stride(n))
    forward = prefixes(codes, np.append(at, n))
    return n, int(forward[-1]), forward[:-1], prefixes(codes[::-1], at)


def packed(sampled: tuple[int, int, np.ndarray, np.ndarray]) -> str:
    n, whole, forward, backward = sampled
    body = np.concatenate(([np.uint64(whole)], forward[1:], backward[1:])).astype(">u8")
    return f"{n:x}." + base64.b64encode(body.tobytes()).decode()


def unpacked(fingerprint: str) -> tuple[int, int, np.ndarray, np.ndarray]:
    size, body = fingerprint.split(".", 1)
    n, values = int(size, 16), np.frombuffer(base64.b64decode(body), ">u8").astype(np.uint64)
    k = (len(values) - 1) // 2
    zero = np.zeros(1, np.uint64)
    return n, int(values[0]), np.concatenate((zero, values[1 : k + 1])), np.concatenate((zero, values[k + 1 :]))


def _common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Runs of blocks whose spans are equal in both, each found by binary search from its first block."""
    away, runs, i, last = (a[: len(b)].astype(np.int64) - b[: len(a)].astype(np.int64)) % PRIME, [], 0, min(len(a), len(b)) - 1
    same = lambda x, y: away[x] == away[y]  # noqa: E731  equal spans move both prefixes by the same amount
    while i < last:
        low, high = i, last
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if same(i, mid) else (low, mid - 1)
        if low > i:
            runs.append((i, low))
        i = low + 1
    return runs


def likeness(a: tuple, b: tuple) -> float:
    """Share of the longer text in equal spans, from two samples."""
    if a[:2] == b[:2]:
        return 1.0
    if not a[0] or not b[0]:
        return 0.0
    (n, _, fa, ba), (m, _, fb, bb) = a, b
    step = max(stride(n), stride(m))
    thin = lambda x, size: x[:: step // stride(size)]
    ahead = [(x * step, y * step) for x, y in _common(thin(fa, n), thin(fb, m))]
    behind = [(x * step, y * step) for x, y in _common(thin(ba, n), thin(bb, m))]
    covered = []
    for size in (n, m):
        total, end = 0, 0
        for x, y in sorted(ahead + [(size - y, size - x) for x, y in behind]):
            total += max(0, y - max(x, end))
            end = max(end, y)
        covered.append(total)
    return min(covered) / max(n, m)


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _edited():
    """Rows follow each other in order; a guest only stands for what follows its bucket's last row."""

    def row(this: tuple, following: tuple) -> tuple:
        doc_id, text, own = this
        n = len(text)
        edited = text[: n - n // 4] + following[1][: n // 4]
        after = sample(code_points(edited)) if edited != text else own
        return (doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), packed(own), packed(after), likeness(own, after), likeness(own, following[2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for part in common.text_slices(batch, "_text"):
                out = []
                for doc_id, guest, text in zip(part.column("doc_id").to_pylist(), part.column("_guest").to_pylist(), part.column("_text").to_pylist()):
                    this = (doc_id, text, sample(code_points(text)))
                    if before is not None:
                        out.append(row(before, this))
                    before = None if guest else this
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), SCHEMA)] if out else [pa.array([], f.type) for f in SCHEMA], schema=SCHEMA)
        if before is not None:
            raise ValueError("a bucket arrived without the row that follows it")

    return run


def bucket_of(bounds: list[int]) -> Column:
    """Bucket of _id among ascending bounds, counted in two steps; an id that several bounds name is cut by _hash."""
    width = max(1, int(len(bounds) ** 0.5))
    values = F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    coarse = F.lit(bounds[width - 1 :: width]).cast("array<bigint>") if bounds else values

    def count(inside) -> Column:
        skip = F.size(F.filter(coarse, inside)) * width
        return skip + F.size(F.filter(F.slice(values, skip + 1, F.lit(width)), inside))

    below, upto = count(lambda b: b < F.col("_id")), count(lambda b: b <= F.col("_id"))
    share = F.col("_hash") / F.lit(2.0**64) + F.lit(0.5)
    return F.when(upto > below, F.least(below + 1 + F.floor(share * (upto - below)).cast("int"), upto)).otherwise(below)


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    The edited text has its last quarter of code points (rounded down) replaced by as many first ones of
    the next document; documents ascend by id (null: last), then by a hash of the text, and the first follows
    the last. Ids are cut into buckets at approximate quantiles; each bucket is one task's sorted run, and
    only the first row of every bucket travels to the bucket before as a guest. Texts are moved once.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumns({"_id": F.coalesce("doc_id", F.lit(common.LAST_ID)), "_hash": F.xxhash64("_text")})
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx("_id", [k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else []
    rows = rows.withColumn("_bucket", bucket_of(sorted(bounds or [])))
    # One row per bucket: at most ``n`` ids and hashes come to the driver.
    firsts = sorted((r["_bucket"], r["f"]["_id"], r["f"]["_hash"]) for r in rows.groupBy("_bucket").agg(F.min(F.struct("_id", "_hash")).alias("f")).collect())
    turns = [(firsts[k - 1][0], i, h) for k, (_, i, h) in enumerate(firsts)]
    turns = spark.createDataFrame(turns, "_home int, _id long, _hash long")
    guests = rows.join(F.broadcast(turns), ["_id", "_hash"]).dropDuplicates(["_home"]).withColumn("_bucket", F.col("_home"))
    columns = ["_bucket", "_guest", "_id", "_hash", "doc_id", "_text"]
    rows = rows.withColumn("_guest", F.lit(False)).select(*columns).unionByName(guests.withColumn("_guest", F.lit(True)).select(*columns))
    rows = rows.repartitionById(n + 1, F.col("_bucket")).sortWithinPartitions("_bucket", "_guest", "_id", "_hash")
    return rows.select("doc_id", "_guest", "_text").mapInArrow(_edited(), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
