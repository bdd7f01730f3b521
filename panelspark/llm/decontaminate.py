"""Benchmark decontamination by SimHash windows.

Every benchmark item and every window of a document with as many words as an item becomes a 128-bit
SimHash of its weighted word shingles. Fingerprints are cut into blocks; two fingerprints within
``radius`` differ in at most radius // blocks bits of some block, so looking up every block value
within that distance finds all fingerprints within the radius. Each candidate pair is then decided
by the exact weighted similarity of its shingles (sum of smaller over sum of larger counts).

Similarity s of two windows with n shingles each needs 2 s n / (1 + s) shared ones, so windows with
fewer shingles of the items of their size are not fingerprinted. The item index travels to the tasks while the items' texts stay below
``broadcast_bytes``; a larger benchmark is dealt into parts of that size, one pass over the documents
each. Words are runs of letters, digits and non-ASCII characters in lower case. Items with fewer words than a shingle are
one shingle. Null and empty texts contain nothing; items without words match nothing; repeated rows
are judged each; items with equal ids are items of their own.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import common  # noqa: F401

BITS, BLOCKS = 128, 8
BLOCK_BITS = BITS // BLOCKS
#: Bytes that belong to words: ASCII letters and digits, and all of other characters.
SOLID = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin."""
    data, offsets = common.utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends, bounds = common.words(data, offsets, SOLID[data])
    return common.span_hashes(data, starts, ends), bounds


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order; a shorter text is one shingle."""
    if not len(words):
        return words
    at = np.arange(max(len(words) - k + 1, 1))
    return common.span_hashes(words, at, np.minimum(at + k, len(words)))


def simhash(shingles: np.ndarray) -> np.ndarray:
    """The two 64-bit halves of a fingerprint; a shingle counts as often as it occurs."""
    bits = _bits(shingles).astype(np.int32) * 2 - 1
    return np.packbits(bits.sum(axis=0) > 0).view(">u8").astype(np.uint64)


def _bits(shingles: np.ndarray) -> np.ndarray:
    halves = np.stack([common.mix(shingles), common.mix(shingles ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
    return np.unpackbits(halves.astype(">u8").view(np.uint8).reshape(len(shingles), BITS // 8), axis=1)


def weighted_similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def block_flips(distance: int) -> np.ndarray:
    """What to exclusive-or a block with to get all values within a Hamming distance."""
    return np.array([sum(1 << f for f in flips) for d in range(distance + 1) for flips in combinations(range(BLOCK_BITS), d)], np.int64)


@dataclass(frozen=True)
class Index:
    """Items as shingle counts, fingerprints and per-block lists of the items near each value."""

    k: int
    radius: int
    ids: list
    counts: list[Counter]
    prints: np.ndarray
    widths: dict[int, list[int]]
    own: dict[int, np.ndarray]
    known: np.ndarray
    quick: np.ndarray
    near: list[tuple[np.ndarray, np.ndarray]]


def build_index(items: list[tuple], k: int = 5, radius: int = 31) -> Index:
    """Index of (id, text) items; ``radius`` 31 of 128 bits keeps more than 99.8 % of pairs at similarity 0.8."""
    ids, counts, prints, widths, found = [], [], [], defaultdict(list), []
    words, bounds = word_hashes(pa.array([t for _, t in items], pa.string()))
    for (item_id, _), a, z in zip(items, bounds[:-1], bounds[1:]):
        s = shingle_hashes(words[a:z], k)
        if not len(s):
            continue
        widths[int(z - a)].append(len(ids))
        ids.append(item_id)
        counts.append(Counter(s.tolist()))
        prints.append(simhash(s))
        found.append(s)
    stacked = np.array(prints, np.uint64).reshape(-1, 2)
    blocks, flips, near = _blocks(stacked), block_flips(radius // BLOCKS), []
    for b in range(BLOCKS):
        values = (blocks[:, b, None] ^ flips).ravel()
        edges = np.concatenate(([0], np.cumsum(np.bincount(values, minlength=1 << BLOCK_BITS))))
        near.append((edges, np.argsort(values, kind="stable") // len(flips)))
    known = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
    own = {w: np.unique(np.concatenate([found[i] for i in of])) for w, of in widths.items()}
    quick = np.zeros(1 << 20, bool)
    quick[known >> np.uint64(44)] = True
    return Index(k, radius, ids, counts, stacked, dict(widths), own, known, quick, near)


def shared(index: Index, shingles: np.ndarray) -> np.ndarray:
    """Which shingles occur in an item."""
    hit = index.quick[shingles >> np.uint64(44)]
    hit[hit] = np.isin(shingles[hit], index.known)
    return hit


def _blocks(p: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(p.astype(">u8")).view(">u2").reshape(*p.shape[:-1], BLOCKS).astype(np.int64)


def candidates(index: Index, p: np.ndarray) -> list[int]:
    """All items whose fingerprint is within the radius of ``p``, through the block lists."""
    some = np.unique(np.concatenate([items[edges[v] : edges[v + 1]] for v, (edges, items) in zip(_blocks(p), index.near)]))
    if not len(some):
        return []
    away = np.bitwise_count(index.prints[some] ^ p).sum(axis=1)
    return some[away <= index.radius].tolist()


def matches(index: Index, words: np.ndarray, threshold: float) -> list[tuple]:
    """(item id, similarity, first word, words) of the best window of each item found in a text."""
    n, k, best = len(words), index.k, {}

    def judge(items: list[int], window: Counter, at: int, width: int) -> None:
        for i in items:
            value = weighted_similarity(index.counts[i], window)
            if value >= threshold and value > best.get(i, (0.0,))[0]:
                best[i] = (value, at, width)

    full = shingle_hashes(words, k)
    hit_full = shared(index, full)
    for width, items in index.widths.items():
        if width > n:
            if hit_full.any():
                judge(sorted(set(items) & set(candidates(index, simhash(full)))), Counter(full.tolist()), 0, n)
            continue
        s = full if width >= k else shingle_hashes(words, width)
        hit = (hit_full if width >= k else shared(index, s)).copy()
        hit[hit] = np.isin(s[hit], index.own[width])
        per = max(width - k + 1, 1)
        total = np.concatenate(([0], np.cumsum(hit)))
        need = math.ceil(2 * threshold / (1 + threshold) * per - 1e-9)
        starts = np.flatnonzero(total[per:] - total[:-per] >= max(need, 1))
        if not len(starts):
            continue
        near = np.zeros(len(s) + 1, np.int32)
        np.add.at(near, starts, 1)
        np.add.at(near, starts + per, -1)
        used = np.cumsum(near[:-1]) > 0
        place = np.concatenate(([0], np.cumsum(used)))
        sums = np.zeros((place[-1] + 1, BITS), np.int32)
        np.cumsum(_bits(s[used]).astype(np.int32) * 2 - 1, axis=0, out=sums[1:])
        prints = np.packbits(sums[place[starts + per]] - sums[place[starts]] > 0, axis=1).view(">u8").astype(np.uint64)
        for at, p in zip(starts.tolist(), prints):
            if found := candidates(index, p):
                judge(found, Counter(s[at : at + per].tolist()), at, width)
    return [(index.ids[i], *best[i]) for i in sorted(best)]


def _search(items: list[tuple], k: int, radius: int, threshold: float, id_name: str):
    schema = pa.schema([(id_name, pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = build_index(items, k, radius)
        small = [w for w in index.widths if w < index.k]
        for batch in batches:
            rows = []
            for part in common.text_slices(batch, "_text"):
                words, bounds = word_hashes(part.column("_text"))
                some = np.zeros(len(part), bool)
                for size in {k, *small}:
                    at, row = common.gram_starts(bounds, size)
                    some[row[shared(index, common.span_hashes(words, at, at + size))]] = True
                ids = part.column(id_name)
                for i in np.flatnonzero(some):
                    rows += [(ids[i].as_py(), *m) for m in matches(index, words[bounds[i] : bounds[i + 1]], threshold)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def parts(benchmark: DataFrame, broadcast_bytes: int, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in lists whose texts stay below ``broadcast_bytes``."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter("t IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-size // broadcast_bytes))
    for part in range(n):
        chosen = items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == part)
        yield [(r.i, r.t) for r in chosen.orderBy("i", "t").collect()]


def search(
    docs: DataFrame, benchmark: DataFrame, *, k: int = 5, threshold: float = 0.8, radius: int = 31, broadcast_bytes: int = 4 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Pairs doc_id, item_id with the similarity and place of the item's best window."""
    some = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("_text"))
    out = None
    for items in parts(benchmark, broadcast_bytes, item_col, item_text_col):
        found = some.mapInArrow(_search(items, k, radius, threshold, "doc_id"), "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = found if out is None else out.unionByName(found)
    return out


def _flagged(items: list[tuple], k: int, radius: int, threshold: float, kept: list[str]):
    """Rows in whose text no item is found; the decision needs the row alone, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = build_index(items, k, radius)
        small = [w for w in index.widths if w < index.k]
        for batch in batches:
            for part in common.text_slices(batch, "text"):
                words, bounds = word_hashes(part.column("text"))
                some = np.zeros(len(part), bool)
                for size in {k, *small}:
                    at, row = common.gram_starts(bounds, size)
                    some[row[shared(index, common.span_hashes(words, at, at + size))]] = True
                for i in np.flatnonzero(some):
                    some[i] = bool(matches(index, words[bounds[i] : bounds[i + 1]], threshold))
                yield part.select(kept).filter(pa.array(~some))

    return run


def clean(
    docs: DataFrame, benchmark: DataFrame, *, k: int = 5, threshold: float = 0.8, radius: int = 31, broadcast_bytes: int = 4 << 20,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found; every column is kept, whatever its name."""
    names, at = docs.columns, docs.columns.index(text_col)
    own, string = [f"c{i}" for i in range(len(names))], docs.schema[at].dataType == T.StringType()
    kept = ["text" if string and i == at else c for i, c in enumerate(own)]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(kept, docs.schema)])
    out = docs.toDF(*own)
    for items in parts(benchmark, broadcast_bytes, item_col, item_text_col):
        if items:
            with_text = out.withColumnRenamed(own[at], "text") if string else out.withColumn("text", F.col(own[at]).cast("string"))
            out = with_text.mapInArrow(_flagged(items, k, radius, threshold, kept), schema).toDF(*own)
    return out.toDF(*names)
