"""Exact n-gram Jaccard join of documents with signature trees.

1. Each text becomes its set of word shingles (64-bit hashes). Equal sets form one class.
2. Prefix filter: two sets with Jaccard similarity t share one of the first n - ceil(t n) + 1 shingles
   of either, under any common order. The order puts corpus-wide frequent shingles last, so passages
   that many documents share rarely enter a prefix.
3. Classes that share a prefix shingle are linked to the best of their shingles' most central members,
   checked exactly on the texts, and joined to components: a group of copies costs one check per member.
4. Prefix shingles that still hold several components are dealt out by shingle and size range; of
   shingles with the very same members only the first in the order is kept, since every pair that
   shares a later one shares it too; and of all only those that stand early enough in some set to be
   the first that a pair shares. In each such group a tree is built whose nodes hold the OR of
   their members' shingle bitmaps, their size range, and how many shingles follow in the order at
   most. Two trees are walked together, and a pair of nodes is dropped when even its largest possible
   overlap is too small, or when both hold one and the same component only. A pair of members stays if
   its full bitmaps allow the threshold and none of the first EARLIER such shingles of both lies before
   this one: a pair that shares many shingles leaves the trees of the first.
5. The pairs of leaves that remain are checked exactly, first the most promising pair of each set,
   then those still between components; connected components give the classes.

Every pair at or above the threshold is linked or in one component already, at any group size: there
is no cap. Null and empty texts have an empty set and no links. Texts with fewer words than a shingle
are one shingle. Rows without an id come after all others and count as one document per text.
Classes are 64-bit set fingerprints: the chance that any two of n classes meet is n^2 / 2^65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm import common
from panelspark.session import stage_table

#: Bits of the smallest bitmap; larger sets have twice their size rounded up to a power of two.
BITS = 1024
#: Members of a leaf, of the two sides of one tree walk, and the share of a task's documents from
#: which a shingle counts as frequent there.
LEAF, SIDE, FREQUENT = 16, 4096, 64
#: Shingles that a member takes along to tell whether a pair met before. Members that may reach the
#: threshold share most of theirs; the few pairs that first meet beyond are made distinct afterwards.
EARLIER = 8
#: Rounds in which each set checks its most promising pair, before all pairs that remain are checked.
PROMISING = 2


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    data, offsets = common.utf8(texts)
    data = common.lower_ascii(data)
    starts, ends, bounds = common.words(data, offsets)
    word = common.span_hashes(data, starts, ends)
    n = np.diff(bounds)
    at, row = common.gram_starts(bounds, k)
    grams = common.span_hashes(word, at, at + k)
    edges = np.searchsorted(row, np.arange(len(n) + 1))
    for i in range(len(n)):
        if 0 < n[i] < k:
            yield common.span_hashes(word, bounds[i : i + 1], bounds[i + 1 : i + 2])
        else:
            yield np.unique(grams[edges[i] : edges[i + 1]])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def bitmap(shingles: np.ndarray) -> np.ndarray:
    size = max(BITS, 1 << (2 * len(shingles) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(shingles >> np.uint64(20)) % np.uint64(size)] = True
    return np.packbits(bits)


def folded(bits: list[bytes], size: int = 0) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all folded to ``size`` bytes (default: the smallest one's)."""
    size = size or min(map(len, bits))
    rows = [np.frombuffer(b, np.uint8) if len(b) == size else np.bitwise_or.reduce(np.frombuffer(b, np.uint8).reshape(-1, size), axis=0) for b in bits]
    return np.concatenate(rows).view(np.uint64).reshape(len(bits), -1)


def _frequent(k: int):
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, docs, sets, size = np.empty(0, np.uint64), np.empty(0, np.int64), 0, [], 0

        def gather() -> None:
            nonlocal keys, counts, size
            now, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (keys[:0], counts[:0])
            n = n + np.where(np.isin(now, keys, assume_unique=True), counts[np.minimum(np.searchsorted(keys, now), len(keys) - 1)], 0) if len(keys) else n
            old = ~np.isin(keys, now, assume_unique=True)
            keys, counts = np.concatenate([now, keys[old]]), np.concatenate([n, counts[old]])
            often = counts > docs // (4 * FREQUENT)
            order = np.argsort(keys[often])
            keys, counts = keys[often][order], counts[often][order]
            sets.clear()
            size = 0

        for batch in batches:
            for part in common.text_slices(batch, "_text"):
                for s in shingle_sets(part.column("_text"), k):
                    sets.append(s)
                    docs += 1
                    size += len(s)
                if size > 1 << 21:
                    gather()
        gather()
        often = counts >= max(4, docs // FREQUENT)
        yield pa.record_batch([common.signed(keys[often]), counts[often]], schema=schema)

    return run


def frequent_shingles(rows: DataFrame, k: int) -> np.ndarray:
    """Shingles that are frequent in some task and in one of 2 * FREQUENT documents of the corpus.

    They only decide the order of the prefix filter. Their number is bounded by 2 * FREQUENT times
    the mean set size, whatever the number of documents.
    """
    n = rows.count()
    found = rows.select("_text").mapInArrow(_frequent(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    often = found.filter(F.col("n") >= max(4, n // (2 * FREQUENT))).select("token").collect()
    return np.sort(np.array([r.token for r in often], np.int64).view(np.uint64))


def _sets(k: int, percent: int, frequent: np.ndarray):
    schema = pa.schema([
        ("_id", pa.int64()), ("_row", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("tokens", pa.list_(pa.int64())), ("bits", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch, "_text"):
                n, node, tokens, bits = [], [], [], []
                for s in shingle_sets(part.column("_text"), k):
                    late = np.isin(s, frequent)
                    first = np.concatenate([s[~late], s[late]])[: prefix_length(len(s), percent)] if len(s) else s
                    n.append(len(s))
                    node.append(int(np.bitwise_xor.reduce(common.mix(common.mix(s) + np.uint64(len(s))), initial=np.uint64(len(s))).astype(np.int64)))
                    tokens.append(common.signed(first))
                    bits.append(bitmap(s).tobytes())
                at = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int32)
                flat = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
                yield pa.record_batch(
                    [part.column("_id"), part.column("_row"), pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.ListArray.from_arrays(at, flat), pa.array(bits, pa.binary())],
                    schema=schema,
                )

    return run


def _check(k: int, percent: int):
    """Rows of one hub follow each other, the hub's own text first; gives the exact links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            for part in common.text_slices(batch, "_text"):
                out = []
                sets = shingle_sets(part.column("_text"), k)
                for a, b, s in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), sets):
                    if b == a:
                        hub, own = a, s
                        continue
                    if a != hub:
                        raise ValueError("a pair arrived without its hub")
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    out.append((a, b, 100 * both >= percent * (len(own) + len(s) - both)))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int, most: int = 256) -> DataFrame:
    """Exact check of pairs (a, b). Members of a hub are dealt into parts of about ``most``, each with a copy of the hub's text."""
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    dealt = pairs.join(size, "a").withColumn("part", F.pmod(F.hash("b"), "parts"))
    hubs = dealt.select("a", "part").distinct().withColumn("b", F.col("a"))
    rows = dealt.select("a", "part", "b").unionByName(hubs)
    rows = rows.join(texts.select(F.col("node").alias("b"), "_text"), "b").repartition("a", "part")
    return rows.sortWithinPartitions("a", "part", (F.col("a") != F.col("b"))).select("a", "b", "_text").mapInArrow(_check(k, percent), "a long, b long, linked boolean")


def components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """node, comp (smallest node reachable) of all nodes of the links (a, b).

    Large-star and small-star steps: every node hands its smallest neighbour to the larger and then to
    the smaller ones, so a component becomes a star in a logarithmic number of rounds, written each round.
    """
    edges = stage_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), name)
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_min.select("u", F.col("m").alias("v")))
        edges = stage_table(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    return stars.unionByName(stars.select(F.col("comp").alias("node"), "comp").distinct())


class Tree:
    """Members sorted by component and size; level 0 are leaves, each level above joins eight nodes."""

    def __init__(self, node: np.ndarray, n: np.ndarray, rest: np.ndarray, comp: np.ndarray, bits: np.ndarray):
        self.order = order = np.lexsort((node, n, comp))
        self.node, self.n, self.rest, self.comp, self.bits = node[order], n[order], rest[order], comp[order], bits[order]
        #: Per level: nodes' width, size range, most shingles from the shared one on, OR and AND of the bitmaps, component range.
        self.levels, width = [], LEAF
        while True:
            at = np.arange(0, len(node), width)
            low, high = np.minimum.reduceat(self.n, at), np.maximum.reduceat(self.n, at)
            first, last = np.minimum.reduceat(self.comp, at), np.maximum.reduceat(self.comp, at)
            self.levels.append((width, low, high, np.maximum.reduceat(self.rest, at), np.bitwise_or.reduceat(self.bits, at), np.bitwise_and.reduceat(self.bits, at), first, last))
            if len(at) == 1:
                break
            width *= 8


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int64)


def _possible(percent, low_a, high_a, rest_a, miss_a, low_b, high_b, rest_b, miss_b):
    """Whether sizes in these ranges, with so many bits certainly missing on the other side, can reach the
    threshold: overlap o needs (100 + percent) o >= percent (x + y), and o <= x - miss_a, o <= y - miss_b.
    At the first shared shingle the overlap lies in the ``rest`` from it on."""
    most = np.minimum(np.minimum(high_a - miss_a, high_b - miss_b), np.minimum(rest_a, rest_b))
    near = 100 * np.minimum(high_a, high_b) >= percent * np.maximum(low_a, low_b)
    return near & ((100 + percent) * most >= percent * (low_a + low_b))


def walk(left: Tree, right: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of members of different components that the bounds can't exclude, by dual traversal."""
    depth = max(len(left.levels), len(right.levels)) - 1
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(depth, -1, -1):
        la, lb = min(level, len(left.levels) - 1), min(level, len(right.levels) - 1)
        _, low_a, high_a, rest_a, or_a, and_a, fa, za = left.levels[la]
        _, low_b, high_b, rest_b, or_b, and_b, fb, zb = right.levels[lb]
        miss_a, miss_b = _ones(and_a[a] & ~or_b[b]), _ones(and_b[b] & ~or_a[a])
        same = (fa[a] == za[a]) & (fb[b] == zb[b]) & (fa[a] == fb[b])
        keep = ~same & _possible(percent, low_a[a], high_a[a], rest_a[a], miss_a, low_b[b], high_b[b], rest_b[b], miss_b)
        a, b = a[keep], b[keep]
        if not len(a):
            return
        if level:
            spread_a, spread_b = level <= len(left.levels) - 1, level <= len(right.levels) - 1
            ca = a[:, None] * 8 + np.arange(8) if spread_a else a[:, None]
            cb = b[:, None] * 8 + np.arange(8) if spread_b else b[:, None]
            pa_, pb_ = np.repeat(ca, cb.shape[1], axis=1).ravel(), np.tile(cb, (1, ca.shape[1])).ravel()
            size_a = len(left.levels[min(level - 1, len(left.levels) - 1)][1])
            size_b = len(right.levels[min(level - 1, len(right.levels) - 1)][1])
            keep = (pa_ < size_a) & (pb_ < size_b) & ((pa_ <= pb_) if left is right else True)
            a, b = pa_[keep], pb_[keep]
    inner = np.arange(LEAF)
    for i in range(0, len(a), 256):
        x = (a[i : i + 256, None, None] * LEAF + inner[:, None]) + 0 * inner
        y = (b[i : i + 256, None, None] * LEAF + inner) + 0 * inner[:, None]
        x, y = x.ravel(), y.ravel()
        keep = (x < len(left.n)) & (y < len(right.n)) & ((x < y) if left is right else True)
        x, y = x[keep], y[keep]
        keep = left.comp[x] != right.comp[y]
        x, y = x[keep], y[keep]
        bx, by = left.bits[x], right.bits[y]
        nx, ny = left.n[x], right.n[y]
        keep = _possible(percent, nx, nx, left.rest[x], _ones(bx & ~by), ny, ny, right.rest[y], _ones(by & ~bx))
        yield x[keep], y[keep]


def _candidates(percent: int):
    """Groups (part, home or guest rows) follow each other; gives the pairs of each that survive, with their best similarity."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("best", pa.float64())])

    def judged(rows: dict, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        """Pairs of places whose full bitmaps leave the threshold possible."""
        node, n, bits, earlier, out = rows["node"], rows["n"], rows["bits"], rows["earlier"], []
        for i, j in zip(x.tolist(), y.tolist()):
            if not earlier[i].isdisjoint(earlier[j]):
                continue
            u, v = folded([bits[i], bits[j]])
            most = min(n[i] - int(_ones(u & ~v)), n[j] - int(_ones(v & ~u)))
            if (100 + percent) * most >= percent * (n[i] + n[j]):
                out.append((min(node[i], node[j]), max(node[i], node[j]), most / (n[i] + n[j] - most)))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    def walked(rows: dict) -> Iterator[pa.RecordBatch]:
        bits = folded(rows["bits"])
        home = ~rows["guest"]
        tree = lambda m: (Tree(rows["node"][m], rows["n"][m], rows["rest"][m], rows["comp"][m], bits[m]), np.flatnonzero(m))
        sides = []
        if home.any():
            own = tree(home)
            if not rows["apart"][0]:
                sides.append((own, own))
            if not home.all():
                sides.append((own, tree(~home)))
        for (left, at), (right, of) in sides:
            for x, y in walk(left, right, percent):
                yield judged(rows, at[left.order[x]], of[right.order[y]])

    def single_leaves(group: np.ndarray, rows: dict) -> Iterator[pa.RecordBatch]:
        """Groups that fit a leaf, all at once: their members are compared with the next ones in the group."""
        bits = folded(rows["bits"], BITS // 8)
        n, rest, comp, guest, apart = (rows[c] for c in ("n", "rest", "comp", "guest", "apart"))
        for step in range(1, LEAF):
            x = np.flatnonzero(group[step:] == group[:-step]) if len(group) > step else np.empty(0, np.int64)
            if not len(x):
                return
            y = x + step
            keep = (comp[x] != comp[y]) & np.where(apart[x], guest[x] != guest[y], ~guest[x] & ~guest[y])
            x, y = x[keep], y[keep]
            keep = _possible(percent, n[x], n[x], rest[x], _ones(bits[x] & ~bits[y]), n[y], n[y], rest[y], _ones(bits[y] & ~bits[x]))
            yield judged(rows, x[keep], y[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, lists, rest = ("node", "n", "rest", "comp", "guest", "apart"), ("bits", "earlier"), None
        for batch in _with_end(batches):
            key = np.empty((0, 4), np.int64)
            rows = {c: np.empty(0, bool if c in ("guest", "apart") else np.int64) for c in plain} | {c: [] for c in lists}
            if batch is not None:
                key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("token", "range", "left", "right")], axis=1)
                rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in plain} | {"bits": batch.column("bits").to_pylist()}
                rows["earlier"] = [frozenset(e) for e in batch.column("earlier").to_pylist()]
                rows |= {c: rows[c].astype(np.int64) for c in ("n", "rest")}
            if rest:
                key = np.concatenate([rest[0], key])
                rows = {c: [*rest[1][c], *v] if c in lists else np.concatenate([rest[1][c], v]) for c, v in rows.items()}
            if not len(key):
                continue
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            begins, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
            if batch is not None:
                last = begins[-1]
                rest = key[last:], {c: v[last:] for c, v in rows.items()}
                begins, ends = begins[:-1], ends[:-1]
            small = (ends - begins) <= LEAF
            group = np.repeat(np.arange(len(begins)), ends - begins)
            pick = np.flatnonzero(small[group]) if len(group) else group
            if len(pick):
                yield from single_leaves(group[pick], {c: [v[i] for i in pick] if c in lists else v[pick] for c, v in rows.items()})
            for a, z in zip(begins[~small], ends[~small]):
                yield from walked({c: v[a:z] for c, v in rows.items()})

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _sift(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("best", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (batch.column(c) for c in ("a", "b", "n", "m", "bits", "other"))
            keep, best = [], []
            for size, other, p, q in zip(n.to_pylist(), m.to_pylist(), x.to_pylist(), y.to_pylist()):
                u, v = folded([p, q])
                most = min(size - int(_ones(u & ~v)), other - int(_ones(v & ~u)))
                keep.append((100 + percent) * most >= percent * (size + other))
                best.append(most / (size + other - most))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([a.filter(mask), b.filter(mask), pa.array(best, pa.float64()).filter(mask)], schema=schema)

    return run


def sifted(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and full bitmaps leave the threshold possible, with the best similarity possible."""
    left = sets.select(F.col("node").alias("a"), "n", "bits")
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("other"))
    rows = pairs.join(left, "a").join(right, "b").filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return rows.select("a", "b", "n", "m", "bits", "other").mapInArrow(_sift(percent), "a long, b long, best double")


def early(percent: int) -> Column:
    """Whether a member (n, pos) can be the shorter one of a pair whose first shared shingle this is.

    The overlap of a pair is at least percent (n + m) / (100 + percent), and no less with n in place of the longer m; it lies
    in the n - pos shingles from the first shared one on.
    """
    return F.expr(f"pos <= n - (2 * {percent} * cast(n as long) + {99 + percent}) div {100 + percent}")


def paired(members: DataFrame, percent: int) -> DataFrame:
    """Members (token, pos, node, n, comp) of tokens that may be the first shared one of a pair of components, with the token's count ``c``.

    A member that is not :func:`early` can only be the longer one of such a pair, so it needs an early one of its size or
    a little less. The first shared token of every pair at the threshold keeps both: nothing is lost with the others.
    """
    same = [F.expr(f"bit_xor(xxhash64(node, {seed}))").alias(f"s{seed}") for seed in (0, 1)]
    short = F.when(early(percent), F.col("n"))
    mixed = members.groupBy("token").agg(
        F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("c"), F.min("pos").alias("least"), F.min(short).alias("low"), F.max(short).alias("high"), *same
    )
    # Tokens with the same members stand in the same order in all of them; the first one is enough.
    mixed = mixed.filter("a < b").groupBy("c", "s0", "s1").agg(F.min_by(F.struct("token", "low", "high"), "least").alias("t")).select("t.*", "c").filter("low IS NOT NULL")
    near = (F.col("n") >= F.col("low")) & (100 * F.col("high").cast("long") >= percent * F.col("n").cast("long"))
    return members.join(stage_table(mixed, "mixed"), "token").filter(early(percent) | near).drop("low", "high")


def tree_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs among members (token, pos, node, n, comp) of the same token and different components.

    Up to SIDE members of a token are one group. Beyond, a member is at home in its size range and a
    guest in the next one (similar sizes are at most one range apart), large ranges are dealt into
    blocks of about SIDE members, and every pair of blocks is a tree walk of its own, so no walk
    holds more than two blocks.
    """
    base = -math.log(min(percent, 99) / 100) * (1 + 1e-6)
    # One row per set with its shared shingles in order: each goes with the first ones before it.
    listed = paired(members, percent).groupBy("node").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.array_sort(F.collect_list(F.struct("pos", "token", "c"))).alias("all"))
    listed = listed.withColumn("start", F.transform(F.slice("all", 1, EARLIER), lambda m: m["token"]))
    rows = listed.select("node", "n", "comp", "start", F.posexplode("all").alias("i", "m"))
    rows = rows.select(
        "node", "n", "comp", F.col("m.token").alias("token"), F.when(F.col("m.c") > SIDE, F.floor(F.log("n") / base).cast("int")).otherwise(0).alias("range"),
        (F.col("n") - F.col("m.pos")).alias("rest"), F.slice("start", F.lit(1), F.col("i")).alias("earlier"),
    )
    rows = stage_table(rows, "mixed-members")
    size = rows.groupBy("token", "range").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("blocks"))
    own = rows.join(size, ["token", "range"]).withColumn("block", F.pmod(F.hash("node"), "blocks"))
    below = size.select("token", (F.col("range") + 1).alias("range"), F.col("blocks").alias("below"))
    above = size.select("token", (F.col("range") - 1).alias("range"), F.col("blocks").alias("above"))
    own = own.join(below, ["token", "range"], "left").join(above, ["token", "range"], "left")
    every = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda r, left, right, guest, apart: F.struct(r.alias("range"), left.cast("int").alias("left"), right.cast("int").alias("right"), guest.alias("guest"), apart.alias("apart"))
    b, r = F.col("block"), F.col("range")
    within = F.transform(every("blocks"), lambda o: at(r, F.least(b, o), F.greatest(b, o), b > o, b != o))
    as_home = F.transform(every("below"), lambda o: at(r, b, -1 - o, F.lit(False), F.lit(True)))
    as_guest = F.transform(every("above"), lambda o: at(r + 1, o, -1 - b, F.lit(True), F.lit(True)))
    kept = ["token", "node", "n", "rest", "comp", "earlier"]
    placed = own.select(*kept, F.explode(F.concat(within, as_home, as_guest)).alias("p")).select(*kept, "p.*")
    placed = placed.join(sets.select("node", "bits"), "node").repartition("token", "range", "left", "right").sortWithinPartitions("token", "range", "left", "right")
    placed = placed.select("token", "range", "left", "right", "node", "n", "rest", "comp", "guest", "apart", "bits", "earlier")
    return placed.mapInArrow(_candidates(percent), "a long, b long, best double").dropDuplicates(["a", "b"])


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A 64-bit key of a row's id and text."""
    return F.xxhash64(docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit("")))


def classes_of(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row _id (null: last), _row, n and _first, the (_id, _row) of its component's first document."""
    if not 1 <= percent <= 100 or k < 1:
        raise ValueError("k must be at least 1 and percent between 1 and 100")
    rows = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(common.LAST_ID)).alias("_id"), row_key(docs, id_col, text_col).alias("_row"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"),
    )
    frequent = frequent_shingles(rows, k)
    sets = stage_table(rows.mapInArrow(_sets(k, percent, frequent), "_id long, _row long, n int, node long, tokens array<long>, bits binary"), "sets")
    tokens = sets.filter("n > 0").select("node", "n", F.posexplode("tokens").alias("pos", "token"))
    shared = tokens.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("token")
    members = stage_table(tokens.join(stage_table(shared, "shared"), "token").groupBy("token", "node").agg(F.first("n").alias("n"), F.first("pos").alias("pos")), "members")
    classes = members.select("node").distinct()
    nodes = stage_table(
        sets.select("node", "_row", "n", "bits").join(classes, "node").groupBy("node").agg(F.min("_row").alias("_row"), *[F.first(c).alias(c) for c in ("n", "bits")]), "nodes"
    )

    def texts_of(pairs: DataFrame) -> DataFrame:
        used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        used = stage_table(nodes.select("node", "_row").join(used, "node"), "used")
        some = common.likely(rows.select("_row", "_text"), "_row", used)
        return stage_table(some.join(used, "_row").select("node", "_text").dropDuplicates(["node"]), "texts")

    def links_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        return stage_table(verified(pairs, texts, k, percent).filter("linked").select("a", "b"), "links")

    def across(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """Pairs of different components, with these as ca and cb."""
        left, right = (known.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
        both = pairs.join(left, "a", "left").join(right, "b", "left")
        return both.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).filter("ca != cb")

    # The leader of a shingle is its most central member, whose shingles most others have: the original among its copies.
    often = stage_table(members.groupBy("token").agg(F.count(F.lit(1)).alias("c")), "often")
    central = members.join(often, "token").groupBy("node").agg((F.sum("c") / F.first("n")).alias("s"))
    leaders = members.join(central, "node").groupBy("token").agg(F.max_by("node", F.struct("s", "node")).alias("leader"))
    best = members.join(stage_table(leaders, "leaders"), "token").filter("node != leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("c"))
    best = best.groupBy("node").agg(F.max_by("leader", F.struct("c", "leader")).alias("a")).select("a", F.col("node").alias("b"))
    best = stage_table(sifted(best, nodes, percent).select("a", "b"), "leaders")
    links = links_of(best, texts_of(best))
    known = components(links)
    labelled = members.select("token", "pos", "node", "n").join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    pairs = stage_table(tree_pairs(stage_table(labelled, "labelled"), nodes, percent), "pairs")
    texts = texts_of(pairs)
    # The most promising pair of each set first: that links most of what is to be linked.
    for _ in range(PROMISING):
        one = across(pairs, known)
        ends = one.select(F.col("a").alias("node"), "a", "b", "best").unionByName(one.select(F.col("b").alias("node"), "a", "b", "best"))
        top = ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("best", "a", "b")).alias("p")).select("p.*").distinct()
        top = stage_table(top, "promising")
        links = links.unionByName(links_of(top, texts))
        known = components(links)
        pairs = stage_table(across(pairs, known).select("a", "b", "best").join(top, ["a", "b"], "left_anti"), "pairs")
    rest = stage_table(across(pairs, known).select("a", "b"), "rest")
    final = components(links.unionByName(links_of(rest, texts)))

    me = F.struct("_id", "_row")
    every = sets.select("_id", "_row", "n", "node")
    of = every.filter("n > 0").join(final, "node", "left").withColumn("_c", F.coalesce("comp", "node"))
    first = of.groupBy("_c").agg(F.min(me).alias("_first"))
    linked = of.join(first, "_c").select("_id", "_row", "n", "_first")
    # Texts without words are linked with nothing, so they have no class to meet in.
    return linked.unionByName(every.filter("n = 0").select("_id", "_row", "n", me.alias("_first")))


def join(docs: DataFrame, k: int = 4, percent: int = 85, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; linked when 100 * intersection >= percent * union."""
    of, none = classes_of(docs, k, percent, id_col, text_col), F.lit(common.LAST_ID)
    return of.select(F.nullif("_id", none).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.nullif(F.col("_first._id"), none).alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component, by id and then by a hash of the text.

    Texts without words stay; rows that repeat both id and text stand or fall together.
    """
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    gone = classes_of(docs, k, percent, id_col, text_col).filter("_row != _first._row").select("_row").distinct()
    rows = docs.toDF(*own)
    key = row_key(rows, own[names.index(id_col)], own[names.index(text_col)])
    return rows.withColumn("_row", key).join(gone, "_row", "left_anti").select(*own).toDF(*names)
