"""Ranked lexical search of documents for benchmark items with a document FP-tree.

Only terms that occur in an item matter to a score, so every document is first restricted to them. In a task
the restricted vectors, with terms in descending order of document frequency, are inserted into a
prefix tree: documents that begin with the same frequent terms share a path. Runs of a path without a
branch are one node, and subtrees of at most ``LEAF`` documents are one leaf. A node keeps for each term
the largest count in its subtree, the smallest length norm m and the smallest id. Since a term's
score grows with its count and falls with m, these bound every score below the node, and each item
walks the tree depth first, best child first, and leaves out subtrees that cannot enter its best ``top``.

Scores are sums of integers and exact. Documents without a term are not ranked; items without a term
that occurs in a document give no rows; rows with equal ids are ranked each; null ids come after all others.
Items with equal ids are ranked together as rows of that id, one list per item. Items travel to the tasks in lists whose texts stay
below ``broadcast_bytes``, one pass over the documents each. Terms are compared by two 64-bit hashes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm import common
from panelspark.llm.decontaminate import parts
from panelspark.session import stage_table

#: Documents of a leaf; cells (documents x terms) of one tree; documents of one tree.
LEAF, CELLS, DOCUMENTS = 32, 1 << 24, 8192
#: Bytes that belong to terms: ASCII letters and digits, and all of other characters.
SOLID = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every term of the texts, and where each text's terms begin."""
    data, offsets = common.utf8(texts)
    data = common.lower_ascii(data).astype(np.uint8)
    starts, ends, bounds = common.words(data, offsets, SOLID[data])
    return common.span_hashes(data, starts, ends), common.span_hashes(data, starts, ends, 1), bounds


def vocabulary(items: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[Counter]]:
    """Distinct terms of the items, by their hashes, and each item's terms with their counts."""
    first, second, bounds = term_hashes(pa.array([t for _, t in items], pa.string()))
    known, at = np.unique(first, return_index=True)
    places = np.searchsorted(known, first)
    return known, second[at], [Counter(places[a:z].tolist()) for a, z in zip(bounds[:-1], bounds[1:])]


def _restricted(known: np.ndarray, check: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch, "_text"):
                first, second, bounds = term_hashes(part.column("_text"))
                at = np.minimum(np.searchsorted(known, first), max(len(known) - 1, 0))
                hit = np.flatnonzero((known[at] == first) & (check[at] == second)) if len(known) else np.empty(0, np.int64)
                row = np.searchsorted(bounds, hit, side="right") - 1
                pairs, n = np.unique(row * max(len(known), 1) + at[hit], return_counts=True)
                edges = np.searchsorted(pairs, np.arange(len(part) + 1) * max(len(known), 1)).astype(np.int32)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(edges, pa.array(pairs % max(len(known), 1), pa.int32())), pa.ListArray.from_arrays(edges, pa.array(n, pa.int32()))],
                    schema=schema,
                )

    return run


class Tree:
    """Prefix tree of restricted vectors; ``rank`` orders the terms by falling document frequency."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, edges: np.ndarray, terms: np.ndarray, counts: np.ndarray, rank: np.ndarray):
        row = np.repeat(np.arange(len(ids)), np.diff(edges))
        order = np.lexsort((rank[terms], row))
        self.path, counts, row = rank[terms][order], counts[order], row[order]
        keys = [self.path[a:z].astype(">u4").tobytes() for a, z in zip(edges[:-1], edges[1:])]
        by = sorted(range(len(ids)), key=lambda i: (keys[i], ids[i]))
        place = np.empty(len(ids), np.int64)
        place[by] = np.arange(len(ids))
        self.ids, self.m = ids[by], m[by]
        self.begin, self.size = edges[:-1][by], np.diff(edges)[by]
        self.cells = np.zeros((len(ids), len(rank)), np.uint32)
        self.cells[place[row], self.path] = counts
        self.low, self.high, self.children = [], [], []
        self._grow()
        nodes = len(self.low)
        self.most, self.least_m, self.least_id = np.zeros((nodes, len(rank)), np.uint32), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        for node in range(nodes - 1, -1, -1):
            of, a, z = self.children[node], self.low[node], self.high[node]
            self.most[node] = self.most[of].max(axis=0) if of else self.cells[a:z].max(axis=0)
            self.least_m[node], self.least_id[node] = self.m[a:z].min(), self.ids[a:z].min()

    def _node(self, low: int, high: int) -> int:
        self.low.append(low)
        self.high.append(high)
        self.children.append([])
        return len(self.low) - 1

    def _grow(self) -> None:
        """Nodes over ranges of the sorted paths; children come after their parent."""
        todo = [(self._node(0, len(self.ids)), 0)]
        while todo:
            node, depth = todo.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= LEAF:
                continue
            n = min(self.size[low], self.size[high - 1]) - depth
            a, z = self.begin[low] + depth, self.begin[high - 1] + depth
            apart = np.flatnonzero(self.path[a : a + n] != self.path[z : z + n])
            depth += int(apart[0]) if len(apart) else int(n)
            here = np.arange(low, high)
            term = np.where(self.size[here] > depth, self.path[np.minimum(self.begin[here] + depth, len(self.path) - 1)], -1)
            cuts = [low, *(low + 1 + np.flatnonzero(term[1:] != term[:-1])).tolist(), high]
            if len(cuts) == 2:  # equal paths to their end
                cuts = [*range(low, high, LEAF), high]
            start = low
            for a, z in zip(cuts[:-1], cuts[1:]):
                if z - a > LEAF:
                    if start < a:
                        self.children[node].append(self._node(start, a))
                    self.children[node].append(self._node(a, z))
                    todo.append((self.children[node][-1], depth + 1))
                    start = z
                elif z - start > LEAF:
                    self.children[node].append(self._node(start, a))
                    start = a
            if start < high:
                self.children[node].append(self._node(start, high))

    def best(self, columns: np.ndarray, weights: np.ndarray, top: int, kept: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """``kept`` (negative score, id) with this tree's documents, the first ``top`` in order."""

        def scores(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
            tf = counts[:, columns].astype(np.int64)
            return ((1_000_000_000 * tf) // (1000 * tf + 12 * m[:, None])) @ weights

        bound, stack = scores(self.most, self.least_m), [0]
        while stack:
            node = stack.pop()
            last = kept[-1] if len(kept) == top else (0, -1)
            if (-int(bound[node]), int(self.least_id[node])) >= last and (len(kept) == top or bound[node] <= 0):
                continue
            if self.children[node]:
                of = np.array(self.children[node])
                stack.extend(of[np.lexsort((-self.least_id[of], bound[of]))].tolist())
                continue
            a, z = self.low[node], self.high[node]
            found = scores(self.cells[a:z], self.m[a:z])
            some = np.flatnonzero(found >= max(1, -last[0]))
            if len(some):
                kept = sorted(kept + list(zip((-found[some]).tolist(), self.ids[a:z][some].tolist())))[:top]
        return kept


def _ranked(items: list[tuple[int, Counter]], rank: np.ndarray, weights: dict[int, int], n_docs: int, n_terms: int, top: int):
    schema = pa.schema([("_item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
    queries = []
    for number, terms in items:
        used = [t for t in terms if weights.get(t, 0) > 0]
        if used:
            queries.append((number, rank[used], np.array([weights[t] * terms[t] for t in used], np.int64)))
    limit = max(1, min(DOCUMENTS, CELLS // max(len(rank), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {number: [] for number, _, _ in queries}
        for batch in batches:
            for start in range(0, len(batch), limit):
                part = batch.slice(start, limit)
                n = part.column("n").to_pylist()
                m = np.array([75 + 25 * x * n_docs // n_terms for x in n], np.int64)
                terms, counts = part.column("terms"), part.column("counts")
                edges = np.concatenate(([0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
                tree = Tree(part.column("_id").to_numpy(), m, edges, terms.flatten().to_numpy(), counts.flatten().to_numpy(), rank)
                for number, columns, weight in queries:
                    kept[number] = tree.best(columns, weight, top, kept[number])
        rows = [(number, doc_id, -score) for number, best in kept.items() for score, doc_id in best]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def _search(docs: DataFrame, items: list[tuple], top: int) -> DataFrame:
    """Best documents of one list of items, as item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    known, check, terms = vocabulary(items)
    vectors = stage_table(docs.mapInArrow(_restricted(known, check), "doc_id long, n long, terms array<int>, counts array<int>").filter("n > 0"), "vectors")
    total = vectors.agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    # At most one row per term of the items.
    df = {r.t: r.c for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).collect()}
    rank = np.empty(len(known), np.int64)
    rank[sorted(range(len(known)), key=lambda t: (-df.get(t, 0), t))] = np.arange(len(known))
    weights = {t: math.floor(1000 * math.log((2 * total.N + 2) / (2 * c + 1))) for t, c in df.items()}
    some = vectors.filter(F.size("terms") > 0).select(F.coalesce("doc_id", F.lit(common.LAST_ID)).alias("_id"), "n", "terms", "counts")
    found = some.mapInArrow(_ranked(list(enumerate(terms)), rank, weights, total.N, max(total.L, 1), top), "_item int, doc_id long, score long")
    # Every task sends at most ``top`` rows per item; they meet in two steps.
    for by in (["_item", "_part"], ["_item"]):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("_part", F.pmod(F.hash("doc_id"), F.lit(64))) if "_part" in by else found
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = F.create_map(*[x for k, (i, _) in enumerate(items) for x in (F.lit(k), F.lit(i).cast("long"))])
    return found.select(names[F.col("_item")].alias("item_id"), "rank", F.nullif("doc_id", F.lit(common.LAST_ID)).alias("doc_id"), "score")


def search(
    docs: DataFrame, benchmark: DataFrame, *, top: int = 20, broadcast_bytes: int = 256 << 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score of every item's ``top`` documents with a score above 0."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    out = None
    for items in parts(benchmark, broadcast_bytes, item_col, item_text_col):
        if items:
            found = _search(rows, items, top)
            out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
