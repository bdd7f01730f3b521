"""Gradient boosting of many fits at once over binned rows.

Every fit is a pair of a group (say fold and horizon) and a feature set. A round grows one tree per fit,
level by level: one pass over the rows sums first- and second-order residuals per fit, node, feature and
bin; the sums of the tasks meet by fit, where the best split of every node is picked; only splits (one row per fit
and node) reach the driver. So a pass serves all fits, and its traffic depends on fits, nodes and bins, not on
rows. The rows' scores are written every ``STAGE`` rounds; in between, tasks apply the trees grown since.
A group whose training rows are one block (``BLOCK_ROWS``) needs no passes: each of its fits meets in one task, which sums
and splits in the same way for all rounds, so small groups take one job in place of one per round and level.

Losses: ``squared``, and ``poisson`` with log link, whose leaves are estimated anew as the logarithm of
observed over expected counts, the exact minimum in each leaf. A missing value is imputed before binning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import stage_table

#: Rounds between two written scores; rows of a block that one task sums before its sums travel.
STAGE, BLOCK_ROWS = 10, 1 << 16
#: Rows that pass all trees at once when they are scored.
ROWS_AT_ONCE = 1 << 10
#: Least share of expected counts a leaf may be scaled to, which keeps the logarithm finite.
LEAST = 1e-6
#: A split on its way to the driver: its fit, round and place in the tree, and the sums left of it and in all.
SPLIT = ("fit", "round", "node", "feature", "cut", "gain", "gl", "hl", "g", "h", "loss")
SPLIT_KINDS = ", ".join(f"{n} {'int' if i < 5 else 'double'}" for i, n in enumerate(SPLIT))


@dataclass(frozen=True)
class Boosting:
    """Parameters of a boosted family."""

    loss: str = "squared"
    rounds: int = 100
    depth: int = 3
    rate: float = 0.08
    penalty: float = 0.0
    min_child: float = 20.0


@dataclass
class Forest:
    """Trees of all fits as arrays: [group, set, round, node] splits and [group, set, round, leaf] values."""

    base: np.ndarray
    sets: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    #: Per round the training loss of every fit before the round, and the gain of each split.
    losses: list[np.ndarray] = field(default_factory=list)
    gain: np.ndarray | None = None

    def grown(self, group: np.ndarray, bins: np.ndarray, s: int, first: int, last: int, depth: int) -> np.ndarray:
        """Sum of the values of rounds first to last - 1 for rows of binned features."""
        out, trees = np.zeros(len(group)), np.arange(last - first)[:, None]
        for one in np.unique(group) if last > first else ():
            mine = np.flatnonzero(group == one)
            feature, cut, value = (a[one, s, first:last] for a in (self.feature, self.cut.astype(np.uint8), self.value))
            # a block of rows passes all trees of its group at once; leaves are added in the order of the rounds
            for begin in range(0, len(mine), ROWS_AT_ONCE):
                at = mine[begin : begin + ROWS_AT_ONCE]
                columns, rows = np.ascontiguousarray(bins[at].T), np.arange(len(at))
                node = np.zeros((last - first, len(at)), np.int64)
                for level in range(depth):
                    splits = slice((1 << level) - 1, (2 << level) - 1)
                    right = columns[feature[:, splits]] > cut[:, splits, None]
                    node = 2 * node + right.ravel()[(trees * right.shape[1] + node) * len(at) + rows]
                out[at] = np.add.reduce(value.ravel()[trees * value.shape[1] + node], axis=0)
        return out

    def node(self, group: np.ndarray, bins: np.ndarray, rows: np.ndarray, s: int, t: int, depth: int) -> np.ndarray:
        """Place of each row in its level after ``depth`` splits of one tree."""
        at = np.zeros(len(group), np.int64)
        for level in range(depth):
            split = at + (1 << level) - 1
            at = 2 * at + (bins[rows, self.feature[group, s, t, split]] > self.cut[group, s, t, split])
        return at


def _rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    binned = batch.column("bins")
    bins = np.frombuffer(b"".join(binned.to_pylist()), np.uint8).reshape(len(batch), width)
    margins = batch.column("margin")
    flat = margins.flatten().to_numpy()
    return batch.column("g").to_numpy().astype(np.int64), batch.column("y").to_numpy().astype(float), bins, flat.reshape(len(batch), -1)


def residuals(loss: str, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Negative gradient, curvature and loss of each row."""
    if loss == "squared":
        return y - margin, np.ones(len(y)), (y - margin) ** 2
    mean = np.exp(margin)
    with np.errstate(divide="ignore", invalid="ignore"):
        log = np.where(y > 0, y * np.log(np.where(y > 0, y, 1.0) / mean), 0.0)
    return y - mean, mean, 2 * (log - y + mean)


class Cells:
    """Sums of weights by node and bin over the columns of one set."""

    def __init__(self, used: np.ndarray, sizes: np.ndarray):
        own = sizes[used]
        self.total = int(own.sum())
        starts = np.concatenate(([0], np.cumsum(own)))[:-1].astype(np.int64)
        wide, two = own > 2, own == 2
        self.wide, self.wide_starts = used[wide], starts[wide]
        self.two, self.two_starts = used[two], starts[two]

    def places(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What :meth:`sums` reads of binned rows, the same for all nodes and weights."""
        return bins[:, self.wide] + self.wide_starts, bins[:, self.two].astype(float)

    def sums(self, places: tuple[np.ndarray, np.ndarray], node: np.ndarray, weight: np.ndarray, nodes: int) -> np.ndarray:
        """[node, bin]; columns with two bins by one product, the others by counting."""
        many, ones = places
        out = np.zeros((nodes, self.total))
        if many.shape[1]:
            at = many + (node * self.total)[:, None]
            out += np.bincount(at.ravel(), np.repeat(weight, many.shape[1]), nodes * self.total).reshape(out.shape)
        if ones.shape[1]:
            by_node = np.zeros((len(node), nodes))
            by_node[np.arange(len(node)), node] = weight
            right = by_node.T @ ones
            out[:, self.two_starts + 1] = right
            out[:, self.two_starts] = by_node.sum(axis=0)[:, None] - right
        return out


def _sums(forest: Forest, p: Boosting, sizes: np.ndarray, first: int, t: int, level: int):
    """Per fit the sums of residuals and curvatures by node and bin, and in front the fit's loss."""
    nodes, width = 1 << level, len(sizes)
    cells = [Cells(used, sizes) for used in forest.sets]
    schema = pa.schema([("fit", pa.int32()), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            group, y, bins, margin = _rows(batch, width)
            rows = np.arange(len(y))
            for s in range(len(forest.sets)):
                score = margin[:, s] + forest.grown(group, bins, s, first, t, p.depth)
                g, h, loss = residuals(p.loss, y, score)
                node = forest.node(group, bins, rows, s, t, level)
                for one in np.unique(group):
                    mine = group == one
                    places = cells[s].places(bins[mine])
                    sums = [cells[s].sums(places, node[mine], w[mine], nodes).ravel() for w in (g, h)]
                    sums = np.concatenate(([loss[mine].sum()], *sums))
                    fit = int(one) * len(forest.sets) + s
                    found[fit] = found[fit] + sums if fit in found else sums
        yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], schema=schema)

    return run


def _whole_fits(sets: Sequence[np.ndarray], base: np.ndarray, p: Boosting, sizes: np.ndarray):
    """All rounds of the fit whose training rows, at most one block, meet in a task: the splits of its trees."""
    cells = [Cells(used, sizes) for used in sets]
    schema = pa.schema([(n, pa.int32() if n in SPLIT[:5] else pa.float64()) for n in SPLIT])

    def run(table: pa.Table) -> pa.Table:
        fit = table.column("fit")[0].as_py()
        group, s = divmod(fit, len(sets))
        y = table.column("y").to_numpy().astype(float)
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(len(y), len(sizes))
        places, rows, out = cells[s].places(bins), np.arange(len(y)), []
        margin = np.full(len(y), base[group])
        for t in range(p.rounds):
            g, h, loss = residuals(p.loss, y, margin)
            cost, node = float(loss.sum()), np.zeros(len(y), np.int64)
            for level in range(p.depth):
                both = np.stack([cells[s].sums(places, node, w, 1 << level) for w in (g, h)])
                found = [best_split(both[:, k], sets[s], sizes, p) for k in range(1 << level)]
                out += [(fit, t, (1 << level) - 1 + k, *x, cost) for k, x in enumerate(found)]
                feature, cut = np.array([x[0] for x in found]), np.array([x[1] for x in found])
                node = 2 * node + (bins[rows, feature[node]] > cut[node])
            margin = margin + np.array([v for x in found for v in leaf_values(x, p)])[node]
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def best_split(sums: np.ndarray, used: np.ndarray, sizes: np.ndarray, p: Boosting) -> tuple:
    """Feature, cut and gain of a node's best split with its sums left and in all; sums is [2, bins of the used features]."""
    g, h = sums
    if not len(g):
        return 0, 255, 0.0, 0.0, 0.0, 0.0, 0.0
    ends = np.cumsum(sizes[used])
    begins = ends - sizes[used]
    gc, hc = np.cumsum(g), np.cumsum(h)
    before = np.repeat(np.where(begins > 0, gc[begins - 1], 0.0), sizes[used]), np.repeat(np.where(begins > 0, hc[begins - 1], 0.0), sizes[used])
    gl, hl = gc - before[0], hc - before[1]
    total_g, total_h = gl[ends[-1] - 1], hl[ends[-1] - 1]
    gr, hr = total_g - gl, total_h - hl
    ok = (hl >= p.min_child) & (hr >= p.min_child)
    ok[ends - 1] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        both = gl**2 / (hl + p.penalty) + gr**2 / (hr + p.penalty)
        gain = both - total_g**2 / (total_h + p.penalty)
    gain = np.where(ok & np.isfinite(gain), gain, -np.inf)
    at = int(np.argmax(gain))
    # Splits that part the rows alike differ by the order of a sum only: the first of them is taken, whatever that order.
    if np.isfinite(gain[at]):
        at = int(np.argmax(gain >= gain[at] - 1e-9 * max(1.0, both[at])))
    if gain[at] <= 1e-9 * max(1.0, total_h):
        return 0, 255, 0.0, total_g, total_h, total_g, total_h
    f = int(np.searchsorted(ends, at, side="right"))
    return int(used[f]), at - int(begins[f]), float(gain[at]), gl[at], hl[at], total_g, total_h


def _splits(forest: Forest, p: Boosting, sizes: np.ndarray, t: int, level: int):
    """The best split of every node of the fits that meet in a task."""
    schema = pa.schema([(n, pa.int32() if n in SPLIT[:5] else pa.float64()) for n in SPLIT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for fit, raw in zip(batch.column("fit").to_pylist(), batch.column("sums").to_pylist()):
                sums = np.frombuffer(raw)
                found[fit] = found[fit] + sums if fit in found else sums
        rows = []
        for fit, sums in found.items():
            used = forest.sets[fit % len(forest.sets)]
            by_node = sums[1:].reshape(2, 1 << level, -1)
            for node in range(1 << level):
                rows.append((fit, t, (1 << level) - 1 + node, *best_split(by_node[:, node], used, sizes, p), sums[0]))
        yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def leaf_value(g: float, h: float, p: Boosting) -> float:
    if h <= 0:
        return 0.0
    if p.loss == "poisson":
        return p.rate * float(np.log(max((g + h) / h, LEAST)))
    return p.rate * float(g / (h + p.penalty))


def leaf_values(split: Sequence[float], p: Boosting) -> tuple[float, float]:
    """Values left and right of a split of the last level: feature, cut, gain, gl, hl, g, h."""
    _, cut, _, gl, hl, g, h = split
    return leaf_value(gl, hl, p), leaf_value(g - gl, h - hl, p) if cut < 255 else 0.0


def _enter(forest: Forest, p: Boosting, r) -> None:
    """Puts a split into its tree."""
    g, s = divmod(r.fit, len(forest.sets))
    at = g, s, r.round, r.node
    forest.feature[at], forest.cut[at], forest.gain[at] = r.feature, r.cut, r.gain
    forest.losses[r.round][g, s] = r.loss
    last = r.node - (1 << (p.depth - 1)) + 1
    if last >= 0:
        forest.value[g, s, r.round, 2 * last : 2 * last + 2] = leaf_values((r.feature, r.cut, r.gain, r.gl, r.hl, r.g, r.h), p)


def _apply(forest: Forest, width: int, first: int, last: int, depth: int, names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            group, _, bins, margin = _rows(batch, width)
            score = np.stack([margin[:, s] + forest.grown(group, bins, s, first, last, depth) for s in range(len(forest.sets))], axis=1)
            edges = pa.array(np.arange(len(batch) + 1) * len(forest.sets), pa.int32())
            columns = [pa.ListArray.from_arrays(edges, pa.array(score.ravel())) if n == "margin" else batch.column(n) for n in names]
            yield pa.record_batch(columns, names=list(names))

    return run


def fit_many(rows: DataFrame, groups: int, sets: Sequence[Sequence[int]], sizes: Sequence[int], p: Boosting) -> tuple[Forest, DataFrame]:
    """Boosts every (group, set) on the training rows and scores all rows.

    ``rows`` has g (group number), train (boolean), y, bins (one byte per feature, below ``sizes``) and key columns;
    the result keeps them and adds ``margin``, one score per set.
    """
    size = np.array(sizes, np.int64)
    means = {r.g: (r.m, r.n) for r in rows.filter("train").groupBy("g").agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    base = np.array([means.get(g, (0.0, 0))[0] for g in range(groups)], float)
    if p.loss == "poisson":
        base = np.log(np.maximum(base, LEAST))
    shape = (groups, len(sets), p.rounds)
    inner = (1 << p.depth) - 1
    forest = Forest(base, [np.array(s, np.int64) for s in sets], np.zeros((*shape, inner), np.int32), np.full((*shape, inner), 255, np.int32), np.zeros((*shape, inner + 1)), gain=np.zeros((*shape, inner)))
    start = F.element_at(F.lit(base.tolist()), F.col("g") + 1)
    scored = rows.withColumn("margin", F.array_repeat(start, len(sets)))
    forest.losses = [np.zeros((groups, len(sets))) for _ in range(p.rounds)]
    per_group = [max(1, -(-means.get(g, (0, 0))[1] // BLOCK_ROWS)) for g in range(groups)]
    small, large = ([g for g in means if (per_group[g] == 1) == one] for one in (True, False))
    part = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("bins", "y", "train")]), F.element_at(F.lit(per_group), F.col("g") + 1))
    scored = stage_table(scored.repartition("g", part), "boosting")
    kinds = ", ".join(f"`{n}` {t}" for n, t in scored.dtypes)
    if small:
        fit = F.explode(F.sequence(F.col("g") * len(sets), F.col("g") * len(sets) + len(sets) - 1)).alias("fit")
        fits = scored.filter("train").filter(F.col("g").isin(small)).select(fit, "y", "bins").repartitionByRange(len(small) * len(sets), "fit")
        for r in fits.groupBy("fit").applyInArrow(_whole_fits(forest.sets, base, p, size), SPLIT_KINDS).collect():
            _enter(forest, p, r)
    first = 0
    for t in range(p.rounds if large else 0):
        if t - first == STAGE:
            scored = stage_table(scored.mapInArrow(_apply(_upto(forest, t), len(size), first, t, p.depth, scored.columns), kinds), "boosting")
            first = t
        for level in range(p.depth):
            now = _upto(forest, t + 1)
            train = scored.filter("train").filter(F.col("g").isin(large)).select("g", "y", "bins", "margin")
            sums = train.mapInArrow(_sums(now, p, size, first, t, level), "fit int, sums binary").repartition("fit")
            for r in sums.mapInArrow(_splits(now, p, size, t, level), SPLIT_KINDS).collect():
                _enter(forest, p, r)
    out = scored.mapInArrow(_apply(_upto(forest, p.rounds), len(size), first, p.rounds, p.depth, scored.columns), kinds)
    return forest, stage_table(out, "boosting")


def score(rows: DataFrame, forest: Forest, sizes: Sequence[int], p: Boosting, keep: Sequence[str]) -> DataFrame:
    """``keep`` of any rows with g and bins, and ``margin``, one score per set."""
    start = F.element_at(F.lit(forest.base.tolist()), F.col("g") + 1)
    names = list(dict.fromkeys([*keep, "g", "y", "bins"]))
    some = rows.select(*names).withColumn("margin", F.array_repeat(start, len(forest.sets)))
    kinds = ", ".join(f"`{n}` {t}" for n, t in some.dtypes)
    return some.mapInArrow(_apply(_upto(forest, p.rounds), len(sizes), 0, p.rounds, p.depth, some.columns), kinds).select(*keep, "margin")


def _upto(forest: Forest, last: int) -> Forest:
    """The trees of the last rounds that tasks need, without statistics."""
    return Forest(forest.base, forest.sets, forest.feature[:, :, :last].copy(), forest.cut[:, :, :last].copy(), forest.value[:, :, :last].copy())


def importance(forest: Forest, names: Sequence[str]) -> list[tuple[int, int, str, float]]:
    """(group, set, feature, share of the gain) of every feature that splits."""
    out = []
    for g in range(forest.feature.shape[0]):
        for s in range(forest.feature.shape[1]):
            total = np.bincount(forest.feature[g, s].ravel(), forest.gain[g, s].ravel(), len(names))
            if total.sum() > 0:
                out += [(g, s, names[f], float(total[f] / total.sum())) for f in np.flatnonzero(total > 0)]
    return out


def binned(rows: DataFrame, values: str, cuts: np.ndarray) -> DataFrame:
    """Rows with ``bins`` in place of the array ``values``: per feature the number of cuts of the group below the value.

    ``cuts`` is [group, feature, cut], filled up with infinity.
    """
    keep = [c for c in rows.columns if c != values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(values).flatten().to_numpy().reshape(len(batch), -1)
            group, out = batch.column("g").to_numpy(), np.empty(x.shape, np.uint8)
            for g in np.unique(group):
                mine = np.flatnonzero(group == g)
                found = np.empty((x.shape[1], len(mine)), np.uint8)
                for f, own in enumerate(np.ascontiguousarray(x[mine].T)):
                    found[f] = np.searchsorted(cuts[g, f], own, side="left")
                out[mine] = found.T
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array([r.tobytes() for r in out], pa.binary())], names=[*keep, "bins"])

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in rows.select(*keep).dtypes) + ", bins binary")
