"""Penalised linear and Poisson regressions of many fits at once, by sums over rows.

A fit is a pair of a group (say fold and horizon) and a feature set. Each task sums the weighted cross products
of its rows for every fit, the sums of the tasks meet by fit, and the Newton step is solved there; the driver
holds coefficients only. Ridge is one step from zero; Poisson (log link) repeats until no step is larger than ``TOL``.

Columns: an unpenalised intercept, numeric values standardised with the group's mean and scale, indicators
as they are, and one column per category level. ridge minimises sum (y - Xb)^2 + alpha |b|^2, poisson
the mean of mu - y log(mu) plus alpha / 2 |b|^2.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOL, STEPS = 1e-9, 50


@dataclass(frozen=True)
class Design:
    """Numeric features, then their indicators, then category levels; the columns each set uses."""

    mean: np.ndarray
    scale: np.ndarray
    levels: int
    sets: tuple[tuple[int, ...], ...]

    @property
    def width(self) -> int:
        return 2 * self.mean.shape[1] + self.levels

    def matrix(self, batch: pa.RecordBatch, group: np.ndarray) -> np.ndarray:
        """Intercept and all columns of the rows."""
        n, p = len(batch), self.mean.shape[1]
        out = np.zeros((n, 1 + self.width))
        out[:, 0] = 1.0
        x = batch.column("x").flatten().to_numpy().reshape(n, 2 * p)
        out[:, 1 : 1 + p] = (x[:, :p] - self.mean[group]) / self.scale[group]
        out[:, 1 + p : 1 + 2 * p] = x[:, p:]
        level = batch.column("level").to_numpy(zero_copy_only=False).astype(np.int64)
        known = np.flatnonzero(level >= 0)
        out[known, 1 + 2 * p + level[known]] = 1.0
        return out

    def columns(self, s: int) -> np.ndarray:
        return np.concatenate(([0], np.array(self.sets[s], np.int64) + 1))


def _sums(design: Design, loss: str, beta: np.ndarray | None):
    """Per fit: rows, gradient and curvature at the present coefficients."""
    schema = pa.schema([("fit", pa.int32()), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            group, y = batch.column("g").to_numpy().astype(np.int64), batch.column("y").to_numpy()
            every = design.matrix(batch, group)
            for g in np.unique(group):
                mine = group == g
                for s in range(len(design.sets)):
                    x, b = every[mine][:, design.columns(s)], beta[g, s][design.columns(s)]
                    mean = x @ b if loss == "squared" else np.exp(x @ b)
                    weighted = x if loss == "squared" else x * mean[:, None]
                    sums = np.concatenate(([float(mine.sum())], x.T @ (y[mine] - mean), (x.T @ weighted).ravel()))
                    fit = int(g) * len(design.sets) + s
                    found[fit] = found[fit] + sums if fit in found else sums
        yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], schema=schema)

    return run


def _steps(design: Design, loss: str, beta: np.ndarray, alpha: float):
    """Newton step of the fits that meet in a task; ``slope`` is the largest entry of the penalised gradient."""
    schema = pa.schema([("fit", pa.int32()), ("n", pa.float64()), ("slope", pa.float64()), ("step", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for fit, raw in zip(batch.column("fit").to_pylist(), batch.column("sums").to_pylist()):
                sums = np.frombuffer(raw)
                found[fit] = found[fit] + sums if fit in found else sums
        rows = []
        for fit, sums in found.items():
            g, s = divmod(fit, len(design.sets))
            at = design.columns(s)
            b, k, n = beta[g, s][at], len(at), sums[0]
            held = alpha * (n if loss == "poisson" else 1.0) * (at > 0)
            slope = sums[1 : 1 + k] - held * b
            step = np.linalg.lstsq(sums[1 + k :].reshape(k, k) + np.diag(held), slope, rcond=None)[0]
            rows.append((fit, n, float(np.abs(slope).max() / n), step.tolist()))
        yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


@dataclass
class Coefficients:
    """[group, set, intercept and columns] coefficients, and per fit its rows and the gradient that is left, per row."""

    beta: np.ndarray
    rows: np.ndarray
    slope: np.ndarray


def fit_many(rows: DataFrame, groups: int, design: Design, loss: str, alpha: float = 1.0) -> Coefficients:
    """Fits every (group, set) on ``rows`` with g, train, y, x (values, then indicators) and level (-1: none)."""
    train = rows.filter("train").select("g", "y", "x", "level")
    out = Coefficients(np.zeros((groups, len(design.sets), 1 + design.width)), *np.zeros((2, groups, len(design.sets))))
    if loss == "poisson":
        from pyspark.sql import functions as F

        for r in train.groupBy("g").agg(F.avg("y").alias("m")).collect():
            out.beta[r.g, :, 0] = np.log(max(r.m, 1e-9))
    for _ in range(STEPS):
        now = out.beta.copy()
        sums = train.mapInArrow(_sums(design, loss, now), "fit int, sums binary").repartition("fit")
        largest = 0.0
        for r in sums.mapInArrow(_steps(design, loss, now, alpha), "fit int, n double, slope double, step array<double>").collect():
            g, s = divmod(r.fit, len(design.sets))
            step = np.array(r.step)
            # A step of a log-linear fit that would multiply a mean by more than e^4 is shortened.
            step *= min(1.0, 4.0 / max(float(np.abs(step).max()), 1e-300)) if loss == "poisson" else 1.0
            out.beta[g, s][design.columns(s)] += step
            out.rows[g, s], out.slope[g, s] = r.n, r.slope
            largest = max(largest, float(np.abs(step).max()))
        # The pass after a ridge step only measures the gradient that is left.
        if largest <= TOL * max(1.0, float(np.abs(out.beta).max())):
            return out
    raise RuntimeError(f"{loss} regression did not settle in {STEPS} steps")


def score(rows: DataFrame, design: Design, loss: str, fitted: Coefficients, keep: Sequence[str]) -> DataFrame:
    """Rows with ``margin``, one score per set (poisson: of the logarithm)."""
    beta, sets = fitted.beta, len(design.sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            group = batch.column("g").to_numpy().astype(np.int64)
            x = design.matrix(batch, group)
            margin = np.stack([np.einsum("ij,ij->i", x, beta[group, s]) for s in range(sets)], axis=1)
            edges = pa.array(np.arange(len(batch) + 1) * sets, pa.int32())
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.ListArray.from_arrays(edges, pa.array(margin.ravel()))], names=[*keep, "margin"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.select(*keep).dtypes)
    return rows.select(*dict.fromkeys([*keep, "g", "x", "level"])).mapInArrow(run, f"{kinds}, margin array<double>")
