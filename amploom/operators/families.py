"""Families of emissions and transitions: what a model asks of them, and the Gaussian and histogram families as columns.

Parameters are small and on the driver; densities are column expressions, and statistics are sums that tasks combine
before the shuffle, so a family never sees rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import logsumexp_by
from . import graph


class EmissionFamily(Protocol):
    """Densities of points in some columns, and new parameters from weighted rows."""

    def log_density(self, *x: Column) -> Column: ...
    def score(self, *x: Column) -> Column: ...
    def update(self, rows: DataFrame, weight: str, *names: str) -> EmissionFamily: ...
    def pack(self) -> list[float]: ...


class TransitionFamily(Protocol):
    """Log-probabilities of edges: rows, columns, products with vectors, and new ones from expected counts."""

    def row(self, i: int) -> DataFrame: ...
    def column(self, j: int) -> DataFrame: ...
    def vec_mat(self, vec: DataFrame) -> DataFrame: ...
    def mat_vec(self, vec: DataFrame) -> DataFrame: ...
    def posteriors(self, alpha: DataFrame, beta: DataFrame) -> DataFrame: ...
    def update(self, counts: DataFrame) -> TransitionFamily: ...


@dataclass(frozen=True)
class Links:
    """Transitions as a table (source, target, lp) of the edges that there are."""

    table: DataFrame

    def row(self, i: int) -> DataFrame:
        return self.table.where(F.col("source") == i)

    def column(self, j: int) -> DataFrame:
        return self.table.where(F.col("target") == j)

    def vec_mat(self, vec: DataFrame) -> DataFrame:
        return graph.vec_mat(vec, self.table)

    def mat_vec(self, vec: DataFrame) -> DataFrame:
        return graph.mat_vec(vec, self.table)

    def posteriors(self, alpha: DataFrame, beta: DataFrame) -> DataFrame:
        return graph.edge_posteriors(alpha, beta, self.table)

    def update(self, counts: DataFrame) -> Links:
        """``counts``: (source, target, xi) in logs, any number of rows an edge."""
        summed = logsumexp_by(counts, ["source", "target"], "xi", "lp")
        return Links(graph.log_links(summed.select("source", "target", F.exp("lp").alias("prob"))))


def weighted_sums(rows: DataFrame, keys: list[str], weight: str, names: tuple[str, ...]) -> DataFrame:
    """Sums of w, w squared, w x_i and w x_i x_j (j at most i) by key."""
    w = F.col(weight)
    of = {"w": w, "w2": w * w}
    of |= {f"x{i}": w * F.col(a) for i, a in enumerate(names)}
    of |= {f"x{i}_{j}": w * F.col(a) * F.col(b) for i, a in enumerate(names) for j, b in enumerate(names[: i + 1])}
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(k) for k, c in of.items()))


def weighted_gaussian(rows: DataFrame, keys: list[str], weight: str, *names: str) -> DataFrame:
    """(keys, n_eff, m0, .., c00, c10, ..): the weighted mean, and the covariance over n_eff = sum w - sum w^2 / sum w.

    Where n_eff isn't above 0 the mean is 0 and the covariance the identity.
    """
    n_eff = F.col("w") - F.try_divide(F.col("w2"), F.col("w"))
    ok = F.coalesce(n_eff > 0, F.lit(False))
    mean = lambda i: F.col(f"x{i}") / F.col("w")
    cov = lambda i, j: (F.col(f"x{i}_{j}") - F.col(f"x{i}") * F.col(f"x{j}") / F.col("w")) / n_eff
    d = range(len(names))
    out = [F.when(ok, mean(i)).otherwise(0.0).alias(f"m{i}") for i in d] + [F.when(ok, cov(i, j)).otherwise(float(i == j)).alias(f"c{i}{j}") for i in d for j in range(i + 1)]
    return weighted_sums(rows, keys, weight, names).select(*keys, F.when(ok, n_eff).otherwise(0.0).alias("n_eff"), *out)


@dataclass(frozen=True)
class Gaussian:
    """A normal distribution by its mean and the lower Cholesky factor of its covariance; by default N(0, I)."""

    mean: np.ndarray
    factor: np.ndarray
    weight: float = 0.0

    @classmethod
    def standard(cls, dim: int) -> Gaussian:
        return cls(np.zeros(dim), np.eye(dim))

    @classmethod
    def of(cls, mean, cov, weight: float = 0.0) -> Gaussian:
        """N(0, I) if the covariance isn't positive definite."""
        try:
            return cls(np.asarray(mean, float), np.linalg.cholesky(np.asarray(cov, float)), weight)
        except np.linalg.LinAlgError:
            return cls.standard(len(mean))

    @property
    def log_norm(self) -> float:
        return -0.5 * len(self.mean) * math.log(2 * math.pi) - float(np.log(np.diag(self.factor)).sum())

    def distance(self, *x: Column) -> Column:
        """The squared Mahalanobis distance from the mean, by forward substitution."""
        y: list[Column] = []
        for i, v in enumerate(x):
            rest = v - float(self.mean[i])
            for j in range(i):
                rest = rest - float(self.factor[i, j]) * y[j]
            y.append(rest / float(self.factor[i, i]))
        return sum((v * v for v in y[1:]), y[0] * y[0])

    def log_density(self, *x: Column) -> Column:
        return -0.5 * self.distance(*x) + self.log_norm

    def score(self, *x: Column) -> Column:
        return 5.0 - self.distance(*x)

    def update(self, rows: DataFrame, weight: str, *names: str) -> Gaussian:
        r = weighted_gaussian(rows, [], weight, *names).withColumn("w", F.col("n_eff")).first()  # one row
        d = len(names)
        cov = [[r[f"c{max(i, j)}{min(i, j)}"] for j in range(d)] for i in range(d)]
        return Gaussian.of([r[f"m{i}"] for i in range(d)], cov, float(r["w"]))

    def pack(self) -> list[float]:
        """Mean, factor by rows, log norm, weight."""
        return [*self.mean.tolist(), *self.factor.ravel().tolist(), self.log_norm, self.weight]

    @classmethod
    def unpack(cls, values: list[float], dim: int) -> Gaussian:
        return cls(np.array(values[:dim]), np.array(values[dim : dim + dim * dim]).reshape(dim, dim), float(values[-1]))


#: The log count that a cell has before any row.
EMPTY = -50.0


@dataclass(frozen=True)
class Histogram:
    """Log-probabilities of the cells of a grid: ``bins`` cells of equal width a dimension from ``low`` to ``high``, the first dimension fastest."""

    low: tuple[float, ...]
    high: tuple[float, ...]
    bins: tuple[int, ...]
    logp: np.ndarray | None = None

    def cell(self, *x: Column) -> Column:
        """The number of a point's cell; values outside count in the cells at the edge."""
        at, stride = F.lit(0).cast("long"), 1
        for v, lo, hi, n in zip(x, self.low, self.high, self.bins):
            at = at + F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((v - lo) / ((hi - lo) / n)))).cast("long") * stride
            stride *= n
        return at

    @property
    def cells(self) -> int:
        return math.prod(self.bins)

    def _values(self) -> np.ndarray:
        return np.full(self.cells, -math.log(self.cells)) if self.logp is None else self.logp

    def log_density(self, *x: Column) -> Column:
        return F.get(F.array(*(F.lit(float(v)) for v in self._values())), self.cell(*x).cast("int"))

    score = log_density

    def sums(self, rows: DataFrame, weight: str, *names: str) -> DataFrame:
        """(cell, n): the weight in each cell that has any."""
        return rows.groupBy(self.cell(*map(F.col, names)).alias("cell")).agg(F.sum(weight).alias("n"))

    def update(self, rows: DataFrame, weight: str, *names: str) -> Histogram:
        logs = np.full(self.cells, EMPTY)
        for cell, n in self.sums(rows, weight, *names).where("cell is not null and n > 0").collect():  # a row a cell
            logs[cell] = np.logaddexp(EMPTY, math.log(n))
        return Histogram(self.low, self.high, self.bins, logs - np.logaddexp.reduce(logs))

    def pack(self) -> list[float]:
        return np.exp(self._values()).tolist()


@dataclass(frozen=True)
class GaussianEmission:
    """The Gaussian family as a trained state's emission: the covariance's divisor is sum w - sum w^2 / sum w over all frames."""

    of: Gaussian

    @property
    def dim(self) -> int:
        return len(self.of.mean)

    @classmethod
    def unpack(cls, params: list[float], dim: int) -> GaussianEmission:
        if not params:
            return cls(Gaussian.standard(dim))
        if len(params) != dim + dim * dim:
            raise ValueError(f"{len(params)} parameters for a Gaussian in {dim} dimensions")
        return cls(Gaussian.of(params[:dim], np.array(params[dim:], float).reshape(dim, dim)))

    def pack(self) -> list[float]:
        return [*self.of.mean.tolist(), *(self.of.factor @ self.of.factor.T).ravel().tolist()]

    def log_density(self, x: np.ndarray) -> np.ndarray:
        y = np.linalg.solve(self.of.factor, (x - self.of.mean).T)
        return -0.5 * (y * y).sum(axis=0) + self.of.log_norm

    def sums(self, x: np.ndarray, w: np.ndarray) -> dict[tuple, float]:
        out = {("w", 0, 0, 0): float(w.sum()), ("w2", 0, 0, 0): float(w @ w)}
        for i in range(x.shape[1]):
            out["wx", 0, i, 0] = float(w @ x[:, i])
            for j in range(i + 1):
                out["wxx", 0, i, j] = float(w @ (x[:, i] * x[:, j]))
        return out

    def updated(self, sums: dict[tuple, float]) -> GaussianEmission:
        """Itself if no frames have weight; N(0, I) if the covariance isn't positive definite."""
        w, d = sums.get(("w", 0, 0, 0), 0.0), range(self.dim)
        n = w - sums.get(("w2", 0, 0, 0), 0.0) / w if w > 0 else 0.0
        if n <= 0:
            return self
        x = np.array([sums["wx", 0, i, 0] for i in d])
        xx = np.array([[sums["wxx", 0, max(i, j), min(i, j)] for j in d] for i in d])
        return GaussianEmission(Gaussian.of(x / w, (xx - np.outer(x, x) / w) / n, n))


@dataclass(frozen=True)
class HistogramEmission:
    """A histogram on a grid as a trained state's emission: its sums are the weights of cells."""

    of: Histogram

    @property
    def dim(self) -> int:
        return len(self.of.bins)

    @classmethod
    def unpack(cls, params: list[float], low, high, bins) -> HistogramEmission:
        grid = Histogram(tuple(map(float, low)), tuple(map(float, high)), tuple(map(int, bins)))
        if not params:
            return cls(grid)
        if len(params) != grid.cells:
            raise ValueError(f"{len(params)} parameters for {grid.cells} cells")
        with np.errstate(divide="ignore"):
            return cls(Histogram(grid.low, grid.high, grid.bins, np.log(np.asarray(params, float))))

    def pack(self) -> list[float]:
        return self.of.pack()

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The number of each point's cell; values outside count in the cells at the edge."""
        at, stride = np.zeros(len(x), int), 1
        for v, lo, hi, n in zip(x.T, self.of.low, self.of.high, self.of.bins):
            at += np.clip(np.floor((v - lo) / ((hi - lo) / n)), 0, n - 1).astype(int) * stride
            stride *= n
        return at

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return self.of._values()[self.cell(x)]

    def sums(self, x: np.ndarray, w: np.ndarray) -> dict[tuple, float]:
        n = np.bincount(self.cell(x), w, self.of.cells)
        return {("cell", 0, c, 0): float(n[c]) for c in np.flatnonzero(n).tolist()}

    def updated(self, sums: dict[tuple, float]) -> HistogramEmission:
        """Itself if no frames have weight."""
        logs = np.full(self.of.cells, EMPTY)
        for (_, _, c, _), v in sums.items():
            logs[c] = np.logaddexp(EMPTY, math.log(v)) if v > 0 else EMPTY
        if not sums:
            return self
        return HistogramEmission(Histogram(self.of.low, self.of.high, self.of.bins, logs - np.logaddexp.reduce(logs)))
