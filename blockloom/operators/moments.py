"""Counts, sums and cross-products in one distributed aggregate, and linear maps of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_COLUMNS = 4000


@dataclass(frozen=True)
class Moments:
    """n rows; s: column sums; g: cross-products; of the named columns."""

    columns: tuple[str, ...]
    n: float
    s: np.ndarray
    g: np.ndarray

    def at(self, cols) -> np.ndarray:
        return np.array([self.columns.index(c) for c in cols], int)

    def part(self, cols) -> Moments:
        i = self.at(cols)
        return Moments(tuple(cols), self.n, self.s[i], self.g[np.ix_(i, i)])

    def mapped(self, a: np.ndarray, b: np.ndarray, columns) -> Moments:
        """Moments of x'a + b: scaling and centring before a fit need no second pass."""
        s = self.s @ a
        return Moments(tuple(columns), self.n, s + self.n * b, a.T @ self.g @ a + np.outer(s, b) + np.outer(b, s) + self.n * np.outer(b, b))

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.columns, self.n - other.n, self.s - other.s, self.g - other.g)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.columns, self.n + other.n, self.s + other.s, self.g + other.g)

    @property
    def mean(self) -> np.ndarray:
        return self.s / self.n

    @property
    def var(self) -> np.ndarray:
        return np.maximum(np.diag(self.g) - self.s**2 / self.n, 0) / max(self.n - 1, 1)


def _poisson(u: np.ndarray) -> np.ndarray:
    """Poisson(1) quantiles of uniform numbers."""
    steps = np.cumsum(np.exp(-1) / np.cumprod(np.r_[1.0, np.arange(1, 13)]))
    return np.searchsorted(steps, u).astype(float)


def moment_cells(df: DataFrame, columns, key: str | None = None, replicates: int = 0, row_id: str | None = None, seed: int = 0) -> DataFrame:
    """k, i, j, x: cell (i, j) of the cross-products of (1, columns), for each value of a whole-number key, or for each Poisson bootstrap replicate.

    Partitions keep partial cross-products; only sums of them are shuffled.  Nulls and NaNs are refused.  A row's weight in a replicate follows from
    its row id and the seed alone, however rows are partitioned.
    """
    columns = tuple(columns)
    if len(columns) > MAX_COLUMNS:
        raise ValueError(f"{len(columns)} columns are too many for a cross-product matrix; at most {MAX_COLUMNS}")
    p = len(columns) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([np.ones(batch.num_rows), *[batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, p)]])
            if not np.isfinite(x).all():
                raise ValueError("block columns must be finite: impute first")
            k = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if replicates:
                for r in range(replicates):
                    step = ((seed * 1_000_003 + r) % (1 << 31) + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
                    h = (k.astype(np.uint64) + np.uint64(step)) * np.uint64(0xBF58476D1CE4E5B9)
                    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    w = _poisson((h >> np.uint64(11)).astype(float) / 2**53)
                    found[r] = found.get(r, 0) + (x * w[:, None]).T @ x
            else:
                for v in np.unique(k):
                    own = x[k == v]
                    found[int(v)] = found.get(int(v), 0) + own.T @ own
        for v, g in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(p, v)), pa.array(np.arange(p)), pa.array(list(g), pa.list_(pa.float64()))], ["k", "i", "v"])

    first = F.col(row_id if replicates else key).cast("bigint") if (replicates or key) else F.lit(0).cast("bigint")
    rows = df.select(first.alias("__k"), *[F.col(f"`{c}`").cast("double").alias(f"__{i}") for i, c in enumerate(columns)])
    rows = rows.select("__k", *[F.coalesce(f"__{i}", F.lit(float("nan"))) for i in range(len(columns))])
    parts = rows.mapInArrow(run, "k bigint, i bigint, v array<double>")
    return parts.select("k", "i", F.posexplode("v").alias("j", "x")).groupBy("k", "i", "j").agg(F.sum("x").alias("x"))


def of_cells(columns: tuple[str, ...], i: np.ndarray, j: np.ndarray, x: np.ndarray) -> Moments:
    """Moments of one key from its cells."""
    g = np.zeros((len(columns) + 1, len(columns) + 1))
    g[i, j] = x
    return Moments(columns, g[0, 0], g[0, 1:], g[1:, 1:])


def moments_by(df: DataFrame, columns, key: str | None = None, replicates: int = 0, row_id: str | None = None, seed: int = 0) -> dict[int, Moments]:
    """Moments by the values of an integer key, or by bootstrap replicate, on the driver."""
    cells = moment_cells(df, columns, key, replicates, row_id, seed).toArrow()
    k, i, j, x = (cells.column(c).to_numpy() for c in range(4))
    return {int(v): of_cells(tuple(columns), i[k == v], j[k == v], x[k == v]) for v in np.unique(k)}


def moments(df: DataFrame, columns) -> Moments:
    """Moments of all rows, from cross-products of columns centred near their means, which keeps their digits."""
    columns = tuple(columns)
    near = df.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    shift = np.array([near[i] if near[i] is not None and np.isfinite(near[i]) else 0.0 for i in range(len(columns))])
    moved = df.select(*[(F.col(f"`{c}`").cast("double") - float(shift[i])).alias(f"c{i}") for i, c in enumerate(columns)])
    got = moments_by(moved, [f"c{i}" for i in range(len(columns))]).get(0)
    if got is None:
        return Moments(columns, 0, np.zeros(len(columns)), np.zeros((len(columns), len(columns))))
    return got.mapped(np.eye(len(columns)), shift, columns)
