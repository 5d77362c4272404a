"""Whitening of embeddings by an exact covariance, its pivoted Cholesky factor and one-sided Jacobi rotations.

Entries become integers, so sums and products add up without rounding, in whatever order tasks end: a lost executor's
work, done again, changes no digit. What comes to the driver is one number for each pair of dimensions.

Rows whose vector is null, empty, or holds null or non-finite entries, or entries too large for the integer grid (an
absolute value of :data:`LIMIT` / :data:`GRID` or more), are left out. So are vectors of another length than the commonest (of equally common ones
the shortest), for which no covariance is defined. Repeated rows and ids count and are returned each. Directions without
variance have no component: fewer than ``k`` come back, and no rows at all where the table is empty or all vectors are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.llm.base import with_fields

#: Steps of the integer grid for a unit, and what is added to an entry on it.
GRID, SHIFT = 1024, 100_000
#: Grid entries from here on are not taken: below, sums of a batch fit 64 bits.
LIMIT = 2.0**48
#: Rows that a task turns into numbers at a time.
ROWS = 1024
#: Below this part of the largest diagonal entry, a pivot is rounding.
RANK = 1e-13


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: ``axes`` has a unit eigenvector a row, ``values`` its eigenvalues, both of integer vectors."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    axes: np.ndarray

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part and rest (below 1) of the mean, so that centring an integer loses nothing."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        return whole, np.array([(s % self.n) / self.n for s in self.sums])


def usable(vector: str = "embedding") -> Column:
    """Whether a row's vector has entries, all of them finite and on the grid. Never null."""
    def entry(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT / GRID)

    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, entry), F.lit(False))


def _commonest(rows: DataFrame, vector: str) -> int:
    """The commonest length of a vector, 0 without rows."""
    found = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def _integers(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """The vectors of a column as rows of integers, some at a time."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, d)
    for at in range(0, len(values), ROWS):
        yield np.floor(values[at:at + ROWS] * GRID).astype(np.int64) + SHIFT


def products(centred: np.ndarray) -> np.ndarray:
    """Exact sums of products of columns: by float arithmetic where all sums are below 2^53, else by Python's integers."""
    most = int(np.abs(centred).max(initial=0))
    if most * most * len(centred) < 2**53:
        block = centred.astype(np.float64)
        return (block.T @ block).astype(np.int64).astype(object)
    block = centred.astype(object)
    return block.T @ block


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(rows: DataFrame, vector: str, d: int) -> list[tuple[int, int]]:
    """``(n, sum)`` of each dimension, exact."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=object)
        for batch in batches:
            for x in _integers(batch.column(0), d):
                n += len(x)
                total += x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), _decimals(total)], ["i", "n", "s"])

    found = rows.select(vector).mapInArrow(partial, "i INT, n LONG, s DECIMAL(38,0)")
    return [(r["n"], int(r["s"])) for r in found.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()]


def _covariance(rows: DataFrame, vector: str, n: int, sums: list[int]) -> np.ndarray:
    """The covariance, divisor ``n``. Products are taken of integers centred on the mean's whole part and summed exactly;
    the rest of the mean, below 1, is taken off in integers as well, so that only the last division rounds."""
    d = len(sums)
    whole, rest = np.array([s // n for s in sums], dtype=np.int64), [s % n for s in sums]
    upper = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), dtype=object)
        for batch in batches:
            for x in _integers(batch.column(0), d):
                total += products(x - whole)
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), _decimals(total[upper])], ["i", "j", "m"])

    found = rows.select(vector).mapInArrow(partial, "i INT, j INT, m DECIMAL(38,0)")
    v = np.zeros((d, d))
    for i, j, m in found.groupBy("i", "j").agg(F.sum("m").alias("m")).collect():
        v[i, j] = v[j, i] = (n * int(m) - rest[i] * rest[j]) / n**2
    return v


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """``L`` with ``a = L @ L.T``, a column for each pivot in the order of the largest diagonal entry left: its rows, in the order
    of the pivots, are a lower triangle. Stops at the rank."""
    a, d = a.copy(), len(a)
    left = np.ones(d, dtype=bool)
    least = RANK * a.diagonal().max(initial=0)
    columns = []
    while left.any():
        p = int(np.argmax(np.where(left, a.diagonal(), -1.0)))
        if a[p, p] <= least:
            break
        column = np.where(left, a[:, p], 0.0) / np.sqrt(a[p, p])
        columns.append(column)
        a -= np.outer(column, column)
        left[p] = False
    return np.array(columns).T if columns else np.zeros((d, 0))


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of ``factor @ factor.T``.

    Columns are rotated pair by pair until all are orthogonal; their squared norms are the eigenvalues. The pairs of a round
    have no column in common and are rotated at once.
    """
    b, r = factor.copy(), factor.shape[1]
    places = [*range(r), -1] if r % 2 else [*range(r)]
    for _ in range(60 if r > 1 else 0):
        worst = 0.0
        for _ in range(len(places) - 1):
            pairs = [(x, y) for x, y in zip(places[:len(places) // 2], reversed(places), strict=False) if min(x, y) >= 0]
            p, q = np.array([min(x) for x in pairs]), np.array([max(x) for x in pairs])
            u, w = b[:, p], b[:, q]
            uu, ww, uw = (u * u).sum(axis=0), (w * w).sum(axis=0), (u * w).sum(axis=0)
            off = np.abs(uw) / np.sqrt(uu * ww)
            worst = max(worst, off.max())
            turn = off > 1e-16
            ratio = np.where(turn, (ww - uu) / np.where(turn, 2 * uw, 1.0), 0.0)
            t = np.where(turn, np.where(ratio < 0, -1.0, 1.0) / (np.abs(ratio) + np.hypot(1.0, ratio)), 0.0)
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            b[:, p], b[:, q] = cos * u - sin * w, sin * u + cos * w
            places = [places[0], places[-1], *places[1:-1]]
        if worst < 1e-15:
            break
    squares = (b * b).sum(axis=0)
    order = np.argsort(-squares, kind="stable")
    return squares[order], b[:, order] / np.sqrt(squares[order])


def fit(df: DataFrame, k: int = 8, vector: str = "embedding") -> Whitening | None:
    """The first ``k`` components of all usable vectors; None without any direction that varies."""
    rows = df.filter(usable(vector))
    d = _commonest(rows, vector)
    if not d:
        return None
    rows = rows.filter(F.size(vector) == d)
    found = _sums(rows, vector, d)
    n, sums = found[0][0], [s for _, s in found]
    v = _covariance(rows, vector, n, sums)
    values, axes = jacobi(pivoted_cholesky(v))
    if not len(values):
        return None
    return Whitening(n, tuple(sums), float(v.trace()), values[:k], np.ascontiguousarray(axes[:, :k].T))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sums over dimensions of ``(n*x-S)**2``, exact; None where one is beyond 64 bits."""
    whole, rest = np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.int64)
    centred = x - whole
    if (n * (int(np.abs(centred).max(initial=0)) + 1)) ** 2 * len(sums) < 2**63:
        apart = n * centred - rest
        return (apart * apart).sum(axis=1).tolist()
    apart = n * centred.astype(object) - rest.astype(object)
    return [v if v < 2**63 else None for v in (apart * apart).sum(axis=1)]


def with_whitened(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The rows with usable vectors, ``whitened`` (an array, one entry for each component) and ``deviation`` (null if beyond 64 bits).

    Rows stay where they are read; columns of these two names are replaced.
    """
    d = len(model.sums)
    rows = df.drop("whitened", "deviation").filter(usable(vector)).filter(F.size(vector) == d)
    at = rows.columns.index(vector)
    whole, rest = model.centre
    scaled = (model.axes / np.sqrt(model.values)[:, None]).T
    n, sums, k = model.n, model.sums, len(model.values)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, apart = [np.zeros((0, k))], []
            for x in _integers(batch.column(at), d):
                found.append(((x - whole) - rest) @ scaled)
                apart += deviations(x, n, sums)
            flat = np.concatenate(found).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists, pa.array(apart, pa.int64())], [*batch.schema.names, "whitened", "deviation"])

    return rows.mapInArrow(whiten, with_fields(rows.schema, "whitened ARRAY<DOUBLE>, deviation LONG"))


def identity_error(whitened: DataFrame, k: int) -> float:
    """The largest absolute entry of the ``whitened`` rows' covariance minus the identity: 0 if they are truly white."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = whitened.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs]).first()
    return max((abs(v - (i == j)) for v, (i, j) in zip(row, pairs, strict=True) if v is not None), default=0.0)
