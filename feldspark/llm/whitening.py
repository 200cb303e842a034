"""Whitened principal components of a table of vectors, with eigenvectors to double precision.

Entries become whole numbers, so sums and centred cross products are exact: every task adds up
whole-number matrices, and Spark adds these. The covariance, a matrix of the vectors' dimension, is the only
thing the driver sees. Its eigenvectors are found in float32 and then refined by
matrix products in extended precision (Ogita and Aishima): each step measures the departures from orthogonality
and diagonality and corrects every vector by first-order perturbation, which doubles the number of right digits.
Eigenvalues too close to divide by their gap form a cluster; its vectors are corrected as a subspace, and a
small shifted problem inside the subspace separates them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SCALE, SHIFT = 1024, 100_000
LIMIT = 2.0**40
"""Scaled entries are held to this size either way, so that sums of a task stay whole."""
PIECE_ENTRIES = 1 << 20
STEPS = 30
STALLED = 4
"""Steps without halving the change after which rounding is all that moves."""
EXACT = 1 << 53


class Fit(NamedTuple):
    """Rows ``n``, whole centre ``centre`` and what the sums exceed it by, eigenvalues and unit vectors (columns), ``trace``."""

    n: int
    centre: np.ndarray
    excess: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(column: str) -> Column:
    """The vector is there and holds only finite numbers."""
    entries = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(entries & (F.size(column) > 0), F.lit(False))


def _pieces(batches: Iterator[pa.RecordBatch], column: str, dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A batch in pieces of bounded size, and their entries as whole numbers."""
    rows = max(1, PIECE_ENTRIES // dimension)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            piece = batch.slice(at, rows)
            entries = piece.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            yield piece, np.clip(np.floor(entries * SCALE), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38))


def exact_products(rows: np.ndarray) -> np.ndarray:
    """Sum of the outer products of whole-number rows, as Python integers.

    Products and sums below 2**53 are exact in float64 in any order; a piece beyond that is halved.
    """
    top = int(np.abs(rows).max(initial=0))
    if top * top * len(rows) < EXACT:
        as_double = rows.astype(np.float64)
        return (as_double.T @ as_double).astype(np.int64).astype(object)
    if len(rows) == 1:
        row = rows[0].astype(object)
        return np.outer(row, row)
    return exact_products(rows[: len(rows) // 2]) + exact_products(rows[len(rows) // 2 :])


def _sums(dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = np.zeros(dimension, object), 0
        for piece, x in _pieces(batches, "vector", dimension):
            totals, n = totals + x.sum(axis=0).astype(object), n + len(x)
        if n:
            places = pa.array(range(-1, dimension), pa.int32())
            yield pa.RecordBatch.from_arrays([places, _decimals([n, *totals])], names=["place", "total"])

    return run


def _products(dimension: int, centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((dimension, dimension), object), False
        for piece, x in _pieces(batches, "vector", dimension):
            total, any_row = total + exact_products(x - centre), True
        if any_row:
            for i in range(dimension):
                places = pa.array(range(i, dimension), pa.int32())
                row = pa.array(np.full(dimension - i, i, np.int32))
                yield pa.RecordBatch.from_arrays([row, places, _decimals(total[i, i:])], names=["row", "place", "total"])

    return run


def _norm(matrix: np.ndarray) -> float:
    """Spectral norm; double precision is enough for a bound."""
    return float(np.linalg.norm(matrix.astype(np.float64), 2)) if matrix.size else 0.0


def refined_eigenvectors(matrix: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric extended-precision matrix.

    Starts from float32. Vectors of eigenvalues that are equal to the last digit are one orthonormal basis among many.
    """
    wide = np.longdouble
    size = len(matrix)
    scale = wide(np.abs(matrix).max(initial=0))
    if scale == 0:
        return np.zeros(size, wide), np.eye(size, dtype=wide)
    a = matrix.astype(wide) / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(wide)
    one, whole = np.eye(size, dtype=wide), _norm(a)
    smallest = float(np.finfo(wide).eps) * size * whole
    values, least, stalled = np.zeros(size, wide), float("inf"), 0
    for _ in range(steps):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        # Unequal halves, divided by a small gap, would bend vectors towards each other.
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        bound = max(2 * (_norm(s - np.diag(values)) + whole * _norm(r)), smallest)
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > bound
        change = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ change
        moved = float(np.abs(change).max())
        for cluster in _clusters(values, bound):
            moved = max(moved, _separate(a, x, cluster, smallest))
        least, stalled = min(least, moved), 0 if moved < least / 2 else stalled + 1
        if moved < 2.0**-58 or stalled == STALLED:
            break
    x = x + x @ ((one - x.T @ x) / 2)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))


def _clusters(values: np.ndarray, bound: float) -> list[np.ndarray]:
    """Numbers of the eigenvalues in chains of gaps at most ``bound``, two or more in each."""
    order = np.argsort(values, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(values[order]) > bound) + 1)
    return [g for g in groups if len(g) > 1]


def _separate(a: np.ndarray, x: np.ndarray, cluster: np.ndarray, smallest: float) -> float:
    """Solve the problem inside the span of a cluster, shifted by its mean so that its spread keeps all digits."""
    basis = x[:, cluster]
    inner = basis.T @ (a @ basis)
    shift = np.diag(inner).mean()
    # The basis is not quite orthonormal; what it departs by weighs as much as the shift.
    inner = inner - shift * (basis.T @ basis)
    spread = np.abs(inner).max()
    off = np.abs(inner - np.diag(np.diag(inner))).max()
    if off <= 4 * smallest or spread == 0:
        return 0.0
    turn = np.linalg.eigh(((inner + inner.T) / (2 * spread)).astype(np.float64))[1]
    x[:, cluster] = basis @ turn.astype(x.dtype)
    return float(np.abs(np.abs(turn).max(axis=0) - 1).max())


def covariance(n: int, excess: list[int], products: dict[tuple[int, int], int]) -> np.ndarray:
    """Exact covariance, rounded once to extended precision; products are centred by whole numbers."""
    size = len(excess)
    matrix = np.zeros((size, size), np.longdouble)
    square = n * n
    for (i, j), total in products.items():
        exact = Fraction(n * total - excess[i] * excess[j], square)
        high = float(exact)
        matrix[i, j] = matrix[j, i] = np.longdouble(high) + np.longdouble(float(exact - Fraction(high)))
    return matrix


def fit(held: DataFrame, dimension: int) -> Fit | None:
    """Components of the column ``vector`` (doubles, ``dimension`` each); None without rows."""
    summed = held.select("vector").mapInArrow(_sums(dimension), "place int, total decimal(38,0)")
    sums = {r["place"]: int(r["total"]) for r in summed.groupBy("place").agg(F.sum("total").alias("total")).collect()}
    if not sums:
        return None
    n = sums.pop(-1)
    totals = [sums[i] for i in range(dimension)]
    centre = np.array([(2 * s + n) // (2 * n) for s in totals], np.int64)
    excess = [s - n * int(c) for s, c in zip(totals, centre)]
    crossed = held.select("vector").mapInArrow(_products(dimension, centre), "row int, place int, total decimal(38,0)")
    crossed = crossed.groupBy("row", "place").agg(F.sum("total").alias("total"))
    matrix = covariance(n, excess, {(r["row"], r["place"]): int(r["total"]) for r in crossed.collect()})
    values, vectors = refined_eigenvectors(matrix)
    vectors = vectors.astype(np.float64)
    # Either sign is an eigenvector; the entry of largest size is made positive.
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(dimension)])
    return Fit(n, centre, excess, values.astype(np.float64), vectors * signs, float(np.diag(matrix).sum()))


def _whitened(found: Fit, id_column: str, used: int):
    dimension = len(found.centre)
    matrix = found.vectors[:, :used] / np.sqrt(found.values[:used])
    mean = np.array([e / found.n for e in found.excess])
    n, excess, constant = found.n, np.array(found.excess, object), sum(e * e for e in found.excess)
    most_excess = max((abs(e) for e in found.excess), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, x in _pieces(batches, "vector", dimension):
            y = x - found.centre
            top = int(np.abs(y).max(initial=0))
            if (n * top + most_excess) ** 2 * dimension < 1 << 63:
                departures = n * y - excess.astype(np.int64)
                deviation = pa.array((departures * departures).sum(axis=1)).cast(pa.decimal128(38))
            else:
                whole = y.astype(object)
                deviation = _decimals(n * n * (whole * whole).sum(axis=1) - 2 * n * (whole @ excess) + constant)
            white = (y - mean) @ matrix
            ends = pa.array(np.arange(0, white.size + 1, used, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [piece.column(id_column), deviation, pa.ListArray.from_arrays(ends, pa.array(white.reshape(-1)))],
                names=[id_column, "deviation", "white"],
            )

    return run


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = 8) -> DataFrame:
    """Return ``id_column``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    A row for each usable row and component. Rows whose vector is null, empty, or holds a null or non-finite
    entry are dropped. The most frequent length is the dimension (of equally frequent ones the largest) and rows of other
    lengths are dropped too. Entries c count as floor(1024 c) + 100000; beyond 2**40 they are held there. ``deviation``
    is exact, a decimal(38,0). Components whose variance is no more than rounding of the largest are left out, so equal rows give no
    result. Repeated and null ids keep a row each, other columns are ignored, and an empty table gives
    an empty result. ``identity_error`` is measured on the whitened numbers themselves.
    """
    kind = vectors.schema[id_column].dataType.simpleString()
    if id_column in ("vector", "deviation", "white"):
        raise ValueError(f"the id column cannot be named {id_column!r}")
    held = vectors.where(usable(column)).select(F.col(id_column), F.col(column).cast("array<double>").alias("vector"))
    lengths = held.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("rows"))
    most = lengths.agg(F.max(F.struct("rows", "length")).alias("most")).first()["most"]
    found = fit(held.where(F.size("vector") == most["length"]), most["length"]) if most else None
    used = 0
    if found is not None:
        floor = max(found.values.max(initial=0.0), 0.0) * len(found.values) * 2.0**-52
        used = int((found.values[:components] > floor).sum())
    if used == 0:
        empty = vectors.where(F.lit(False)).select(id_column)
        names = ("component int", "n bigint", "deviation decimal(38,0)", "whitened double", "explained double", "identity_error double")
        return empty.select(id_column, *[F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in names])
    rows = held.where(F.size("vector") == most["length"]).mapInArrow(
        _whitened(found, id_column, used), f"`{id_column}` {kind}, deviation decimal(38,0), white array<double>"
    )
    rows = cut_lineage(rows)
    pairs = [(i, j) for i in range(used) for j in range(i, used)]
    measured = rows.agg(*[F.covar_pop(F.col("white")[i], F.col("white")[j]).alias(f"c_{i}_{j}") for i, j in pairs]).first()
    error = max(abs(measured[f"c_{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = F.array(*[F.lit(float(v / found.trace)) for v in found.values[:used]])
    return rows.select(id_column, "deviation", F.posexplode("white").alias("at", "whitened")).select(
        id_column, (F.col("at") + 1).alias("component"), F.lit(found.n).cast("bigint").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
