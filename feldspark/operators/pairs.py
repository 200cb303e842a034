"""Moments of all pairs of columns in one scan.

Every task multiplies its rows, as a matrix, with itself: counts, sums, squares and products of the rows where both columns
of a pair are present. Tasks are merged by the rule for joining two samples' means and centred products, first in
groups of tasks and then over these, so no pass over the rows is needed to centre them beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import dbl

TILE = 512
"""Columns of a tile; a pair of tiles is one scan, so tables of up to this many columns take one."""
GROUPS = 32
FIELDS = ("n", "mx", "my", "cxx", "cyy", "cxy")
ROW = "i int, part bigint, " + ", ".join(f"{f} array<double>" for f in FIELDS)


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The fields of all pairs of a column of ``x`` and one of ``y``; not-a-number is absent."""
    here, there = ~np.isnan(x), ~np.isnan(y)

    def shifted(values, present):
        # Relative to a value of the column itself, so that a constant column has no spread at all.
        first = np.where(present.any(axis=0), values[present.argmax(axis=0), np.arange(values.shape[1])], 0.0) if len(values) else np.zeros(values.shape[1])
        return np.where(present, values - first, 0.0), first

    u, u0 = shifted(x, here)
    v, v0 = shifted(y, there)
    a, b = here.astype(float), there.astype(float)
    n = a.T @ b
    divisor = np.maximum(n, 1)
    sx, sy = u.T @ b, a.T @ v
    return np.stack(
        (n, u0[:, None] + sx / divisor, v0[None, :] + sy / divisor, (u * u).T @ b - sx * sx / divisor,
         a.T @ (v * v) - sy * sy / divisor, u.T @ v - sx * sy / divisor)
    )


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    dx, dy = np.where(a[0] * b[0] > 0, b[1] - a[1], 0.0), np.where(a[0] * b[0] > 0, b[2] - a[2], 0.0)
    weight = a[0] * share
    mx = np.where(a[0] > 0, a[1] + dx * share, b[1])
    my = np.where(a[0] > 0, a[2] + dy * share, b[2])
    return np.stack((n, mx, my, a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight))


def _per_task(left: Sequence[int], right: Sequence[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            values = np.stack(columns, axis=1).astype(float)
            found = _moments(values[:, left], values[:, right])
            total = found if total is None else _joined(total, found)
        if total is not None:
            part = TaskContext.get().partitionId() % GROUPS
            rows = {"i": np.arange(len(left), dtype=np.int32), "part": np.full(len(left), part, np.int64), **{f: list(total[k]) for k, f in enumerate(FIELDS)}}
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows), preserve_index=False)

    return run


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    total = None
    for row in frame.itertuples():
        one = np.stack([np.asarray(getattr(row, f)) for f in FIELDS])
        total = one if total is None else _joined(total, one)
    return pd.DataFrame({"i": [frame["i"].iloc[0]], "part": [0], **{f: [total[k]] for k, f in enumerate(FIELDS)}})


def _scan(numbers: DataFrame, left: Sequence[int], right: Sequence[int]) -> DataFrame:
    used = sorted({*left, *right})
    at = {c: k for k, c in enumerate(used)}
    tasks = numbers.select(*[f"x{c}" for c in used]).mapInArrow(_per_task([at[c] for c in left], [at[c] for c in right]), ROW)
    groups = tasks.groupBy("i", "part").applyInPandas(_merged, ROW)
    whole = groups.groupBy("i").applyInPandas(_merged, ROW)
    zipped = F.arrays_zip(F.array(*[F.lit(c) for c in right]).alias("j"), *[F.col(f) for f in FIELDS])
    return whole.select(F.array(*[F.lit(c) for c in left])[F.col("i")].alias("i"), F.explode(zipped).alias("z")).select("i", "z.*")


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a``, ``b``, ``n``, ``mx``, ``my``, ``cxx``, ``cyy`` and ``cxy`` of every pair of columns, each once, in the order given.

    ``n`` counts the rows with both values (null and NaN are absent), and the rest are their means and sums of centred squares and
    products. Without a pair the result is empty.
    """
    schema = "a string, b string, n bigint, mx double, my double, cxx double, cyy double, cxy double"
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], schema)
    numbers = df.select(*[F.coalesce(dbl(c), F.lit(float("nan"))).alias(f"x{i}") for i, c in enumerate(columns)])
    tiles = [list(range(start, min(start + TILE, len(columns)))) for start in range(0, len(columns), TILE)]
    result = None
    for p, left in enumerate(tiles):
        for right in tiles[p:]:
            part = _scan(numbers, left, right).where("i < j")
            result = part if result is None else result.unionByName(part)
    names = F.array(*[F.lit(c) for c in columns])
    return result.select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), F.col("n").cast("bigint").alias("n"), "mx", "my", "cxx", "cyy", "cxy")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a``, ``b``, ``r``: Pearson's correlation of every pair; null below two rows, NaN where a column is constant."""
    size = F.sqrt(F.col("cxx")) * F.sqrt(F.col("cyy"))
    r = F.when(F.col("n") < 2, F.lit(None)).when(size == 0, F.lit(float("nan"))).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cxy") / size)))
    return pair_moments(df, columns).select("a", "b", r.alias("r"))
