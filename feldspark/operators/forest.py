"""Isolation forest: trees grown in parallel on small samples, rows scored where they are."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import dbl
from ..sources.tables import scratch_folder
from .aggregates import exact_quantiles
from .ordering import hash_cuts, hash_key, ranked_by_hash

SAMPLE_ROWS = 256


def _average_path(n):
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, seed: int) -> dict:
    random = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(2, len(points))))
    nodes: list[list] = []

    def add(rows, depth):
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(rows)])
        held = points[rows]
        if depth >= limit or len(rows) <= 1:
            return at
        low, high = held.min(0), held.max(0)
        open_columns = np.flatnonzero(high > low)
        if not len(open_columns):
            return at
        column = int(random.choice(open_columns))
        value = float(random.uniform(low[column], high[column]))
        below = held[:, column] < value
        if below.all() or not below.any():
            below = held[:, column] <= low[column]
            value = float(np.nextafter(low[column], high[column]))
        nodes[at][:2] = [column, value]
        nodes[at][2] = add(rows[below], depth + 1)
        nodes[at][3] = add(rows[~below], depth + 1)
        return at

    add(np.arange(len(points)), 0)
    return {"nodes": nodes}


def _flat(nodes):
    """Node arrays in which leaves lead to themselves, with the path length each leaf stands for."""
    table = np.array(nodes)
    n, leaf = len(table), table[:, 0] < 0
    here = np.arange(n)
    low = np.where(leaf, here, table[:, 2]).astype(np.int64)
    high = np.where(leaf, here, table[:, 3]).astype(np.int64)
    depth = np.zeros(n)
    for i in range(n):  # children follow their parents
        if not leaf[i]:
            depth[low[i]] = depth[high[i]] = depth[i] + 1
    column = np.where(leaf, 0, table[:, 0]).astype(np.int64)
    return column, table[:, 1], low, high, depth + _average_path(table[:, 4]), int(depth.max())


def _heap(nodes):
    """Columns, values and leaf lengths of a tree filled up to its full depth, the children of node i at 2i+1 and 2i+2."""
    column, value, low, high, length, depth = _flat(nodes)
    at = np.zeros(2 ** (depth + 1) - 1, dtype=np.intp)
    for i in range(1, len(at)):
        parent = at[(i - 1) // 2]
        at[i] = low[parent] if i % 2 else high[parent]
    first_leaf = 2**depth - 1
    return column[at].astype(np.intp), value[at], length[at[first_leaf:]], depth


def _path_lengths(points: np.ndarray, trees) -> np.ndarray:
    """Sum over the trees of each point's path length; ``points`` has a row for each column."""
    n = points.shape[1]
    values, rows, total = points.ravel(), np.arange(n), np.zeros(n)
    for column, value, length, depth in trees:
        start, at = column * n, np.zeros(n, dtype=np.intp)
        for _ in range(depth):
            high = ~(values.take(start.take(at) + rows) < value.take(at))
            at += at
            at += 1
            at += high
        total += length.take(at - (2**depth - 1))
    return total


def _tree_samples(df: DataFrame, id_column: str, columns: Sequence[str], trees: int, seed: int) -> DataFrame:
    """(tree, x): 256 rows for each tree, or all if there are fewer.

    The trees take runs of that length one after another in hash order, and begin anew when it
    ends, so small tables give trees that share rows and large ones trees that do not.
    """
    n = df.count()
    size = min(SAMPLE_ROWS, n)
    spark = df.sparkSession
    # trees x 256 rows, whatever the size of the table
    wanted = spark.range(trees * size).select(
        F.floor(F.col("id") / max(size, 1)).cast("int").alias("tree"), (F.pmod("id", F.lit(max(n, 1))) + 1).alias("rank")
    )
    if trees * size < n:
        # Only the rows before the cut are ranked; the others are not shuffled.
        cut = hash_cuts(df, id_column, seed, {None: [trees * size]})[None][0]
        df = df.where(hash_key(id_column, seed) <= F.lit(cut))
    ranked = ranked_by_hash(df.select(id_column, F.array(*[dbl(c) for c in columns]).alias("x")), id_column, seed)
    return ranked.join(F.broadcast(wanted), "rank").select("tree", "x")


def fit_isolation_forest(
    train: DataFrame, id_column: str, columns: Sequence[str], trees: int = 200, contamination: float = 0.05, seed: int = 42
) -> dict:
    """Trees, medians for missing values and the score cut-off, all from training rows."""
    medians = {c: v[0] for c, v in exact_quantiles(train, {c: [0.5] for c in columns}).items()}
    ready = train.select(id_column, *[F.coalesce(dbl(c), F.lit(medians[c])).alias(c) for c in columns])

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = _grow(np.stack(list(rows["x"])), seed * 100_003 + int(key[0]))["nodes"]
        return pd.DataFrame({"tree": [key[0]], "rows": [len(rows)], "nodes": [[[float(v) for v in n] for n in nodes]]})

    grown = _tree_samples(ready, id_column, columns, trees, seed).groupBy("tree").applyInPandas(
        grow, "tree int, rows int, nodes array<array<double>>"
    )
    forest = [(r["rows"], r["nodes"]) for r in sorted(grown.collect(), key=lambda r: r["tree"])]
    fitted = {"columns": list(columns), "medians": medians, "forest": forest, "cutoff": None}
    # Every round of the quantile reads the scores, so they are computed once and kept as one column.
    kept = scratch_folder(train.sparkSession, "anomaly")
    score_isolation_forest(ready, fitted, flag=False).select("anomaly_score").write.parquet(kept)
    scored = train.sparkSession.read.parquet(kept)
    fitted["cutoff"] = exact_quantiles(scored, {"anomaly_score": [1 - contamination]})["anomaly_score"][0]
    return fitted


def score_isolation_forest(df: DataFrame, fitted: dict, flag: bool = True) -> DataFrame:
    """Add ``anomaly_score`` and ``is_outlier_multivariate``."""
    columns = fitted["columns"]
    trees = [_heap(nodes) for _, nodes in fitted["forest"]]
    usual = float(_average_path(np.mean([n for n, _ in fitted["forest"]])))

    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for held in batches:
            points = np.stack([c.to_numpy(dtype=float) for c in held])
            yield pd.Series(np.power(2.0, -_path_lengths(points, trees) / len(trees) / usual))

    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    filled = [F.coalesce(dbl(c), F.lit(fitted["medians"][c])) for c in columns]
    scored = df.withColumn("anomaly_score", F.pandas_udf(score, "double")(*filled))
    if not flag:
        return scored
    return scored.withColumn("is_outlier_multivariate", (F.col("anomaly_score") > F.lit(fitted["cutoff"])).cast("int"))
