"""Distribution transforms and scalers, learned on training rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_table
from ..functions.moments import sample_skewness
from ..functions.normal import normal_quantile
from ..functions.roles import dbl, numeric_columns
from .aggregates import aggregate_row, exact_quantiles, per_column
from .clean import binary_columns
from .ordering import running_totals

SEARCH_POINTS = 41
SEARCH_PASSES = 4
QUANTILE_POINTS = 1000
POWER_ZERO = 1e-12
TRANSFORMS = ("yeojohnson", "boxcox", "log1p", "sqrt", "quantile")
SCALERS = ("standard", "minmax", "robust", "maxabs", "none")


def skewed_columns(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 1.0) -> list[str]:
    columns = list(columns or numeric_columns(df))
    binary = set(binary_columns(df, columns))
    skews = aggregate_row(df, {c: sample_skewness(c) for c in columns if c not in binary})
    return [c for c in columns if c in skews and skews[c] is not None and abs(skews[c]) > threshold]


def skew_report(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 1.0) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    chosen = skewed_columns(df, columns, threshold)
    stats = per_column(df, columns, {"skew": sample_skewness})
    size = F.abs("skew")
    return stats.select(
        "column",
        F.round("skew", 4).alias("skewness"),
        F.round(size, 4).alias("abs_skewness"),
        F.col("column").isin(chosen).cast("int").alias("will_transform"),
        F.when(size > 2, "HIGH").when(size > 1, "MED").otherwise("OK").alias("severity"),
    ).orderBy(F.desc("abs_skewness"), "column")


def yeo_johnson(x: Column, power: float | Column) -> Column:
    p = F.lit(power) if isinstance(power, (int, float)) else power
    rest = F.lit(2.0) - p
    up = F.when(F.abs(p) < POWER_ZERO, F.log1p(x)).otherwise((F.pow(x + 1, p) - 1) / p)
    down = F.when(F.abs(rest) < POWER_ZERO, -F.log1p(-x)).otherwise(-(F.pow(1 - x, rest) - 1) / rest)
    return F.when(x >= 0, up).otherwise(down)


def box_cox(x: Column, power: float | Column) -> Column:
    p = F.lit(power) if isinstance(power, (int, float)) else power
    return F.when(F.abs(p) < POWER_ZERO, F.log(x)).otherwise((F.pow(x, p) - 1) / p)


def fit_powers(df: DataFrame, columns: Sequence[str], method: str = "yeojohnson") -> dict[str, float]:
    """Maximum-likelihood power of each column.

    Every pass evaluates a grid of powers for all columns in one aggregation whose groups
    are (column, grid point); the next pass narrows the grid around the best point.
    """
    transform = {"yeojohnson": yeo_johnson, "boxcox": box_cox}[method]
    if not columns:
        return {}
    x = F.col("x")
    jacobian = F.signum(x) * F.log1p(F.abs(x)) if method == "yeojohnson" else F.log(x)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), dbl(c).alias("x")) for c in columns]))
    long = df.select(pairs.alias("p")).select("p.*").where("x is not null")
    centre, reach = dict.fromkeys(columns, 0.0), 5.0
    for _ in range(SEARCH_PASSES):
        steps = [reach * (2 * i / (SEARCH_POINTS - 1) - 1) for i in range(SEARCH_POINTS)]
        grid = small_table(
            df.sparkSession,
            [(c, [centre[c] + s for s in steps]) for c in columns], "column string, powers array<double>"
        )
        tried = long.join(F.broadcast(grid), "column").select("column", "x", F.explode("powers").alias("power"))
        scored = tried.groupBy("column", "power").agg(
            F.var_pop(transform(x, F.col("power"))).alias("spread"), F.sum(jacobian).alias("shift"), F.count(x).alias("n")
        )
        likelihood = -F.col("n") / 2 * F.log("spread") + (F.col("power") - 1) * F.col("shift")
        usable = scored.where((F.col("spread") > 0) & (F.col("spread") < float("inf")))
        best = usable.groupBy("column").agg(F.max_by("power", F.struct(likelihood, -F.col("power"))).alias("power"))
        found = dict(best.collect())
        centre = {c: found.get(c, 1.0) for c in columns}
        reach /= (SEARCH_POINTS - 1) / 4
    return centre


def fit_transform(df: DataFrame, columns: Sequence[str], method: str) -> dict:
    """Learn a transform; Box-Cox gives way to Yeo-Johnson for all if any column is not positive."""
    if method not in TRANSFORMS:
        raise ValueError(f"unknown transform {method!r}")
    if method == "boxcox" and columns:
        lowest = aggregate_row(df, {c: F.min(dbl(c)) for c in columns})
        if any(v is None or v <= 0 for v in lowest.values()):
            method = "yeojohnson"
    if method in ("yeojohnson", "boxcox"):
        return {"method": method, "powers": fit_powers(df, columns, method) if columns else {}}
    if method == "quantile":
        n = df.count()
        points = max(2, min(QUANTILE_POINTS, n))
        shares = [i / (points - 1) for i in range(points)]
        return {"method": method, "grids": quantile_grids(df, columns, shares)}
    return {"method": method, "columns": list(columns)}


def quantile_grids(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict:
    """A fine grid of exact quantiles of each column, by one rule whatever the size of the table.

    Values are counted, and running totals over the distinct ones place every order statistic;
    a quantile between two of them is interpolated.
    """
    grids: dict = {}
    for c in columns:
        counted = df.select(dbl(c).alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        placed = running_totals(counted, ["x"], ["n"])
        total = placed.select("all_n").first()
        if total is None:
            grids[c] = [0.0 for _ in shares]
            continue
        spots = [share * (total[0] - 1) for share in shares]
        wanted = sorted({r for spot in spots for r in (math.floor(spot), math.ceil(spot))})
        ranks = F.explode(F.filter(F.array(*[F.lit(r) for r in wanted]), lambda r: (r < F.col("cum_n")) & (r >= F.col("cum_n") - F.col("n"))))
        at = {r["r"]: r["x"] for r in placed.select(ranks.alias("r"), "x").collect()}  # two rows a share at most
        grids[c] = [float(at[math.floor(s)] + (at[math.ceil(s)] - at[math.floor(s)]) * (s - math.floor(s))) for s in spots]
    return grids


def apply_transform(df: DataFrame, fitted: Mapping) -> DataFrame:
    method = fitted["method"]
    if method in ("yeojohnson", "boxcox"):
        f = yeo_johnson if method == "yeojohnson" else box_cox
        return df.withColumns({c: f(dbl(c), p) for c, p in fitted["powers"].items() if c in df.columns})
    if method == "log1p":
        return df.withColumns({c: F.log1p(dbl(c)) for c in fitted["columns"] if c in df.columns})
    if method == "sqrt":
        return df.withColumns({c: F.sqrt(dbl(c)) for c in fitted["columns"] if c in df.columns})
    grids = {c: np.asarray(g) for c, g in fitted["grids"].items() if c in df.columns}
    return df.withColumns({c: _to_normal(grid)(dbl(c)) for c, grid in grids.items()})


def _to_normal(grid: np.ndarray):
    edge = 1e-7
    shares = np.linspace(0, 1, len(grid))

    def to_normal(values: pd.Series) -> pd.Series:
        x = values.to_numpy(dtype=float)
        # average of the rank from the left and from the right, so that ties sit in the middle
        rank = 0.5 * (np.interp(x, grid, shares) - np.interp(-x, -grid[::-1], -shares[::-1]))
        rank = np.where(x <= grid[0], 0.0, np.where(x >= grid[-1], 1.0, rank))
        known = ~np.isnan(x)
        out = np.full(len(x), np.nan)
        out[known] = normal_quantile(np.clip(rank[known], edge, 1 - edge))
        return pd.Series(out).where(known, None)

    return F.pandas_udf(to_normal, "double")


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str = "standard") -> dict[str, tuple[float, float]]:
    """Centre and scale of each column; a zero scale counts as one."""
    if kind not in SCALERS:
        raise ValueError(f"unknown scaler {kind!r}")
    if kind == "none":
        return {}
    if kind == "robust":
        q = exact_quantiles(df, {c: [0.05, 0.5, 0.95] for c in columns})
        raw = {c: (v[1], v[2] - v[0]) for c, v in q.items() if v[1] is not None}
    else:
        fns = {
            "standard": (lambda x: F.avg(x), lambda x: F.stddev_pop(x)),
            "minmax": (lambda x: F.min(x), lambda x: F.max(x) - F.min(x)),
            "maxabs": (lambda x: F.lit(0.0), lambda x: F.max(F.abs(x))),
        }[kind]
        found = aggregate_row(df, {(c, i): fn(dbl(c)) for c in columns for i, fn in enumerate(fns)})
        raw = {c: (found[c, 0], found[c, 1]) for c in columns if found[c, 1] is not None}
    return {c: (float(a), float(b) if b else 1.0) for c, (a, b) in raw.items()}


def apply_scaler(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (dbl(c) - F.lit(a)) / F.lit(b) for c, (a, b) in fitted.items() if c in df.columns})
