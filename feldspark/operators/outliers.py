"""Outlier bounds and treatments. Multivariate detectors are in ``forest`` and ``neighbours``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import dbl
from .aggregates import aggregate_row, exact_quantiles, per_column

TREATMENTS = ("cap", "remove", "flag", "cap_and_flag")
Bounds = Mapping[str, tuple[float, float]]


def iqr_bounds(df: DataFrame, columns: Sequence[str], t: float = 1.5) -> dict[str, tuple[float, float]]:
    quartiles = exact_quantiles(df, {c: [0.25, 0.75] for c in columns})
    return {c: (q1 - t * (q3 - q1), q3 + t * (q3 - q1)) for c, (q1, q3) in quartiles.items() if q1 is not None}


def zscore_bounds(df: DataFrame, columns: Sequence[str], t: float = 3.0) -> dict[str, tuple[float, float]]:
    found = aggregate_row(df, {(c, f.__name__): f(dbl(c)) for c in columns for f in (F.avg, F.stddev_samp)})
    return {
        c: (found[c, "avg"] - t * found[c, "stddev_samp"], found[c, "avg"] + t * found[c, "stddev_samp"])
        for c in columns
        if found[c, "stddev_samp"] is not None
    }


def mad_bounds(df: DataFrame, columns: Sequence[str], t: float = 3.5) -> dict[str, tuple[float, float]]:
    """Median +- t * MAD / 0.6745."""
    medians = {c: v[0] for c, v in exact_quantiles(df, {c: [0.5] for c in columns}).items() if v[0] is not None}
    deviations = df.select(*[F.abs(dbl(c) - F.lit(m)).alias(c) for c, m in medians.items()])
    mads = {c: v[0] for c, v in exact_quantiles(deviations, {c: [0.5] for c in medians}).items()}
    return {c: (m - t * mads[c] / 0.6745, m + t * mads[c] / 0.6745) for c, m in medians.items()}


def fit_bounds(df: DataFrame, columns: Sequence[str], method: str = "iqr", t: float = 1.5) -> dict[str, tuple[float, float]]:
    fits = {"iqr": iqr_bounds, "zscore": zscore_bounds, "modified_zscore": mad_bounds}
    if method not in fits:
        raise ValueError(f"unknown outlier method {method!r}")
    return fits[method](df, columns, t)


def _outside(column: str, bounds: Bounds):
    low, high = bounds[column]
    return (F.col(column) < F.lit(low)) | (F.col(column) > F.lit(high))


def treat(df: DataFrame, bounds: Bounds, treatment: str = "cap", mask=None) -> DataFrame:
    """Cap, remove and/or flag. ``mask`` marks whole rows (multivariate detectors)."""
    if treatment not in TREATMENTS:
        raise ValueError(f"unknown treatment {treatment!r}")
    present = [c for c in bounds if c in df.columns]
    if treatment == "remove":
        bad = mask
        if bad is None:
            bad = F.lit(False)
            for c in present:
                bad = bad | F.coalesce(_outside(c, bounds), F.lit(False))
        return df.where(~bad)
    changes = {}
    if "flag" in treatment:
        if mask is None:
            changes.update({f"{c}_is_outlier": F.coalesce(_outside(c, bounds), F.lit(False)).cast("int") for c in present})
        else:
            changes["is_outlier_multivariate"] = mask.cast("int")
    if "cap" in treatment:
        # greatest/least skip nulls, so a missing value must be kept missing explicitly
        for c in present:
            low, high = bounds[c]
            changes[c] = F.when(F.col(c).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), dbl(c))))
    return df.withColumns(changes)


def outlier_report(df: DataFrame, bounds: Bounds, action: str) -> DataFrame:
    columns = list(bounds)
    stats = per_column(
        df,
        columns,
        {
            "n_outliers": lambda c: F.count(F.when(_outside(c, bounds), 1)),
            "pct_outliers": lambda c: F.round(F.count(F.when(_outside(c, bounds), 1)) / F.count(F.lit(1)) * 100, 2),
            "lower_bound": lambda c: F.round(F.lit(float(bounds[c][0])), 4),
            "upper_bound": lambda c: F.round(F.lit(float(bounds[c][1])), 4),
        },
    )
    return stats.withColumn("action", F.lit(action)).orderBy(F.desc("n_outliers"), "column")
