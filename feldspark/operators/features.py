"""Feature engineering: projections, and group statistics learned on training rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.roles import dbl, numeric_columns
from .aggregates import aggregate_row, exact_quantiles

EPSILON = 1e-8
# White space as text libraries see it (ASCII controls, separators, every Unicode space).
SPACE_CLASS = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
AGGREGATES = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": F.count,
    "nunique": F.count_distinct,
}


def polynomial(df: DataFrame, columns: Sequence[str] | None = None, degree: int = 2) -> DataFrame:
    """Products of distinct columns, named ``a b``; by default of the first ten numeric columns."""
    columns = list(columns or numeric_columns(df)[:10])
    products = {}
    for size in range(2, degree + 1):
        for group in combinations(columns, size):
            value = dbl(group[0])
            for c in group[1:]:
                value = value * dbl(c)
            products[" ".join(group)] = value
    return df.select("*", *[v.alias(n) for n, v in products.items() if n not in df.columns])


def ratios(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    out = {}
    for a, b in pairs:
        out[f"{a}_div_{b}"] = dbl(a) / (dbl(b) + EPSILON)
        out[f"{a}_pct_of_sum"] = dbl(a) / (dbl(a) + dbl(b) + EPSILON)
    return df.withColumns(out)


def fit_bins(df: DataFrame, columns: Sequence[str], n_bins: int = 5, strategy: str = "quantile", seed: int = 42) -> dict[str, list[float]]:
    """Bin edges per column; edges closer than 1e-8 are merged."""
    if strategy == "quantile":
        edges = exact_quantiles(df, {c: [i / n_bins for i in range(n_bins + 1)] for c in columns})
    elif strategy in ("uniform", "kmeans"):
        ends = aggregate_row(df, {(c, f.__name__): f(dbl(c)) for c in columns for f in (F.min, F.max)})
        columns = [c for c in columns if ends[c, "min"] is not None]
        edges = {c: [ends[c, "min"] + (ends[c, "max"] - ends[c, "min"]) * i / n_bins for i in range(n_bins + 1)] for c in columns}
        if strategy == "kmeans":
            for c in columns:
                centres = _centres(df, c, n_bins, seed)
                edges[c] = [ends[c, "min"], *[(a + b) / 2 for a, b in zip(centres, centres[1:])], ends[c, "max"]]
    else:
        raise ValueError(f"unknown binning strategy {strategy!r}")
    merged = {}
    for c, values in edges.items():
        if values[0] is None:  # a column without values has no bins
            merged[c] = []
            continue
        kept = [values[0]]
        for v in values[1:]:
            if v - kept[-1] > EPSILON:
                kept.append(v)
        merged[c] = [float(v) for v in kept]
    return merged


def _centres(df: DataFrame, column: str, k: int, seed: int) -> list[float]:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=[column], outputCol="__f").transform(df.where(F.col(column).isNotNull()).select(dbl(column).alias(column)))
    return sorted(float(c[0]) for c in KMeans(k=k, featuresCol="__f", seed=seed, maxIter=50).fit(points).clusterCenters())


def apply_bins(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """``col_bin``: number of inner edges at or below the value, so outer values fall in the end bins."""
    out = {}
    for c, values in edges.items():
        number = sum(((dbl(c) >= F.lit(e)).cast("int") for e in values[1:-1]), F.lit(0))
        out[f"{c}_bin"] = F.when(F.col(c).isNotNull(), number)
    return df.withColumns(out)


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``a_x_b`` (product) when both are 64-bit numbers, else the text cross ``a__b``."""
    kinds = (T.LongType, T.DoubleType)
    out = {}
    for a, b in pairs:
        if isinstance(df.schema[a].dataType, kinds) and isinstance(df.schema[b].dataType, kinds):
            out[f"{a}_x_{b}"] = F.col(a) * F.col(b)
        else:
            text = [F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in (a, b)]
            out[f"{a}__{b}"] = F.concat_ws("_", *text)
    return df.withColumns(out)


def group_statistics(train: DataFrame, group: str, column: str, functions: Sequence[str] = ("mean", "std")) -> DataFrame:
    """One row per group with ``column_by_group_function`` columns."""
    from .impute import grouped_quantile

    plain = [f for f in functions if f != "median"]
    unknown = [f for f in plain if f not in AGGREGATES]
    if unknown:
        raise ValueError(f"unknown aggregates {unknown}")
    known = train.where(F.col(group).isNotNull())
    table = known.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), *[AGGREGATES[f](F.col(column)).alias(f"{column}_by_{group}_{f}") for f in plain])
    if "median" in functions:
        table = table.join(grouped_quantile(train, group, column, 0.5, f"{column}_by_{group}_median"), group, "left")
    return table.drop("__n")


def add_group_statistics(df: DataFrame, statistics: DataFrame, group: str) -> DataFrame:
    """Attach learned group statistics; unseen groups get nulls."""
    return df.join(statistics, group, "left")


def text_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Length and counts of words, digits, special and upper-case characters of the whole text."""
    out = {}
    for c in columns:
        text = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        out[f"{c}_length"] = F.length(text)
        out[f"{c}_word_count"] = F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+"))
        out[f"{c}_n_digits"] = F.regexp_count(text, F.lit(r"\p{Nd}"))
        out[f"{c}_n_special"] = F.regexp_count(text, F.lit(f"[^a-zA-Z0-9{SPACE_CLASS}]"))
        out[f"{c}_n_upper"] = F.regexp_count(text, F.lit("[A-Z]"))
    return df.withColumns(out)


def _moment(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.try_to_timestamp(column)
    return F.col(column).cast("timestamp")


def date_parts(df: DataFrame, column: str) -> dict[str, Column]:
    at = _moment(df, column)
    return {
        f"{column}_year": F.year(at),
        f"{column}_month": F.month(at),
        f"{column}_day": F.dayofmonth(at),
        f"{column}_hour": F.hour(at),
        f"{column}_minute": F.minute(at),
        f"{column}_weekday": F.weekday(at),
        f"{column}_quarter": F.quarter(at),
        f"{column}_dayofyear": F.dayofyear(at),
        f"{column}_weekofyear": F.weekofyear(at),
    }


def date_flags(df: DataFrame, column: str) -> dict[str, Column]:
    at = _moment(df, column)
    return {
        f"{column}_is_weekend": F.coalesce((F.weekday(at) >= 5).cast("int"), F.lit(0)),
        f"{column}_is_monthstart": F.coalesce((F.dayofmonth(at) == 1).cast("int"), F.lit(0)),
        f"{column}_is_monthend": F.coalesce((F.last_day(at) == at.cast("date")).cast("int"), F.lit(0)),
    }


def date_cycles(df: DataFrame, column: str) -> dict[str, Column]:
    at = _moment(df, column)
    parts = {"hour": (F.hour(at), 24), "month": (F.month(at), 12), "weekday": (F.weekday(at), 7), "doy": (F.dayofyear(at), 365)}
    out = {}
    for name, (value, period) in parts.items():
        angle = F.lit(2 * math.pi) * value / F.lit(float(period))
        out[f"{column}_{name}_sin"] = F.sin(angle)
        out[f"{column}_{name}_cos"] = F.cos(angle)
    return out


def days_since(df: DataFrame, column: str, reference: str) -> Column:
    """Whole days since the reference date, rounded down."""
    seconds = _moment(df, column).cast("double") - F.lit(reference).cast("timestamp").cast("double")
    return F.floor(seconds / F.lit(86400.0))


def date_features(
    df: DataFrame,
    columns: Sequence[str],
    parts: bool = True,
    flags: bool = True,
    cycles: bool = True,
    since: Mapping[str, str] | None = None,
    drop: bool = True,
) -> DataFrame:
    out: dict[str, Column] = {}
    for c in columns:
        if c not in df.columns:
            continue
        if parts:
            out.update(date_parts(df, c))
        if flags:
            out.update(date_flags(df, c))
        if cycles:
            out.update(date_cycles(df, c))
        if since and c in since:
            out[f"{c}_days_since_ref"] = days_since(df, c, since[c])
    added = df.select("*", *[v.alias(n) for n, v in out.items()])
    return added.drop(*columns) if drop else added


def rfm(df: DataFrame, customer: str, date: str, amount: str, reference: str | None = None) -> DataFrame:
    """Recency, frequency and monetary value per customer."""
    if reference is None:
        last = df.agg(F.max(F.col(date).cast("timestamp")).alias("m")).first()["m"]
        now = F.lit(last).cast("timestamp").cast("double") + 86400.0
    else:
        now = F.lit(reference).cast("timestamp").cast("double")
    known = df.where(F.col(customer).isNotNull())
    per = known.groupBy(customer).agg(
        F.max(F.col(date).cast("timestamp")).alias("__last"),
        F.count(date).alias("frequency"),
        F.coalesce(F.sum(dbl(amount)), F.lit(0.0)).alias("monetary"),
    )
    recency = F.floor((now - F.col("__last").cast("double")) / F.lit(86400.0))
    return per.select(
        customer,
        recency.alias("recency"),
        "frequency",
        "monetary",
        F.when(F.col("frequency") > 0, F.col("monetary") / F.col("frequency")).alias("avg_order_value"),
        F.log1p("monetary").alias("monetary_log"),
        F.log1p(recency.cast("double")).alias("recency_log"),
    )
