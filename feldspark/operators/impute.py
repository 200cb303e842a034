"""Missing values: statistics from training rows, fills anywhere."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.moments import sample_skewness
from ..functions.roles import dbl, numeric_columns, string_columns
from ..session import cut_lineage
from .aggregates import aggregate_row, exact_quantiles, per_column
from .ordering import running_totals, surrounding_values


def columns_with_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    columns = list(columns or df.columns)
    counts = aggregate_row(df, {c: F.count(F.when(F.col(f"`{c}`").isNull(), 1)) for c in columns})
    return [c for c in columns if counts[c]]


def numeric_fills(df: DataFrame, columns: Sequence[str], strategy: str = "median") -> dict[str, float]:
    if strategy == "mean":
        return aggregate_row(df, {c: F.avg(dbl(c)) for c in columns})
    if strategy == "median":
        return {c: v[0] for c, v in exact_quantiles(df, {c: [0.5] for c in columns}).items()}
    raise ValueError(f"unknown numeric strategy {strategy!r}")


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value of each column; the smallest of equally frequent ones."""
    found = {}
    for c in columns:
        best = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(1).collect()
        found[c] = best[0][0] if best else None
    return found


def categorical_fills(df: DataFrame, columns: Sequence[str], strategy: str = "most_frequent", constant: str = "MISSING"):
    if strategy == "most_frequent":
        return modes(df, columns)
    if strategy == "constant":
        return {c: constant for c in columns}
    raise ValueError(f"unknown categorical strategy {strategy!r}")


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items() if v is not None and c in df.columns})


def grouped_quantile(df: DataFrame, group: str, column: str, p: float, out: str = "value") -> DataFrame:
    """Exact interpolated quantile of every group.

    Groups are counted per distinct value and laid out in one global order, so a group of
    any size is spread over partitions and no group is gathered in one buffer.
    """
    counted = df.where(F.col(group).isNotNull() & F.col(column).isNotNull()).groupBy(group, dbl(column).alias("__x")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    running = running_totals(counted, [group, "__x"], ["__n"])
    spans = running.groupBy(group).agg(F.min(F.col("cum___n") - F.col("__n")).alias("__s"), F.sum("__n").alias("__t"))
    position = F.lit(float(p)) * (F.col("__t") - 1)
    first = F.col("cum___n") - F.col("__n") - F.col("__s")
    last = F.col("cum___n") - F.col("__s") - 1
    covers = lambda r: (first <= r) & (r <= last)
    ends = running.join(spans, group).groupBy(group).agg(
        F.max(F.when(covers(F.floor(position)), F.col("__x"))).alias("__lo"),
        F.max(F.when(covers(F.ceil(position)), F.col("__x"))).alias("__hi"),
        F.first(position - F.floor(position)).alias("__f"),
    )
    return ends.select(group, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__f")).alias(out))


def group_fill(df: DataFrame, column: str, group: str, strategy: str = "median") -> DataFrame:
    """Fill from the row's group; what remains from the filled column as a whole."""
    known = df.where(F.col(column).isNotNull() & F.col(group).isNotNull())
    if strategy == "median":
        stats = grouped_quantile(df, group, column, 0.5, "__stat")
    elif strategy == "mean":
        stats = known.groupBy(group).agg(F.avg(dbl(column)).alias("__stat"))
    elif strategy == "mode":
        counted = known.groupBy(group, column).agg(F.count(F.lit(1)).alias("__n"))
        stats = counted.groupBy(group).agg(F.min_by(column, F.struct(-F.col("__n"), F.col(column))).alias("__stat"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    filled = df.join(stats, group, "left").withColumn(column, F.coalesce(column, "__stat")).select(*df.columns)
    if not columns_with_nulls(filled, [column]):
        return filled
    fallback = numeric_fills(filled, [column])[column] if strategy == "median" else modes(filled, [column])[column]
    return fill(filled, {column: fallback})


def fill_in_time(
    df: DataFrame, time: str, tie: str, columns: Sequence[str] | None = None, group: Sequence[str] = (), method: str = "ffill"
) -> DataFrame:
    """Fill numeric columns along time: last value, then next one; or linear in time.

    Interpolation keeps the last value after the final observation and leaves the gap
    before the first one.
    """
    columns = [c for c in (columns or numeric_columns(df)) if c not in {time, tie, *group}]

    def observed(c: str) -> Column:
        pair = F.struct(F.col(c).alias("v"), F.col(time).cast("timestamp").cast("double").alias("t"))
        return F.when(F.col(c).isNotNull(), pair)

    near = surrounding_values(df, [time, tie], {c: observed(c) for c in columns}, group)
    now = F.col(time).cast("timestamp").cast("double")
    filled = {}
    for c in columns:
        before, after = F.col(f"prev_{c}"), F.col(f"next_{c}")
        if method == "ffill":
            filled[c] = F.coalesce(before["v"], after["v"])
        elif method == "interpolate":
            slope = (after["v"] - before["v"]) * (now - before["t"]) / (after["t"] - before["t"])
            between = F.when(after["t"] == before["t"], before["v"].cast("double")).otherwise(before["v"] + slope)
            filled[c] = F.coalesce(dbl(c), F.when(after.isNull(), before["v"].cast("double")).otherwise(between))
        else:
            raise ValueError(f"unknown method {method!r}")
    return near.select(*[filled[c].alias(c) if c in filled else c for c in df.columns])


def advice(df: DataFrame) -> DataFrame:
    """Suggested treatment of each column that has nulls."""
    numbers, texts = set(numeric_columns(df)), set(string_columns(df))
    stats = per_column(
        df,
        df.columns,
        {
            "n_missing": lambda c: F.count(F.when(F.col(f"`{c}`").isNull(), 1)),
            "share": lambda c: F.avg(F.col(f"`{c}`").isNull().cast("double")),
            "skew": lambda c: F.abs(sample_skewness(c)) if c in numbers else F.lit(None).cast("double"),
            "is_text": lambda c: F.lit(c in texts),
        },
    )
    choice = (
        F.when(F.col("share") > 0.6, "DROP")
        .when(F.col("is_text") & (F.col("share") > 0.3), "ADD_CATEGORY")
        .when(F.col("is_text"), "MODE")
        .when(F.col("share") < 0.05, "MEDIAN")
        .when(F.col("skew") > 1, "MEDIAN_SKEWED")
        .when(F.col("share") > 0.3, "KNN_OR_ITERATIVE")
        .otherwise("MEDIAN")
    )
    return stats.where("n_missing > 0").select(
        "column", "n_missing", F.round(F.col("share") * 100, 1).alias("pct_missing"), choice.alias("recommendation")
    )


def fit_chained(
    df: DataFrame, columns: Sequence[str], rounds: int = 10, ridge: float = 1e-3, tolerance: float = 1e-3
) -> dict:
    """Chained regressions: start from medians, then predict each column from the others.

    Returns the starting medians and the regressions in the order they were fitted. Each
    round ends in a written copy, so plans do not grow with the rounds.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    nulls = aggregate_row(df, {c: F.count(F.when(F.col(c).isNull(), 1)) for c in columns})
    start = numeric_fills(df, columns)
    flags = [F.col(c).isNull().alias(f"__na_{c}") for c in columns]
    current = cut_lineage(df.select(*[F.coalesce(dbl(c), F.lit(start[c])).alias(c) for c in columns], *flags))
    scale = max(abs(v or 0.0) for v in aggregate_row(df, {c: F.max(F.abs(dbl(c))) for c in columns}.copy()).values())
    steps: list[dict] = []
    for _ in range(rounds):
        change = 0.0
        for target in sorted((c for c in columns if nulls[c]), key=lambda c: (nulls[c], c)):
            others = [c for c in columns if c != target]
            train = VectorAssembler(inputCols=others, outputCol="__f").transform(current.where(~F.col(f"__na_{target}")))
            fitted = LinearRegression(featuresCol="__f", labelCol=target, regParam=ridge, solver="normal").fit(train)
            step = {"column": target, "others": others, "weights": [float(w) for w in fitted.coefficients], "bias": float(fitted.intercept)}
            steps.append(step)
            updated = F.when(F.col(f"__na_{target}"), _linear(step)).otherwise(F.col(target))
            gap = current.agg(F.max(F.when(F.col(f"__na_{target}"), F.abs(_linear(step) - F.col(target))))).first()[0]
            change = max(change, gap or 0.0)
            current = current.withColumn(target, updated)
        current = cut_lineage(current)
        if change < tolerance * scale:
            break
    return {"start": start, "steps": steps}


def _linear(step: Mapping) -> Column:
    total = F.lit(step["bias"])
    for c, w in zip(step["others"], step["weights"]):
        total = total + F.lit(w) * F.col(c)
    return total


def apply_chained(df: DataFrame, fitted: Mapping) -> DataFrame:
    columns = list(fitted["start"])
    other = [c for c in df.columns if c not in columns]
    current = df.select(
        *other,
        *[F.col(c).isNull().alias(f"__na_{c}") for c in columns],
        *[F.coalesce(dbl(c), F.lit(fitted["start"][c])).alias(c) for c in columns],
    )
    for step in fitted["steps"]:
        c = step["column"]
        current = current.withColumn(c, F.when(F.col(f"__na_{c}"), _linear(step)).otherwise(F.col(c)))
    return current.select(*df.columns)
