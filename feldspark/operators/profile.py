"""Profiles: the tables behind inspection reports and exploratory plots."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_table
from ..functions.moments import sample_kurtosis, sample_skewness
from ..functions.roles import dbl, numeric_columns, string_columns, type_class
from .aggregates import aggregate_row, exact_quantiles, per_column
from .ordering import running_totals
from .pairs import correlations
from .rank_correlation import kendall_counts, kendall_tau  # noqa: F401

PERCENTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def types(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString(), type_class(f.dataType)) for f in df.schema]
    return small_table(df.sparkSession, rows, "column string, dtype string, kind string")


def missing(df: DataFrame) -> DataFrame:
    """Columns with nulls: count and percentage, most first."""
    stats = per_column(
        df,
        df.columns,
        {
            "n_missing": lambda c: F.count(F.when(F.col(f"`{c}`").isNull(), 1)),
            "pct_missing": lambda c: F.round(F.avg(F.col(f"`{c}`").isNull().cast("double")) * 100, 2),
        },
    )
    return stats.where("n_missing > 0").orderBy(F.desc("pct_missing"), "column")


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct values (nulls aside), share of rows and class of each column."""
    columns = list(columns or df.columns)
    distinct = F.count_distinct if exact else F.approx_count_distinct
    stats = per_column(
        df,
        columns,
        {"n_unique": lambda c: distinct(F.col(f"`{c}`")), "n_rows": lambda c: F.count(F.lit(1))},
    )
    ratio = F.col("n_unique") / F.col("n_rows")
    kind = (
        F.when(F.col("n_unique") == 1, "CONSTANT")
        .when(F.col("n_unique") == 2, "BINARY")
        .when(F.col("n_unique") <= 10, "LOW")
        .when(F.col("n_unique") <= 50, "MED")
        .when(ratio > 0.95, "QUASI-ID")
        .otherwise("HIGH")
    )
    return stats.select("column", "n_unique", F.round(ratio * 100, 2).alias("pct_unique"), kind.alias("kind"))


def duplicates(df: DataFrame) -> DataFrame:
    """Per column (and ``*`` for whole rows): rows that repeat an earlier value."""
    columns = df.columns
    whole = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).agg(
        F.lit("*").alias("column"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicated"),
        F.sum("__n").alias("n_rows"),
    )
    single = per_column(
        df,
        columns,
        {
            "n_duplicated": lambda c: F.count(F.lit(1))
            - F.count_distinct(F.col(f"`{c}`"))
            - F.max(F.col(f"`{c}`").isNull().cast("int")),
            "n_rows": lambda c: F.count(F.lit(1)),
        },
    )
    both = whole.unionByName(single)
    return both.select(
        "column", "n_duplicated", F.round(F.col("n_duplicated") / F.col("n_rows") * 100, 2).alias("pct_duplicated")
    )


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return per_column(
        df,
        columns,
        {
            "n": lambda c: F.count(c),
            "mean": lambda c: F.avg(dbl(c)),
            "std": lambda c: F.stddev_samp(dbl(c)),
            "min": lambda c: F.min(dbl(c)),
            "max": lambda c: F.max(dbl(c)),
            "skew": sample_skewness,
            "kurtosis": sample_kurtosis,
        },
    )


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    quantiles = exact_quantiles(df, {c: list(PERCENTILES.values()) for c in columns})
    rows = [(c, *map(_float, quantiles[c])) for c in columns]
    schema = "column string, " + ", ".join(f"{p} double" for p in PERCENTILES)
    table = small_table(df.sparkSession, rows, schema)
    return moments(df, columns).join(F.broadcast(table), "column")


def _float(value):
    return None if value is None else float(value)


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Class counts, percentages, ratio of largest to smallest class and a warning level."""
    counted = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    # One row reaches the driver; a target may have any number of values.
    total, most, fewest = counted.agg(F.sum("n"), F.max("n"), F.min("n")).first()
    ratio = F.lit(most) / F.lit(fewest)
    return counted.select(
        F.col(target).cast("string").alias("target"),
        "n",
        (F.col("n") / F.lit(total) * 100).alias("pct"),
        ratio.alias("imbalance_ratio"),
        F.when(ratio > 10, "severe").when(ratio > 3, "moderate").otherwise("balanced").alias("level"),
    )


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """Class counts for text or few-valued targets, else mean, spread and skewness."""
    few = df.select(target).distinct().limit(20).count() < 20
    if few or target in string_columns(df):
        return class_counts(df, target)
    skew = sample_skewness(target)
    return df.agg(
        F.avg(dbl(target)).alias("mean"),
        F.stddev_samp(dbl(target)).alias("std"),
        skew.alias("skew"),
        (F.abs(skew) > 1).cast("int").alias("skewed"),
    )


def quick(df: DataFrame) -> DataFrame:
    """Short list of findings: missing, duplicates, constants, quasi-ids, strong skew."""
    spark = df.sparkSession
    found: list[tuple[str, str, float]] = []
    for row in missing(df).limit(5).collect():
        found.append(("missing", row["column"], float(row["pct_missing"])))
    found.append(("duplicate_rows", "*", float(duplicates(df).where("column = '*'").first()["n_duplicated"])))
    texts = set(string_columns(df))
    n = df.count()
    for row in cardinality(df).collect():
        if row["n_unique"] <= 1:
            found.append(("constant", row["column"], float(row["n_unique"])))
        elif row["column"] in texts and row["n_unique"] / n > 0.9:
            found.append(("quasi_id", row["column"], row["n_unique"] / n))
    skews = per_column(df, numeric_columns(df), {"skew": sample_skewness})
    strong = skews.where("abs(skew) > 2").orderBy(F.desc(F.abs("skew")), "column").limit(5)
    found += [("skewed", r["column"], float(r["skew"])) for r in strong.collect()]
    return small_table(spark, found, "finding string, column string, value double")


def missing_correlation(df: DataFrame) -> DataFrame:
    """Correlation of the null indicators of every pair of columns that have nulls."""
    counts = aggregate_row(df, {c: F.count(F.when(F.col(f"`{c}`").isNull(), 1)) for c in df.columns})
    holed = [c for c in df.columns if counts[c]]
    return correlations(df.select(*[F.col(f"`{c}`").isNull().cast("double").alias(c) for c in holed]), holed)


def _long(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    if not columns:
        none = [F.lit(None).cast("string").alias("column"), F.lit(None).cast("double").alias("x")]
        return df.select(*keep, *none).where(F.lit(False))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), dbl(c).alias("x")) for c in columns]))
    return df.select(*keep, pairs.alias("p")).select(*keep, "p.column", "p.x").where("x is not null")


def _bucket(bins: int):
    width = F.col("hi") - F.col("lo")
    position = F.floor((F.col("x") - F.col("lo")) / width * bins)
    return F.when(width == 0, F.lit(0)).otherwise(F.least(position, F.lit(bins - 1))).cast("int")


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 40) -> DataFrame:
    """Equal-width histogram and skew band of each column."""
    ranges = per_column(
        df, columns, {"lo": lambda c: F.min(dbl(c)), "hi": lambda c: F.max(dbl(c)), "skew": sample_skewness}
    )
    binned = _long(df, columns).join(F.broadcast(ranges), "column").withColumn("bin", _bucket(bins))
    band = F.when(F.abs("skew") > 2, "high").when(F.abs("skew") > 1, "medium").otherwise("ok")
    return (
        binned.groupBy("column", "bin", "lo", "hi", "skew").agg(F.count(F.lit(1)).alias("n"))
        .select(
            "column",
            "bin",
            (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("left_edge"),
            "n",
            band.alias("skew_band"),
        )
    )


def class_histograms(df: DataFrame, columns: Sequence[str], target: str, bins: int = 30) -> DataFrame:
    """Density per class, each class binned over its own range."""
    long = _long(df, columns, target)
    ranges = long.groupBy(target, "column").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("total")
    )
    keyed = long.join(ranges, [target, "column"])
    counted = keyed.withColumn("bin", _bucket(bins)).groupBy(target, "column", "bin", "lo", "hi", "total").agg(
        F.count(F.lit(1)).alias("n")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return counted.select(target, "column", "bin", "n", F.when(width > 0, F.col("n") / (F.col("total") * width)).alias("density"))


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, threshold: float | None = None) -> DataFrame:
    """Pearson correlation of every pair, on rows where both values are present."""
    table = correlations(df, list(columns or numeric_columns(df)))
    return table if threshold is None else table.where(F.abs("r") > threshold)


def top_categories(df: DataFrame, columns: Sequence[str], top: int = 15) -> DataFrame:
    """Most frequent values of each text column, with its number of distinct values."""
    named = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    pairs = F.explode(F.array(*named) if named else F.array().cast("array<struct<column:string,value:string>>"))
    counted = (
        df.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    first = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    distinct = counted.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    # the rank filter lets Spark keep `top` rows per column before the shuffle
    ranked = counted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(distinct), "column")


def boxplots(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers (last value within 1.5 IQR) and number of outliers."""
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    columns = [c for c in columns if quartiles[c][0] is not None]
    limits = {}
    for c in columns:
        q1, _, q3 = quartiles[c]
        limits[c] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    expressions = {}
    for c, (low, high) in limits.items():
        inside = dbl(c).between(low, high)
        expressions[c, "low"] = F.min(F.when(inside, dbl(c)))
        expressions[c, "high"] = F.max(F.when(inside, dbl(c)))
        expressions[c, "out"] = F.count(F.when(~inside, 1))
    found = aggregate_row(df, expressions)
    rows = [(c, *map(float, quartiles[c]), float(found[c, "low"]), float(found[c, "high"]), found[c, "out"]) for c in columns]
    return small_table(
            df.sparkSession,
        rows, "column string, q1 double, median double, q3 double, whisker_low double, whisker_high double, n_outliers bigint"
    )


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Table (column, x, rank): the average rank of every distinct value."""
    counted = _long(df, columns).groupBy("column", "x").agg(F.count(F.lit(1)).alias("n"))
    totals = running_totals(counted, ["column", "x"], ["n"])
    offsets = totals.groupBy("column").agg(F.min(F.col("cum_n") - F.col("n")).alias("skip"))
    running = totals.join(F.broadcast(offsets), "column")
    rank = F.col("cum_n") - F.col("skip") - (F.col("n") - 1) / F.lit(2.0)
    return running.select("column", "x", rank.cast("double").alias("rank"))


def spearman_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman correlation of complete columns: Pearson correlation of average ranks."""
    ranks = average_ranks(df, columns)
    ranked = df.select(*[dbl(c).alias(f"__x{i}") for i, c in enumerate(columns)])
    for i, c in enumerate(columns):
        side = ranks.where(F.col("column") == c).select(F.col("x").alias(f"__x{i}"), F.col("rank").alias(f"__k{i}"))
        ranked = ranked.join(side, f"__x{i}", "left")
    named = ranked.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(columns)])
    return correlation_pairs(named, columns)


def cramers_v(df: DataFrame, a: str, b: str) -> float:
    """Cramer's V of two categorical columns with any number of values: joins of counts, one row to the driver."""
    whole = df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    cells = whole.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    left = cells.groupBy("a").agg(F.sum("n").alias("of_a"))
    right = cells.groupBy("b").agg(F.sum("n").alias("of_b"))
    share = F.sum(F.col("n").cast("double") * F.col("n") / F.col("of_a") / F.col("of_b"))
    share = cells.join(left, "a").join(right, "b").agg(share).first()[0]
    levels = min(left.count(), right.count())
    return 0.0 if levels < 2 else (max(0.0, share - 1) / (levels - 1)) ** 0.5


def association(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Spearman for numeric pairs, Cramer's V for categorical pairs."""
    spark = df.sparkSession
    rows = [(a, b, "cramers_v", cramers_v(df, a, b)) for a, b in combinations(categorical, 2)]
    table = small_table(spark, rows, "a string, b string, measure string, value double")
    ranks = spearman_pairs(df, numeric).select("a", "b", F.lit("spearman").alias("measure"), F.col("r").alias("value"))
    return table.unionByName(ranks)


def interactions(df: DataFrame, a: str, b: str, bins: int = 10) -> DataFrame:
    """Two-dimensional histogram of a pair of numeric columns."""
    ends = aggregate_row(df, {(c, f.__name__): f(dbl(c)) for c in (a, b) for f in (F.min, F.max)})

    def cell(c):
        low, high = ends[c, "min"], ends[c, "max"]
        if low == high:
            return F.lit(0)
        return F.least(F.floor((dbl(c) - F.lit(low)) / F.lit(high - low) * bins), F.lit(bins - 1)).cast("int")

    whole = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return whole.groupBy(cell(a).alias("bin_a"), cell(b).alias("bin_b")).agg(F.count(F.lit(1)).alias("n"))


def alerts(df: DataFrame) -> DataFrame:
    """Columns that need attention: constant, high cardinality, missing, skewed; repeated rows."""
    findings = quick(df).select("finding", "column")
    high = cardinality(df, string_columns(df)).where("kind in ('HIGH', 'QUASI-ID')").select(
        F.lit("high_cardinality").alias("finding"), "column"
    )
    repeated = duplicates(df).where("column <> '*' or n_duplicated > 0").where("column = '*'")
    return findings.where("finding not in ('duplicate_rows', 'quasi_id')").unionByName(high).unionByName(
        repeated.select(F.lit("duplicate_rows").alias("finding"), "column")
    )


def report(df: DataFrame) -> DataFrame:
    """Overview figures of a profile report, one row per figure."""
    numbers, texts = numeric_columns(df), string_columns(df)
    n = df.count()
    holes = aggregate_row(df, {c: F.count(F.when(F.col(f"`{c}`").isNull(), 1)) for c in df.columns})
    copies = duplicates(df).where("column = '*'").first()["n_duplicated"]
    rows = [
        ("n_rows", float(n)),
        ("n_columns", float(len(df.columns))),
        ("n_numeric", float(len(numbers))),
        ("n_text", float(len(texts))),
        ("missing_cells", float(sum(holes.values()))),
        ("pct_missing_cells", round(100 * sum(holes.values()) / max(1, n * len(df.columns)), 4)),
        ("duplicate_rows", float(copies)),
        ("n_alerts", float(alerts(df).count())),
    ]
    return small_table(df.sparkSession, rows, "figure string, value double")


def head_tail(df: DataFrame, order: str, n: int = 10) -> DataFrame:
    """First and last rows in ``order`` (top-n, no full sort)."""
    first = df.orderBy(order).limit(n).withColumn("part", F.lit("head"))
    last = df.orderBy(F.desc(order)).limit(n).withColumn("part", F.lit("tail"))
    return first.unionByName(last)


def before_after(before: DataFrame, after: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """Histograms of the same columns before and after a step."""
    return histograms(before, columns, bins).withColumn("stage", F.lit("before")).unionByName(
        histograms(after, columns, bins).withColumn("stage", F.lit("after"))
    )


def normal_quantile_plot(df: DataFrame, column: str, points: int = 20) -> DataFrame:
    """Observed quantiles against those of the normal distribution."""
    shares = [(i + 0.5) / points for i in range(points)]
    observed = exact_quantiles(df, {column: shares})[column]
    rows = [(p, NormalDist().inv_cdf(p), float(v)) for p, v in zip(shares, observed)]
    return small_table(df.sparkSession, rows, "share double, theoretical double, observed double")
