"""Splits, folds and leakage checks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.roles import dbl, numeric_columns
from .ordering import hash_cuts, hash_key, running_totals, stratum_sizes, with_rank


class LeakageError(ValueError):
    """A group or row is on both sides of a split."""


def write_splits(df: DataFrame, folder: str, split: str = "split") -> str:
    df.write.mode("overwrite").partitionBy(split).parquet(folder)
    return folder


def read_splits(spark: SparkSession, folder: str, wanted: Sequence[str], split: str = "split") -> DataFrame:
    """Read some splits; only their folders are scanned."""
    return spark.read.parquet(folder).where(F.col(split).isin(list(wanted)))


def proportional_quota(sizes: dict, total: int) -> dict:
    """Whole numbers near ``total * share`` that add up to ``total`` (largest remainder, then value order)."""
    n = sum(sizes.values())
    ideal = {s: total * c / n for s, c in sizes.items()}
    quota = {s: math.floor(v) for s, v in ideal.items()}
    left = total - sum(quota.values())
    for s in sorted(sizes, key=lambda s: (quota[s] - ideal[s], str(s)))[:left]:
        quota[s] += 1
    return quota


def assign_by_rank(df: DataFrame, id_column: str, seed, bounds: dict, names: Sequence, stratum: str | None, out: str) -> DataFrame:
    """Label rows by hash-rank intervals: ranks up to the first bound get names[0], and so on."""
    cuts = hash_cuts(df, id_column, seed, bounds, stratum)
    key = hash_key(id_column, seed)
    label = None
    for s, keys in cuts.items():
        inside = F.lit(True) if stratum is None else F.col(stratum).eqNullSafe(F.lit(s))
        for bound, name in zip(keys, names):
            hit = inside & (key <= F.lit(bound))
            label = F.when(hit, F.lit(name)) if label is None else label.when(hit, F.lit(name))
    return df.withColumn(out, label.otherwise(F.lit(names[-1])))


def split_holdout(
    df: DataFrame,
    id_column: str,
    label: str | None = None,
    test_size: float = 0.15,
    val_size: float = 0.15,
    seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """Add a train/val/test column, stratified by ``label`` if given. Rows do not move."""
    sizes = stratum_sizes(df, label) if label else {None: df.count()}
    n = sum(sizes.values())
    n_test = math.ceil(test_size * n)
    test = proportional_quota(sizes, n_test)
    rest = {s: c - test[s] for s, c in sizes.items()}
    n_val = math.ceil(val_size / (1 - test_size) * (n - n_test))
    val = proportional_quota(rest, n_val)
    bounds = {s: [test[s], test[s] + val[s]] for s in sizes}
    return assign_by_rank(df, id_column, seed, bounds, ["test", "val", "train"], label, out)


def split_kfold(
    df: DataFrame, id_column: str, label: str | None = None, k: int = 5, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Add the validation fold 0..k-1 of each row; sizes differ by at most one per label."""
    sizes = stratum_sizes(df, label) if label else {None: df.count()}
    bounds = {s: [c // k * (f + 1) + min(f + 1, c % k) for f in range(k - 1)] for s, c in sizes.items()}
    return assign_by_rank(df, id_column, seed, bounds, list(range(k)), label, out)


def fold_table(df: DataFrame, id_column: str, fold: str = "fold", k: int = 5) -> DataFrame:
    """One row per row and fold, with its role there."""
    return df.select(id_column, fold, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("in_fold")).select(
        id_column,
        "in_fold",
        F.when(F.col(fold) == F.col("in_fold"), "val").otherwise("train").alias("role"),
    )


def split_timeseries(df: DataFrame, order: Sequence[str], k: int = 5, out: str = "test_fold") -> DataFrame:
    """Expanding window: add ``position`` (1-based) and the fold that tests the row (-1: train only)."""
    placed = with_rank(df, order, "position")
    n = placed.count()
    size = n // (k + 1)
    first = n - k * size
    fold = F.floor((F.col("position") - 1 - first) / F.lit(size)).cast("int")
    return placed.withColumn(out, F.when(F.col("position") > first, fold).otherwise(F.lit(-1)))


def timeseries_fold_table(df: DataFrame, id_column: str, k: int = 5, test_fold: str = "test_fold") -> DataFrame:
    """One row per row and fold it takes part in: earlier rows train, the fold's rows test."""
    return (
        df.select(id_column, test_fold, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
        .where(F.col(test_fold) <= F.col("fold"))
        .select(id_column, "fold", F.when(F.col(test_fold) == F.col("fold"), "test").otherwise("train").alias("role"))
    )


def split_group(
    df: DataFrame, group: str | None, label: str | None = None, k: int = 5, out: str = "fold"
) -> DataFrame:
    """Whole groups per fold. Groups are dealt back and forth by size, so folds stay balanced."""
    if not group:
        raise ValueError("a group split needs a group column")
    sizes = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("__n"),
        (F.sum(dbl(label)) if label else F.lit(0.0)).alias("__pos"),
    )
    ranked = with_rank(
        sizes.select(group, (-F.col("__pos")).alias("__a"), (-F.col("__n")).alias("__b")), ["__a", "__b", group], "__r"
    )
    place = (F.col("__r") - 1) % (2 * k)
    fold = F.when(place < k, place).otherwise(2 * k - 1 - place).cast("int")
    return df.join(ranked.select(group, fold.alias(out)), group)


def check_group_folds(df: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups that appear in more than one fold (empty when the split is sound)."""
    return df.groupBy(group).agg(F.min(fold).alias("low"), F.max(fold).alias("high")).where("low <> high")


def shared_ids(train: DataFrame, test: DataFrame, id_column: str) -> DataFrame:
    return train.select(id_column).distinct().join(test.select(id_column), id_column, "left_semi")


def shared_rows(train: DataFrame, test: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Equal rows on both sides with the number of pairs; missing equals missing.

    Both sides are counted per distinct row before they meet, so a row copied a million
    times on each side is one joined row, not 10^12.
    """
    columns = list(columns or train.columns)
    left = train.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_train"))
    right = test.groupBy(*[F.col(c).alias(f"__{c}") for c in columns]).agg(F.count(F.lit(1)).alias("n_test"))
    match = None
    for c in columns:
        term = F.col(c).eqNullSafe(F.col(f"__{c}"))
        match = term if match is None else match & term
    return left.join(right, match).select(
        *columns, "n_train", "n_test", (F.col("n_train") * F.col("n_test")).alias("pairs")
    )


def ks_statistics(train: DataFrame, test: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value per numeric column."""
    columns = [c for c in (columns or numeric_columns(train)) if c in test.columns]
    if not columns:
        return train.sparkSession.createDataFrame(
            [], "column string, statistic double, n1 bigint, n2 bigint, p_value double, suspicious int"
        )

    def values(df, side):
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), dbl(c).alias("x")) for c in columns]))
        long = df.select(pairs.alias("p")).select("p.*").where("x is not null")
        return long.select("column", "x", F.lit(1 - side).alias("a"), F.lit(side).alias("b"))

    counted = values(train, 0).unionByName(values(test, 1)).groupBy("column", "x").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    # One row per distinct value from here on; every later step reads the written copy.
    running = running_totals(counted, ["column", "x"], ["a", "b"])
    offsets = running.groupBy("column").agg(
        F.min(F.col("cum_a") - F.col("a")).alias("s1"), F.min(F.col("cum_b") - F.col("b")).alias("s2"),
        F.sum("a").alias("n1"), F.sum("b").alias("n2"),
    )
    gap = F.abs((F.col("cum_a") - F.col("s1")) / F.col("n1") - (F.col("cum_b") - F.col("s2")) / F.col("n2"))
    return (
        running.join(F.broadcast(offsets), "column").groupBy("column")
        .agg(F.max(gap).alias("statistic"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
        .withColumn("p_value", _ks_p_value(F.col("statistic"), F.col("n1"), F.col("n2")))
        .withColumn("suspicious", (F.col("p_value") > 0.999).cast("int"))
    )


def _ks_p_value(d, n1, n2, terms: int = 100):
    """Kolmogorov's limiting distribution, as a finite alternating series."""
    scaled = d * F.sqrt(n1.cast("double") * n2 / (n1 + n2))
    # One expression over a sequence; a hundred copies of the statistic's would not compile.
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda total, j: total + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * scaled * scaled),
    )
    return F.when(scaled < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def check_leakage(train: DataFrame, test: DataFrame, id_column: str, features: Sequence[str]) -> dict:
    """Shared ids, shared rows and columns with identical distributions, right after a split."""
    ids = shared_ids(train, test, id_column).count()
    pairs = shared_rows(train.select(*features), test.select(*features)).agg(F.sum("pairs")).first()[0] or 0
    same = ks_statistics(train.select(*features), test.select(*features)).where("suspicious = 1")
    return {
        "shared_ids": ids,
        "duplicate_pairs": pairs,
        "suspicious": sorted(r["column"] for r in same.collect()),
        "leakage": bool(ids or pairs),
    }


def split_summary(df: DataFrame, split: str, label: str) -> DataFrame:
    """Rows, share of the table and share of the split, per split and class."""
    from pyspark.sql import Window

    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))  # splits x classes rows
    return counts.select(
        split,
        label,
        "n",
        (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share_of_table"),
        (F.col("n") / F.sum("n").over(Window.partitionBy(split))).alias("share_of_split"),
        F.size(F.collect_set(label).over(Window.partitionBy(F.lit(1)))).cast("bigint").alias("n_classes"),
    )
