"""Filters, predicates and input checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import dbl, numeric_columns
from .aggregates import aggregate_row


class InputError(ValueError):
    """The table cannot be used for training as it is."""


def sentinel_to_null(df: DataFrame, columns: Sequence[str] | None = None, sentinel: float = -1) -> DataFrame:
    """Null out the sentinel in columns whose minimum is exactly the sentinel."""
    columns = numeric_columns(df) if columns is None else list(columns)
    lowest = aggregate_row(df, {c: F.min(c) for c in columns})
    coded = {c for c in columns if lowest[c] == sentinel}
    return df.select(*[F.nullif(F.col(c), F.lit(sentinel).cast(df.schema[c].dataType)).alias(c) if c in coded else c for c in df.columns])


def null_shares(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, float]:
    columns = columns or df.columns
    return aggregate_row(df, {c: F.coalesce(F.avg(F.col(f"`{c}`").isNull().cast("double")), F.lit(0.0)) for c in columns})


def drop_sparse_columns(df: DataFrame, threshold: float = 0.6, keep: Sequence[str] = ()) -> DataFrame:
    shares = null_shares(df)
    return df.drop(*[c for c, s in shares.items() if s > threshold and c not in keep])


def drop_sparse_rows(df: DataFrame, threshold: float, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows whose share of null cells is at most ``threshold``. For training rows only."""
    columns = list(columns or df.columns)
    nulls = sum((F.col(f"`{c}`").isNull().cast("int") for c in columns), F.lit(0))
    return df.where(nulls / F.lit(float(len(columns))) <= F.lit(float(threshold)))


def missing_indicators(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in columns})


def validate_no_missing(df: DataFrame, raise_error: bool = True) -> bool:
    counts = aggregate_row(df, {c: F.count(F.when(F.col(f"`{c}`").isNull(), 1)) for c in df.columns})
    bad = {c: n for c, n in counts.items() if n}
    if bad and raise_error:
        raise InputError(f"{sum(bad.values())} missing values remain in {sorted(bad)}")
    return not bad


def missing_summary(df: DataFrame) -> DataFrame:
    """One row: total missing cells and whether the table is complete."""
    total = sum((F.count(F.when(F.col(f"`{c}`").isNull(), 1)) for c in df.columns), F.lit(0).cast("bigint"))
    return df.agg(total.alias("n_missing")).withColumn("is_complete", (F.col("n_missing") == 0).cast("int"))


def binary_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns whose non-null values are all 0 or 1."""
    columns = numeric_columns(df) if columns is None else list(columns)
    only = aggregate_row(df, {c: F.coalesce(F.min(dbl(c).isin(0.0, 1.0)), F.lit(True)) for c in columns})
    return [c for c in columns if only[c]]


def validate_input(df: DataFrame, target: str, few_rows: int = 100) -> dict:
    """Row count, null targets and a warning flag; raises when the target is unusable."""
    if target not in df.columns:
        raise InputError(f"target {target!r} is not a column")
    found = aggregate_row(df, {"n_rows": F.count(F.lit(1)), "n_null_target": F.count(F.when(F.col(target).isNull(), 1))})
    if found["n_null_target"]:
        raise InputError(f"target {target!r} is null in {found['n_null_target']} rows")
    return {**found, "few_rows": found["n_rows"] < few_rows}
