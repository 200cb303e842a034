"""Column roles, resolved from the schema without touching data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def type_class(data_type: T.DataType) -> str:
    if isinstance(data_type, T.IntegralType):
        return "integer"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(data_type, T.StringType):
        return "string/mixed"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "other"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes NULL: the aggregates skip NULL but not NaN."""
    return df.select(
        *[
            F.when(F.isnan(f.name), None).otherwise(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def dbl(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def rounded(column: str | Column, digits: int = 6) -> Column:
    """Round, with negative zero folded into zero."""
    return F.round(dbl(column), digits) + F.lit(0.0)


def label_map(column: str | Column, mapping: dict, default=None) -> Column:
    """A literal lookup for a small driver-side dictionary."""
    source = F.col(column) if isinstance(column, str) else column
    if not mapping:
        return F.lit(default)
    pairs = [F.lit(item) for entry in mapping.items() for item in entry]
    found = F.element_at(F.create_map(*pairs), source)
    return found if default is None else F.coalesce(found, F.lit(default))
