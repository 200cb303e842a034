"""The table of runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``, with the SQL that must agree with it."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream, whether it is one file or a folder of files.

    A stream that starts at a plain path takes it for a folder; a pattern that only the table matches
    may find either, and lists the files inside a folder.
    """
    path = f"{folder}/{name}.parque[t]"
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(path)
