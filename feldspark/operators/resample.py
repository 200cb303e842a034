"""Class weights and random resampling. Synthetic resampling is in ``synthetic``."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import label_map
from ..session import small_table
from .ordering import hash_cuts, hash_key, hash_uniform, ranked_by_hash, stratum_sizes


def class_weights(df: DataFrame, label: str) -> dict:
    sizes = stratum_sizes(df.where(F.col(label).isNotNull()), label)
    n = sum(sizes.values())
    return {c: n / (len(sizes) * m) for c, m in sizes.items()}


def with_weights(df: DataFrame, label: str, weights: Mapping | None = None, out: str = "weight") -> DataFrame:
    return df.withColumn(out, label_map(label, dict(weights or class_weights(df, label))))


def positive_weight(df: DataFrame, label: str) -> float:
    """Negatives per positive, two digits."""
    sizes = stratum_sizes(df, label)
    positives = sum(n for c, n in sizes.items() if c == 1)
    if not positives:
        raise ValueError(f"no positive rows in {label!r}")
    return round((sum(sizes.values()) - positives) / positives, 2)


def over_targets(sizes: Mapping, strategy: str | float | Mapping = "auto") -> dict:
    """Class sizes to reach: the largest class, a ratio of it, or given sizes."""
    top = max(sizes.values())
    if isinstance(strategy, Mapping):
        return {c: max(n, strategy.get(c, n)) for c, n in sizes.items()}
    goal = top if strategy == "auto" else int(top * float(strategy))
    return {c: n if n == top else max(n, goal) for c, n in sizes.items()}


def under_targets(sizes: Mapping, strategy: str | float | Mapping = "auto") -> dict:
    low = min(sizes.values())
    if isinstance(strategy, Mapping):
        return {c: min(n, strategy.get(c, n)) for c, n in sizes.items()}
    goal = low if strategy == "auto" else int(low / float(strategy))
    return {c: n if n == low else min(n, goal) for c, n in sizes.items()}


def undersample(df: DataFrame, id_column: str, label: str, strategy="auto", seed: int = 42) -> DataFrame:
    """Keep the first rows of each class in hash order. A filter: rows do not move."""
    sizes = stratum_sizes(df, label)
    goals = under_targets(sizes, strategy)
    cuts = hash_cuts(df, id_column, seed, {c: [goals[c]] for c in sizes if goals[c] < sizes[c]}, label)
    keep = F.lit(True)
    for c, (cut,) in cuts.items():
        keep = keep & (~F.col(label).eqNullSafe(F.lit(c)) | (hash_key(id_column, seed) <= F.lit(cut)))
    return df.where(keep)


def draws(df: DataFrame, label: str, sizes: Mapping, goals: Mapping, seed: int) -> DataFrame:
    """(label, copy, rank): which row of its class each extra row repeats, drawn with replacement."""
    spark = df.sparkSession
    kind = df.schema[label].dataType.simpleString()
    result = None
    for c in sizes:
        need = goals[c] - sizes[c]
        if need <= 0:
            continue
        pick = F.floor(hash_uniform(F.concat(F.lit(f"{seed}:{c}:"), F.col("id").cast("string"))) * sizes[c]) + 1
        part = spark.range(1, need + 1).select(
            F.lit(c).cast(kind).alias(label), F.col("id").alias("copy"), pick.cast("bigint").alias("rank")
        )
        result = part if result is None else result.unionByName(part)
    if result is None:
        result = small_table(spark, [], f"{label} {kind}, copy bigint, rank bigint")
    return result


def oversample(df: DataFrame, id_column: str, label: str, strategy="auto", seed: int = 42) -> DataFrame:
    """All rows (copy 0) plus repeated rows of the smaller classes (copy 1, 2, ...)."""
    sizes = stratum_sizes(df, label)
    goals = over_targets(sizes, strategy)
    growing = [c for c in sizes if goals[c] > sizes[c]]
    ranked = ranked_by_hash(df.where(F.col(label).isin(growing)), id_column, seed, label)
    extra = draws(df, label, sizes, goals, seed).join(ranked, [label, "rank"]).select(*df.columns, "copy")
    return df.withColumn("copy", F.lit(0).cast("bigint")).unionByName(extra)


def resample_report(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    def counts(df, stage):
        return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), label, "n")

    return counts(before, "before").unionByName(counts(after, "after"))
