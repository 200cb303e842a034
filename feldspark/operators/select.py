"""Feature selection rules over one-pass statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import dbl
from ..session import cut_lineage, small_table
from .aggregates import aggregate_row
from .features import apply_bins, fit_bins
from .pairs import correlations

def variances(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return aggregate_row(df, {c: F.var_pop(dbl(c)) for c in columns})


def keep_varying(df: DataFrame, columns: Sequence[str], threshold: float = 0.01) -> list[str]:
    found = variances(df, columns)
    return [c for c in columns if found[c] is not None and found[c] > threshold]


def correlation_drops(df: DataFrame, columns: Sequence[str], target: str, threshold: float = 0.95) -> list[str]:
    """Of each too similar pair drop the one less correlated with the target (ties: the later one).

    Columns already dropped still take part in later pairs.
    """
    pairs = list(combinations(columns, 2))
    # One row for each pair of columns.
    found = {(r["a"], r["b"]): r["r"] for r in correlations(df, [*columns, target]).collect()}
    found.update({c: found.get((c, target)) for c in columns})

    def size(key):
        value = found[key]
        return None if value is None or value != value else abs(value)

    dropped = set()
    for first, later in pairs:
        similar = size((first, later))
        if similar is not None and similar > threshold:
            a, b = size(first), size(later)
            dropped.add(first if a is not None and b is not None and a < b else later)
    return [c for c in columns if c in dropped]


def mutual_information(
    df: DataFrame, columns: Sequence[str], target: str, bins: int = 10, classification: bool = True
) -> dict[str, float]:
    """Mutual information (nats) of each quantile-binned feature with the target.

    One aggregation counts every (feature, bin, target) cell, and joins of these counts with their own sums give one number
    for each feature, whatever the number of target values.
    """
    if not columns:
        return {}
    edges = fit_bins(df, columns, bins)
    binned = apply_bins(df, edges)
    if classification:
        outcome = F.col(target).cast("string")
    else:
        binned = apply_bins(binned, fit_bins(df, [target], bins))
        outcome = F.col(f"{target}_bin").cast("string")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_bin").cast("int").alias("bin")) for c in columns]))
    counts = binned.select(outcome.alias("y"), cells.alias("c")).select("y", "c.*").where("bin is not null and y is not null")
    cells = cut_lineage(counts.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("m")))
    of_bin = cells.groupBy("feature", "bin").agg(F.sum("m").alias("of_bin"))
    of_y = cells.groupBy("feature", "y").agg(F.sum("m").alias("of_y"))
    total = cells.groupBy("feature").agg(F.sum("m").alias("n"))
    held = cells.join(F.broadcast(total), "feature").join(F.broadcast(of_bin), ["feature", "bin"]).join(of_y, ["feature", "y"])
    share = F.col("m") / F.col("n")
    term = share * F.log(F.col("m").cast("double") * F.col("n") / (F.col("of_bin").cast("double") * F.col("of_y")))
    found = {r["feature"]: r["mi"] for r in held.groupBy("feature").agg(F.sum(term).alias("mi")).collect()}
    return {c: float(found.get(c) or 0.0) for c in columns}


def top_features(scores: Mapping[str, float], n: int | None = None, share: float = 0.5) -> list[str]:
    """Best features by score; by default half of them, at least one."""
    ranked = sorted(scores, key=lambda c: (-scores[c], list(scores).index(c)))
    return ranked[: min(n or max(1, int(len(scores) * share)), len(scores))]


def ranking_table(spark, scores: Mapping[str, float], selected: Sequence[str]) -> DataFrame:
    order = sorted(scores, key=lambda c: (-scores[c], list(scores).index(c)))
    rows = [(c, round(float(scores[c]), 6) + 0.0, i + 1, int(c in set(selected))) for i, c in enumerate(order)]
    return small_table(spark, rows, "feature string, importance double, rank int, selected int")
