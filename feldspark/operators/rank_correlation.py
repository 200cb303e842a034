"""Kendall's tau-b of two columns with any number of values, by counting inversions.

Pairs of values are counted once each. Where they do not fit one task they are cut into ranges twice: by the
first column (ties by the second), and by the second (ties by the first). A discordant pair then lies

* in one range of the second column, and is counted there;
* in one range of the first column but two of the second, and is counted there by the numbers of the second's ranges;
* in two ranges of either, and is counted from how many rows each pair of ranges holds, which is the same problem on a far
  smaller table.

Ranges follow both columns, so a frequent value is spread over several of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from math import isqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

LOCAL_ROWS = 500_000
COUNT = "total decimal(38,0)"


class PairCounts(NamedTuple):
    """Pairs of rows in all, tied in either column, concordant and discordant."""

    pairs: int
    tied_a: int
    tied_b: int
    concordant: int
    discordant: int

    @property
    def tau(self) -> float:
        """Tau-b; not a number where a column has one value only."""
        left, right = self.pairs - self.tied_a, self.pairs - self.tied_b
        return (self.concordant - self.discordant) / (float(left) * float(right)) ** 0.5 if left and right else float("nan")


def inversions(order: np.ndarray, weights: np.ndarray) -> int:
    """Sum over i < j with order[i] > order[j] of the products of their weights.

    Numbers are compared bit by bit from the highest: of two that agree so far, an earlier one with the bit set before a later
    one without it is an inversion, and running sums count all of these at once.
    """
    if len(order) < 2:
        return 0
    _, ranks = np.unique(order, return_inverse=True)
    ranks, weights = ranks.astype(np.int64), weights.astype(np.int64)
    heavy = int(weights.sum()) >= 1 << 31
    total = 0
    for bit in reversed(range(int(ranks.max()).bit_length())):
        group, is_set = ranks >> (bit + 1), (ranks >> bit) & 1 == 1
        before = np.cumsum(np.where(is_set, weights, 0))
        first = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))
        skipped = np.repeat(np.where(first > 0, before[first - 1], 0), np.diff(np.concatenate((first, [len(ranks)]))))
        found = weights[~is_set], (before - skipped)[~is_set]
        total += int((found[0].astype(object) * found[1].astype(object)).sum()) if heavy else int((found[0] * found[1]).sum())
        place = np.argsort(ranks >> bit, kind="stable")
        ranks, weights = ranks[place], weights[place]
    return total


def _counted(first: str, second: str, compared: str):
    """Inversions of one partition, in the order of ``first`` and ``second``, of the column ``compared``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            rows = pd.concat(held, ignore_index=True)
            x, y = (np.unique(rows[c].to_numpy(), return_inverse=True)[1] for c in (first, second))
            place = np.lexsort((y, x))
            total = inversions(rows[compared].to_numpy()[place], rows["n"].to_numpy()[place])
            yield pd.DataFrame({"total": [Decimal(total)]})

    return run


def _summed(parts: DataFrame) -> int:
    return int(parts.agg(F.coalesce(F.sum("total"), F.lit(0).cast("decimal(38,0)"))).first()[0])


def discordant_pairs(cells: DataFrame, local_rows: int = LOCAL_ROWS) -> int:
    """Weighted pairs of distinct rows (``a``, ``b``, ``n``) of which one has the smaller ``a`` and the larger ``b``."""
    size = cells.count()
    if size <= local_rows:
        return _summed(cells.coalesce(1).mapInPandas(_counted("a", "b", "b"), COUNT))
    # So few that pairs of ranges are at most half as many as the rows, whatever the size.
    ranges = max(1, min(2 * -(-size // local_rows), isqrt(size // 2)))
    by_b = cut_lineage(cells.repartitionByRange(ranges, "b", "a").withColumn("k", F.spark_partition_id()))
    by_a = cut_lineage(by_b.repartitionByRange(ranges, "a", "b").withColumn("p", F.spark_partition_id()))
    inside = _summed(by_b.select("a", "b", "n").mapInPandas(_counted("a", "b", "b"), COUNT))
    across = _summed(by_a.select("a", "b", "k", "n").mapInPandas(_counted("a", "b", "k"), COUNT))
    apart = cut_lineage(by_a.groupBy(F.col("p").alias("a"), F.col("k").alias("b")).agg(F.sum("n").alias("n")))
    return inside + across + discordant_pairs(apart, local_rows)


def kendall_counts(df: DataFrame, a: str, b: str, local_rows: int = LOCAL_ROWS) -> PairCounts:
    """Counts behind tau-b over the rows that have both values; NaN is the largest value, equal to itself."""
    whole = df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    cells = cut_lineage(whole.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    wide = F.col("n").cast("decimal(38,0)")
    pairs = F.coalesce(F.sum(wide * (wide - 1)).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))

    def tied(*columns: str) -> int:
        grouped = cells.groupBy(*columns).agg(F.sum("n").alias("n")) if columns else cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        return int(grouped.agg(pairs).first()[0]) // 2

    every, tied_a, tied_b, both = tied(), tied("a"), tied("b"), int(cells.agg(pairs).first()[0]) // 2
    discordant = discordant_pairs(cells, local_rows)
    return PairCounts(every, tied_a, tied_b, every - tied_a - tied_b + both - discordant, discordant)


def kendall_tau(df: DataFrame, a: str, b: str) -> float:
    return kendall_counts(df, a, b).tau
