"""Wide aggregates: many statistics of many columns in as few passes as possible."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roles import dbl

# One aggregate this wide still compiles to reasonable generated code.
EXPRESSIONS_PER_PASS = 200
# Largest number of values one percentile buffer may hold.
PERCENTILE_BUFFER = 50_000


def aggregate_row(df: DataFrame, expressions: Mapping[str, Column]) -> dict:
    """Evaluate named global aggregates and bring back the single result row."""
    names = list(expressions)
    result: dict = {}
    for start in range(0, len(names), EXPRESSIONS_PER_PASS):
        part = names[start : start + EXPRESSIONS_PER_PASS]
        row = df.agg(*[expressions[n].alias(f"v{i}") for i, n in enumerate(part)]).first()
        result.update(zip(part, row))
    return result


def per_column(
    df: DataFrame, columns: Sequence[str], statistics: Mapping[str, Callable[[str], Column]]
) -> DataFrame:
    """One row per column, one field per statistic, from wide aggregates (lazy)."""
    per_pass = max(1, EXPRESSIONS_PER_PASS // max(1, len(statistics)))
    result = None
    for start in range(0, len(columns), per_pass):
        part = columns[start : start + per_pass]
        wide = df.agg(
            *[
                F.struct(F.lit(c).alias("column"), *[fn(c).alias(s) for s, fn in statistics.items()]).alias(f"c{i}")
                for i, c in enumerate(part)
            ]
        )
        long = wide.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(part))])).alias("r")).select("r.*")
        result = long if result is None else result.unionByName(long)
    return result


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    buffer: int = PERCENTILE_BUFFER,
    accuracy: int = 10_000,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of several columns, exact at any size.

    ``percentile`` keeps every distinct value in one aggregation buffer, so it is used
    only on value ranges counted to be small. Larger columns are first narrowed: an
    approximate summary brackets the wanted rank, the rows below the bracket are counted,
    and the bracket is narrowed again until it fits. Each round is one pass over all
    columns and ranks together and returns a handful of numbers.
    """
    columns = [c for c, ps in wanted.items() if len(ps)]
    counts = aggregate_row(df, {c: F.count(dbl(c)) for c in columns})
    result: dict[str, list[float | None]] = {c: [None] * len(wanted[c]) for c in wanted}

    small = {c: F.percentile(dbl(c), F.array(*[F.lit(float(p)) for p in wanted[c]])) for c in columns if 0 < counts[c] <= buffer}
    for column, values in aggregate_row(df, small).items() if small else ():
        result[column] = list(values)

    large = [c for c in columns if counts[c] > buffer]
    if large:
        ranks = {}
        for c in large:
            for p in wanted[c]:
                position = p * (counts[c] - 1)
                ranks[c, p] = (math.floor(position), math.ceil(position))
        found = _order_statistics(df, {(c, *r) for (c, _), r in ranks.items()}, counts, buffer, accuracy)
        for c in large:
            result[c] = []
            for p in wanted[c]:
                low, high = found[c, *ranks[c, p]]
                position = p * (counts[c] - 1)
                result[c].append(low + (high - low) * (position - ranks[c, p][0]))
    return result


def _order_statistics(df, wanted, counts, buffer, accuracy):
    """Values at pairs of neighbouring zero-based ranks, by narrowing a bracket around each pair."""
    # (column, rank, rank) -> low end, high end, rows below it, rows inside it, slack
    brackets = {key: (None, None, 0, counts[key[0]], 4.0 / accuracy) for key in wanted}
    found: dict = {}

    def inside(column, low, high):
        x = dbl(column)
        return x.isNotNull() if low is None else x.between(low, high)

    while brackets:
        asked = {}
        shared: dict = {}
        for key, (low, high, below, size, slack) in brackets.items():
            column, first, last = key
            if size <= buffer:
                held = "" if low is None else f" AND CAST(`{column}` AS DOUBLE) BETWEEN {low!r}D AND {high!r}D"
                shares = ", ".join(f"{(rank - below + 0.5) / size!r}D" for rank in (first, last))
                asked[key] = F.expr(
                    f"percentile_disc(array({shares})) WITHIN GROUP (ORDER BY CAST(`{column}` AS DOUBLE))"
                    f" FILTER (WHERE `{column}` IS NOT NULL{held})"
                )
            else:
                ends = [max(0.0, (first - below) / (size - 1) - slack), min(1.0, (last - below) / (size - 1) + slack)]
                shared.setdefault((column, low, high), []).append((key, ends))
        # pairs that share a bracket share one summary
        for (column, low, high), keys in shared.items():
            every = [end for _, ends in keys for end in ends]
            asked[column, low, high] = F.percentile_approx(F.when(inside(column, low, high), dbl(column)), every, accuracy)
        answers = aggregate_row(df, asked)
        for bracket, keys in shared.items():
            for i, (key, _) in enumerate(keys):
                answers[key] = answers[bracket][2 * i : 2 * i + 2]

        checks = {}
        for key, (_, _, _, size, _) in list(brackets.items()):
            if size <= buffer:
                found[key] = tuple(answers[key])
                del brackets[key]
            else:
                new_low, new_high = answers[key]
                checks[key, "below"] = F.count(F.when(dbl(key[0]) < F.lit(new_low), 1))
                checks[key, "inside"] = F.count(F.when(inside(key[0], new_low, new_high), 1))
        sizes = aggregate_row(df, checks) if checks else {}

        for key, (low, high, below, size, slack) in list(brackets.items()):
            new_low, new_high = answers[key]
            before, held = sizes[key, "below"], sizes[key, "inside"]
            if not before <= key[1] <= key[2] < before + held:
                brackets[key] = (low, high, below, size, slack * 4)
            elif new_low == new_high:
                found[key] = (new_low, new_high)
                del brackets[key]
            elif held >= size:
                # no longer shrinking: the bracket holds few distinct values, each very often
                found[key] = tuple(_value_by_counts(df, key[0], rank, new_low, new_high, before) for rank in key[1:])
                del brackets[key]
            else:
                brackets[key] = (new_low, new_high, before, held, slack)
    return found


def _value_by_counts(df, column, rank, low, high, below):
    """Order statistic inside a bracket whose few distinct values repeat very often."""
    x = dbl(column)
    table = df.where(x.between(low, high)).groupBy(x.alias("x")).count().orderBy("x")
    seen = below
    for row in table.toLocalIterator():
        seen += row["count"]
        if rank < seen:
            return float(row["x"])
    raise AssertionError("rank outside its bracket")
