"""Synthetic minority rows and boundary cleaning, on top of the neighbour join.

Choices (base row, neighbour, position between them) come from hashes of the row number,
so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roles import dbl
from ..session import cut_lineage
from .aggregates import aggregate_row
from .neighbours import nearest
from .ordering import hash_uniform, ranked_by_hash, stratum_sizes
from .resample import draws, over_targets


def _u(name: str, seed: int, *parts: Column) -> Column:
    text = [F.lit(f"{name}:{seed}")]
    for p in parts:
        text += [F.lit(":"), p.cast("string")]
    return hash_uniform(F.concat(*text))


def _between(drawn: DataFrame, points: DataFrame, near: DataFrame, id_column: str, label: str, columns, seed: int) -> DataFrame:
    """Rows (label, copy, base id) become points between the base and one of its neighbours."""
    available = near.groupBy(id_column).agg(F.count(F.lit(1)).alias("__k"))
    chosen = drawn.join(available, id_column).withColumn(
        "__nn", (F.floor(_u("n", seed, F.col(label), F.col("copy")) * F.col("__k")) + 1).cast("int")
    )
    linked = chosen.join(near.select(id_column, F.col("rank").alias("__nn"), "neighbour"), [id_column, "__nn"])
    base = points.select(id_column, *[dbl(c).alias(f"__a_{c}") for c in columns])
    other = points.select(F.col(id_column).alias("neighbour"), *[dbl(c).alias(f"__b_{c}") for c in columns])
    step = _u("u", seed, F.col(label), F.col("copy"))
    return linked.join(base, id_column).join(other, "neighbour").select(
        id_column,
        "neighbour",
        label,
        "copy",
        *[(F.col(f"__a_{c}") + step * (F.col(f"__b_{c}") - F.col(f"__a_{c}"))).alias(c) for c in columns],
    )


def _originals(df: DataFrame, id_column: str, label: str, columns, extra=()) -> DataFrame:
    return df.select(
        id_column, F.lit(None).cast(df.schema[id_column].dataType).alias("neighbour"), label,
        F.lit(0).cast("bigint").alias("copy"), *[dbl(c).alias(c) for c in columns], *extra,
    )


def smote(
    df: DataFrame, id_column: str, label: str, columns: Sequence[str], k: int = 5, strategy="auto", seed: int = 42, **cells
) -> DataFrame:
    """All rows (copy 0) plus points between same-class neighbours, up to the largest class."""
    sizes = stratum_sizes(df, label)
    goals = over_targets(sizes, strategy)
    growing = [c for c in sizes if goals[c] > sizes[c]]
    few = cut_lineage(df.where(F.col(label).isin(growing)).select(id_column, label, *[dbl(c).alias(c) for c in columns]))
    near = cut_lineage(nearest(few, few, id_column, id_column, columns, k, block=label, exclude_same_id=True, **cells))
    ranked = ranked_by_hash(few.select(id_column, label), id_column, seed, label)
    drawn = draws(df, label, sizes, goals, seed).join(ranked, [label, "rank"]).select(id_column, label, "copy")
    return _originals(df, id_column, label, columns).unionByName(_between(drawn, few, near, id_column, label, columns, seed))


def smotenc(
    df: DataFrame,
    id_column: str,
    label: str,
    columns: Sequence[str],
    categorical: Sequence[str],
    k: int = 5,
    strategy="auto",
    seed: int = 42,
    **cells,
) -> DataFrame:
    """SMOTE with categorical columns: levels enter the distance as scaled indicator columns,
    and a new row takes its base's neighbours' most frequent level (ties: the smallest)."""
    from .encode import sorted_levels

    sizes = stratum_sizes(df, label)
    goals = over_targets(sizes, strategy)
    growing = [c for c in sizes if goals[c] > sizes[c]]
    few = df.where(F.col(label).isin(growing))
    spreads = aggregate_row(few, {c: F.stddev_pop(dbl(c)) for c in columns})
    middle = sorted(v or 0.0 for v in spreads.values())
    half = len(middle) // 2
    weight = (middle[half] if len(middle) % 2 else (middle[half - 1] + middle[half]) / 2) / 2
    flags = {}
    for c in categorical:
        for i, level in enumerate(sorted_levels(df, c)):
            flags[f"__c_{c}_{i}"] = F.when(F.col(c).eqNullSafe(F.lit(level)), F.lit(weight)).otherwise(0.0)
    coded = cut_lineage(
        few.select(id_column, label, *[dbl(c).alias(c) for c in columns], *categorical, *[v.alias(n) for n, v in flags.items()])
    )
    near = cut_lineage(
        nearest(coded, coded, id_column, id_column, [*columns, *flags], k, block=label, exclude_same_id=True, **cells)
    )
    levels = coded.select(F.col(id_column).alias("neighbour"), *categorical)
    votes = near.join(levels, "neighbour")
    for_base = near.select(id_column).distinct()
    for c in categorical:
        counted = votes.where(F.col(c).isNotNull()).groupBy(id_column, c).agg(F.count(F.lit(1)).alias("__n"))
        best = counted.groupBy(id_column).agg(F.min_by(c, F.struct(-F.col("__n"), F.col(c))).alias(c))
        for_base = for_base.join(best, id_column, "left")
    ranked = ranked_by_hash(coded.select(id_column, label), id_column, seed, label)
    drawn = draws(df, label, sizes, goals, seed).join(ranked, [label, "rank"]).select(id_column, label, "copy")
    made = _between(drawn, coded, near, id_column, label, columns, seed).join(for_base, id_column)
    return _originals(df, id_column, label, columns, categorical).unionByName(made.select(id_column, "neighbour", label, "copy", *columns, *categorical))


def adasyn(df: DataFrame, id_column: str, label: str, columns: Sequence[str], k: int = 5, seed: int = 42, **cells) -> DataFrame:
    """Synthetic rows in proportion to the share of other-class neighbours of each minority row."""
    sizes = stratum_sizes(df, label)
    goals = over_targets(sizes)
    kept = cut_lineage(df.select(id_column, label, *[dbl(c).alias(c) for c in columns]))
    result = _originals(df, id_column, label, columns)
    labels = kept.select(F.col(id_column).alias("neighbour"), F.col(label).alias("__other"))
    for c in (c for c in sizes if goals[c] > sizes[c]):
        mine = cut_lineage(kept.where(F.col(label) == F.lit(c)))
        around = nearest(mine, kept, id_column, id_column, columns, k, exclude_same_id=True, **cells)
        hardness = cut_lineage(
            around.join(labels, "neighbour").groupBy(id_column).agg(F.avg((F.col("__other") != F.lit(c)).cast("double")).alias("h"))
        )
        total = aggregate_row(hardness, {"t": F.sum("h")})["t"]
        if not total:
            raise ValueError(f"no row of class {c!r} has neighbours of another class")
        quota = F.rint(F.col("h") / F.lit(total) * F.lit(float(goals[c] - sizes[c]))).cast("int")
        drawn = (
            hardness.withColumn("__q", quota).where("__q > 0")
            .select(id_column, F.explode(F.sequence(F.lit(1), F.col("__q"))).alias("__i"))
            .select(id_column, F.lit(c).cast(df.schema[label].dataType).alias(label), F.concat_ws(":", id_column, "__i").alias("copy"))
        )
        near = cut_lineage(nearest(mine, mine, id_column, id_column, columns, k, exclude_same_id=True, **cells))
        made = _between(drawn, mine, near, id_column, label, columns, seed)
        number = F.substring_index("copy", ":", -1).cast("bigint")
        result = result.unionByName(made.withColumn("copy", number))
    return result


def tomek_links(df: DataFrame, id_column: str, label: str, columns: Sequence[str], **cells) -> DataFrame:
    """Ids of rows in mutual nearest pairs of different classes, with their label."""
    near = cut_lineage(nearest(df, df, id_column, id_column, columns, 1, exclude_same_id=True, **cells)).select(id_column, "neighbour")
    back = near.select(F.col(id_column).alias("neighbour"), F.col("neighbour").alias(id_column))
    mutual = near.join(back, [id_column, "neighbour"])
    own = df.select(id_column, label)
    other = df.select(F.col(id_column).alias("neighbour"), F.col(label).alias("__other"))
    return mutual.join(own, id_column).join(other, "neighbour").where(F.col(label) != F.col("__other")).select(id_column, label)


def remove_tomek_links(df: DataFrame, id_column: str, label: str, columns: Sequence[str], which: str = "not_minority", **cells) -> DataFrame:
    """Drop linked rows: of every class (``all``) or of all but the smallest class."""
    linked = tomek_links(df, id_column, label, columns, **cells)
    if which == "not_minority":
        sizes = stratum_sizes(df, label)
        linked = linked.where(F.col(label) != F.lit(min(sizes, key=lambda c: (sizes[c], str(c)))))
    return df.join(linked.select(id_column), id_column, "left_anti")


def edited_neighbours(df: DataFrame, id_column: str, label: str, columns: Sequence[str], k: int = 3, **cells) -> DataFrame:
    """Keep rows whose k nearest neighbours all share their class."""
    near = nearest(df, df, id_column, id_column, columns, k, exclude_same_id=True, **cells)
    other = df.select(F.col(id_column).alias("neighbour"), F.col(label).alias("__other"))
    own = df.select(id_column, F.col(label).alias("__own"))
    bad = near.join(other, "neighbour").join(own, id_column).where(F.col("__other") != F.col("__own")).select(id_column).distinct()
    return df.join(bad, id_column, "left_anti")


def smote_clean(
    df: DataFrame, id_column: str, label: str, columns: Sequence[str], cleaning: str = "tomek", k: int = 5, seed: int = 42, **cells
) -> DataFrame:
    """SMOTE, then Tomek-link removal or edited neighbours over old and new rows together."""
    made = smote(df, id_column, label, columns, k, "auto", seed, **cells)
    keyed = cut_lineage(made.withColumn("__key", F.concat_ws(":", F.col(label), F.col(id_column), F.col("copy"))))
    if cleaning == "tomek":
        return remove_tomek_links(keyed, "__key", label, columns, **cells).drop("__key")
    if cleaning == "enn":
        return edited_neighbours(keyed, "__key", label, columns, **cells).drop("__key")
    raise ValueError(f"unknown cleaning {cleaning!r}")


def needs_resampling(df: DataFrame, label: str, below: float = 0.3) -> bool:
    """Whether the smallest class holds less than the given share of the rows."""
    sizes = stratum_sizes(df, label)
    return min(sizes.values()) / sum(sizes.values()) < below


RESAMPLERS = ("smotetomek", "smoteenn", "smote", "smotenc", "adasyn", "oversample", "undersample", "class_weight")


def resample(
    df: DataFrame, id_column: str, label: str, columns: Sequence[str], strategy: str = "smotetomek",
    categorical: Sequence[str] = (), k: int = 5, seed: int = 42,
) -> DataFrame:
    """Any of the strategies by name. For training rows only."""
    from . import resample as basic

    if strategy in ("smotetomek", "smoteenn"):
        return smote_clean(df, id_column, label, columns, "tomek" if strategy == "smotetomek" else "enn", k, seed)
    if strategy == "smote":
        return smote(df, id_column, label, columns, k, "auto", seed)
    if strategy == "smotenc":
        return smotenc(df, id_column, label, columns, categorical, k, "auto", seed)
    if strategy == "adasyn":
        return adasyn(df, id_column, label, columns, k, seed)
    if strategy == "oversample":
        return basic.oversample(df, id_column, label, seed=seed)
    if strategy == "undersample":
        return basic.undersample(df, id_column, label, seed=seed)
    if strategy == "class_weight":
        return basic.with_weights(df, label)
    raise ValueError(f"unknown strategy {strategy!r}; expected one of {RESAMPLERS}")


