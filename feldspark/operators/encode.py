"""Categorical encodings, learned on training rows.

After rare grouping a column keeps few levels, so its mapping is a literal. Without it a
column may have any number of levels; mappings are then tables, joined on the category. One of few
rows is broadcast. Of a larger one only the levels that hold a noticeable share of the training rows are, which are few by
that share; all other rows meet the rest of the table in a join whose keys are dealt in pieces where they match nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roles import dbl, label_map

MAX_LITERAL_LEVELS = 1_000
BROADCAST_LEVELS = 100_000
"""Mapping tables of more rows are joined in two parts."""
HOT_SHARE = 0.001
"""Levels with at least this share of the training rows are broadcast, at most one by the inverse of it."""
PIECES = 64
RARE = "Rare"
POOLED = "infrequent_sklearn"


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Table (column, level, n) of non-null values; empty without columns."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, level string, n bigint")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns]))
    return (
        df.select(pairs.alias("p")).select("p.*").where("level is not null").groupBy("column", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fit_rare(df: DataFrame, columns: Sequence[str], tolerance: float = 0.05, min_levels: int = 5) -> dict[str, list[str]]:
    """Levels to keep per column.

    Columns with more than ``min_levels`` levels keep those at or above the tolerance, at
    most 1/tolerance of them; the rest keep all.
    """
    if not columns:
        return {}
    counts = level_counts(df, columns)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("levels"))
    kept = counts.join(F.broadcast(totals), "column").where(
        (F.col("levels") <= min_levels) | (F.col("n") / F.col("total") >= tolerance)
    )
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in kept.select("column", "level").collect():
        found[row["column"]].append(row["level"])
    return {c: sorted(levels) for c, levels in found.items()}


def apply_rare(df: DataFrame, kept: Mapping[str, Sequence[str]]) -> DataFrame:
    if not kept:
        return df
    return df.withColumns(
        {c: F.when(F.col(c).isNull() | F.col(c).isin(list(levels)), F.col(c)).otherwise(RARE) for c, levels in kept.items()}
    )


def route(df: DataFrame, columns: Sequence[str], threshold: int = 10, override: Mapping[str, str] | None = None) -> dict[str, str]:
    """Method class of each column by number of levels: binary, low or high; overrides name the method."""
    override = dict(override or {})
    from .aggregates import aggregate_row

    free = [c for c in columns if c not in override]
    n = aggregate_row(df, {c: F.count_distinct(c) for c in free}) if free else {}
    kind = {c: "binary" if n[c] <= 2 else "low" if n[c] <= threshold else "high" for c in free}
    return {c: override.get(c) or kind[c] for c in columns}


def sorted_levels(df: DataFrame, column: str, limit: int = MAX_LITERAL_LEVELS) -> list[str]:
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column!r} has more than {limit} levels; use a table mapping")
    return sorted(r[0] for r in rows)


def fit_ordinal(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, int]]:
    return {c: {v: i for i, v in enumerate(sorted_levels(df, c))} for c in columns}


def apply_ordinal(df: DataFrame, codes: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Levels to codes; anything else to -1 (binary and ordinal encoding alike)."""
    return df.withColumns({c: label_map(F.col(c).cast("string"), dict(m), -1).cast("int") for c, m in codes.items()})


def fit_onehot(df: DataFrame, columns: Sequence[str], max_categories: int = 15, counts: DataFrame | None = None) -> dict[str, dict]:
    """Levels to show, and whether others are pooled; beyond the limit the most frequent stay.

    ``counts`` are the level counts of the columns, where the caller holds them.
    """
    from pyspark.sql import Window

    counts = level_counts(df, columns) if counts is None else counts
    sizes = {r["column"]: r["k"] for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), F.desc("level")))
    top: dict[str, list[str]] = {c: [] for c in columns}
    for row in counts.withColumn("place", place).where(F.col("place") <= max_categories).collect():
        pooled = sizes[row["column"]] > max_categories
        if not (pooled and row["place"] == max_categories):
            top[row["column"]].append(row["level"])
    plan = {}
    for c in columns:
        levels = sorted(top[c])
        plan[c] = {"levels": levels[1:] if len(levels) == 2 and sizes[c] == 2 else levels, "pooled": sizes.get(c, 0) > max_categories}
    return plan


def onehot_tables(df: DataFrame, plan: Mapping[str, Mapping], counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """(level, value, rows) of the levels without a column of their own, for the columns that have any."""
    pooled = {c: p["levels"] for c, p in plan.items() if p["pooled"]}
    counts = level_counts(df, list(pooled)) if counts is None else counts
    return {
        c: counts.where((F.col("column") == c) & ~F.col("level").isin(list(shown))).select("level", F.lit(1.0).alias("value"), F.col("n").alias("rows"))
        for c, shown in pooled.items()
    }


def with_pooled(df: DataFrame, plan: Mapping[str, Mapping], pooled: Mapping[str, DataFrame] | None) -> DataFrame:
    """Add ``__pooled_<c>``, 1 for the levels of a column that share one, for the columns with such levels."""
    for c, p in plan.items():
        if p["pooled"] and f"__pooled_{c}" not in df.columns:
            df = with_mapped(df, pooled[c], c, f"__pooled_{c}")
    return df


def apply_onehot(df: DataFrame, plan: Mapping[str, Mapping], pooled: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """0/1 columns ``col_level``; unknown and missing values are all zeros; originals go.

    ``pooled`` has the levels that share one column, for the columns with such levels.
    """
    out: list[Column] = []
    columns = [c for c in df.columns if not c.startswith("__pooled_")]
    df = with_pooled(df, plan, pooled)
    for c, p in plan.items():
        text = F.col(c).cast("string")
        for level in p["levels"]:
            out.append(F.coalesce((text == level).cast("double"), F.lit(0.0)).alias(f"{c}_{level}"))
        if p["pooled"]:
            out.append(F.coalesce(F.col(f"__pooled_{c}"), F.lit(0.0)).alias(f"{c}_{POOLED}"))
    return df.select(*[c for c in columns if c not in plan], *out)


def level_table(
    df: DataFrame, column: str, methods: Sequence[str], target: str | None = None, smoothing: float = 5.0, min_leaf: int = 10, regularization: float = 1.0
) -> DataFrame:
    """(level, a value for each method, rows) of a column with any number of levels, from one aggregation.

    ``ordinal`` is the place of the level; ``target`` its mean target, pulled towards the overall mean when it is small;
    ``woe`` the log ratio of its share among positives and negatives, 0 for single-row levels; ``count`` its share of the rows.
    """
    from .aggregates import aggregate_row
    from .ordering import with_rank

    known = df.where(F.col(column).isNotNull())
    statistics, values = {"rows": F.count(F.lit(1))}, {}
    if "ordinal" in methods:
        values["ordinal"] = (F.col("__r") - 1).cast("int")
    if "target" in methods:
        statistics["m"] = F.avg(dbl(target))
        prior = aggregate_row(df, {"p": F.avg(dbl(target))})["p"]
        weight = 1 / (1 + F.exp(-(F.col("rows") - F.lit(float(min_leaf))) / F.lit(float(smoothing))))
        values["target"] = weight * F.col("m") + (1 - weight) * F.lit(prior)
    if "woe" in methods:
        statistics["s"] = F.sum(dbl(target))
        total = aggregate_row(df, {"s": F.sum(dbl(target)), "n": F.count(dbl(target))})
        r = float(regularization)
        positive = (F.col("s") + r) / F.lit(total["s"] + 2 * r)
        negative = (F.col("rows") - F.col("s") + r) / F.lit(total["n"] - total["s"] + 2 * r)
        values["woe"] = F.when(F.col("rows") == 1, F.lit(0.0)).otherwise(F.log(positive / negative))
    if "count" in methods:
        values["count"] = F.col("rows") / F.lit(float(known.count()))
    levels = known.groupBy(F.col(column).cast("string").alias("level")).agg(*[v.alias(n) for n, v in statistics.items()])
    if "ordinal" in methods:
        levels = with_rank(levels, ["level"], "__r")
    return levels.select("level", *[values[m].alias(m) for m in methods], "rows")


def ordinal_table(df: DataFrame, column: str) -> DataFrame:
    """(level, code, rows): codes of a column with any number of levels."""
    return level_table(df, column, ["ordinal"]).withColumnRenamed("ordinal", "code")


def target_table(df: DataFrame, column: str, target: str, smoothing: float = 5.0, min_leaf: int = 10) -> DataFrame:
    """(level, value, rows): mean target of a level pulled towards the overall mean when it is small."""
    return level_table(df, column, ["target"], target, smoothing, min_leaf).withColumnRenamed("target", "value")


def woe_table(df: DataFrame, column: str, target: str, regularization: float = 1.0) -> DataFrame:
    """(level, value, rows): log ratio of the level's share among positives and negatives; single-row levels get 0."""
    return level_table(df, column, ["woe"], target, regularization=regularization).withColumnRenamed("woe", "value")


def frequency_table(df: DataFrame, column: str) -> DataFrame:
    """(level, value, rows): the level's share of the rows."""
    return level_table(df, column, ["count"]).withColumnRenamed("count", "value")


def equal_columns(df: DataFrame, columns: Sequence[str]) -> list[list[str]]:
    """The columns in groups whose values, as text, are the same in every row of ``df``.

    Columns whose digests differ are told apart by one pass over the rows; those that are left are compared row by row.
    """
    from .aggregates import aggregate_row

    if len(columns) < 2:
        return [[c] for c in columns]
    text = {c: F.col(f"`{c}`").cast("string") for c in columns}
    digests = aggregate_row(df, {c: F.bit_xor(F.xxhash64(F.coalesce(t, F.lit("")))) for c, t in text.items()})
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :] if digests[a] == digests[b]]
    same = aggregate_row(df, {(a, b): F.every(text[a].eqNullSafe(text[b])) for a, b in pairs}) if pairs else {}
    groups: list[list[str]] = []
    for c in columns:
        group = next((g for g in groups if same.get((g[0], c))), None)
        if group is None:
            groups.append([c])
        else:
            group.append(c)
    return groups


def with_mapped(df: DataFrame, mapping: DataFrame, column: str, into: str, broadcast_levels: int = BROADCAST_LEVELS) -> DataFrame:
    """Add ``into``, the mapped value of a column, null for values the mapping lacks.

    ``mapping`` has the level, its value and, optionally, ``rows``, how many training rows hold it.
    """
    value = mapping.columns[1]
    named = mapping.select(F.col("level").alias("__level"), F.col(value).alias("__value"), *(["rows"] if "rows" in mapping.columns else []))
    level = F.col(column).cast("string")
    if named.count() <= broadcast_levels:
        return df.join(F.broadcast(named.drop("rows")), level == F.col("__level"), "left").withColumn(into, F.col("__value")).drop("__level", "__value")
    rest, known = named.drop("rows"), F.lit(False)
    if "rows" in named.columns:
        least = HOT_SHARE * named.agg(F.sum("rows")).first()[0]
        hot = named.where(F.col("rows") >= least).select(F.col("__level").alias("__hot"), F.col("__value").alias("__hot_value"))
        df = df.join(F.broadcast(hot), level == F.col("__hot"), "left")
        rest, known = named.where(F.col("rows") < least).drop("rows"), F.col("__hot").isNotNull()
    # Rows that need no other value would all have one key; they get keys that match nothing, in pieces.
    done = known | level.isNull()
    # The partition a row comes from deals them evenly and needs no column, so columns nobody asks for are not shuffled.
    piece = F.pmod(F.spark_partition_id(), F.lit(PIECES)).cast("string")
    keyed = df.withColumn("__open", ~done).withColumn("__key", F.when(done, piece).otherwise(level))
    joined = keyed.join(rest.withColumn("__asked", F.lit(True)), (F.col("__key") == F.col("__level")) & (F.col("__open") == F.col("__asked")), "left")
    found = F.coalesce("__hot_value", "__value") if "rows" in named.columns else F.col("__value")
    return joined.withColumn(into, found).drop("__open", "__key", "__level", "__value", "__asked", "__hot", "__hot_value")


def apply_table(df: DataFrame, mapping: DataFrame, column: str, unseen=None, missing=None, broadcast_levels: int = BROADCAST_LEVELS) -> DataFrame:
    """Replace a column by its mapped value."""
    joined = with_mapped(df, mapping, column, "__mapped", broadcast_levels)
    value = F.when(F.col(column).isNull(), F.lit(missing)).otherwise(F.coalesce(F.col("__mapped"), F.lit(unseen)))
    return joined.select(*[value.alias(c) if c == column else F.col(c) for c in df.columns])


def encode_target(train: DataFrame, df: DataFrame, columns: Sequence[str], target: str, smoothing=5.0, min_leaf=10) -> DataFrame:
    from .aggregates import aggregate_row

    prior = aggregate_row(train, {"p": F.avg(dbl(target))})["p"]
    for c in columns:
        df = apply_table(df, target_table(train, c, target, smoothing, min_leaf), c, prior, prior)
    return df


def encode_woe(train: DataFrame, df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    for c in columns:
        df = apply_table(df, woe_table(train, c, target), c, 0.0, 0.0)
    return df


def encode_frequency(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = apply_table(df, frequency_table(train, c), c, 0.0, None)
    return df


def hash_bucket(value: Column, n: int) -> Column:
    """md5(value), read as one 128-bit number, modulo 8, 16, 24 or 32."""
    digest = F.md5(value)
    low = F.conv(F.substring(digest, 31, 2), 16, 10).cast("int")
    if n in (8, 16, 32):
        return low % n
    if n == 24:
        # 16 = 1 (mod 3), so the residue modulo 3 is that of the sum of the hex digits
        ones = 32 - F.length(F.translate(digest, "147ad", ""))
        twos = 32 - F.length(F.translate(digest, "258be", ""))
        return (16 * ((ones + 2 * twos) % 3) + 9 * (low % 8)) % 24
    raise ValueError("hash encoding uses 8, 16, 24 or 32 columns")


def encode_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of hashed values over min(32, 8 x columns) columns; originals go."""
    n = min(32, 8 * len(columns))
    held = df.select("*", *[hash_bucket(F.col(c).cast("string"), n).alias(f"__b_{c}") for c in columns])
    sums = [
        sum((F.coalesce((F.col(f"__b_{c}") == i).cast("int"), F.lit(0)) for c in columns), F.lit(0)).alias(f"col_{i}")
        for i in range(n)
    ]
    return held.select(*[c for c in df.columns if c not in columns], *sums)


def encode_ordinal_custom(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """The position in a given order; values outside it become null."""
    return df.withColumn(column, label_map(F.col(column), {v: i for i, v in enumerate(order)}).cast("int"))
