"""Orders over whole tables without a single-task window.

* ``hash_key``/``hash_cuts``: pseudo-random order by md5 of the row id. A quota in that
  order is a plain comparison with a cut key found by refining prefix histograms, so the
  rows themselves are never shuffled or sorted.
* ``ranked_by_hash``: dense rank in the same order, windowed by uniform hash prefix.
* ``in_order``: any other order, by range partitioning plus one offset per partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, small_table

CUT_BUCKET_ROWS = 10_000
PREFIX_STEP = 3
MAX_STRATA = 1_000


def hash_key(id_column: str | Column, seed: int | str) -> Column:
    source = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.md5(F.concat(F.lit(f"{seed}:"), source.cast("string")))


def hash_uniform(text: Column) -> Column:
    """A number in [0, 1) from the first thirteen hex digits of md5(text), as many as a double holds."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def hash_cuts(
    df: DataFrame,
    id_column: str,
    seed: int | str,
    ranks: Mapping[object, Sequence[int]],
    stratum: str | None = None,
    bucket_rows: int = CUT_BUCKET_ROWS,
) -> dict[object, list[str]]:
    """For each stratum, the hash key at each 1-based rank (rank 0 gives the empty key).

    ``ranks`` maps stratum value (``None`` without strata) to ranks. Needs unique ids.
    """
    keyed = df.select(
        (F.col(stratum) if stratum else F.lit(None).cast("int")).alias("s"), hash_key(id_column, seed).alias("h")
    )
    open_cuts = {(s, r): ("", r) for s, rs in ranks.items() for r in rs if r > 0}
    keys: dict = {(s, 0): "" for s in ranks}
    length = 0
    while open_cuts:
        length += PREFIX_STEP
        if length > 32:
            raise ValueError(f"{id_column!r} does not identify rows: equal keys cannot be split")
        prefix = F.substring("h", 1, length)
        level = keyed
        if length > PREFIX_STEP:
            parents = {(s, p) for (s, _), (p, _) in open_cuts.items()}
            level = keyed.where(_any_prefix(parents, length - PREFIX_STEP))
        counts: dict = {}
        for s, p, n in level.groupBy("s", prefix.alias("p")).count().collect():
            counts.setdefault(s, []).append((p, n))
        leaves = {}
        for cut, (parent, rest) in list(open_cuts.items()):
            for p, n in sorted(counts.get(cut[0], [])):
                if not p.startswith(parent):
                    continue
                if rest <= n:
                    if n <= bucket_rows:
                        leaves.setdefault((cut[0], p), []).append((cut, rest))
                        del open_cuts[cut]
                    else:
                        open_cuts[cut] = (p, rest)
                    break
                rest -= n
            else:
                raise ValueError(f"rank {cut[1]} exceeds the rows of stratum {cut[0]!r}")
        if leaves:
            held: dict = {}
            for s, h in level.where(_any_prefix(set(leaves), length)).collect():
                held.setdefault((s, h[:length]), []).append(h)
            for leaf, cuts in leaves.items():
                in_order = sorted(held[leaf])
                for cut, rest in cuts:
                    keys[cut] = in_order[rest - 1]
    return {s: [keys[s, r] for r in rs] for s, rs in ranks.items()}


def _any_prefix(pairs, length: int) -> Column:
    by_stratum: dict = {}
    for s, p in pairs:
        by_stratum.setdefault(s, []).append(p)
    condition = F.lit(False)
    for s, prefixes in by_stratum.items():
        condition |= F.col("s").eqNullSafe(F.lit(s)) & F.substring("h", 1, length).isin(prefixes)
    return condition


def stratum_sizes(df: DataFrame, stratum: str) -> dict:
    """Row count per stratum value; refuses a column with more than MAX_STRATA values."""
    rows = df.groupBy(stratum).count().limit(MAX_STRATA + 1).collect()
    if len(rows) > MAX_STRATA:
        raise ValueError(f"{stratum!r} has more than {MAX_STRATA} values, too many for strata")
    return {row[0]: row[1] for row in sorted(rows, key=lambda r: (r[0] is None, str(r[0])))}


def ranked_by_hash(df: DataFrame, id_column: str, seed: int | str, stratum: str | None = None) -> DataFrame:
    """Add ``rank`` (1..n in hash order, restarting per stratum).

    The window is partitioned by a hash prefix, which is uniform whatever the strata;
    the prefix offsets form a table of at most strata x 4096 rows.
    """
    spread = df.withColumn("__h", hash_key(id_column, seed)).withColumn("__p", F.substring("__h", 1, PREFIX_STEP))
    groups = ["__p"] + ([stratum] if stratum else [])
    before = Window.partitionBy(*([stratum] if stratum else [F.lit(0)])).orderBy("__p").rowsBetween(
        Window.unboundedPreceding, -1
    )
    few = stratum is None or len(stratum_sizes(df, stratum)) <= 50
    offsets = (
        spread.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    local = Window.partitionBy(*groups).orderBy("__h", id_column)
    right = offsets.select(*[F.col(g).alias(f"__r_{i}") for i, g in enumerate(groups)], "__off")
    match = None
    for i, g in enumerate(groups):
        term = F.col(g).eqNullSafe(F.col(f"__r_{i}"))
        match = term if match is None else match & term
    return (
        spread.withColumn("__local", F.row_number().over(local))
        .join(F.broadcast(right) if few else right, match, "left")  # at most 50 x 4096 rows
        .withColumn("rank", (F.col("__local") + F.col("__off")).cast("bigint"))
        .drop("__h", "__p", "__local", "__off", *[f"__r_{i}" for i in range(len(groups))])
    )


def in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partition and sort by ``order``; add ``__part`` and ``__seq``.

    ``__part`` numbers the range partitions in order and ``__seq`` grows with the order.
    The placement depends on sampled boundaries, hence the lineage cut. ``order`` should
    end in a unique column, so that a frequent leading value spreads over partitions.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__seq", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__seq", 33))
    )
    return cut_lineage(placed)


def with_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """Add the 1-based position in ``order`` over the whole table."""
    placed = in_order(df, order)
    counts = placed.groupBy("__part").count().collect()  # one row per partition
    offsets, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in counts):
        offsets.append((part, total))
        total += n
    table = small_table(df.sparkSession, offsets, "__part bigint, __off bigint")
    inside = F.col("__seq") - F.shiftleft("__part", 33)
    return (
        placed.join(F.broadcast(table), "__part")
        .withColumn(name, (inside + F.col("__off") + 1).cast("bigint"))
        .drop("__part", "__seq", "__off")
    )


def running_totals(df: DataFrame, order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum in ``order``) and ``all_<c>`` (total).

    Meant for pre-aggregated input with one row per order value.
    """
    placed = in_order(df, order)
    parts = sorted(placed.groupBy("__part").agg(*[F.sum(c).alias(c) for c in sums]).collect(), key=lambda r: r[0])
    kinds = {f.name: f.dataType.simpleString() for f in placed.groupBy().agg(*[F.sum(c).alias(c) for c in sums]).schema}
    before = {c: 0 for c in sums}
    offsets = []
    for row in parts:
        offsets.append((row[0], *[_typed(before[c], kinds[c]) for c in sums]))
        for c in sums:
            before[c] += row[c] or 0
    schema = "__part bigint, " + ", ".join(f"`__off_{c}` {kinds[c]}" for c in sums)
    table = small_table(df.sparkSession, offsets, schema)
    local = Window.partitionBy("__part").orderBy("__seq").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(F.broadcast(table), "__part").select(
        *df.columns,
        *[(F.coalesce(F.sum(c).over(local), F.lit(0)) + F.col(f"__off_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.lit(before[c]).cast(kinds[c]).alias(f"all_{c}") for c in sums],
    )


def _typed(value, kind: str):
    return float(value) if kind in ("double", "float") else value


def surrounding_values(
    df: DataFrame, order: Sequence[str], values: Mapping[str, Column], group: Sequence[str] = ()
) -> DataFrame:
    """Add ``prev_<k>`` and ``next_<k>``: nearest non-null value at or before / at or after each row.

    Within a range partition these are ordinary windows; across partitions only the first
    and last group of each partition can be open, so two summary rows per partition carry
    the values over.
    """
    base = df.select("*", *[v.alias(f"__v_{k}") for k, v in values.items()])
    placed = in_order(base, [*group, *order])
    key = F.struct(F.lit(0).alias("g"), *[F.col(c) for c in group])
    placed = placed.withColumn("__g", F.to_json(key) if group else F.lit("0"))

    edges = placed.groupBy("__part").agg(
        F.min_by("__g", "__seq").alias("__first"), F.max_by("__g", "__seq").alias("__last")
    )
    at_edges = placed.join(F.broadcast(edges), "__part").where(
        (F.col("__g") == F.col("__first")) | (F.col("__g") == F.col("__last"))
    )
    summary = at_edges.groupBy("__part", "__g").agg(
        *[F.min_by(f"__v_{k}", F.when(F.col(f"__v_{k}").isNotNull(), F.col("__seq"))).alias(f"__fst_{k}") for k in values],
        *[F.max_by(f"__v_{k}", F.when(F.col(f"__v_{k}").isNotNull(), F.col("__seq"))).alias(f"__lst_{k}") for k in values],
    )
    # Frames that end at the last row cost quadratic time; looking ahead is looking back in reverse.
    earlier = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("__g").orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        "__part",
        "__g",
        *[F.last(f"__lst_{k}", True).over(earlier).alias(f"__in_{k}") for k in values],
        *[F.last(f"__fst_{k}", True).over(later).alias(f"__out_{k}") for k in values],
    )
    local = Window.partitionBy("__part", "__g")
    back = local.orderBy("__seq").rowsBetween(Window.unboundedPreceding, 0)
    ahead = local.orderBy(F.desc("__seq")).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(F.broadcast(carry), ["__part", "__g"], "left").select(
        *df.columns,
        *[F.coalesce(F.last(f"__v_{k}", True).over(back), f"__in_{k}").alias(f"prev_{k}") for k in values],
        *[F.coalesce(F.last(f"__v_{k}", True).over(ahead), f"__out_{k}").alias(f"next_{k}") for k in values],
    )
