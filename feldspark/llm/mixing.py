"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Sources share all words by weight; one whose share would exceed ``epochs`` times its own words is
held there, and the excess goes to the others by weight until no share is above. Every document
of a source is then taken the whole number of times its target holds the source, and those first in a
seeded order once more, as far as the rest of the target goes. The place in that order where the
rest is used up is found from sums over hash prefixes, so no source is sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import in_order
from ..session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
PREFIXES = (3, 6)
"""Hex digits of the prefixes that narrow the cut: 4096 sums a source at each level, then about a 2^-24th of its rows."""


BROADCAST_SOURCES = 100_000
SALTS = 64
"""Pieces a source's rows are dealt in where the sources are too many to broadcast."""


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_weights(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """Add ``weight``: 1 to ``cycle``, repeating, for the sources by code point, null last."""
    placed = in_order(sizes.withColumn("__null", F.col("source").isNull()), ["__null", "source"])
    # One row for each range partition, so a window over them all is small whatever the number of sources.
    parts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.col("__seq") - F.shiftleft("__part", 33)
    rank = inside + F.col("__before")
    return placed.join(F.broadcast(offsets), "__part").select(*sizes.columns, (F.pmod(rank, F.lit(cycle)) + 1).alias("weight"))


def targets(sizes: DataFrame, epochs: int = 3) -> DataFrame:
    """Add ``target`` to sources with ``source_size`` and ``weight``; each round is one aggregate over the sources."""
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, cap = 0.0, F.lit(epochs) * F.col("source_size")
    while True:
        above = F.lit(level) * F.col("weight") > cap
        held, weight = sizes.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        higher = (total - held) / weight if weight else level
        if higher <= level:
            break
        level = higher
    return sizes.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap.cast("double")))


def _by_source(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with the facts of their source, whose name is in ``of``. A source may hold most rows, and is not gathered in one task."""
    same = F.col("source").eqNullSafe(F.col("of"))
    if facts.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(facts), same)
    dealt = rows.withColumn("piece", F.pmod(F.xxhash64("draw"), F.lit(SALTS)))
    copies = facts.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return dealt.join(copies, same & (F.col("piece") == F.col("copy"))).drop("piece", "copy")


def _cuts(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``source`` and ``cut``: the last seeded key taken once more, for sources with a rest to take."""
    open_rows = sized.where("size > 0").groupBy("source", "draw").agg(F.sum("size").alias("size"))
    rest = sources.where("source_size > 0").select(
        "source", (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).alias("rest")
    )
    place = rest.withColumn("before", F.lit(0).cast("bigint")).withColumn("prefix", F.lit(""))
    length = 0
    for digits in PREFIXES:
        parents = place.select(F.col("source").alias("of"), F.col("prefix").alias("p"), "before", "rest")
        within = _by_source(open_rows, parents).where(F.substring("draw", 1, length) == F.col("p"))
        sums = within.groupBy("source", F.substring("draw", 1, digits).alias("prefix")).agg(
            F.sum("size").alias("size"), F.first("before").alias("start"), F.first("rest").alias("rest")
        )
        ordered = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        reached = F.sum("size").over(ordered) + F.col("start")
        place = cut_lineage(
            sums.withColumn("reached", reached)
            .where((F.col("reached") >= F.col("rest")) & (F.col("reached") - F.col("size") < F.col("rest")))
            .select("source", "prefix", (F.col("reached") - F.col("size")).alias("before"), "rest")
        )
        length = digits
    parents = place.select(F.col("source").alias("of"), F.col("prefix").alias("p"), "before", "rest")
    last = _by_source(open_rows, parents).where(F.substring("draw", 1, length) == F.col("p"))
    reached = F.sum("size").over(Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    # Taken while that leaves the sum nearer to the rest than before.
    taken = last.withColumn("reached", reached).where(2 * F.col("reached") - F.col("size") <= 2 * F.col("rest"))
    cut = taken.groupBy("source").agg(F.max("draw").alias("last"))
    return place.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", F.coalesce("last", "prefix").alias("cut")
    )


def _draw(id_column: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))


def _sized(docs: DataFrame, id_column: str, text: str, source: str, seed: int) -> DataFrame:
    return cut_lineage(
        docs.select(
            F.col(id_column).alias("id"),
            F.col(source).cast("string").alias("source"),
            word_count(F.col(text)).alias("size"),
            _draw(id_column, seed).alias("draw"),
        )
    )


def _plan(sized: DataFrame, epochs: int, cycle: int) -> DataFrame:
    """One row for each source: ``of``, ``source_size``, ``target``, ``whole`` repetitions and the ``cut`` of one more."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = cut_lineage(targets(source_weights(sizes, cycle), epochs))
    cuts = _cuts(sized, sources).withColumnRenamed("source", "s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = sources.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("of"), "source_size", "target", whole.cast("bigint").alias("whole"), "cut"
    )
    return cut_lineage(plan)


def _times(draw: Column) -> Column:
    return F.col("whole") + F.coalesce(draw <= F.col("cut"), F.lit(False)).cast("bigint")


def mix(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", epochs: int = 3, cycle: int = 3, seed: int = 1
) -> DataFrame:
    """Return ``id_column``, ``size``, ``source_size``, ``target`` and ``times`` (how often the mix takes it) of every row.

    The size of a row is the number of words of its text, 0 if null. Null is a source like others,
    the last in order. Rows with equal ids are drawn together, null ids as one; texts without words are
    taken any number of times without words. A source's words come within half of the size of the id at
    its cut of the target. Reruns agree, as the order is by md5 of the seed and the id. An empty table gives an
    empty result; other columns are ignored.
    """
    sized = _sized(docs, id_column, text, source, seed)
    plan = _plan(sized, epochs, cycle)
    return _by_source(sized, plan).select(
        F.col("id").alias(id_column), "size", "source_size", "target", _times(F.col("draw")).alias("times")
    )


def repeated(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", epochs: int = 3, cycle: int = 3, seed: int = 1,
    number: str = "repetition",
) -> DataFrame:
    """The rows of the mix: every row of ``docs`` as often as ``mix`` takes it, with ``number`` from 1.

    Cases are as in ``mix``; a column called ``number`` is replaced.
    """
    plan = _plan(_sized(docs, id_column, text, source, seed), epochs, cycle)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).cast("string").alias("source"), _draw(id_column, seed).alias("draw")
    )
    taken = _by_source(rows, plan).withColumn("times", _times(F.col("draw"))).where("times > 0")
    return taken.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c != number], F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias(number)
    )
