"""Maximal conversations among logged snapshots, and their rendering.

Every turn's hash is salted with its place, so the exclusive or of the first k of them is a rolling
hash of a prefix of k turns. A conversation whose whole hash is a shorter prefix of another one is
dropped by an anti-join; of equal ones the smallest id stays. The places and rolling hashes come from
a range partitioning of all turns with one carried value per partition, so a single conversation
may spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import in_order
from ..session import cut_lineage

PART_TURNS = 512
"""Turns rendered into one row."""
LAST = 9223372036854775807


def _placed(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv``, ``role``, ``text``, ``place`` from 1 and the rolling hashes ``a`` and ``b`` of every turn."""
    rows = turns.select(
        F.col(conv_id).isNull().alias("none"),
        F.col(conv_id).alias("conv"),
        F.coalesce(F.col(turn).cast("bigint"), F.lit(LAST)).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    rows = in_order(rows, ["none", "conv", "turn", "role", "text"])
    # A conversation has one of these rows for each partition it reaches into.
    piece = rows.groupBy("none", "conv", "__part").agg(F.count(F.lit(1)).alias("turns"))
    before = Window.partitionBy("none", "conv").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("earlier")
    rows = _with_carried(rows, piece.select("none", "conv", "__part", offset))
    inside = Window.partitionBy("none", "conv", "__part").orderBy("__seq")
    rows = rows.withColumn("place", F.row_number().over(inside) + F.col("earlier"))
    for name in ("a", "b"):
        rows = rows.withColumn(name, F.xxhash64(F.lit(name), "place", "role", "text"))
    rows = cut_lineage(rows.drop("earlier"))
    piece = rows.groupBy("none", "conv", "__part").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    carried = [F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"earlier_{c}") for c in ("a", "b")]
    rows = _with_carried(rows, piece.select("none", "conv", "__part", *carried))
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "none", "conv", "role", "text", "place",
        *[F.bit_xor(c).over(running).bitwiseXOR(F.col(f"earlier_{c}")).alias(c) for c in ("a", "b")],
    )


def _with_carried(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    renamed = pieces.select(F.col("none").alias("n"), F.col("conv").alias("c"), F.col("__part").alias("p"), *pieces.columns[3:])
    same = (F.col("none") == F.col("n")) & F.col("conv").eqNullSafe(F.col("c")) & (F.col("__part") == F.col("p"))
    return rows.join(renamed, same).drop("n", "c", "p")


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def maximal_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Return ``conv_id``, ``part``, ``n_turns`` (of the part) and ``text`` of the conversations no other one continues.

    Turns are in order of ``turn``, ties by role and text, a null turn last; null roles and texts count as
    empty. A conversation whose turns begin a longer one is dropped; of equal ones that with the smallest id
    stays. Turns without an id are one conversation, which gives way to equal ones with an id. A part
    holds up to PART_TURNS turns, numbered from 0, so nearly all conversations are one row. Repeated turns
    are turns; other columns are ignored; an empty table gives an empty result.
    """
    placed = cut_lineage(_placed(turns, conv_id, turn, role, text))
    length = placed.groupBy("none", "conv").agg(F.max("place").alias("place")).select(F.col("none").alias("n"), F.col("conv").alias("c"), F.col("place").alias("turns"))
    same = (F.col("none") == F.col("n")) & F.col("conv").eqNullSafe(F.col("c"))
    measured = placed.select("none", "conv", "place", "a", "b").join(length, same)
    whole = measured.where(F.col("place") == F.col("turns")).groupBy("place", "a", "b").agg(F.min(F.struct("none", "conv")).alias("of"))
    prefixes = measured.where(F.col("place") < F.col("turns")).select("place", "a", "b").distinct()
    kept = whole.join(prefixes, ["place", "a", "b"], "left_anti").select(F.col("of.none").alias("n"), F.col("of.conv").alias("c"))
    lines = placed.join(kept, same, "left_semi").select(
        "none", "conv", F.floor((F.col("place") - 1) / PART_TURNS).alias("part"), "place", rendered_turn(F.col("role"), F.col("text")).alias("line")
    )
    parts = lines.groupBy("none", "conv", "part").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("turns"))
    return parts.select(
        F.col("conv").alias(conv_id), "part", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["line"]), "").alias("text"),
    )
