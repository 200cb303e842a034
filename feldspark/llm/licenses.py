"""License notices by an exact set-similarity join of text blocks with notice templates.

1. Words of the templates are counted over all documents and ordered from the rarest up.
2. A block is a run of twice as many words as the longest template has (as a power of two), and the
   next block starts half a block on, so every run of a template's length lies in some block.
3. A template of n words that must share o of them with a block has one of its n - o + 1 rarest words
   in it (prefix filter). Blocks around such words are joined with the templates on the words of
   both prefixes; the number of words (length filter) and the places of the shared word in both
   orders (positional filter) bound the overlap from above, and what is left is verified in full.
4. Of the templates found in one block, one whose shared words all belong to a better one goes.

Words that no template has cannot be shared, so they are left out of the order. Everything is
built-in functions; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, small_table

# Names and notices of public licenses.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
)
THRESHOLD_PERCENT = 80

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 100_000
"""An index of more rows than this is joined without a broadcast."""


def words(text: Column) -> Column:
    """Letters, digits and characters above 0x7F in runs, with A-Z lowered; null is an empty text."""
    spaced = F.trim(F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SEPARATORS, " "))
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")


def block_words(templates: Sequence[tuple[str, str]]) -> int:
    """Words a block has: the longest template's number, up to a power of two, and as many again."""
    longest = max(len(text.split()) for _, text in templates)
    return 2 << (longest - 1).bit_length()


def least_shared(n: int, percent: int) -> int:
    return max(1, ceil(n * percent / 100))


def _places(found: Column, phrase: str) -> Column:
    """Where the words of ``phrase`` stand one after another; only looked for where its first word occurs."""
    parts = phrase.split()
    first = F.filter(F.transform(found, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())

    def follows(i: Column) -> Column:
        return F.slice(found, i + 1, F.lit(len(parts))) == F.array(*[F.lit(p) for p in parts])

    nothing = F.array().cast("array<int>")
    return F.when(F.array_contains(found, parts[-1]) & F.array_contains(found, parts[0]), F.filter(first, follows)).otherwise(nothing)


def _array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _ordered_vocabulary(worded: DataFrame, templates: Sequence[tuple[str, str]]) -> list[str]:
    """The words of all templates from the rarest in the documents up; as many rows as the templates have words."""
    vocabulary = sorted({w for _, text in templates for w in text.split()})
    held = worded.select(F.explode(F.array_intersect("words", _array(vocabulary))).alias("word"))
    counted = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))


def _index(templates: Sequence[tuple[str, str]], order: Sequence[str], percent: int) -> list[tuple]:
    """A row for each word of each template's prefix: word, its place, template, label, shared words needed, words in order."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for number, (label, text) in enumerate(templates):
        held = sorted(set(text.split()), key=rank.__getitem__)
        needed = least_shared(len(held), percent)
        rows += [(word, i, number, label, needed, held) for i, word in enumerate(held[: len(held) - needed + 1])]
    return rows


def _blocks(found: Column, order: Sequence[str], prefixes: Sequence[str], width: int, needed: int) -> Column:
    """Number and template words, in global order, of the blocks that hold a word of some template's prefix."""
    step = width // 2
    near = F.filter(F.transform(found, lambda w, i: F.when(w.isin(*prefixes), F.floor(i / step).cast("int"))), lambda b: b.isNotNull())
    # Of a run of words in one stretch, one is enough.
    stretches = F.array_distinct(near)
    starts = F.array_distinct(F.flatten(F.transform(stretches, lambda b: F.array(b, F.greatest(b - 1, F.lit(0))))))
    held = F.transform(
        starts,
        lambda b: F.struct(b.alias("block"), F.array_intersect(_array(order), F.slice(found, b * step + 1, F.lit(width))).alias("held")),
    )
    return F.filter(held, lambda x: F.size(x["held"]) >= needed)


def _found(blocks: DataFrame, index: list[tuple], keys: Sequence[str]) -> DataFrame:
    """``keys``, ``block``, ``label``, ``shared`` (words) and ``containment`` of the pairs at the threshold."""
    spark = blocks.sparkSession
    least = min(row[4] for row in index)
    prefix = blocks.withColumn("size", F.size("held")).select(
        "*", F.posexplode(F.slice("held", F.lit(1), F.col("size") - least + 1)).alias("place", "word")
    )
    table = small_table(spark, index, "word string, at int, template int, label string, needed int, of array<string>")
    table = F.broadcast(table) if len(index) <= BROADCAST_ROWS else table
    bound = F.least(F.size("of") - F.col("at"), F.col("size") - F.col("place"))
    met = prefix.join(table, "word").where((F.col("size") >= F.col("needed")) & (bound >= F.col("needed")))
    shared = met.withColumn("shared", F.array_intersect("of", "held"))
    # A pair meets at every word its prefixes share; it counts at the rarest one.
    once = shared.where((F.col("shared")[0] == F.col("word")) & (F.size("shared") >= F.col("needed")))
    return once.select(*keys, "block", "template", "label", "shared", (F.size("shared") / F.size("of")).alias("containment"))


def _best(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Without templates whose shared words another template of the same block has too, with a better match.

    A group is one block, and holds a row for each template at most.
    """
    pair = F.struct("label", "shared", "containment", "template")
    grouped = found.groupBy(*keys, "block").agg(F.collect_set(pair).alias("all"))

    def beaten(x: Column, y: Column) -> Column:
        better = (F.size(y["shared"]) > F.size(x["shared"])) | (y["containment"] > x["containment"])
        within = F.size(F.array_except(x["shared"], y["shared"])) == 0
        return within & better & (y["containment"] >= x["containment"])

    kept = F.filter("all", lambda x: ~F.exists("all", lambda y: beaten(x, y)))
    return grouped.select(*keys, "block", F.explode(kept).alias("x")).select(*keys, "block", "x.label", "x.shared", "x.containment")


def _prepared(docs: DataFrame, id_column: str, text: str, templates, percent: int) -> tuple[DataFrame, list[tuple]]:
    worded = docs.select(F.col(id_column).alias("id"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_key"), words(F.col(text)).alias("words"))
    order = _ordered_vocabulary(worded, templates)
    index = _index(templates, order, percent)
    width = block_words(templates)
    prefixes = sorted({row[0] for row in index})
    placed = worded.select(
        "id", "text_key", F.size("words").cast("bigint").alias("n_words"),
        *[_places(F.col("words"), phrase).alias(f"base_{i}") for i, (_, phrase) in enumerate(PHRASES)],
        _blocks(F.col("words"), order, prefixes, width, min(row[4] for row in index)).alias("blocks"),
    )
    return cut_lineage(placed), index


def notices(docs: DataFrame, id_column: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Every text block that holds ``percent`` of a template's distinct words, and is no worse match of it than of another.

    Returns ``id_column``, ``text_key`` (md5 of the text), ``label``, ``first_word`` and ``end_word`` of the block
    (words from 0, end exclusive), ``shared`` (words) and ``containment``. Rows with equal id and text give their
    rows once. Null and empty texts have no blocks; other columns are ignored; an empty table gives an
    empty result. ``templates`` are (label, words in lower case) and small enough for the driver.
    """
    placed, index = _prepared(docs, id_column, text, templates, percent)
    best = _best(_blocks_found(placed, index), ["id", "text_key"])
    width = block_words(templates)
    lengths = placed.where(F.size("blocks") > 0).groupBy("id", "text_key").agg(F.max("n_words").alias("n"))
    named = lengths.select(F.col("id").alias("i"), F.col("text_key").alias("k"), "n")
    start = F.col("block").cast("bigint") * (width // 2)
    return best.join(named, F.col("id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k"))).select(
        F.col("id").alias(id_column), "text_key", "label", start.alias("first_word"), F.least(start + width, "n").alias("end_word"), "shared", "containment"
    )


def _blocks_found(placed: DataFrame, index: list[tuple]) -> DataFrame:
    rows = placed.select("id", "text_key", F.explode("blocks").alias("b")).select("id", "text_key", "b.block", "b.held")
    return _found(rows, index, ["id", "text_key"])


def license_labels(docs: DataFrame, id_column: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row per row of ``docs``: places of the exact phrases, and labels of these and of the blocks found.

    Returns ``id_column``, ``n_words``, ``n_base``, ``first_word``, ``last_word`` (starts of places, null without any),
    ``base_labels``, ``labels`` (sorted, joined with commas) and ``score``: 1 where a phrase stands,
    else the largest containment of a block, else 0. A null text is empty; empty texts have no words; repeated ids
    keep a row each, with what their own text holds; null ids are kept; an empty table gives an empty result. Columns
    other than the two named are ignored, whatever their names.
    """
    placed, index = _prepared(docs, id_column, text, templates, percent)
    best = _best(_blocks_found(placed, index), ["id", "text_key"])
    found = best.groupBy(F.col("id").alias("found_id"), F.col("text_key").alias("found_key")).agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("containment")
    )
    bases = [F.col(f"base_{i}") for i in range(len(PHRASES))]
    every = F.concat(*bases)
    named = F.filter(F.array(*[F.when(F.size(b) > 0, F.lit(label)) for b, (label, _) in zip(bases, PHRASES)]), lambda x: x.isNotNull())
    same = F.col("id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key"))
    labels = F.array_distinct(F.concat(named, F.coalesce("more", F.array().cast("array<string>"))))
    return placed.join(found, same, "left").select(
        F.col("id").alias(id_column), "n_words", F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"), F.array_max(every).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
