"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

Texts are lowered and everything but letters and their marks becomes one space. Counts of character 4-grams per
language are summed over all training rows in Spark, the lower orders follow from them as continuation counts, and
the discounts of every order from how many n-grams have small counts; all three are group-bys over the full counts. The smoothed
log-probabilities of all languages stand in one row per n-gram, found by its hash in a sorted array with an index of
hash prefixes. Arrays are cut into blocks of bounded size by the two characters before the predicted one, so every
n-gram finds its shorter forms in its own block; a block at a time is on the driver, and each adds its part of the sums of
every document. The language with the lowest cross-entropy per character wins. Training rows left out of the counts calibrate the score and the
cross-entropy above which a text is not accepted as its best language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import Chunk, mix, text_batches

ORDER = 4
SPACE = 32
BLOCK_CELLS = 8_000_000
"""N-grams times languages of one block of the model; a larger model has more blocks."""
BLOCKS_AT_ONCE = 4
"""Blocks that tasks hold at a time; after these the sums are written down before the next ones come."""
HELD_ENTRIES = 4_000_000
REJECT = 0.005
"""Share of right calibration rows that may lie above the accepted cross-entropy."""


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For every code point 2 if it is a letter, 1 if it is a mark, else 0."""
    import unicodedata

    category = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    return np.array([2 if c == "L" else 1 if c == "M" else 0 for c in category], np.uint8)


def grams_of(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 4-grams (16 bits a character, the predicted one lowest), the first of each row (with the end), and letters per row.

    A character beyond 16 bits stands in the range of private characters, by its remainder.
    """
    held = chunk.data.tobytes()
    pieces = [held[a:b].decode("utf-8", "replace").lower().encode("utf-32-le") for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:])]
    ends = np.cumsum([0, *[len(p) // 4 for p in pieces]])
    points = np.frombuffer(b"".join(pieces), np.uint32)
    kind = _kinds()[points]
    letter = kind > 0
    units = np.where(points < 0x10000, points, 0xE000 + points % 0x1900).astype(np.uint16)
    before = np.zeros_like(letter)
    before[1:] = letter[:-1]
    starts = ends[:-1][ends[:-1] < len(units)]
    before[starts] = False
    keep = letter | before
    kept = np.concatenate(([0], np.cumsum(keep)))
    first = kept[ends]
    totals = np.concatenate(([0], np.cumsum(kind == 2)))
    units = np.where(letter, units, np.uint16(SPACE))[keep].astype(np.uint64)
    place = np.arange(len(units)) - np.repeat(first[:-1], np.diff(first))
    packed = units.copy()
    for back in range(1, ORDER):
        earlier = np.full(len(units), SPACE, np.uint64)
        earlier[back:] = units[:-back] if back < len(units) else earlier[back:]
        earlier[place < back] = SPACE
        packed |= earlier << np.uint64(16 * back)
    return packed, first, totals[ends[1:]] - totals[ends[:-1]]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(which, np.concatenate([c for _, c in parts])).astype(np.int64)


def _count_batches(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        entries = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, counts = _merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"]
                )

        for batch, chunk in text_batches(batches, text):
            packed, first, _ = grams_of(chunk)
            langs = np.array(batch.column("lang").to_pylist(), object)
            spread = np.diff(first)
            for lang in set(langs.tolist()):
                own = packed[np.repeat(langs == lang, spread)]
                if len(own):
                    keys, counts = np.unique(own, return_counts=True)
                    parts = held.setdefault(lang, [])
                    parts.append((keys, counts))
                    entries += len(keys)
                    if len(parts) > 8:
                        entries -= sum(len(k) for k, _ in parts)
                        parts[:] = [_merged(parts)]
                        entries += len(parts[0][0])
            if entries > HELD_ENTRIES:
                yield from out()
                held, entries = {}, 0
        yield from out()

    return run


class HashArray:
    """Keys by hash in sorted order, with the place where each hash prefix starts."""

    def __init__(self, keys: np.ndarray):
        hashed = mix(keys.astype(np.uint64))
        self.order = np.argsort(hashed)
        self.hashed = hashed[self.order]
        self.shift = np.uint64(64 - max(4, int(len(keys)).bit_length()))
        prefixes = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)
        self.start = np.searchsorted(self.hashed >> self.shift, prefixes).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the original order, or -1."""
        hashed = mix(keys)
        prefix = (hashed >> self.shift).astype(np.int64)
        at, stop = self.start[prefix], self.start[prefix + 1]
        result = np.full(len(keys), -1, np.int32)
        open_ones = np.flatnonzero(at < stop)
        at, stop, hashed = at[open_ones], stop[open_ones], hashed[open_ones]
        while len(open_ones):
            equal = self.hashed[at] == hashed
            result[open_ones[equal]] = self.order[at[equal]]
            at += 1
            more = ~equal & (at < stop)
            open_ones, at, stop, hashed = open_ones[more], at[more], stop[more], hashed[more]
        return result


@dataclass
class Model:
    """Per order: n-grams with a log-probability per language, and contexts with a log back-off weight per language."""

    languages: list[str]
    grams: dict[int, HashArray]
    logs: dict[int, np.ndarray]
    contexts: dict[int, HashArray]
    backoffs: dict[int, np.ndarray]
    floor: np.ndarray

    def log_probabilities(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.broadcast_to(self.floor, (len(packed), len(self.floor)))
        packed = packed & np.uint64((1 << (16 * order)) - 1)
        at = self.grams[order].find(packed)
        result = self.logs[order][np.maximum(at, 0)]
        missing = np.flatnonzero(at < 0)
        if len(missing):
            result[missing] = self.log_probabilities(packed[missing], order - 1)
            context = self.contexts[order].find(packed[missing] >> np.uint64(16))
            known = context >= 0
            result[missing[known]] += self.backoffs[order][context[known]]
        return result

    def sums(self, packed: np.ndarray, first: np.ndarray, blocks: int, block: int) -> np.ndarray:
        """Rows by languages: log-probabilities of the row's n-grams that belong to this block."""
        result = np.zeros((len(first) - 1, len(self.languages)))
        rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
        if blocks > 1:
            own = block_of(packed, blocks) == block
            packed, rows = packed[own], rows[own]
        if len(packed):
            starts = np.concatenate(([0], np.flatnonzero(np.diff(rows)) + 1))
            result[rows[starts]] = np.add.reduceat(self.log_probabilities(packed), starts, axis=0, dtype=np.float64)
        return result


def block_of(packed: np.ndarray, blocks: int) -> np.ndarray:
    """The block of an n-gram of three or more characters, by the two before the predicted one."""
    return (mix((packed >> np.uint64(16)) & np.uint64(0xFFFFFFFF)) % np.uint64(blocks)).astype(np.int64)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken from counts of one, two, and three or more, from how many n-grams have counts of one to four.

    Where these are too few to say, half of a count.
    """
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    share = n1 / (n1 + 2 * n2)
    found = (1 - 2 * share * n2 / n1, 2 - 3 * share * n3 / n2, 3 - 4 * share * n4 / n3 if n3 else 1.5)
    return tuple(float(np.clip(d, 0.05, k - 0.05)) for k, d in zip((1, 2, 3), found))


def _kneser_ney(keys: np.ndarray, counts: np.ndarray, taken: tuple[float, float, float]) -> tuple:
    """N-grams, discounted shares, contexts, and the weight a context leaves to the lower order."""
    off = np.array(taken)[np.minimum(counts, 3) - 1]
    context, which = np.unique(keys >> np.uint64(16), return_inverse=True)
    totals = np.bincount(which, counts)
    return keys, (counts - off) / totals[which], context, np.bincount(which, off) / totals


def build(counts: dict[int, dict[str, tuple[np.ndarray, np.ndarray]]], taken: dict[tuple[str, int], tuple], languages: list[str], letters: int) -> Model:
    """A block: n-grams and counts by order and language, and the discounts of all. ``letters`` share what is left to unseen ones."""
    nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    levels = {(lang, order): _kneser_ney(*counts[order].get(lang, nothing), taken.get((lang, order), (0.5,) * 3)) for lang in languages for order in range(1, ORDER + 1)}
    floor = np.full(len(languages), -np.log(letters), np.float32)
    model = Model(languages, {}, {}, {}, {}, floor)
    for order in range(1, ORDER + 1):
        grams = np.unique(np.concatenate([levels[x, order][0] for x in languages]))
        contexts = np.unique(np.concatenate([levels[x, order][2] for x in languages]))
        lower = np.exp(model.log_probabilities(grams, order - 1).astype(np.float64))
        logs = np.zeros((len(grams), len(languages)))
        weights = np.ones((len(contexts), len(languages)))
        for i, lang in enumerate(languages):
            keys, shares, own, left = levels[lang, order]
            weights[np.searchsorted(contexts, own), i] = left
            logs[:, i] = weights[np.searchsorted(contexts, grams >> np.uint64(16)), i] * lower[:, i] if len(grams) else 0.0
            logs[np.searchsorted(grams, keys), i] += shares
        model.grams[order], model.logs[order] = HashArray(grams), np.log(logs).astype(np.float32)
        model.contexts[order], model.backoffs[order] = HashArray(contexts), np.log(weights).astype(np.float32)
    return model


@dataclass
class Fitted:
    """Counts of every order as tables, what is small of the model, and into how many blocks it is cut."""

    languages: list[str]
    levels: dict[int, DataFrame]
    taken: dict[tuple[str, int], tuple]
    letters: int
    blocks: int

    def block(self, number: int) -> Model:
        """One block; the orders of one and two characters, at most an alphabet's pairs for each language, are in all of them."""
        counts = {}
        for order, table in self.levels.items():
            if order > 2 and self.blocks > 1:
                table = table.where(F.col("block") == number)
            rows = table.select("lang", "gram", "n").toPandas()
            keys, sizes = rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy()
            held = {}
            for lang, at in rows.groupby("lang").indices.items():
                at = at[np.argsort(keys[at])]
                held[str(lang)] = (keys[at], sizes[at])
            counts[order] = held
        return build(counts, self.taken, self.languages, self.letters)


def _with_block(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = block_of(batch.column("gram").to_numpy().view(np.uint64), blocks)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], names=[*batch.schema.names, "block"])

    return run


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", block_cells: int = BLOCK_CELLS) -> Fitted | None:
    """Count over all rows with a language, every language and n-gram; None without any letter."""
    named = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = named.mapInArrow(_count_batches("text"), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    levels = {ORDER: cut_lineage(counts)}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (16 * order)) - 1)).alias("gram")
        levels[order] = cut_lineage(levels[order + 1].select("lang", shorter).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")))
    taken, size = {}, 0
    for order, table in levels.items():
        few = [F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]
        for row in table.groupBy("lang").agg(*few, F.count(F.lit(1)).alias("all")).collect():  # a row for each language
            taken[row["lang"], order] = discounts(row["n1"], row["n2"], row["n3"], row["n4"])
            size += row["all"] if order > 2 else 0
    languages = sorted({lang for lang, _ in taken})
    if not languages:
        return None
    letters = max(2, levels[1].select("gram").distinct().count() + 1)
    blocks = max(1, -(-size * len(languages) // block_cells))
    if blocks > 1:
        for order in (ORDER, ORDER - 1):
            levels[order] = cut_lineage(levels[order].mapInArrow(_with_block(blocks), "lang string, gram bigint, n bigint, block bigint"))
    return Fitted(languages, levels, taken, letters, blocks)


def _sum_batches(text: str, model, blocks: int, block: int):
    """Add this block's part to ``sums``, which is null before the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in text_batches(batches, text):
            packed, first, letters = grams_of(chunk)
            found = model.value.sums(packed, first, blocks, block)
            so_far = batch.column("sums")
            if so_far.null_count == 0 and len(so_far):
                found = found + so_far.flatten().to_numpy(zero_copy_only=False).reshape(found.shape)
            ends = pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32))
            new = {
                "sums": pa.ListArray.from_arrays(ends, pa.array(found.reshape(-1))), "letters": pa.array(letters.astype(np.int64)),
                "units": pa.array(np.diff(first).astype(np.int64)),
            }
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(name, batch.column(i)) for i, name in enumerate(names)], names=names)

    return run


def _decision_batches(languages: list[str], carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(languages))
            units, letters = (batch.column(c).to_numpy() for c in ("units", "letters"))
            known = (units > 0) & (letters > 0)
            values = np.where(known[:, None], -sums / np.maximum(units, 1)[:, None], np.inf)
            order = np.argsort(values, axis=1, kind="stable")
            rows = np.arange(len(values))
            best = values[rows, order[:, 0]]
            second = values[rows, order[:, 1]] if values.shape[1] > 1 else best + 1
            names = [languages[i] if k else None for i, k in zip(order[:, 0], known)]
            gap = np.where(known, second, 0) - np.where(known, best, 0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried], pa.array(names, pa.string()), pa.array(np.where(known, best, np.nan)),
                 pa.array(gap.astype(np.float64)), batch.column("letters")],
                names=[*carried, "best", "entropy", "gap", "letters"],
            )

    return run


def _summed(rows: DataFrame, fitted: Fitted, text: str) -> DataFrame:
    """``rows`` with the sums of log-probabilities of every language, without the text."""
    nothing = {"sums": "array<double>", "letters": "bigint", "units": "bigint"}
    rows = rows.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in nothing.items()])
    for block in range(fitted.blocks):
        if block and block % BLOCKS_AT_ONCE == 0:
            rows = cut_lineage(rows)
        held = rows.sparkSession.sparkContext.broadcast(fitted.block(block))
        rows = rows.mapInArrow(_sum_batches(text, held, fitted.blocks, block), rows.schema)
    return rows.drop(text)


def _logistic(rows: pd.DataFrame) -> tuple[float, float]:
    """Slope and shift for right answers out of all at each rounded strength, by Newton steps."""
    w = np.array([1.0, 0.0])
    if rows.empty:
        return 1.0, 0.0
    x = np.stack([rows["strength"].to_numpy(float), np.ones(len(rows))], axis=1)
    n = rows["n"].to_numpy(float) + 0.02
    share = (rows["right"].to_numpy(float) + 0.01) / n
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - share)) + 1e-3 * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _strength() -> Column:
    """How far the best language leads: the total lead, in logarithm, since characters depend on each other."""
    return F.log1p(F.greatest(F.col("gap"), F.lit(0.0)) * F.col("letters"))


def identify(docs: DataFrame, train: Column, calibrate: Column, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``id_column``, ``lang_pred``, ``score`` and ``accepted`` of every row, from the whole text.

    Rows where ``train`` holds are counted; those where ``calibrate`` holds fit the score (the chance that the
    answer is right) and the cross-entropies above which a text is not accepted. ``lang_pred`` is the
    learned language with the lowest cross-entropy, the first by name of equals; a null text, or one
    without letters, has ``und``, score 0 and is not accepted, as has everything if nothing was learned. Rows with a null
    language are predicted but teach nothing. Repeated rows get equal answers; other columns are ignored.
    """
    flagged = docs.select(
        F.col(id_column), F.col(text).alias("__text"), F.col(lang).cast("string").alias("__lang"),
        F.coalesce(train, F.lit(False)).alias("__train"), F.coalesce(calibrate, F.lit(False)).alias("__calibrate"),
    )
    fitted = fit(flagged.where("__train"), "__text", "__lang")
    if fitted is None:
        return flagged.select(id_column, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    kind = docs.schema[id_column].dataType.simpleString()
    carried = [id_column, "__lang", "__calibrate"]
    summed = _summed(flagged.select(*carried, "__text"), fitted, "__text")
    scored = summed.mapInArrow(
        _decision_batches(fitted.languages, carried),
        f"`{id_column}` {kind}, __lang string, __calibrate boolean, best string, entropy double, gap double, letters bigint",
    )
    scored = cut_lineage(scored.withColumn("strength", F.when(F.col("best").isNotNull(), _strength())))
    known = scored.where("__calibrate and __lang is not null and best is not null")
    tally = known.groupBy(F.round("strength", 1).alias("strength")).agg(
        F.sum((F.col("best") == F.col("__lang")).cast("long")).alias("right"), F.count(F.lit(1)).alias("n")
    )
    slope, shift = _logistic(tally.toPandas())  # strength is a logarithm: a few hundred rows
    limits = known.where("best = __lang").groupBy("best").agg(F.percentile_approx("entropy", 1 - REJECT, 10_000).alias("limit")).collect()
    limit = F.lit(None).cast("double")
    for row in limits:
        limit = F.when(F.col("best") == row["best"], F.lit(row["limit"])).otherwise(limit)
    chance = 1 / (1 + F.exp(-(F.lit(slope) * F.col("strength") + F.lit(shift))))
    return scored.select(
        id_column,
        F.coalesce("best", F.lit("und")).alias("lang_pred"),
        F.coalesce(chance, F.lit(0.0)).alias("score"),
        F.coalesce(F.col("entropy") <= limit, F.lit(False)).alias("accepted"),
    )
