"""Quality rules with isolation forests on their statistics.

Statistics of every whole text are counted in one pass. For each group of rules a forest of random splits is grown on a
bounded sample of them; documents that few splits isolate are unlike the others. One forest over all groups would call a
good text with one odd line as unusual as a text full of symbols, so each group has its own path length
under which a document is not kept, calibrated on labelled rows: the most bad ones are left out
for which at most a small share of the good ones go, and of such lengths the one that loses the fewest good ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import Chunk, shingle_hashes, text_batches, word_hashes, words

TREES = 100
TREE_ROWS = 256
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
GOOD_LOST = 0.01
"""Share of the good labelled rows that the calibrated threshold may leave out."""
SYMBOLS = b"#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits")
GROUPS = {"words": (0,), "symbols": (1, 2), "repeats": (3, 4), "digits": (5,)}
"""The columns of ``features`` by group of rules."""


def _class_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_SYMBOL = _class_table(SYMBOLS)
_DIGIT = _class_table(b"0123456789")
_LEAD = np.array([not 0x80 <= b < 0xC0 for b in range(256)])


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    totals = np.concatenate(([0], np.cumsum(flags)))
    return totals[offsets[1:]] - totals[offsets[:-1]]


def statistics_of(chunk: Chunk) -> np.ndarray:
    """Rows by STATISTICS."""
    found = words(chunk)
    n_words = found.counts
    hashes = word_hashes(chunk, found, fold=False)
    n = len(n_words)
    inside = np.zeros(len(chunk.data) + 1, np.int8)
    inside[found.begin] += 1
    inside[found.end] -= 1
    in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    result = np.zeros((n, len(STATISTICS)), np.int64)
    result[:, 0] = n_words
    result[:, 1] = _per_row(_LEAD[chunk.data] & in_word, chunk.offsets)
    result[:, 2] = _per_row(_SYMBOL[chunk.data], chunk.offsets)
    result[:, 6] = _per_row(_DIGIT[chunk.data], chunk.offsets)
    held = chunk.data.tobytes()
    windows, at = shingle_hashes(hashes, found.first, 3)
    for i in range(n):
        lines = held[chunk.offsets[i] : chunk.offsets[i + 1]].split(b"\n")
        full = [x for x in lines if x.strip(b" \t\n\r\x0b\x0c")]
        result[i, 3] = len(full) - len(set(full))
        result[i, 5] = len(full)
        count = int(n_words[i])
        if count >= 4:
            mine = windows[at[i] : at[i + 1]]
            order = np.argsort(mine, kind="stable")
            equal = mine[order][1:] == mine[order][:-1]
            if equal.any():
                twice = np.zeros(len(mine), bool)
                twice[order[1:][equal]] = True
                twice[order[:-1][equal]] = True
                covered = np.zeros(count, bool)
                for step in range(3):
                    covered[step : step + len(mine)] |= twice
                result[i, 4] = covered.sum()
    return result


def _statistics_batches(text: str, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in text_batches(batches, text):
            values = statistics_of(chunk)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried], *[pa.array(values[:, j].copy()) for j in range(values.shape[1])]],
                names=[*carried, *STATISTICS],
            )

    return run


def statistics(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(
        _statistics_batches(text, [id_column]), f"`{id_column}` {kind}, " + ", ".join(f"{c} bigint" for c in STATISTICS)
    )


def features(values: np.ndarray) -> np.ndarray:
    """The shares that the rules are about; constants keep those of short texts from jumping."""
    x = {name: values[:, j].astype(np.float64) for j, name in enumerate(STATISTICS)}
    return np.stack(
        [
            (x["word_chars"] + 100) / (x["n_words"] + 20),
            x["n_symbols"] / (x["word_chars"] + 100),
            x["n_symbols"] / (x["n_words"] + 20),
            x["n_dup_lines"] / (x["n_lines"] + 10),
            x["n_repeat_words"] / (x["n_words"] + 200),
            x["n_digits"] / (x["word_chars"] + 100),
        ],
        axis=1,
    )


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n values."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Flat trees: split feature (-1 at a leaf), threshold, left child (right follows it), path length of a leaf."""

    feature: list[np.ndarray]
    threshold: list[np.ndarray]
    left: list[np.ndarray]
    length: list[np.ndarray]
    norm: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (- mean path length / expected one): near 1 for documents that few splits isolate."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, left, length in zip(self.feature, self.threshold, self.left, self.length):
            node = np.zeros(len(x), np.int64)
            while True:
                split = feature[node]
                inner = split >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(split, 0)] >= threshold[node]
                node = np.where(inner, left[node] + right, node)
            total += length[node]
        return 2.0 ** (-total / max(1, len(self.feature)) / max(self.norm, 1e-9))


def grow(x: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    """Random splits of a random feature between its extremes, to the depth at which a tree's rows are expected apart."""
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(x))
    deepest = int(np.ceil(np.log2(max(size, 2))))
    forest = Forest([], [], [], [], float(_average_path(np.array(size))))
    for _ in range(trees if size else 0):
        feature, threshold, left, length = [-1], [0.0], [0], [0.0]
        waiting = [(0, x[rng.choice(len(x), size, replace=False)], 0)]
        while waiting:
            node, part, depth = waiting.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            spread = np.flatnonzero(high > low)
            if depth >= deepest or not len(spread):
                length[node] = depth + float(_average_path(np.array(len(part))))
                continue
            j = int(rng.choice(spread))
            cut = rng.uniform(low[j], high[j])
            right = part[:, j] >= cut
            if right.all() or not right.any():
                cut, right = high[j], part[:, j] >= high[j]
            feature[node], threshold[node], left[node] = j, cut, len(feature)
            for side in (part[~right], part[right]):
                waiting.append((len(feature), side, depth + 1))
                feature.append(-1), threshold.append(0.0), left.append(0), length.append(0.0)
        forest.feature.append(np.array(feature))
        forest.threshold.append(np.array(threshold))
        forest.left.append(np.array(left))
        forest.length.append(np.array(length))
    return forest


def _forest_batches(forests, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS], axis=1)
            scores = np.zeros((len(values), len(GROUPS)))
            for lo in range(0, len(values), 4096):
                x = features(values[lo : lo + 4096])
                for j, group in enumerate(GROUPS.values()):
                    scores[lo : lo + 4096, j] = forests.value[j].scores(x[:, group])
            found = [pa.array(scores[:, j].copy()) for j in range(len(GROUPS))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], *found], names=[*carried, *[f"anomaly_{g}" for g in GROUPS]])

    return run


def _threshold(tally: list[tuple[float, int, int]], good_lost: float) -> float | None:
    """The score from which on documents are left out, from rows of score, good and bad; None if that finds nothing."""
    allowed = good_lost * sum(good for _, good, _ in tally)
    lost = found = most = 0
    best = None
    for at, good, bad in sorted(tally, reverse=True):
        lost, found = lost + good, found + bad
        if lost > allowed or not allowed:
            break
        if found > most:
            most, best = found, at
    return best


def judge(
    docs: DataFrame,
    labels: DataFrame | None = None,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
    good_lost: float = GOOD_LOST,
) -> DataFrame:
    """``id_column``, the statistics, ``base_failed``, ``anomaly_<group>`` and their largest, ``anomaly`` (0 to 1), and ``kept`` of every row.

    ``base_failed``: fewer than LEAST_WORDS words, or more than MOST_REPEATED_PERCENT of the words in
    three-word windows that occur again in the text. ``kept`` is false for those and for anomalies at or above the
    threshold of their group. The forests are grown on about ``trees`` x ``tree_rows`` rows drawn by hash from those that
    pass the base rules; the thresholds come from all labelled rows among them (1 good, 0 bad), each losing at most
    ``good_lost`` / groups of the good ones. Without labelled rows of both kinds nothing else is left out. A null text has no words.
    Rows with a null id have no label; repeated rows get equal answers; other columns are ignored.
    """
    counted = cut_lineage(statistics(docs, id_column, text))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed)
    passing = counted.where("not base_failed")
    n = passing.count()
    share = min(1.0, trees * tree_rows / n) if n else 0.0
    drawn = passing.where(F.pmod(F.xxhash64(id_column, *STATISTICS), F.lit(1 << 30)) < int(share * (1 << 30)))
    # About trees x tree_rows rows, whatever the size of the table.
    sample = drawn.select(F.xxhash64(id_column).alias("k"), *STATISTICS).toPandas().sort_values(["k", *STATISTICS])
    seen = features(sample[list(STATISTICS)].to_numpy(np.int64))
    forests = [grow(seen[:, group], trees, tree_rows) for group in GROUPS.values()]
    kind = docs.schema[id_column].dataType.simpleString()
    carried = [id_column, *STATISTICS, "base_failed"]
    scores = [f"anomaly_{g}" for g in GROUPS]
    schema = f"`{id_column}` {kind}, " + ", ".join(f"{c} bigint" for c in STATISTICS) + ", base_failed boolean, " + ", ".join(f"{c} double" for c in scores)
    held = docs.sparkSession.sparkContext.broadcast(forests)
    scored = cut_lineage(counted.select(*carried).mapInArrow(_forest_batches(held, carried), schema))
    kept = ~F.col("base_failed")
    if labels is not None:
        known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
        known = known.groupBy(F.col(id_column).alias("__id")).agg(F.min(F.col(label).cast("int")).alias("__label"))
        joined = scored.where("not base_failed").join(known, F.col(id_column) == F.col("__id"))
        each = joined.select("__label", F.posexplode(F.array(*scores)).alias("group", "score"))
        # At most 1001 rows a group.
        tally = each.groupBy("group", (F.floor(F.col("score") * 1000) / 1000).alias("at")).agg(
            F.sum((F.col("__label") == 1).cast("long")).alias("good"), F.sum((F.col("__label") == 0).cast("long")).alias("bad")
        ).collect()
        for j, name in enumerate(scores):
            threshold = _threshold([(r["at"], r["good"], r["bad"]) for r in tally if r["group"] == j], good_lost / len(GROUPS))
            if threshold is not None:
                kept &= F.floor(F.col(name) * 1000) / 1000 < F.lit(threshold)
    return scored.withColumn("anomaly", F.greatest(*scores)).withColumn("kept", kept)
