"""Toxicity by a gap-weighted subsequence kernel, Nystroem landmarks and a linear support vector machine.

The kernel compares strings by their common subsequences of ORDER characters, each weighted by
DECAY to the power of the lengths it spans, so characters put between those of an insult lower
the similarity a little instead of breaking it. Units are words reduced to their letters, with a
mark at either end; three or more single letters in a row are one unit. A sentence is as similar
to a landmark as its most similar unit, a document as its most similar sentence, and the machine
is trained on those similarities after the Nystroem map. Landmarks are the character runs that tell
toxic training documents from others best.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import Chunk, mix, text_batches

ORDER = 4
RUN = 5
DECAY = 0.7
DEGREE = 2
"""Power of the similarity to a landmark: a few common subsequences count little next to all of them."""
LANDMARKS = 96
TRAIN_ROWS = 6_000
"""At most about this many training documents of either label."""
FOLDS = 5
"""The logistic curve is fitted to margins of documents the machine did not train on."""
WINDOW, STRIDE = 24, 12
"""Longer units are read in windows, which overlap by more than a landmark and its gaps."""
SHORT = 12
START, END = 1, 2
_B = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Per code point: 0 other, 1 letter or mark, 2 space."""
    import unicodedata

    kind = np.zeros(0x110000, np.uint8)
    for i in range(0x20000):
        c = unicodedata.category(chr(i))[0]
        kind[i] = 1 if c in "LM" else 0
    kind[0x20000:0x32000] = 1
    kind[[9, 10, 11, 12, 13, 32]] = 2
    return kind


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    forward, backward = np.full(size, _B, np.uint64), np.full(size, pow(_B, -1, 2**64), np.uint64)
    forward[0] = backward[0] = 1
    return np.cumprod(forward, dtype=np.uint64), np.cumprod(backward, dtype=np.uint64)


@dataclass
class Units:
    """Distinct units of a chunk as padded code points, and the unit and row of each occurrence."""

    codes: np.ndarray
    lengths: np.ndarray
    unit: np.ndarray
    row: np.ndarray


def units_of(chunk: Chunk) -> Units:
    """Units of the rows of a chunk. Rows end with a space put between them."""
    held = chunk.data.tobytes()
    lowered = [held[a:b].decode("utf-8", "replace").lower() for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:])]
    sizes = np.array([len(t) for t in lowered]) + 1
    points = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le"), np.uint32)
    kind = _letters()[points]
    at = np.flatnonzero(kind == 1)
    if not len(at):
        return Units(np.zeros((0, 1), np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    word = np.cumsum(kind == 2)[at]
    ends_of_rows = np.cumsum(sizes)
    row = np.searchsorted(ends_of_rows, at, "right")
    letters = points[at]
    new = np.ones(len(at), bool)
    new[1:] = word[1:] != word[:-1]
    # Single-letter words in a row belong together when there are three or more of them.
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at)))
    single = length == 1
    follows = np.zeros(len(begin), bool)
    follows[1:] = single[1:] & single[:-1] & (row[begin[1:]] == row[begin[:-1]])
    group = np.cumsum(~follows)
    members = np.bincount(group)
    joined = follows & (members[group] >= 3)
    begin = begin[~joined]
    length = np.diff(np.append(begin, len(at)))
    row = row[begin]
    long = length > WINDOW
    if long.any():
        begin, length, row = _windows(begin, length, row)
    forward, backward = _powers(1 << max(20, len(letters).bit_length()))
    values = mix(letters.astype(np.uint64))
    totals = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(values * forward[: len(letters)], out=totals[1:])
    hashes = mix((totals[begin + length] - totals[begin]) * backward[begin] + length.astype(np.uint64))
    _, first, unit = np.unique(hashes, return_index=True, return_inverse=True)
    begin, length = begin[first], length[first]
    codes = np.zeros((len(first), WINDOW + 2), np.uint32)
    codes[:, 0] = START
    spread = np.arange(WINDOW)
    inside = spread[None, :] < length[:, None]
    codes[:, 1 : WINDOW + 1][inside] = letters[(begin[:, None] + spread[None, :])[inside]]
    codes[np.arange(len(first)), length + 1] = END
    return Units(codes, length + 2, unit, row)


def _windows(begin: np.ndarray, length: np.ndarray, row: np.ndarray):
    pieces = np.where(length > WINDOW, -(-(length - WINDOW) // STRIDE) + 1, 1)
    place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(begin, pieces) + place * STRIDE
    left = np.repeat(begin + length, pieces) - starts
    return starts, np.minimum(left, WINDOW), np.repeat(row, pieces)


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of order ORDER for pairs of rows of two padded code arrays (0: no character)."""
    n, width = left.shape
    other = right.shape[1]
    equal = (left[:, :, None] == right[:, None, :]) & (left[:, :, None] != 0)
    equal = np.ascontiguousarray(equal.transpose(1, 2, 0)).astype(np.float32)
    decay, square = np.float32(DECAY), np.float32(DECAY * DECAY)
    tail = np.ones((width + 1, other + 1, n), np.float32)
    for _ in range(ORDER - 1):
        after = np.zeros((width + 1, other + 1, n), np.float32)
        for i in range(1, width + 1):
            run = np.zeros(n, np.float32)
            for j in range(1, other + 1):
                run = decay * run + square * equal[i - 1, j - 1] * tail[i - 1, j - 1]
                after[i, j] = decay * after[i - 1, j] + run
        tail = after
    return square * np.einsum("ijn,ijn->n", equal, tail[:-1, :-1])


def _letter_bits(codes: np.ndarray) -> np.ndarray:
    bits = np.uint64(1) << (mix(codes.astype(np.uint64)) >> np.uint64(58))
    bits[codes == 0] = 0
    return np.bitwise_or.reduce(bits, axis=1)


def _common_length(codes: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row with one landmark, on bits; the kernel is zero under ORDER."""
    places = np.zeros(codes.shape, np.uint8)
    for i, c in enumerate(mark):
        places |= (codes == c).astype(np.uint8) << np.uint8(i)
    open_bits = np.full(len(codes), 255, np.uint8)
    for column in places.T:
        used = open_bits & column
        open_bits = (open_bits + used) | (open_bits - used)
    return np.bitwise_count(~open_bits & np.uint8((1 << len(mark)) - 1))


@dataclass
class Model:
    """Landmarks with their own kernel values, and weights of the similarities (Nystroem map folded in)."""

    landmarks: np.ndarray
    norms: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    bits: np.ndarray = field(init=False)

    def __post_init__(self):
        self.bits = _letter_bits(self.landmarks)

    def similarities(self, chunk: Chunk) -> np.ndarray:
        """Documents by landmarks. The kernel is only worked out where it is not zero."""
        n = len(chunk.offsets) - 1
        found = units_of(chunk)
        result = np.zeros((n, len(self.landmarks)), np.float32)
        if not len(found.unit) or not len(self.landmarks):
            return result
        bits = _letter_bits(found.codes)
        short = found.lengths <= SHORT
        values_unit, values_mark = [], []
        for mark in range(len(self.landmarks)):
            lacking = np.bitwise_count(self.bits[mark] & ~bits)
            near = np.flatnonzero(lacking <= RUN - ORDER)
            # Most units are short, and padding never matches.
            parts = [near[short[near]], near[~short[near]]]
            widths = [SHORT, found.codes.shape[1]]
            near = np.concatenate(
                [x[_common_length(found.codes[x, :w], self.landmarks[mark]) >= ORDER] for x, w in zip(parts, widths)]
            )
            values_unit.append(near)
            values_mark.append(np.full(len(near), mark))
        unit, mark = np.concatenate(values_unit), np.concatenate(values_mark)
        order = np.argsort(found.lengths[unit], kind="stable")
        unit, mark = unit[order], mark[order]
        lengths = found.lengths[unit]
        values = np.zeros(len(unit), np.float32)
        for length in np.unique(lengths):
            a, b = np.searchsorted(lengths, [length, length + 1])
            for lo in range(a, b, 4096):
                hi = min(b, lo + 4096)
                values[lo:hi] = kernel(found.codes[unit[lo:hi], :length], self.landmarks[mark[lo:hi]])
        values = np.minimum(values / self.norms[mark], 1) ** DEGREE
        keep = values > 0.001
        unit, mark, values = unit[keep], mark[keep], values[keep]
        # Occurrences of the units that are like any landmark, then the greatest value per row and landmark.
        order = np.argsort(unit, kind="stable")
        unit, mark, values = unit[order], mark[order], values[order]
        starts = np.searchsorted(unit, np.arange(len(found.codes) + 1))
        low, high = starts[found.unit], starts[found.unit + 1]
        hits = high > low
        low, count, row = low[hits], (high - low)[hits], found.row[hits]
        total = int(count.sum())
        if total:
            at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(total)
            np.maximum.at(result, (np.repeat(row, count), mark[at]), values[at])
        return result

    def scores(self, similarities: np.ndarray) -> np.ndarray:
        margin = similarities @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def _run_counts(text: str):
    """Per partition: in how many toxic and other documents each run of RUN characters of a unit occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in text_batches(batches, text):
            found = units_of(chunk)
            toxic = np.asarray(batch.column("toxic").to_numpy(zero_copy_only=False)).astype(np.int64)
            if not len(found.unit):
                continue
            starts = found.codes.shape[1] - RUN + 1
            views = np.lib.stride_tricks.sliding_window_view(found.codes, RUN, axis=1)[:, :starts]
            real = np.arange(starts)[None, :] + RUN <= found.lengths[:, None]
            owner, place = np.nonzero(real)
            runs = np.ascontiguousarray(views[owner, place])
            hashes = np.zeros(len(runs), np.uint64)
            for i in range(RUN):
                hashes = mix(hashes ^ runs[:, i].astype(np.uint64)) * np.uint64(_B)
            names, first, which = np.unique(hashes, return_index=True, return_inverse=True)
            at = np.searchsorted(owner, np.arange(len(found.lengths) + 1))
            count = np.diff(at)[found.unit]
            place = np.repeat(at[found.unit] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            pairs = np.unique(np.repeat(found.row, count) * len(names) + which[place])
            doc, which = pairs // len(names), pairs % len(names)
            toxics = np.bincount(which, toxic[doc], len(names)).astype(np.int64)
            every = np.bincount(which, minlength=len(names))
            packed = np.zeros((len(names), RUN), np.uint32)
            packed[:] = runs[first]
            texts = packed.tobytes().decode("utf-32-le", "replace")
            texts = [texts[i : i + RUN] for i in range(0, len(texts), RUN)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts), pa.array(toxics), pa.array(every.astype(np.int64))], names=["run", "toxics", "every"]
            )

    return run


def _similarity_rows(text: str, marks):
    """Similarities of the training documents to the landmarks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in text_batches(batches, text):
            values = marks.value.similarities(chunk).astype(np.float64)
            ends = np.arange(0, values.size + 1, max(1, values.shape[1]))[: len(values) + 1]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), lists], names=["key", "toxic", "x"])

    return run


def _support_vectors(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin; classes weigh the same."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    sign = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        inside = sign * (x1 @ w) < 1
        a = x1[inside] * weight[inside, None]
        new = np.linalg.solve(ridge + cost * (x1[inside].T @ a), cost * (a.T @ sign[inside]))
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def _calibrated(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits the weighted labels best, by Newton steps with smoothed targets."""
    positive, negative = weight[y > 0].sum(), weight[y <= 0].sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        curve, slope = weight * (p * (1 - p) + 1e-9), weight * (p - target)
        step = np.linalg.solve((x * curve[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ slope + 1e-6 * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic",
        landmarks: int = LANDMARKS, train_rows: int = TRAIN_ROWS) -> Model:
    """Train on at most about ``train_rows`` labelled documents of either label, drawn by a hash of the id.

    The bound is on the training sample alone; the curve behind the score weights it back to all labels. A document with several labels counts as toxic if one
    says so; null labels and ids are ignored. Without documents of both labels the model scores 0.5.
    """
    spark = docs.sparkSession
    clean = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
    clean = clean.groupBy(F.col(id_column).alias("key")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    counts = {r[0]: r[1] for r in clean.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    empty = Model(np.zeros((0, RUN), np.uint32), np.zeros(0), np.zeros(0), 0.0)
    if not counts.get(0) or not counts.get(1):
        return empty
    drawn, shares = None, {value: min(1.0, train_rows / n) for value, n in counts.items()}
    for value, share in shares.items():
        part = clean.where((F.col("toxic") == value) & (F.pmod(F.xxhash64("key", F.lit("train")), F.lit(1 << 30)) < int(share * (1 << 30))))
        drawn = part if drawn is None else drawn.unionByName(part)
    # At most about 2 x train_rows ids, whatever the size of the tables.
    texts = docs.select(F.col(id_column).alias("key"), F.col(text).alias("text")).join(F.broadcast(drawn), "key")
    texts = cut_lineage(texts.repartition(spark.sparkContext.defaultParallelism * 2, F.xxhash64("key")))
    seen = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    if not seen.get(0) or not seen.get(1):
        return empty
    rates = texts.mapInArrow(_run_counts("text"), "run string, toxics bigint, every bigint").groupBy("run").agg(
        F.sum("toxics").alias("toxics"), F.sum("every").alias("every")
    )
    n1, n0 = float(seen[1]), float(seen[0])
    p1, p0 = (F.col("toxics") + 0.5) / (n1 + 1), (F.col("every") - F.col("toxics") + 0.5) / (n0 + 1)
    best = (
        rates.where(F.col("toxics") >= F.lit(max(3, int(0.002 * n1))))
        .withColumn("gain", F.col("toxics") * F.log(p1 / p0))
        .where(p1 > 4 * p0)
        .orderBy(F.desc("gain"), "run")
        .limit(landmarks)
        .collect()
    )
    if not best:
        return empty
    marks = np.array([[ord(c) for c in r["run"]] for r in best], np.uint32)
    norms = kernel(marks, marks)
    model = Model(marks, norms, np.zeros(len(marks)), 0.0)
    rows = texts.mapInArrow(
        _similarity_rows("text", spark.sparkContext.broadcast(model)), f"key {texts.schema['key'].dataType.simpleString()}, toxic int, x array<double>"
    ).select(F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(FOLDS)).alias("fold"), "toxic", "x", "key").orderBy("key").toPandas()
    x, y = np.array(rows["x"].tolist()).reshape(len(rows), -1), rows["toxic"].to_numpy()
    cross = np.array([kernel(np.repeat(marks[i : i + 1], len(marks), 0), marks) for i in range(len(marks))], np.float64)
    cross = (cross / np.sqrt(np.outer(norms, norms))) ** DEGREE
    values, vectors = np.linalg.eigh((cross + cross.T) / 2)
    nystroem = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    z = x @ nystroem
    margins = np.zeros(len(y))
    for fold in range(FOLDS):
        holds = rows["fold"].to_numpy() == fold
        w, b = _support_vectors(z[~holds], y[~holds])
        margins[holds] = z[holds] @ w + b
    # Each drawn row stands for 1 / share rows of its label, so the score is a chance at the table's own ratio of labels.
    slope, shift = _calibrated(margins, y, np.where(y > 0, 1 / shares[1], 1 / shares[0]))
    w, b = _support_vectors(z, y)
    return Model(marks, norms, nystroem @ w, b, slope, shift)


def _scored(text: str, model, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in text_batches(batches, text):
            values = model.value.scores(model.value.similarities(chunk))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried], pa.array(values.astype(np.float64))], names=[*carried, "score"]
            )

    return run


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column`` and ``score`` (0 to 1, higher: toxic) of every row; the whole text is read.

    A null or empty text has no units and gets the score of a document that is like no landmark.
    Repeated rows get equal scores; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(_scored(text, held, [id_column]), f"`{id_column}` {kind}, score double")


def _below(text: str, model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in text_batches(batches, text):
            yield batch.filter(pa.array(model.value.scores(model.value.similarities(chunk)) < threshold))

    return run


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, whole."""
    return docs.mapInArrow(_below(text, docs.sparkSession.sparkContext.broadcast(model), threshold), docs.schema)
