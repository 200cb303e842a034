"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

A fixed-length MinHash compares sets of like size, so a short item inside a long document would
be lost. Here each item keeps the smallest hashes of its shingles, as many as its size partition
needs: an item of n shingles of which a share t must be found has at most n - ceil(t n) missing,
so one more than that of its minima are enough for every containing document to hold one of them.
A document is searched for the minima of all partitions in one pass over its shingles, whatever
its length, and no pair is lost. Candidates are then verified on the words themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Chunk, Words, chunks, shingle_hashes, text_batches, word_hashes, words

BLOCK_BYTES = 32 << 20
"""Items sent to the tasks at once, in bytes of text; more of them take further passes over the documents."""


def needed(n: int, percent: int) -> int:
    """The least number of n shingles that is ``percent`` of them."""
    return -(-n * percent // 100)


def _folded_words(chunk: Chunk, found: Words, row: int) -> list[bytes]:
    lo, hi = found.first[row], found.first[row + 1]
    raw = chunk.data[chunk.offsets[row] : chunk.offsets[row + 1]].tobytes().lower()
    base = chunk.offsets[row]
    return [raw[b - base : e - base] for b, e in zip(found.begin[lo:hi], found.end[lo:hi])]


class ItemIndex:
    """The minima of a block of items by hash, per shingle width, and their shingles as words."""

    def __init__(self, texts: list[str | None], width: int, percent: int):
        self.percent = percent
        self.shingles: list[set[tuple[bytes, ...]]] = []
        by_width: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        row = 0
        for chunk in chunks(pa.array(texts, pa.string())):
            found = words(chunk)
            hashes = word_hashes(chunk, found)
            for i, count in enumerate(found.counts):
                used = min(width, int(count))
                own = _folded_words(chunk, found, i)
                self.shingles.append({tuple(own[j : j + used]) for j in range(count - used + 1)} if used else set())
                if used:
                    runs, _ = shingle_hashes(hashes[found.first[i] : found.first[i + 1]], np.array([0, count]), used)
                    by_width[used].append((np.unique(runs), row))
                row += 1
        self.minima: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for used, sets in by_width.items():
            kept, owners = [], []
            for runs, item in sets:
                # Partitions double in size; a partition's largest size decides for all of it.
                largest = (1 << len(runs).bit_length()) - 1
                take = min(len(runs), largest - needed(largest, percent) + 1)
                kept.append(runs[:take])
                owners.append(np.full(take, item))
            hashes, owner = np.concatenate(kept), np.concatenate(owners)
            order = np.argsort(hashes, kind="stable")
            filtered = np.zeros(1 << 20, bool)
            filtered[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.minima[used] = hashes[order], owner[order], filtered

    def found_in(self, chunk: Chunk) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, shingles of the item, shingles shared) for the documents of a chunk."""
        found = words(chunk)
        hashes = word_hashes(chunk, found)
        candidates: dict[int, set[int]] = defaultdict(set)
        for used, (minima, owner, filtered) in self.minima.items():
            runs, at = shingle_hashes(hashes, found.first, used)
            maybe = np.flatnonzero(filtered[(runs & np.uint64((1 << 20) - 1)).astype(np.int64)])
            low, high = np.searchsorted(minima, runs[maybe]), np.searchsorted(minima, runs[maybe], "right")
            rows = np.searchsorted(at, maybe, "right") - 1
            for r, a, b in zip(rows[high > low], low[high > low], high[high > low]):
                candidates[int(r)].update(owner[a:b].tolist())
        for row, items in sorted(candidates.items()):
            own = _folded_words(chunk, found, row)
            held: dict[int, set] = {}
            for item in sorted(items):
                wanted = self.shingles[item]
                used = len(next(iter(wanted)))
                if used not in held:
                    held[used] = {tuple(own[j : j + used]) for j in range(len(own) - used + 1)}
                shared = len(wanted & held[used])
                if shared >= needed(len(wanted), self.percent):
                    yield row, item, len(wanted), shared


def _search(index, identities, id_column: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = identities.value
        for batch, chunk in text_batches(batches, text):
            hits = list(index.value.found_in(chunk))
            rows, items, sizes, shared = zip(*hits) if hits else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_column).take(pa.array(rows, pa.int32())),
                    pa.array([names[i] for i in items], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(shared, pa.int64()),
                ],
                names=[id_column, "__item", "n_item_shingles", "n_shared"],
            )

    return run


def _blocks(items: DataFrame, item_column: str, item_text: str, width: int, percent: int, block_bytes: int):
    """Indexes of the items and their ids, block by block."""
    asked = items.select(F.col(item_column).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = asked.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-total // max(1, block_bytes // 2)))
    asked = asked.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    for block in range(blocks):
        rows = asked.where(F.col("b") == block).select("i", "t").collect()
        yield ItemIndex([r.t for r in rows], width, percent), [r.i for r in rows]


def _free_of(index, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in text_batches(batches, text):
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, *_ in index.value.found_in(chunk)]] = False
            yield batch.filter(pa.array(keep))

    return run


def without_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_column: str = "item_id", item_text: str = "text",
    width: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that hold no item as ``contained_items`` finds them, with all their columns."""
    for index, _ in _blocks(items, item_column, item_text, width, percent, block_bytes):
        docs = docs.mapInArrow(_free_of(docs.sparkSession.sparkContext.broadcast(index), text), docs.schema)
    return docs


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    width: int = 5,
    percent: int = 80,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Pairs of a document and an item of which it holds ``percent`` of the distinct ``width``-word shingles.

    Words are runs of characters other than space and 0x09-0x0D, with A-Z lowered. An item of
    fewer words is one shingle of all its words. Returns ``id_column``, ``item_column`` (a whole
    number), ``n_item_shingles``, ``n_shared`` and ``containment``. Null or empty texts and items
    hold nothing and are found nowhere; repeated rows of either table give a row each; other
    columns are ignored. The items are the stated query set: they go to the tasks in blocks of at most
    ``block_bytes`` (or one item), each block in one pass over the documents, and only one block at a
    time is on the driver.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    result = None
    for index, names in _blocks(items, item_column, item_text, width, percent, block_bytes):
        part = docs.select(id_column, text).mapInArrow(
            _search(spark.sparkContext.broadcast(index), spark.sparkContext.broadcast(names), id_column, text),
            f"`{id_column}` {kind}, __item bigint, n_item_shingles bigint, n_shared bigint",
        )
        result = part if result is None else result.unionByName(part)
    return result.select(
        id_column,
        F.col("__item").alias(item_column),
        "n_item_shingles",
        "n_shared",
        (F.col("n_shared") / F.col("n_item_shingles")).alias("containment"),
    )
