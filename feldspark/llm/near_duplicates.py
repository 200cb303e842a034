"""Near-duplicate groups by b-bit MinHash, confirmed on whole shingle sets.

1. One pass over the texts gives each document its number of distinct shingles, a digest of
   the whole set, band keys and ``bits`` low bits of every minimum, packed in bit planes.
   Documents with equal sets form a class at once; everything later works on classes.
2. Classes that share a band key form a star around one of them, and joined stars form clusters. Only texts of
   clusters are read again, for the whole sets.
3. Two sets at the threshold share one of the rarest shingles of either, in the order of how many sets of the cluster hold them. Every set has a
   row for each of these. All rows of a shingle meet one hub, the set with the fewest shingles of its own;
   pairs that sizes and places do not rule out are estimated by bit counts of the packed planes, corrected for chance
   agreement, and those near the threshold are confirmed on whole sets.
4. Confirmed pairs form components. Sets of a shingle's largest component need not meet each other; the few others
   meet what sizes and places allow in the same estimate and confirmation, so that no link is lost.
5. Components of the confirmed links give the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components, tasks_for
from .text import mix, shingle_hashes, text_batches, word_hashes, words

LOST = 1e-6
"""A pair at the threshold misses every band with at most this probability."""
NEAR_MARGIN = 0.25
"""Pairs whose estimate is this far below the threshold, more than six standard errors, are not confirmed."""
SIZE_STEPS = 32
"""Size buckets to a doubling; a set meets the buckets its partners' sizes can lie in."""


def band_shape(threshold: float, lost: float = LOST, at_most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have for which ``lost`` holds with ``at_most`` minima."""
    best = None
    for rows in range(1, 17):
        hit = threshold**rows
        bands = 1 if hit >= 1 else ceil(log(lost) / log(1 - hit))
        if best is None or bands * rows <= at_most:
            best = (bands, rows)
    return best


def _digest(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(715517).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signature_batches(text: str, width: int, bands: int, rows: int, bits: int, carried: list[str]):
    k = bands * rows
    multipliers, salts = _multipliers(k), mix(_multipliers(bands))
    words_per_plane = (k + 63) // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in text_batches(batches, text):
            found = words(chunk)
            runs, at = shingle_hashes(word_hashes(chunk, found), found.first, width)
            n_docs = batch.num_rows
            counts = np.zeros(n_docs, np.int64)
            digests: list[bytes | None] = [None] * n_docs
            parts = []
            for i in np.flatnonzero(np.diff(at)):
                own = np.unique(runs[at[i] : at[i + 1]])
                counts[i] = len(own)
                digests[i] = _digest(own.tobytes())
                parts.append(own)
            filled = np.flatnonzero(counts)
            keys = np.zeros((len(filled), bands), np.uint64)
            planes = np.zeros((len(filled), bits * words_per_plane), np.uint64)
            if parts:
                every = np.concatenate(parts)
                starts = np.concatenate(([0], np.cumsum(counts[filled])))[:-1]
                hashed = np.empty_like(every)
                for j in range(k):
                    np.multiply(every, multipliers[j], out=hashed)
                    low = mix(np.minimum.reduceat(hashed, starts))
                    keys[:, j // rows] = keys[:, j // rows] * np.uint64(31) + low
                    for bit in range(bits):
                        planes[:, bit * words_per_plane + j // 64] |= ((low >> np.uint64(bit)) & np.uint64(1)) << np.uint64(j % 64)
                keys = mix(keys ^ salts)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carried], pa.array(counts), pa.array(digests, pa.binary()),
                 _lists(keys, counts), _lists(planes, counts)],
                names=[*carried, "n_shingles", "digest", "bands", "planes"],
            )

    return run


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(np.where(counts > 0, values.shape[1], 0))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.reshape(-1).view(np.int64)))


def signatures(docs: DataFrame, id_column: str, text: str, width: int, bands: int, rows: int, bits: int) -> DataFrame:
    """One row per document: id, hash of the text, n_shingles, digest (null without words), bands and packed planes."""
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text, F.xxhash64(text).alias("text_key")).mapInArrow(
        _signature_batches(text, width, bands, rows, bits, [id_column, "text_key"]),
        f"`{id_column}` {kind}, text_key bigint, n_shingles bigint, digest binary, bands array<bigint>, planes array<bigint>",
    )


def estimated_similarity(left: Column, right: Column, minima: int, bits: int) -> Column:
    """Share of equal minima by bit counts of packed planes, corrected for equal low bits by chance."""
    per = (minima + 63) // 64
    unequal = F.lit(0)
    for word in range(per):
        differ = F.lit(0).cast("bigint")
        for bit in range(bits):
            at = bit * per + word
            differ = differ.bitwiseOR(left[at].bitwiseXOR(right[at]))
        unequal = unequal + F.bit_count(differ)
    chance = 0.5**bits
    return (F.lit(1.0) - unequal / F.lit(float(minima)) - chance) / (1 - chance)


def _clusters(classes: DataFrame) -> DataFrame:
    """``digest`` and ``cluster`` of the classes that share a band key with another one, directly or through others."""
    # The band's number is part of its key's hash, so the key alone names the bucket.
    banded = classes.select("digest", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("digest").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    edges = banded.join(hubs.select("key", "hub"), "key").where("digest <> hub").select("digest", "hub").distinct()
    grouped = components(edges, "digest", "hub")
    return grouped.select(F.col("node").alias("digest"), F.col("root").alias("cluster"))


def _set_batches(text: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, chunk in text_batches(batches, text):
            found = words(chunk)
            runs, at = shingle_hashes(word_hashes(chunk, found), found.first, width)
            sets = [np.unique(runs[at[i] : at[i + 1]]).tobytes() for i in range(batch.num_rows)]
            # Rows may repeat an id and a text hash; only the set that was signed goes on.
            sets = [s if _digest(s) == d else None for s, d in zip(sets, batch.column("digest").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("digest", "cluster", "planes")], pa.array(sets, pa.binary())],
                names=["digest", "cluster", "planes", "shingles"],
            )

    return run


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(s, np.int64) for s in batch.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        for lo in range(0, len(sets), 64):
            n = sizes[lo : lo + 64]
            owner = pa.array(np.repeat(np.arange(lo, lo + len(n)), n))
            columns = [batch.column("digest").take(owner), batch.column("cluster").take(owner), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets[lo : lo + 64]))]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "cluster", "size", "shingle"])


def _prefix_rows(sets: DataFrame, percent: int) -> DataFrame:
    """``cluster``, ``shingle``, ``digest``, ``size``, ``at`` and ``most`` of the shingles through which a set can be linked.

    Shingles are in order of how few sets of the cluster hold them, and ``at`` is a shingle's place. Two sets at the
    threshold share one of the first n - ceil(threshold n) + 1 of either. A set that meets another at its place ``at``, their
    first shared shingle, shares at most the n - at from there on, so the other has at most ``most`` shingles.
    """
    rows = sets.select("digest", "cluster", "shingles").mapInArrow(
        _shingle_rows, "digest binary, cluster binary, size bigint, shingle bigint"
    )
    rows = rows.select(F.xxhash64("cluster").alias("cluster"), "digest", "size", "shingle")
    held = rows.groupBy("cluster", "shingle").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    own = Window.partitionBy("digest")
    # Shingles no other set has come first, and need no rows.
    alone = F.col("size") - F.count(F.lit(1)).over(own)
    at = alone + F.row_number().over(own.orderBy("sets", "shingle")) - 1
    most = F.floor((100 + percent) * (F.col("size") - F.col("at")) / percent).cast("bigint") - F.col("size")
    placed = rows.join(held, ["cluster", "shingle"]).withColumn("at", at)
    first = placed.where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * percent / 100)).withColumn("most", most)
    return first.where(F.col("most") * 100 >= F.col("size") * percent).select("cluster", "shingle", "digest", "size", "at", "most")


def _pairs(met: DataFrame, percent: int) -> DataFrame:
    """Distinct ``x`` < ``y`` of rows with ``digest``, ``size``, ``most`` and another set's ``digest2``, ``size2``, ``most2`` that can be linked."""
    allowed = (F.col("size2") <= F.col("most")) & (F.col("size") <= F.col("most2")) & (F.col("digest") != F.col("digest2"))
    alike = (F.least("size", "size2") * 100) >= (F.greatest("size", "size2") * percent)
    return met.where(allowed & alike).select(F.least("digest", "digest2").alias("x"), F.greatest("digest", "digest2").alias("y")).distinct()


def _confirm_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for left, right in zip(batch.column("x_set"), batch.column("y_set")):
                a, b = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                a, b = (a, b) if len(a) <= len(b) else (b, a)
                place = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = int((b[place] == a).sum())
                near.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["x", "y"]).filter(pa.array(near, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, minima: int, bits: int) -> DataFrame:
    """The pairs whose whole sets are at the threshold, ``x`` and ``y``; only pairs of a near estimate fetch their sets."""
    for side in ("x", "y"):
        planes = sets.select(F.col("digest").alias(side), F.col("planes").alias(f"{side}_planes"))
        pairs = pairs.join(planes, side)
    near = estimated_similarity(F.col("x_planes"), F.col("y_planes"), minima, bits) >= percent / 100 - NEAR_MARGIN
    pairs = cut_lineage(pairs.where(near).select("x", "y"))
    pairs = pairs.coalesce(tasks_for(pairs.count()))
    for side in ("x", "y"):
        pairs = pairs.join(sets.select(F.col("digest").alias(side), F.col("shingles").alias(f"{side}_set")), side)
    return cut_lineage(pairs.mapInArrow(_confirm_batches(percent), "x binary, y binary"))


def _links(sets: DataFrame, percent: int, minima: int, bits: int) -> DataFrame:
    """Confirmed links ``x``, ``y`` that connect what the similarity graph connects."""
    rows = cut_lineage(_prefix_rows(sets, percent))
    key = ["cluster", "shingle"]
    hubs = rows.groupBy(*key).agg(F.min(F.struct("at", "digest", "size", "most")).alias("h"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    hubs = hubs.select(*key, F.col("h.digest").alias("digest2"), F.col("h.size").alias("size2"), F.col("h.most").alias("most2"))
    tried = cut_lineage(_pairs(rows.join(hubs, key), percent))
    links = _confirmed(tried, sets, percent, minima, bits)
    parts = cut_lineage(components(links, "x", "y"))
    parted = rows.join(hubs.select(*key), key, "left_semi").join(parts.withColumnRenamed("node", "digest"), "digest", "left")
    parted = cut_lineage(parted.withColumn("root", F.coalesce("root", "digest")))
    counted = parted.groupBy(*key, "root").agg(F.count(F.lit(1)).alias("sets"), F.min("size").alias("least"))
    tops = counted.groupBy(*key).agg(
        F.max(F.struct("sets", "root")).alias("top"), F.count(F.lit(1)).alias("roots"), F.min("least").alias("least")
    ).where("roots > 1")
    unlike = cut_lineage(parted.join(tops.select(*key, F.col("top.root").alias("top"), "least"), key))
    bucket = lambda size: F.floor(F.log2(size) * SIZE_STEPS).cast("int")
    largest = F.least("most", F.floor(F.col("size") * 100 / percent).cast("bigint"))
    smallest = F.ceil(F.col("size") * percent / 100).cast("bigint")
    # Of two sets of different components at most one is of the largest, so this is one side of every pair left.
    asking = unlike.where((F.col("root") != F.col("top")) & (largest >= F.col("least")))
    asking = asking.select(*key, "digest", "size", "most", "root", F.explode(F.sequence(bucket(smallest), bucket(largest))).alias("bucket"))
    others = unlike.select(
        *key, bucket(F.col("size")).alias("bucket"),
        *[F.col(c).alias(f"{c}2") for c in ("digest", "size", "most", "root")],
    )
    met = asking.join(others, [*key, "bucket"]).where("root <> root2")
    left = _pairs(met, percent).join(tried, ["x", "y"], "left_anti")
    stars = parts.where("node <> root").select(F.col("node").alias("x"), F.col("root").alias("y"))
    return stars.unionByName(_confirmed(left, sets, percent, minima, bits))


def _grouped(docs: DataFrame, id_column: str, text: str, width: int, threshold_percent: int, bits: int) -> DataFrame:
    threshold = threshold_percent / 100
    bands, rows = band_shape(threshold)
    signed = cut_lineage(signatures(docs, id_column, text, width, bands, rows, bits))
    full = signed.where("digest is not null")
    classes = full.groupBy("digest").agg(
        F.min(F.struct(F.col(id_column).isNull(), F.col(id_column).alias("id"), "text_key")).alias("first"),
        F.first("bands").alias("bands"),
        F.first("planes").alias("planes"),
    )
    classes = cut_lineage(classes)
    wanted = (
        _clusters(classes)
        .join(classes.select("digest", "first", "planes"), "digest")
        .select("digest", "cluster", "planes", F.col("first.id").alias("first_id"), F.col("first.text_key").alias("key"))
    )
    # The text is found by its hash and the first id of its class, so copies are not read again.
    texts = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))
    same = (F.col("text_key") == F.col("key")) & F.col("id").eqNullSafe(F.col("first_id"))
    read = texts.join(wanted, same).select("digest", "cluster", "planes", "text")
    sets = read.mapInArrow(_set_batches("text", width), "digest binary, cluster binary, planes array<bigint>, shingles binary")
    sets = cut_lineage(sets.where("shingles is not null"))
    if sets.count() > sets.select("digest").distinct().count():
        # Rows repeat an id and a text.
        sets = cut_lineage(sets.dropDuplicates(["digest"]))
    linked = components(_links(sets, threshold_percent, bands * rows, bits), "x", "y")
    rooted = classes.select("digest", F.col("first.id").alias("first_id")).join(linked.withColumnRenamed("node", "digest"), "digest", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "digest"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = rooted.join(smallest, "root").select("digest", "root", "component_id")
    columns = [id_column, "text_key", "n_shingles", "component_id", "root"]
    with_sets = full.join(of_class, "digest").select(*columns)
    without = signed.where("digest is null").withColumn("component_id", F.col(id_column)).withColumn("root", F.lit(None).cast("binary"))
    both = with_sets.unionByName(without.select(*columns))
    return both.withColumn("kept", F.col(id_column).eqNullSafe(F.col("component_id")))


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    width: int = 5,
    threshold_percent: int = 80,
    bits: int = 2,
) -> DataFrame:
    """Group documents whose distinct ``width``-word shingles have a Jaccard similarity at the threshold or more.

    Words are runs of characters other than space and 0x09-0x0D, with A-Z lowered; a text with
    fewer words is one shingle. Links are confirmed on whole sets, of 64-bit shingle hashes.
    Returns ``id_column``, ``n_shingles``, ``component_id`` (the smallest id linked directly or
    through others) and ``kept`` (the row has that id). A text that is null or has no words has no
    shingles and is its own component. Rows that repeat an id are the same document to the caller
    and are kept or not together; a null id gets the smallest non-null id of its group, and is
    kept if there is none. Other columns are ignored, and an empty table gives an empty result.
    """
    return _grouped(docs, id_column, text, width, threshold_percent, bits).drop("text_key", "root")


def without_copies(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5, threshold_percent: int = 80, bits: int = 2
) -> DataFrame:
    """One row of ``docs`` for each group of near copies, and all rows without words, with all their columns.

    The row with the smallest id stays, a null id being the largest; then that with the smallest hash of its text, and of rows
    equal in id and text any one. Columns may have any names; an empty table stays empty.
    """
    rows = cut_lineage(_grouped(docs, id_column, text, width, threshold_percent, bits).where("root is not null").select(F.col(id_column).alias("id"), "text_key", "root"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    first = rows.groupBy("root").agg(F.min(order).alias("first")).select("root", F.col("first.id").alias("first_id"), F.col("first.text_key").alias("first_key"))
    stays = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    counted = rows.groupBy("root", "id", "text_key").agg(F.count(F.lit(1)).alias("times")).join(first, "root").withColumn("stays", stays)
    # Neither a copy nor one of several equal rows goes through here.
    other = cut_lineage(counted.where("not stays or times > 1").select("id", "text_key", "stays"))

    def same(marked: DataFrame) -> Column:
        return docs[id_column].eqNullSafe(marked["id"]) & F.xxhash64(docs[text]).eqNullSafe(marked["text_key"])

    single = docs.join(other, same(other), "left_anti")
    repeated = other.where("stays")
    if repeated.isEmpty():
        return single
    return single.unionByName(docs.join(repeated, same(repeated), "left_semi").dropDuplicates([id_column, text]))
