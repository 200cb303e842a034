"""Prefix tries of conversations: a node for every distinct beginning, with what its conversations share.

1. A turn is a digest of role and text, and a conversation a sequence of digests. Equal sequences are
   counted once. The digest of a prefix folds that of its turns, so a node has one name everywhere.
2. Prefixes at lengths 1, 2, 4, ... are weighed. A sequence is cut at its shortest prefix that is light; light
   prefixes are dealt to shards by hash, so whatever lies below one lies in one shard, of bounded size.
3. In a shard, turns get dense ids and the sequences go into a double array: the child of state s by turn id t is
   BASE[s] + t if CHECK there says s. Walking all sequences through it gives the nodes and their sums.
4. Nodes above the cuts occur in several shards. Their counts are merged; what they add to their own
   ancestors is carried up by doubling steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SHARD_TURNS = 50_000
BROADCAST_ROWS = 100_000
BLOCK_BYTES = 1 << 16
LONGEST_POWER = 30
WORD = r"[^\x20\x09-\x0D]+"
TURNS = "array<struct<key:binary,words:bigint>>"
NODE = (
    "node binary, parent binary, depth bigint, members bigint, first {id}, words bigint, shared boolean, parent_shared boolean, "
    "parent_first {id}, children bigint, leaves bigint, saved bigint"
)


def _digest(value: Column) -> Column:
    return F.unhex(F.md5(value))


EMPTY = hashlib.md5(b"").digest()


def prefix_digest(turns: Column) -> Column:
    """Folded digest of a sequence; that of no turns is the root's."""
    return F.aggregate(turns, F.lit(EMPTY), lambda so_far, t: _digest(F.concat(so_far, t["key"])))


def sequences(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``id`` and ``turns`` (digest and number of words of each) of every conversation with an id.

    In order of ``turn``, null first; ties by role, then digest. Null roles and texts are empty. Rows
    without an id belong to no conversation. Texts do not leave their task, but a conversation's digests are one row.
    """
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    by = F.coalesce(F.col(role).cast("string"), F.lit(""))
    # The length keeps a role's end apart from a text's start.
    key = _digest(F.concat(F.length(by).cast("string"), F.lit(":"), by, said))
    number = F.col(turn).cast("bigint")
    one = F.struct(
        number.isNotNull().alias("numbered"), F.coalesce(number, F.lit(0)).alias("turn"), by.alias("role"), key.alias("key"),
        F.size(F.regexp_extract_all(said, F.lit(WORD), F.lit(0))).cast("bigint").alias("words"),
    )
    held = rows.where(F.col(conv_id).isNotNull()).groupBy(F.col(conv_id).alias("id")).agg(F.array_sort(F.collect_list(one)).alias("all"))
    return held.select("id", F.transform("all", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def _cut(distinct: DataFrame, shard_turns: int) -> DataFrame:
    """Add ``cut``, the number of turns of the shortest light prefix, and ``shard``; without one the cut lies beyond the end."""
    size = F.size("turns")
    lengths = F.filter(F.array(*[F.lit(1 << k) for k in range(LONGEST_POWER)]), lambda n: n <= size)
    prefixes = F.transform(lengths, lambda n: F.struct(n.alias("length"), prefix_digest(F.slice("turns", F.lit(1), n)).alias("prefix")))
    spread = distinct.select("end", size.alias("size"), F.explode(prefixes).alias("p")).select("end", "size", "p.length", "p.prefix")
    weighed = spread.groupBy("length", "prefix").agg(F.sum("size").alias("weight")).where(F.col("weight") > shard_turns)
    heavy = cut_lineage(weighed.select(F.col("prefix").alias("heavy")))
    heavy = F.broadcast(heavy) if heavy.count() <= BROADCAST_ROWS else heavy
    light = spread.join(heavy, F.col("prefix") == F.col("heavy"), "left_anti")
    first = light.groupBy(F.col("end").alias("of")).agg(F.min(F.struct("length", "prefix")).alias("p"))
    total = distinct.agg(F.sum(size)).first()[0] or 0
    shards = 1 + total // shard_turns
    cut = F.coalesce(F.col("p.length"), F.size("turns") + 1).alias("cut")
    shard = F.pmod(F.xxhash64(F.coalesce("p.prefix", "end")), F.lit(shards)).alias("shard")
    return distinct.join(first, F.col("end") == F.col("of"), "left").select("end", "turns", "members", "first", cut, shard)


class DoubleArray:
    """BASE and CHECK over dense turn ids; slot 0 is the root, and CHECK is -1 in free slots."""

    def __init__(self, symbols: int):
        self.base = np.zeros(symbols + 2, np.int64)
        self.check = np.full(symbols + 2, -1, np.int64)
        self.check[0] = 0

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate((self.base, np.zeros(more, np.int64)))
            self.check = np.concatenate((self.check, np.full(more, -1, np.int64)))

    def _free(self, least: int) -> np.ndarray:
        """Free slots in order, at least so many."""
        free = np.flatnonzero(self.check < 0)
        if len(free) < least:
            self._grow(len(self.check) + least)
            free = np.flatnonzero(self.check < 0)
        return free

    def add(self, states: np.ndarray, symbols: np.ndarray) -> None:
        """Give each state its children; pairs are sorted by state, and a state's children all come at once."""
        starts = np.flatnonzero(np.concatenate(([True], states[1:] != states[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(states)])))
        for i in starts[sizes > 1][np.argsort(-sizes[sizes > 1], kind="stable")]:
            stop = i + int(sizes[np.searchsorted(starts, i)])
            self._place(int(states[i]), symbols[i:stop])
        single = starts[sizes == 1]
        slots = self._free(len(single))[: len(single)]
        self.base[states[single]] = slots - symbols[single]
        self.check[slots] = states[single]

    def _place(self, state: int, symbols: np.ndarray) -> None:
        """The first base at which all of a state's children find free slots."""
        reach = symbols - symbols[0]
        free = self._free(1)
        for at in range(0, len(free), 256):
            tried = free[at : at + 256, None] + reach
            self._grow(int(tried[-1, -1]) + 1)
            fits = (self.check[tried] < 0).all(axis=1)
            if fits.any():
                slots = tried[int(np.argmax(fits))]
                break
        else:
            slots = len(self.check) + reach
            self._grow(int(slots[-1]) + 1)
        self.base[state] = slots[0] - symbols[0]
        self.check[slots] = state

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of the states by these symbols, -1 where there is none."""
        to = self.base[states] + symbols
        inside = (to > 0) & (to < len(self.check))
        found = np.where(inside, self.check[np.where(inside, to, 0)] == states, False)
        return np.where(found, to, -1)


def dense_ids(keys: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 1 for the distinct keys, by the place of their first occurrence, so that siblings have close numbers."""
    place = np.arange(len(keys)) - np.repeat(at, lengths)
    if not len(keys):
        return np.zeros(0, np.int64), 0
    _, inverse = np.unique(keys, axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    count = int(inverse.max()) + 1
    earliest = np.full(count, np.iinfo(np.int64).max)
    np.minimum.at(earliest, inverse, place)
    number = np.empty(count, np.int64)
    number[np.argsort(earliest, kind="stable")] = np.arange(1, count + 1)
    return number[inverse], count


def packed(symbols: np.ndarray, at: np.ndarray, lengths: np.ndarray, count: int) -> DoubleArray:
    """The double array of sequences that begin ``at`` their place in ``symbols``, one depth after another."""
    array = DoubleArray(count)
    states = np.zeros(len(at), np.int64)
    for depth in range(int(lengths.max(initial=0))):
        longer = np.flatnonzero(lengths > depth)
        pairs = np.unique(np.stack((states[longer], symbols[at[longer] + depth]), axis=1), axis=0)
        array.add(pairs[:, 0], pairs[:, 1])
        states[longer] = array.step(states[longer], symbols[at[longer] + depth])
    return array


def _shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of one shard, by walking its sequences through their double array."""
    turns = table.column("turns").combine_chunks()
    lengths = turns.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    flat = turns.flatten()
    names = flat.field("key").to_pylist()
    keys = np.frombuffer(b"".join(names), np.uint64).reshape(-1, 2)
    words = flat.field("words").to_numpy(zero_copy_only=False)
    symbols, count = dense_ids(keys, at, lengths)
    array = packed(symbols, at, lengths, count)

    slots = len(array.check)
    depth, of_words = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    members, shared = np.zeros(slots, np.int64), np.zeros(slots, bool)
    turn_of = np.full(slots, -1, np.int64)
    ids = table.column("first").combine_chunks()
    # Ids may be of any kind; their order is kept in ranks.
    ranks = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
    by_rank = np.argsort(ranks)
    first = np.full(slots, len(ids), np.int64)
    weight = table.column("members").to_numpy()
    cut = table.column("cut").to_numpy()
    states = np.zeros(len(at), np.int64)
    for d in range(int(lengths.max(initial=0)) + 1):
        here = np.flatnonzero(lengths >= d)
        if d:
            states[here] = array.step(states[here], symbols[at[here] + d - 1])
            turn_of[states[here]] = at[here] + d - 1
        now = states[here]
        np.add.at(members, now, weight[here])
        np.minimum.at(first, now, ranks[here])
        depth[now] = d
        shared[now[cut[here] > d]] = True
    used = np.flatnonzero(members)
    inner = used[used > 0]
    of_words[inner] = words[turn_of[inner]]

    in_order = used[np.argsort(depth[used], kind="stable")]
    digest: dict[int, bytes] = {}
    for s in in_order.tolist():
        digest[s] = hashlib.md5(digest[int(array.check[s])] + names[turn_of[s]]).digest() if s else EMPTY
    own = ~shared
    children = np.zeros(slots, np.int64)
    np.add.at(children, array.check[inner[own[inner]]], 1)
    # Nodes of other shards are no children of an own node, so it is known here whether it is a leaf.
    leaves = np.where(own & (children == 0), 1, 0)
    saved = np.where(own, (members - 1) * of_words, 0)
    edges = np.flatnonzero(np.diff(depth[in_order])) + 1
    for level in np.split(in_order, edges)[:0:-1]:
        np.add.at(leaves, array.check[level], leaves[level])
        np.add.at(saved, array.check[level], saved[level])

    parent = array.check[used]
    root = used == 0
    firsts = ids.take(pa.array(by_rank[first[used]]))
    parents = ids.take(pa.array(by_rank[first[parent]]))
    return pa.table(
        {
            "node": pa.array([digest[s] for s in used.tolist()], pa.binary()),
            "parent": pa.array([None if s == 0 else digest[int(array.check[s])] for s in used.tolist()], pa.binary()),
            "depth": depth[used], "members": members[used], "first": firsts, "words": of_words[used], "shared": shared[used],
            "parent_shared": pa.array(shared[parent], mask=root), "parent_first": parents,
            "children": children[used], "leaves": leaves[used], "saved": saved[used],
        }
    )


def _merged(parts: DataFrame) -> DataFrame:
    """The shared nodes, one row each, with the sums of their whole subtrees."""
    merged = parts.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("members").alias("members"), F.min("first").alias("first"),
        F.first("words").alias("words"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
    )
    merged = cut_lineage(merged)
    below = merged.where("parent is not null").groupBy(F.col("parent").alias("above")).agg(F.count(F.lit(1)).alias("below"))
    merged = merged.join(below, F.col("node") == F.col("above"), "left").withColumn("children", F.col("children") + F.coalesce("below", F.lit(0)))
    # What shards hold below a node has reached all its ancestors there; only the node's own share is left to carry up.
    leaf = F.when(F.col("children") == 0, 1).otherwise(0).cast("bigint")
    merged = cut_lineage(merged.withColumn("leaf", leaf).withColumn("own", (F.col("members") - 1) * F.col("words")).drop("above", "below"))
    climb = cut_lineage(merged.select("node", F.col("parent").alias("up"), "leaf", "own"))
    # After k rounds a node has the sums of its descendants less than 2**k below, and knows the node 2**k above.
    while not climb.where("up is not null").isEmpty():
        given = climb.where("up is not null").groupBy(F.col("up").alias("to")).agg(F.sum("leaf").alias("more_leaf"), F.sum("own").alias("more_own"))
        jump = climb.select(F.col("node").alias("at"), F.col("up").alias("next"))
        climb = climb.join(given, F.col("node") == F.col("to"), "left").join(jump, F.col("up") == F.col("at"), "left")
        climb = cut_lineage(
            climb.select(
                "node", F.col("next").alias("up"), (F.col("leaf") + F.coalesce("more_leaf", F.lit(0))).alias("leaf"),
                (F.col("own") + F.coalesce("more_own", F.lit(0))).alias("own"),
            )
        )
    carried = climb.select(F.col("node").alias("of"), F.col("leaf").alias("sum_leaf"), F.col("own").alias("sum_own"))
    whole = merged.join(carried, F.col("node") == F.col("of"))
    return whole.withColumn("leaves", F.col("leaves") + F.col("sum_leaf")).withColumn("saved", F.col("saved") + F.col("sum_own")).select(*merged.columns)


def prefix_nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> tuple[DataFrame, DataFrame]:
    """Nodes of the prefix trie of ``sequences`` (``id``, ``turns``), and the ``id`` and ``end`` node of each sequence.

    Nodes have ``node`` (a digest), ``depth``, ``first`` and ``parent_first`` (smallest ids through a node and through its
    parent), ``members``, ``children``, ``leaves`` (childless nodes in the subtree) and ``saved`` (words of the last
    turns in the subtree that further members repeat). The root is the prefix without turns, and is missing only where
    there are no sequences. Equal sequences, also a third of all, are one sequence with a count; a prefix many share is
    cut further down. Ids must not be null or repeat; other columns are ignored.
    """
    kind = sequences.schema["id"].dataType.simpleString()
    named = cut_lineage(sequences.select("id", F.col("turns").cast(TURNS).alias("turns")).withColumn("end", prefix_digest(F.col("turns"))))
    distinct = named.groupBy("end").agg(F.first("turns").alias("turns"), F.count(F.lit(1)).alias("members"), F.min("id").alias("first"))
    distinct = cut_lineage(distinct)
    parts = cut_lineage(_cut(distinct, shard_turns).groupBy("shard").applyInArrow(_shard_nodes, NODE.format(id=kind)))
    merged = cut_lineage(_merged(parts.where("shared")))
    few = merged.count() <= BROADCAST_ROWS
    upper = merged.select(F.col("node").alias("up"), F.col("first").alias("up_first"))
    columns = ["node", "depth", "first", "parent_first", "members", "children", "leaves", "saved"]
    inside = parts.where("not shared and not parent_shared")
    below = parts.where("not shared and parent_shared").drop("parent_first").select("node", "parent", *[c for c in columns[1:] if c != "parent_first"])
    every = below.unionByName(merged.select(*below.columns)).join(F.broadcast(upper) if few else upper, F.col("parent") == F.col("up"), "left")
    nodes = inside.select(*columns).unionByName(every.withColumn("parent_first", F.col("up_first")).select(*columns))
    return nodes, named.select("id", "end")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the same end, joined with commas to texts of bounded size; rows come in order."""
    end, first, held, size = None, None, [], 0

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([first]), pa.array([",".join(held)])], names=["end", "first", "ids"])

    for batch in batches:
        for e, i in zip(batch.column("end").to_pylist(), batch.column("id").to_pylist()):
            if held and (e != end or size > BLOCK_BYTES):
                yield flushed()
                held, size = [], 0
            if not held:
                end, first = e, i
            held.append(str(i))
            size += len(held[-1]) + 1
    if held:
        yield flushed()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each end's blocks, which come in order; one block is held at a time."""
    end, state = None, None
    for batch in batches:
        ends, digests = [], []
        for e, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist()):
            if state is not None and e == end:
                state.update(b",")
            else:
                if state is not None:
                    ends.append(end)
                    digests.append(state.hexdigest())
                end, state = e, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(ends, pa.binary()), pa.array(digests, pa.string())], names=["end", "sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([state.hexdigest()])], names=["end", "sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``end`` and ``sha256`` of its ids in ascending order, joined with commas.

    The ids are joined in blocks where a range partitioning puts them, so a frequent end spreads over
    tasks; the hash itself runs over a node's blocks one after another, as it must.
    """
    kind = ends.schema["id"].dataType.simpleString()
    placed = ends.repartitionByRange("end", "id").sortWithinPartitions("end", "id")
    blocks = cut_lineage(placed.select("end", "id").mapInArrow(_blocks, f"end binary, first {kind}, ids string"))
    return blocks.repartition("end").sortWithinPartitions("end", "first").mapInArrow(_hashes, "end binary, sha256 string")
