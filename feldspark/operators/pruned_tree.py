"""Decision trees pruned by cost and complexity, with the strength chosen by cross-validation.

A tree's node table is as large as the model, so pruning is arithmetic on the driver: the inner node whose collapse costs least
impurity per leaf saved goes first, again and again. Validation rows are only counted by leaf and class, in one
pass for each fold; every pruned subtree is scored from these counts, since its leaves are unions of the full tree's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roles import dbl
from ..session import small_table
from .explain import tree_nodes
from .models import decision_tree, mean_std
from .resample import with_weights
from .split import split_kfold

STRENGTHS = 20
"""Strengths of the full tree's sequence that are tried, evenly spread over it."""
DEPTH = 12


class Node(NamedTuple):
    """An inner node has children and tests ``feature`` <= ``threshold`` for the left one; ``weights`` are sums by class."""

    feature: int
    threshold: float
    left: int
    right: int
    weights: tuple[float, float]

    @property
    def chance(self) -> float:
        return self.weights[1] / sum(self.weights)

    @property
    def is_leaf(self) -> bool:
        return self.left < 0


def nodes_of(spark, model) -> dict[int, Node]:
    """The nodes of a fitted two-class tree; 0 is the root."""
    found = {}
    for number, node in tree_nodes(spark, model)[0][1].items():
        inner = node["leftChild"] >= 0
        threshold = float(node["split"]["leftCategoriesOrThreshold"][0]) if inner else 0.0
        found[number] = Node(node["split"]["featureIndex"] if inner else -1, threshold, node["leftChild"], node["rightChild"], tuple(node["impurityStats"]))
    return found


def _gini_cost(node: Node, whole: float) -> float:
    total = sum(node.weights)
    return total / whole * (1 - sum((w / total) ** 2 for w in node.weights)) if total else 0.0


def weakest_links(nodes: Mapping[int, Node]) -> dict[int, float]:
    """The strength from which each inner node is a leaf; no less than those of the nodes below it."""
    whole = sum(nodes[0].weights)
    own = {i: _gini_cost(n, whole) for i, n in nodes.items()}
    parent = {c: i for i, n in nodes.items() if not n.is_leaf for c in (n.left, n.right)}
    below, leaves = {}, {}
    for i in sorted(nodes, key=lambda x: -_depth(x, parent)):
        n = nodes[i]
        below[i] = own[i] if n.is_leaf else below[n.left] + below[n.right]
        leaves[i] = 1 if n.is_leaf else leaves[n.left] + leaves[n.right]
    open_nodes = {i for i, n in nodes.items() if not n.is_leaf}
    strength: dict[int, float] = {}
    reached = 0.0
    while open_nodes:
        price = {i: (own[i] - below[i]) / (leaves[i] - 1) for i in open_nodes}
        least = min(price.values())
        reached = max(reached, least)
        # Of the cheapest, one not under another cheapest one; those under it go with it.
        chosen = min((i for i in open_nodes if price[i] <= least), key=lambda i: _depth(i, parent))
        saved, gained = leaves[chosen] - 1, own[chosen] - below[chosen]
        for i in _under(chosen, nodes):
            if i in open_nodes:
                strength[i] = reached
                open_nodes.discard(i)
        at = chosen
        while True:
            leaves[at], below[at] = leaves[at] - saved, below[at] + gained
            if at not in parent:
                break
            at = parent[at]
    return strength


def _depth(node: int, parent: Mapping[int, int]) -> int:
    depth = 0
    while node in parent:
        node, depth = parent[node], depth + 1
    return depth


def _under(node: int, nodes: Mapping[int, Node]) -> list[int]:
    found = [node]
    for i in found:
        if not nodes[i].is_leaf:
            found += [nodes[i].left, nodes[i].right]
    return found


def pruned(nodes: Mapping[int, Node], strength: Mapping[int, float], alpha: float) -> dict[int, Node]:
    """The subtree at ``alpha``: inner nodes of no greater strength are leaves."""
    kept: dict[int, Node] = {}
    waiting = [0]
    while waiting:
        i = waiting.pop()
        node = nodes[i]
        if not node.is_leaf and strength[i] <= alpha:
            node = node._replace(feature=-1, left=-1, right=-1)
        kept[i] = node
        if not node.is_leaf:
            waiting += [node.left, node.right]
    return kept


def _leaf_of(nodes: Mapping[int, Node], kept: Mapping[int, Node]) -> list[int]:
    """For each leaf of the full tree, in preorder, the leaf of the pruned one that holds it."""
    found: list[int] = []

    def walk(i: int, holder: int | None) -> None:
        node = nodes[i]
        holder = i if holder is None and i in kept and kept[i].is_leaf else holder
        if node.is_leaf:
            found.append(i if holder is None else holder)
        else:
            walk(node.left, holder)
            walk(node.right, holder)

    walk(0, None)
    return found


def auc_of_counts(counts: Mapping[int, tuple[int, int]], nodes: Mapping[int, Node]) -> float | None:
    """Area under the curve of rows counted by leaf (negatives, positives), ties counted half."""
    merged: dict[float, list[int]] = {}
    for leaf, (negative, positive) in counts.items():
        held = merged.setdefault(nodes[leaf].chance, [0, 0])
        held[0] += negative
        held[1] += positive
    area, negatives, positives = 0.0, 0, 0
    for chance in sorted(merged):
        negative, positive = merged[chance]
        area += positive * (negatives + negative / 2)
        negatives, positives = negatives + negative, positives + positive
    return area / (negatives * positives) if negatives and positives else None


@dataclass
class PrunedTree:
    features: list[str]
    nodes: dict[int, Node]
    alpha: float = 0.0
    trials: list[tuple[float, float, float]] = field(default_factory=list)

    def _pick(self, leaf, i: int = 0) -> Column:
        node = self.nodes[i]
        if node.is_leaf:
            return F.lit(leaf(i, node))
        test = dbl(self.features[node.feature]) <= F.lit(node.threshold)
        return F.when(test, self._pick(leaf, node.left)).otherwise(self._pick(leaf, node.right))

    def probability(self) -> Column:
        """The chance of class 1, as one expression."""
        return self._pick(lambda i, node: float(node.chance))

    def leaf(self) -> Column:
        return self._pick(lambda i, node: i)

    def rules(self) -> list[str]:
        """The tree as indented text, a line for each test and leaf."""
        lines: list[str] = []

        def walk(i: int, depth: int) -> None:
            node = self.nodes[i]
            if node.is_leaf:
                lines.append(f"{'|   ' * depth}|--- class: {int(node.chance >= 0.5)} ({node.chance:.4f})")
                return
            name = self.features[node.feature]
            for sign, child in (("<=", node.left), ("> ", node.right)):
                lines.append(f"{'|   ' * depth}|--- {name} {sign} {node.threshold:.4f}")
                walk(child, depth + 1)

        walk(0, 0)
        return lines

    def node_table(self, spark) -> DataFrame:
        rows = [
            (i, n.left if not n.is_leaf else None, n.right if not n.is_leaf else None, None if n.is_leaf else self.features[n.feature],
             None if n.is_leaf else n.threshold, float(sum(n.weights)), float(n.chance))
            for i, n in sorted(self.nodes.items())
        ]
        return small_table(spark, rows, "node int, left int, right int, feature string, threshold double, weight double, probability double")


def fit_pruned_tree(
    df: DataFrame, id_column: str, features: Sequence[str], label: str, min_leaf: int = 20, depth: int = DEPTH, k: int = 5,
    auto_prune: bool = True, seed: int = 42,
) -> PrunedTree:
    """A tree with balanced class weights; with ``auto_prune`` cut back to the strength of the best mean AUC over ``k`` folds.

    The strengths tried come from a tree without a least leaf size; of equally good ones the weakest is taken. Labels are 0 and 1.
    """
    spark = df.sparkSession
    weighted = split_kfold(with_weights(df, label), id_column, label, k, seed, "__fold").persist()
    try:
        tree = decision_tree(features, label, depth, min_leaf, weight="weight", seed=seed).fit(weighted).stages[-1]
        nodes = nodes_of(spark, tree)
        if not auto_prune:
            return PrunedTree(list(features), nodes)
        loose = decision_tree(features, label, depth, 1, weight="weight", seed=seed)
        path = sorted({0.0, *weakest_links(nodes_of(spark, loose.fit(weighted).stages[-1])).values()})
        tried = path[:: max(1, len(path) // STRENGTHS)]
        scores: list[list[float]] = []
        for fold in range(k):
            scores.append(_fold_scores(spark, weighted, fold, loose, label, tried))
    finally:
        weighted.unpersist()
    by_strength = [[s[i] for s in scores if s[i] is not None] or [0.5] for i in range(len(tried))]
    trials = [(alpha, *mean_std(values)) for alpha, values in zip(tried, by_strength)]
    best = max(trials, key=lambda t: (t[1], -t[0]))[0]
    return PrunedTree(list(features), pruned(nodes, weakest_links(nodes), best), best, trials)


def _fold_scores(spark, weighted: DataFrame, fold: int, estimator, label: str, tried: Sequence[float]) -> list[float | None]:
    """Validation AUC of the fold's tree at every strength, from one count of rows by leaf and class."""
    model = estimator.fit(weighted.where(F.col("__fold") != fold))
    tree = model.stages[-1].setLeafCol("__leaf")
    nodes = nodes_of(spark, tree)
    held = tree.transform(model.stages[0].transform(weighted.where(F.col("__fold") == fold)))
    positive = F.sum((dbl(label) == 1).cast("bigint"))
    counted = held.groupBy("__leaf").agg(F.count(F.lit(1)).alias("n"), positive.alias("pos")).collect()  # a row for each leaf
    strength = weakest_links(nodes)
    found: list[float | None] = []
    for alpha in tried:
        kept = pruned(nodes, strength, alpha)
        holder = _leaf_of(nodes, kept)
        counts: dict[int, np.ndarray] = {}
        for row in counted:
            leaf = holder[int(row["__leaf"])]
            counts[leaf] = counts.get(leaf, np.zeros(2, np.int64)) + np.array([row["n"] - row["pos"], row["pos"]])
        found.append(auc_of_counts({leaf: tuple(map(int, c)) for leaf, c in counts.items()}, kept))
    return found
