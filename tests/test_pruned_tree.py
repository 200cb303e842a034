"""Pruned trees against all subtrees of a small tree; shift detection; pseudo labels."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from feldspark.operators import models, shift
from feldspark.operators.metrics import roc_auc
from feldspark.operators.pruned_tree import Node, _gini_cost, auc_of_counts, fit_pruned_tree, pruned, weakest_links


def random_tree(rng, depth=3):
    nodes = {}

    def grow(left_depth):
        number = len(nodes)
        nodes[number] = None
        if left_depth == 0 or (number and rng.random() < 0.2):
            nodes[number] = Node(-1, 0.0, -1, -1, tuple(map(float, rng.integers(1, 30, 2))))
            return number
        left, right = grow(left_depth - 1), grow(left_depth - 1)
        weights = tuple(a + b for a, b in zip(nodes[left].weights, nodes[right].weights))
        nodes[number] = Node(0, 0.0, left, right, weights)
        return number

    grow(depth)
    return nodes


def subtrees(nodes, at=0):
    """Every pruned subtree as its set of leaves."""
    yield frozenset([at])
    node = nodes[at]
    if not node.is_leaf:
        for a, b in itertools.product(subtrees(nodes, node.left), subtrees(nodes, node.right)):
            yield a | b


@pytest.mark.parametrize("seed", range(8))
def test_subtrees_are_the_best_of_all(seed):
    nodes = random_tree(np.random.default_rng(seed))
    whole = sum(nodes[0].weights)
    strength = weakest_links(nodes)
    every = list(subtrees(nodes))
    for alpha in sorted({0.0, 1e-4, 1e-2, 0.05, 1.0, *strength.values()}):
        leaves = frozenset(i for i, n in pruned(nodes, strength, alpha).items() if n.is_leaf)
        cost = {t: sum(_gini_cost(nodes[i], whole) + alpha for i in t) for t in every}
        least = min(cost.values())
        assert cost[leaves] == pytest.approx(least, abs=1e-12)
        assert len(leaves) == min(len(t) for t in every if cost[t] <= least + 1e-12)


def noisy(spark, n=900, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = ((x[:, 0] > 0.3) ^ (rng.random(n) < 0.15)).astype(float)
    return spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(n)], "id int, a double, b double, c double, y double")


def test_pruned_tree(spark):
    df = noisy(spark)
    tree = fit_pruned_tree(df, "id", ["a", "b", "c"], "y", min_leaf=5)
    full = fit_pruned_tree(df, "id", ["a", "b", "c"], "y", min_leaf=5, auto_prune=False)
    assert tree.alpha > 0 and len(tree.nodes) < len(full.nodes) and len(tree.trials) >= 10
    assert tree.features[tree.nodes[0].feature] == "a" and abs(tree.nodes[0].threshold - 0.3) < 0.2
    assert max(t[1] for t in tree.trials) == dict((t[0], t[1]) for t in tree.trials)[tree.alpha]
    scored = df.withColumn("p", tree.probability()).withColumn("leaf", tree.leaf()).persist()
    by_leaf = {r["leaf"]: r for r in scored.groupBy("leaf").agg(F.sum("y").alias("pos"), F.count("y").alias("n"), F.avg("p").alias("p")).collect()}
    assert set(by_leaf) == {i for i, n in tree.nodes.items() if n.is_leaf}
    counts = {i: (int(r["n"] - r["pos"]), int(r["pos"])) for i, r in by_leaf.items()}
    assert auc_of_counts(counts, tree.nodes) == pytest.approx(roc_auc(scored, "y", "p"))
    balance = df.where("y = 0").count() / df.where("y = 1").count()
    for i, r in by_leaf.items():
        positives = r["pos"] * balance
        assert r["p"] == pytest.approx(positives / (positives + r["n"] - r["pos"]))
    assert sum("class:" in line for line in tree.rules()) == len(by_leaf) and tree.node_table(spark).count() == len(tree.nodes)


def test_a_planted_shift_is_found_and_dropped(spark):
    df = noisy(spark).drop("y")
    new = noisy(spark, seed=5).drop("y").withColumn("b", F.col("b") + 3)
    found = shift.adversarial_validation(df, new, "id", ["a", "b", "c"], k=3, rounds=10, rate=0.1, depth=3)
    rounds = found.rounds.collect()
    assert found.verdict == "similar" and found.features == ["a", "c"]
    assert [r["dropped"] for r in rounds] == ["b", None] and rounds[0]["verdict"] == "shifted"


def test_pseudo_labels(spark):
    df = noisy(spark)
    estimator = models.logistic_regression(["a", "b", "c"], "y", 900)
    model, added = models.pseudo_label(estimator, df, noisy(spark, 300, 9).drop("y"), ["a", "b", "c"], "y", 0.9)
    rows = added.collect()
    assert rows and all((r["a"] > 0.3) == (r["y"] == 1.0) for r in rows) and model.transform(df).count() == 900
    _, none = models.pseudo_label(estimator, df, noisy(spark, 30, 9).drop("y"), ["a", "b", "c"], "y", 1.0)
    assert none.count() == 0


def test_search_shares_folds_and_keeps_its_deadline(spark, monkeypatch):
    made = []
    real = models.split_kfold
    monkeypatch.setattr(models, "split_kfold", lambda *a, **b: made.append(1) or real(*a, **b))
    df = noisy(spark, 300)
    build = lambda **s: models.logistic_regression(["a", "b", "c"], "y", 300, **s)
    space = {"c": ("log", 1e-3, 1e2)}
    best, table = models.search(build, space, df, "id", "y", trials=5, k=3)
    rows = table.orderBy("trial").collect()
    assert made == [1] and [r["state"] for r in rows] == ["done"] * 5
    assert str(best) == max(rows, key=lambda r: (r["score"], -r["trial"]))["settings"]
    # The same scores as one cross-validation after another.
    alone = models.mean_std(models.cross_validate(build(**best), df, "id", "y", 3))[0]
    assert max(r["score"] for r in rows) == pytest.approx(alone)
    slow = lambda **s: models.random_forest(["a", "b", "c"], "y", trees=400, depth=12)
    started = time.monotonic()
    best, table = models.search(slow, space, df, "id", "y", trials=40, seconds=3, k=3)
    states = [r["state"] for r in table.collect()]
    assert len(states) == 40 and "out of time" in states and time.monotonic() - started < 120
    assert models.search(build, space, df, "id", "y", trials=3, seconds=0, k=3)[0] is None
