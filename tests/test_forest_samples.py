"""Samples of the isolation forest are the first rows in hash order, whether or not the table is cut first."""

import numpy as np
from pyspark.sql import functions as F

from feldspark.operators import forest
from feldspark.operators.ordering import ranked_by_hash


def test_samples_are_the_first_rows_in_hash_order(spark, monkeypatch):
    monkeypatch.setattr(forest, "SAMPLE_ROWS", 10)
    values = np.random.default_rng(2).permutation(500)
    df = spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(values)], "id int, a double").repartition(4)
    for trees in (3, 80):  # fewer rows than the table has, and more
        got = sorted((r["tree"], r["x"][0]) for r in forest._tree_samples(df, "id", ["a"], trees, 7).collect())
        ranks = {r["rank"]: r["a"] for r in ranked_by_hash(df, "id", 7).collect()}
        assert got == sorted((i // 10, ranks[i % 500 + 1]) for i in range(trees * 10))
    few = df.limit(4)
    assert forest._tree_samples(few, "id", ["a"], 2, 7).count() == 8 and forest._tree_samples(df.limit(0), "id", ["a"], 2, 7).count() == 0


def _walk(nodes, row):
    at, depth = 0, 0
    while nodes[at][0] >= 0:
        at, depth = int(nodes[at][3 - (row[int(nodes[at][0])] < nodes[at][1])]), depth + 1
    return depth + float(forest._average_path(nodes[at][4]))


def test_scores_are_computed_once_to_find_the_cut(spark, monkeypatch):
    """However many rounds the quantile takes, each row is scored once; the scores are those of a walk through every tree."""
    monkeypatch.setattr(forest, "SAMPLE_ROWS", 40)
    quantiles = forest.exact_quantiles
    monkeypatch.setattr(forest, "exact_quantiles", lambda df, wanted: quantiles(df, wanted, buffer=50, accuracy=100))
    scorer, frames = forest.score_isolation_forest, []
    calls = spark.sparkContext.accumulator(0)

    def counted(df, fitted, flag=True):
        made = scorer(df, fitted, flag)
        if not flag:
            seen = F.udf(lambda x: (calls.add(1), x)[1], "double").asNondeterministic()
            made = made.withColumn("anomaly_score", seen("anomaly_score"))
        frames.append(made)
        return made

    monkeypatch.setattr(forest, "score_isolation_forest", counted)
    values = np.random.default_rng(4).normal(size=(600, 3))
    rows = [(i, *(None if (i + j) % 50 == 0 else float(v) for j, v in enumerate(x))) for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(3)
    fitted = forest.fit_isolation_forest(df, "id", ["a", "b", "c"], trees=12, contamination=0.1)
    assert len(frames) == 1 and calls.value == 600
    usual = float(forest._average_path(np.mean([n for n, _ in fitted["forest"]])))
    found = {r["id"]: r for r in scorer(df, fitted).collect()}
    for i, *x in rows:
        x = [fitted["medians"][c] if v is None else v for c, v in zip("abc", x)]
        expected = 2 ** (-np.mean([_walk(nodes, x) for _, nodes in fitted["forest"]]) / usual)
        assert np.isclose(found[i]["anomaly_score"], expected, rtol=1e-12)
        assert found[i]["is_outlier_multivariate"] == (found[i]["anomaly_score"] > fitted["cutoff"])
    assert np.isclose(fitted["cutoff"], np.quantile([r["anomaly_score"] for r in found.values()], 0.9), rtol=1e-12)
