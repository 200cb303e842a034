"""Neighbour operators against brute force on small tables with many copies."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from feldspark.operators import forest, neighbours as N, synthetic as S
from feldspark.operators.ordering import stratum_sizes


def brute(ids, x, k, blocks=None):
    out = {}
    for i in range(len(ids)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        ok = [j for j in range(len(ids)) if j != i and (blocks is None or blocks[j] == blocks[i])]
        ok.sort(key=lambda j: (((x[j] - x[i]) ** 2).sum(), ids[j]))
        out[ids[i]] = [(ids[j], round(float(d[j]), 9)) for j in ok[:k]]
    return out


@pytest.fixture(scope="module")
def points():
    """A third of all rows are one point; the rest are clustered with a few far away."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.tile([1.0, 2.0, 3.0], (200, 1)), np.round(rng.normal(0, 3, (390, 3)), 1), rng.normal(500, 100, (10, 3))])
    return pd.DataFrame({"id": np.arange(600), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": (np.arange(600) % 4 == 0).astype(int)})


@pytest.mark.parametrize("cells", [{}, {"cell_points": 40, "cell_queries": 25}])
@pytest.mark.parametrize("block", [None, "y"])
def test_neighbour_join_is_exact(spark, points, cells, block):
    df = spark.createDataFrame(points)
    rows = N.nearest(df, df, "id", "id", ["a", "b", "c"], 4, block, True, **cells).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append((r["neighbour"], round(r["distance"], 9)))
    x = points[["a", "b", "c"]].to_numpy()
    assert got == brute(list(points["id"]), x, 4, list(points["y"]) if block else None)


def test_fewer_points_than_neighbours(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, None)], "id int, a double")
    rows = N.nearest(df, df, "id", "id", ["a"], 5, exclude_same_id=True).collect()
    assert sorted((r["id"], r["neighbour"]) for r in rows) == [(1, 2), (2, 1)]


def test_local_outlier_factor(spark, points):
    pdf = points.iloc[150:600].copy()
    df = spark.createDataFrame(pdf)
    x, ids, k = pdf[["a", "b", "c"]].to_numpy(), list(pdf["id"]), 5
    near = brute(ids, x, k)
    kd = {i: n[-1][1] for i, n in near.items()}
    lrd = {i: 1 / (np.mean([max(d, kd[j]) for j, d in n]) + 1e-10) for i, n in near.items()}
    expected = {i: np.mean([lrd[j] for j, _ in n]) / lrd[i] for i, n in near.items()}
    got = {r["id"]: r["lof"] for r in N.local_outlier_factor(df, "id", ["a", "b", "c"], k, cell_points=60).collect()}
    for i in ids:
        assert got[i] == pytest.approx(expected[i], rel=1e-5)


def test_knn_fills_leave_no_holes(spark, points):
    pdf = points[["id", "a", "b", "c"]].copy()
    pdf.loc[::5, "a"] = None
    pdf.loc[::7, "b"] = None
    filled = N.knn_fills(spark.createDataFrame(pdf).select("id", *[F.nanvl(c, F.lit(None)).alias(c) for c in "abc"]), "id", ["a", "b", "c"]).toPandas()
    assert not filled[["a", "b", "c"]].isna().any().any()
    kept = pdf.merge(filled, on="id")
    known = kept["a_x"].notna()
    assert (kept.loc[known, "a_x"] == kept.loc[known, "a_y"]).all()


def test_isolation_forest_finds_the_far_points(spark, points):
    df = spark.createDataFrame(points)
    fitted = forest.fit_isolation_forest(df, "id", ["a", "b", "c"], trees=50, contamination=0.05)
    scored = forest.score_isolation_forest(df, fitted).toPandas()
    assert scored.loc[scored["id"] >= 590, "is_outlier_multivariate"].all()
    assert scored["is_outlier_multivariate"].mean() <= 0.05


def test_large_tables_deal_rows_to_trees(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 13).cast("double").alias("b"))
    fitted = forest.fit_isolation_forest(df, "id", ["a", "b"], trees=10)
    assert len(fitted["forest"]) == 10 and all(150 < n < 400 for n, _ in fitted["forest"])


AXES = ["a", "b", "c"]


def test_smote_balances_and_stays_between_neighbours(spark, points):
    df = spark.createDataFrame(points)
    made = S.smote(df, "id", "y", AXES)
    assert len(set(stratum_sizes(made, "y").values())) == 1
    pdf, base = made.toPandas(), points.set_index("id")
    new = pdf[pdf["copy"] > 0]
    for row in new.sample(40, random_state=0).itertuples():
        a, b = base.loc[row.id, AXES].to_numpy(float), base.loc[int(row.neighbour), AXES].to_numpy(float)
        p = np.array([row.a, row.b, row.c])
        assert base.loc[row.id, "y"] == row.y == base.loc[int(row.neighbour), "y"]
        assert (p >= np.minimum(a, b) - 1e-9).all() and (p <= np.maximum(a, b) + 1e-9).all()
    again = S.smote(df, "id", "y", AXES).toPandas()
    key = ["y", "copy", "id"]
    pd.testing.assert_frame_equal(
        pdf.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True)
    )


def test_smotenc_uses_known_levels(spark, points):
    df = spark.createDataFrame(points.assign(kind=np.where(points["id"] % 3 == 0, "p", "q")))
    made = S.smotenc(df, "id", "y", AXES, ["kind"]).toPandas()
    assert set(made["kind"]) == {"p", "q"}
    assert made["y"].value_counts().nunique() == 1


def test_adasyn_adds_about_the_missing_rows(spark, points):
    made = S.adasyn(spark.createDataFrame(points), "id", "y", AXES).toPandas()
    assert abs((made["copy"] > 0).sum() - 300) <= 80


def test_cleaning_rules(spark, points):
    pdf = points.iloc[150:600]
    df = spark.createDataFrame(pdf)
    ids, y = list(pdf["id"]), dict(zip(pdf["id"], pdf["y"]))
    near = brute(ids, pdf[AXES].to_numpy(), 3)
    linked = {i for i in ids if near[near[i][0][0]][0][0] == i and y[i] != y[near[i][0][0]]}
    kept = {r[0] for r in S.remove_tomek_links(df, "id", "y", AXES, "all").select("id").collect()}
    assert kept == set(ids) - linked
    kept = {r[0] for r in S.edited_neighbours(df, "id", "y", AXES).select("id").collect()}
    assert kept == {i for i in ids if all(y[j] == y[i] for j, _ in near[i])}
