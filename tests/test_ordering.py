import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from feldspark.operators.aggregates import exact_quantiles
from feldspark.operators.ordering import hash_cuts, hash_key, ranked_by_hash, running_totals, surrounding_values, with_rank
from feldspark.operators.split import proportional_quota, split_group, split_holdout, split_kfold, check_group_folds


def keys(ids, seed):
    return sorted((hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i) for i in ids)


def test_hash_cuts_refine_to_the_exact_key(spark):
    df = spark.range(5000).withColumn("s", (F.col("id") % 3 == 0).cast("int"))
    cuts = hash_cuts(df, "id", 7, {0: [0, 10, 3000], 1: [1, 1667]}, "s", bucket_rows=2)
    for s, ranks in {0: [10, 3000], 1: [1, 1667]}.items():
        order = keys([i for i in range(5000) if (i % 3 == 0) == bool(s)], 7)
        assert [order[r - 1][0] for r in ranks] == cuts[s][-2:]
    assert cuts[0][0] == ""
    kept = df.where(F.col("s") == 0).where(hash_key("id", 7) <= F.lit(cuts[0][1])).count()
    assert kept == 10


def test_hash_cuts_reject_repeated_ids(spark):
    df = spark.range(50).select(F.lit(1).alias("id"))
    with pytest.raises(ValueError):
        hash_cuts(df, "id", 7, {None: [10]}, bucket_rows=2)


def test_ranked_by_hash_is_dense(spark):
    df = spark.range(3000).withColumn("s", F.col("id") % 2)
    rows = ranked_by_hash(df, "id", 3, "s").collect()
    for s in (0, 1):
        expected = {i: n + 1 for n, (_, i) in enumerate(keys(range(s, 3000, 2), 3))}
        assert {r["id"]: r["rank"] for r in rows if r["s"] == s} == expected


def test_rank_and_running_totals_with_a_hot_value(spark):
    random.seed(1)
    data = [(i, 5 if i % 3 == 0 else random.randint(0, 9), i % 7) for i in range(4000)]
    df = spark.createDataFrame(data, "id int, k int, v int").repartition(7)
    ranked = {r["id"]: r["rank"] for r in with_rank(df, ["k", "id"]).collect()}
    order = sorted(data, key=lambda r: (r[1], r[0]))
    assert ranked == {r[0]: n + 1 for n, r in enumerate(order)}
    total, expected = 0, {}
    for r in order:
        total += r[2]
        expected[r[0]] = total
    rows = running_totals(df, ["k", "id"], ["v"]).collect()
    assert {r["id"]: r["cum_v"] for r in rows} == expected
    assert {r["all_v"] for r in rows} == {total}


def test_surrounding_values_cross_partitions_and_groups(spark):
    random.seed(2)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 == 0 else random.choice(["a", "b", "c", None])
        rows.append((i, group, random.randint(0, 500), None if random.random() < 0.9 else float(i)))
    df = spark.createDataFrame(rows, "id int, g string, t int, v double").repartition(5)
    got = surrounding_values(df, ["t", "id"], {"v": F.col("v")}, ["g"]).toPandas()
    pdf = pd.DataFrame(rows, columns=["id", "g", "t", "v"]).sort_values(["t", "id"])
    by = pdf.groupby(pdf["g"].fillna("-none-"))["v"]
    expected = pdf.assign(prev=by.ffill(), next=by.bfill()).sort_values("id")
    got = got.sort_values("id")
    np.testing.assert_array_equal(got["prev_v"].to_numpy(float), expected["prev"].to_numpy(float))
    np.testing.assert_array_equal(got["next_v"].to_numpy(float), expected["next"].to_numpy(float))


@pytest.mark.parametrize("buffer,accuracy", [(10**6, 10_000), (50, 20), (5, 100)])
def test_exact_quantiles_narrowing(spark, buffer, accuracy):
    rng = np.random.default_rng(0)
    a = np.concatenate([rng.lognormal(0, 4, 2000), np.full(1500, 3.25), [1e300, -1e300]])
    b = rng.integers(0, 4, len(a)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b})).repartition(4)
    ps = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, {"a": ps, "b": ps}, buffer=buffer, accuracy=accuracy)
    np.testing.assert_allclose(got["a"], np.quantile(a, ps), rtol=1e-12)
    np.testing.assert_allclose(got["b"], np.quantile(b, ps), rtol=1e-12)


def test_holdout_sizes_and_completeness(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    parts = {(r["split"], r["y"]): r["count"] for r in split_holdout(df, "id", "y").groupBy("split", "y").count().collect()}
    assert sum(parts.values()) == 1000
    assert parts["test", 0] + parts["test", 1] == 150 and parts["val", 0] + parts["val", 1] == 150
    assert parts["test", 1] == 15 and parts["val", 1] == 15


def test_quota_adds_up():
    assert proportional_quota({"a": 10, "b": 10, "c": 1}, 7) == {"a": 4, "b": 3, "c": 0} or sum(
        proportional_quota({"a": 10, "b": 10, "c": 1}, 7).values()
    ) == 7


def test_kfold_is_balanced(spark):
    df = spark.range(503).withColumn("y", F.col("id") % 2)
    sizes = [r["count"] for r in split_kfold(df, "id", "y").groupBy("fold", "y").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1


def test_group_folds_do_not_overlap(spark):
    df = spark.range(2000).withColumn("g", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40)).withColumn("y", F.col("id") % 2)
    folded = split_group(df, "g", "y", 5)
    assert folded.count() == 2000
    assert check_group_folds(folded, "g").count() == 0
    with pytest.raises(ValueError):
        split_group(df, None)
