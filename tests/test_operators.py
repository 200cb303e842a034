import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from feldspark.config import ConfigError, TrainingConfig
from feldspark.functions.moments import sample_kurtosis, sample_skewness
from feldspark.functions.normal import normal_quantile
from feldspark.operators import clean, encode, features, impute, metrics, outliers, profile, resample, scale
from feldspark.operators import select as selection
from feldspark.operators import split
from feldspark.sources import tables


def frame(spark, **columns):
    pdf = pd.DataFrame(columns)
    df = spark.createDataFrame(pdf)
    return df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t == "double" else c for c, t in df.dtypes])


def test_moments_match_data_frame_libraries(spark):
    x = np.random.default_rng(0).lognormal(size=300)
    row = frame(spark, x=x).agg(sample_skewness("x").alias("s"), sample_kurtosis("x").alias("k")).first()
    assert row["s"] == pytest.approx(pd.Series(x).skew()) and row["k"] == pytest.approx(pd.Series(x).kurtosis())
    flat = frame(spark, x=[2.0] * 9).agg(sample_skewness("x").alias("s")).first()
    assert flat["s"] == 0.0


def test_missing_rules(spark):
    df = frame(spark, good=[1.0, 2, 3, 4, 5], bad=[None, None, None, None, 1.0])
    assert clean.drop_sparse_columns(df, 0.5).columns == ["good"]
    with pytest.raises(ValueError):
        clean.validate_no_missing(df)
    assert clean.validate_no_missing(df, raise_error=False) is False
    assert clean.validate_no_missing(df.select("good"))


def test_validate_input(spark):
    df = frame(spark, y=[1.0, None])
    with pytest.raises(clean.InputError):
        clean.validate_input(df, "z")
    with pytest.raises(clean.InputError):
        clean.validate_input(df, "y")


def test_sentinel_only_where_it_is_the_minimum(spark):
    rows = clean.sentinel_to_null(frame(spark, a=[-1.0, 2.0], b=[-3.0, -1.0])).collect()
    assert [tuple(r) for r in rows] == [(None, -3.0), (2.0, -1.0)]


def test_group_median_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    g = np.where(np.arange(900) % 3 == 0, "hot", rng.choice(list("abcdef"), 900))
    x = np.round(rng.normal(size=900), 2)
    got = {r[0]: r[1] for r in impute.grouped_quantile(frame(spark, g=g, x=x), "g", "x", 0.5).collect()}
    expected = pd.DataFrame({"g": g, "x": x}).groupby("g")["x"].median()
    assert got == pytest.approx(expected.to_dict())


def test_chained_imputation_beats_the_median(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=400)
    b = 3 * a + rng.normal(scale=0.1, size=400)
    holed = np.where(np.arange(400) % 4 == 0, np.nan, b)
    df = frame(spark, i=np.arange(400), a=a, b=holed)
    filled = impute.apply_chained(df, impute.fit_chained(df, ["a", "b"])).toPandas().sort_values("i")
    gap = np.abs(filled["b"].to_numpy() - b)[::4]
    assert gap.mean() < 0.2 and not filled.isna().any().any()


def test_interpolation_edges(spark):
    df = spark.createDataFrame(
        [(0, "2024-01-01 00:00:00", None), (1, "2024-01-01 01:00:00", 1.0), (2, "2024-01-01 02:00:00", None),
         (3, "2024-01-01 05:00:00", 5.0), (4, "2024-01-01 06:00:00", None)], "i int, t string, v double",
    ).withColumn("t", F.col("t").cast("timestamp"))
    got = {r["i"]: r["v"] for r in impute.fill_in_time(df, "t", "i", ["v"], method="interpolate").collect()}
    assert got == {0: None, 1: 1.0, 2: 2.0, 3: 5.0, 4: 5.0}
    got = {r["i"]: r["v"] for r in impute.fill_in_time(df, "t", "i", ["v"]).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 1.0, 3: 5.0, 4: 5.0}


def test_capping_keeps_rows_and_nulls(spark):
    df = frame(spark, x=[1.0, 2, 3, 4, 100, None])
    bounds = outliers.iqr_bounds(df, ["x"])
    rows = outliers.treat(df, bounds, "cap_and_flag").collect()
    assert len(rows) == 6 and rows[5]["x"] is None and rows[5]["x_is_outlier"] == 0
    assert rows[4]["x"] == bounds["x"][1] and rows[4]["x_is_outlier"] == 1
    assert outliers.treat(df, bounds, "remove").count() == 5


def test_hash_encoding_is_the_md5_residue(spark):
    values = [f"v{i}" for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for n in (8, 16, 24, 32):
        got = [r[0] for r in df.select(encode.hash_bucket(F.col("v"), n)).collect()]
        assert got == [int(hashlib.md5(v.encode()).hexdigest(), 16) % n for v in values]


def test_rare_levels_and_unseen_values(spark):
    train = spark.createDataFrame([("a",)] * 50 + [("b",)] * 40 + [(c,) for c in "cdefg"], "x string")
    kept = encode.fit_rare(train, ["x"])
    assert kept == {"x": ["a", "b", "c", "d", "e", "f", "g"][:2]}
    new = spark.createDataFrame([("a",), ("zzz",), (None,)], "x string")
    assert [r[0] for r in encode.apply_rare(new, kept).collect()] == ["a", "Rare", None]


def test_onehot_binary_and_unknown(spark):
    train = spark.createDataFrame([("a", "p"), ("b", "q"), ("b", "r")], "x string, y string")
    plan = encode.fit_onehot(train, ["x", "y"])
    new = encode.apply_onehot(spark.createDataFrame([("b", "zzz")], "x string, y string"), plan)
    assert new.columns == ["x_b", "y_p", "y_q", "y_r"] and tuple(new.first()) == (1.0, 0.0, 0.0, 0.0)


def test_target_encoding_formula(spark):
    train = spark.createDataFrame([("a", 1)] * 12 + [("b", 0)] * 8, "e string, y int")
    new = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "x string").withColumn("e", F.col("x"))
    got = {r["x"]: r["e"] for r in encode.encode_target(train, new, ["e"], "y").collect()}
    w = lambda n: 1 / (1 + math.exp(-(n - 10) / 5))
    assert got["a"] == pytest.approx(w(12) + (1 - w(12)) * 0.6) and got["b"] == pytest.approx((1 - w(8)) * 0.6)
    assert got["c"] == got[None] == pytest.approx(0.6)


def test_power_search_finds_the_likelihood_peak(spark):
    x = np.random.default_rng(4).lognormal(0.5, 0.8, 800)
    df = frame(spark, x=x)

    def likelihood(p, boxcox):
        t = (x**p - 1) / p if boxcox else ((x + 1) ** p - 1) / p
        return -len(x) / 2 * np.log(t.var()) + (p - 1) * (np.log(x) if boxcox else np.log1p(x)).sum()

    for method, boxcox in (("boxcox", True), ("yeojohnson", False)):
        p = scale.fit_powers(df, ["x"], method)["x"]
        grid = np.linspace(p - 0.5, p + 0.5, 1000)
        best = grid[np.argmax([likelihood(g, boxcox) for g in grid])]
        assert p == pytest.approx(best, abs=2e-3)


def test_boxcox_falls_back(spark):
    assert scale.fit_transform(frame(spark, x=[0.0, 1.0, 5.0]), ["x"], "boxcox")["method"] == "yeojohnson"


def test_quantile_transform_is_normal(spark):
    df = frame(spark, x=np.random.default_rng(5).exponential(size=2000))
    out = scale.apply_transform(df, scale.fit_transform(df, ["x"], "quantile")).toPandas()["x"]
    assert abs(out.mean()) < 0.02 and out.std() == pytest.approx(1, abs=0.05)


def test_normal_quantile():
    from statistics import NormalDist

    p = np.array([1e-7, 0.01, 0.3, 0.5, 0.77, 0.999, 1 - 1e-7])
    np.testing.assert_allclose(normal_quantile(p), [NormalDist().inv_cdf(v) for v in p], atol=1e-9)


def test_constant_columns_scale_to_zero(spark):
    df = frame(spark, x=[3.0, 3.0])
    for kind in ("standard", "minmax", "robust"):
        assert [r[0] for r in scale.apply_scaler(df, scale.fit_scaler(df, ["x"], kind)).collect()] == [0.0, 0.0]


def test_bins_clip_and_merge(spark):
    edges = features.fit_bins(frame(spark, x=[0.0] * 6 + [1.0, 2.0, 3.0, 4.0]), ["x"])
    assert edges["x"][0] == 0.0 and len(edges["x"]) < 6
    got = [r[0] for r in features.apply_bins(frame(spark, x=[-9.0, 99.0]), edges).select("x_bin").collect()]
    assert got == [0, len(edges["x"]) - 2]


def test_text_and_date_features(spark):
    df = spark.createDataFrame([("Ab 1 2  ٣!", "2024-02-29 10:30:00"), (None, "rubbish")], "t string, d string")
    one, two = features.date_features(features.text_features(df, ["t"]), ["d"], since={"d": "2024-01-01"}).collect()
    assert (one["t_length"], one["t_word_count"], one["t_n_digits"], one["t_n_special"], one["t_n_upper"]) == (10, 4, 3, 2, 1)
    assert two["t_length"] == 3 and two["d_year"] is None and two["d_is_weekend"] == 0
    assert (one["d_weekday"], one["d_is_monthend"], one["d_days_since_ref"]) == (3, 1, 59)


def test_rfm_by_hand(spark):
    df = spark.createDataFrame([("a", "2024-01-01", 10.0), ("a", "2024-01-05", 5.0), ("b", "2024-01-03", None)], "c string, d string, m double")
    df = df.withColumn("d", F.col("d").cast("timestamp"))
    got = {r["c"]: (r["recency"], r["frequency"], r["monetary"]) for r in features.rfm(df, "c", "d", "m").collect()}
    assert got == {"a": (1, 2, 15.0), "b": (3, 1, 0.0)}


def test_thresholds(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, p double")
    assert metrics.best_threshold(df, "y", "p", "f1").first()["threshold"] == 0.35
    none = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double")
    assert tuple(metrics.best_threshold(none, "y", "p", "precision").first())[1:] == (0.5, 0.0)


def test_auc_with_ties(spark):
    rng = np.random.default_rng(6)
    y, p = rng.integers(0, 2, 400), np.round(rng.random(400), 1)
    pos, neg = p[y == 1], p[y == 0]
    expected = ((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2)
    assert metrics.roc_auc(frame(spark, y=y, p=p), "y", "p") == pytest.approx(expected)


def test_kendall_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 6, 150), rng.integers(0, 5, 150)
    s = np.sign(a[:, None] - a) * np.sign(b[:, None] - b)
    n0 = 150 * 149 / 2
    ties = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
    expected = (s.sum() / 2) / np.sqrt((n0 - ties(a)) * (n0 - ties(b)))
    assert profile.kendall_tau(frame(spark, a=a, b=b), "a", "b") == pytest.approx(expected)


@pytest.mark.parametrize("local_rows", [7, 50, 10_000])
def test_kendall_counts_in_ranges(spark, local_rows):
    rng = np.random.default_rng(17)
    a, b = rng.integers(0, 40, 300), rng.integers(0, 12, 300)
    a[:120], b[60:150] = 5, 3  # hot values, also a hot pair
    s = np.sign(a[:, None] - a) * np.sign(b[:, None] - b)
    found = profile.kendall_counts(frame(spark, a=a, b=b).repartition(4), "a", "b", local_rows)
    assert (found.concordant, found.discordant) == ((s > 0).sum() // 2, (s < 0).sum() // 2)
    assert found.pairs == found.concordant + found.discordant + found.tied_a + found.tied_b - sum(
        c * (c - 1) // 2 for c in np.unique(np.stack((a, b)), axis=1, return_counts=True)[1]
    )


def test_kendall_of_texts_nulls_and_constants(spark):
    rows = [("a", 1.0), ("b", 2.0), ("é", 3.0), (None, 9.0), ("z", None), ("b", 0.5)]
    df = spark.createDataFrame(rows, "a string, b double")
    found = profile.kendall_counts(df, "a", "b", 2)
    assert (found.pairs, found.concordant, found.discordant, found.tied_a, found.tied_b) == (6, 4, 1, 1, 0)
    assert np.isnan(profile.kendall_tau(df.where("a = 'b'"), "a", "b")) and np.isnan(profile.kendall_tau(df.limit(0), "a", "b"))


def test_correlation_rule_keeps_the_better_feature(spark):
    rng = np.random.default_rng(8)
    y = rng.normal(size=300)
    a = y + rng.normal(scale=0.5, size=300)
    df = frame(spark, y=y, worse=a + rng.normal(scale=0.02, size=300), better=a, other=rng.normal(size=300))
    dropped = selection.correlation_drops(df, ["worse", "better", "other"], "y")
    assert len(dropped) == 1 and dropped[0] in ("worse", "better")


def test_leakage_is_reported(spark):
    df = spark.range(200).withColumn("x", F.col("id") % 7).withColumn("z", F.when(F.col("id") % 2 == 0, F.col("id")))
    train, test = df.where("id < 150"), df.where("id >= 150")
    assert split.check_leakage(train, test, "id", ["id"])["leakage"] is False
    found = split.check_leakage(train, test.unionByName(train.limit(3)), "id", ["x", "z"])
    assert found["shared_ids"] == 3 and found["leakage"] and found["duplicate_pairs"] > 3


def test_sampling_errors_and_sizes(spark):
    df = spark.range(100)
    with pytest.raises(ValueError):
        tables.sample_fraction(df, 0.0, "id")
    assert tables.sample_fraction(df, 0.25, "id").count() == 25
    assert tables.sample_n(df, 1000, "id").count() == 100
    with pytest.raises(ValueError):
        tables.load(spark, "/nowhere/file.xyz")


def test_resampling_targets(spark):
    df = spark.range(110).withColumn("y", (F.col("id") < 10).cast("int"))
    assert resample.positive_weight(df, "y") == 10.0
    assert resample.class_weights(df, "y") == {0: 0.55, 1: 5.5}
    counts = {r[0]: r[1] for r in resample.oversample(df, "id", "y", 0.5).groupBy("y").count().collect()}
    assert counts == {0: 100, 1: 50}
    with pytest.raises(ValueError):
        resample.positive_weight(df.where("y = 0"), "y")


def test_config_is_checked():
    assert TrainingConfig.from_dict({"data": {"target": "t"}}).data.target == "t"
    for bad in (
        {"modeling": {"task": "ranking"}}, {"scaling": {"scaler": "huge"}}, {"data": {"test_size": 2}}, {"nonsense": {}},
        {"outliers": {"method": "guess"}}, {"data": {"test_size": 0.6, "val_size": 0.5}},
    ):
        with pytest.raises(ConfigError):
            TrainingConfig.from_dict(bad)


def test_empty_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, None, "k"), (1.0, None, "k")], "a double, n double, t string")
    assert outliers.iqr_bounds(df, ["n"]) == {}
    for kind in ("standard", "minmax", "robust", "maxabs"):
        assert list(scale.fit_scaler(df, ["a", "n"], kind)) == ["a"]
    assert profile.boxplots(df, ["a", "n"]).count() == 1
    assert profile.cramers_v(df.withColumn("u", F.lit("x")), "t", "u") == 0.0
    assert [r["n"] for r in profile.histograms(df, ["a"]).collect()] == [2]
    assert features.apply_bins(df, features.fit_bins(df, ["n"])).select("n_bin").first()[0] is None
    assert impute.fill(df, impute.numeric_fills(df, ["n"])).where("n is null").count() == 2
