"""End-to-end training on tables of one kind of column, and options that used to be ignored."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from feldspark.config import ConfigError, TrainingConfig
from feldspark.operators.encode import apply_rare, fit_rare, level_counts
from feldspark.operators.profile import top_categories
from feldspark.operators.scale import quantile_grids
from feldspark.operators.split import ks_statistics
from feldspark.sources.tables import read_feather, write_feather
from feldspark.training import train


def rows(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0.8).astype(int)
    values = [(i, int(y[i]), *map(float, x[i]), "ab"[int(x[i, 1] > 0)]) for i in range(n)]
    return spark.createDataFrame(values, "id long, y int, a double, b double, c double, t string")


def settings(**changes):
    modeling = {"models": ["logistic_regression", "boosting"], "resampling": "none", "settings": {"boosting": {"rounds": 5, "depth": 3}}}
    modeling.update(changes.pop("modeling", {}))
    return TrainingConfig.from_dict({"data": {"target": "y", "row_id": "id"}, "modeling": modeling, **changes})


def check(result, new):
    out = result.model.transform(new).select("id", vector_to_array("probability")[1].alias("p")).toPandas()
    assert len(out) == new.count() and out["p"].between(0, 1).all()
    return out


def test_numeric_table(spark):
    result = train(rows(spark).drop("t"), settings())
    check(result, rows(spark, 50, 2).drop("t"))
    assert result.test_metrics["roc_auc"] > 0.8


def test_text_table(spark):
    text = rows(spark).select("id", "y", "t", F.when(F.col("a") > 0.8, "hi").otherwise("lo").alias("u"))
    check(train(text, settings()), text.limit(40))


def test_flagged_outliers_are_no_feature(spark):
    table = rows(spark).drop("t")
    result = train(table, settings(outliers={"method": "isolation_forest", "treatment": "flag"}))
    assert "is_outlier_multivariate" not in result.features
    check(result, rows(spark, 30, 3).drop("t"))


def test_class_weights_reach_the_models(spark):
    table = rows(spark).drop("t")
    plain = check(train(table, settings(modeling={"models": ["logistic_regression"]})), table)
    weighted = check(train(table, settings(modeling={"models": ["logistic_regression"], "resampling": "class_weight"})), table)
    assert weighted["p"].mean() > plain["p"].mean() + 0.05


def test_unknown_resampling_is_refused():
    with pytest.raises(ConfigError):
        settings(modeling={"resampling": "nearmiss"})


def test_helpers_without_columns(spark):
    table = rows(spark, 10)
    assert level_counts(table, []).count() == 0
    assert fit_rare(table, []) == {} and apply_rare(table, {}).columns == table.columns
    assert top_categories(table, []).count() == 0
    assert ks_statistics(table.select("t"), table.select("t")).count() == 0


@pytest.mark.parametrize("n", [1, 7, 900])
def test_quantile_grid_is_exact_at_any_size(spark, n):
    values = np.random.default_rng(n).integers(0, 50, n).astype(float)
    table = spark.createDataFrame([(float(v),) for v in values], "x double")
    shares = [0.0, 0.1, 0.5, 0.99, 1.0]
    assert quantile_grids(table, ["x"], shares)["x"] == pytest.approx(np.quantile(values, shares))


def test_feather_replaces_what_was_there(spark, tmp_path):
    folder = str(tmp_path / "f")
    write_feather(spark.range(100).repartition(5), folder)
    write_feather(spark.range(10).coalesce(1), folder)
    assert read_feather(spark, folder, "id bigint").count() == 10
