import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from feldspark.config import TrainingConfig
from feldspark.operators import explain as X
from feldspark.operators import models as M
from feldspark.operators.stages import TableStage
from feldspark.plans.scoring_queries import url_model
from feldspark.sources.registry import ModelRegistry
from feldspark.sources.tables import scratch_folder
from feldspark.streaming.scoring import score_urls, stream_scores
from feldspark.training import prepare_only, train

FEATURES = [f"f{i}" for i in range(5)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=600) > 0.8).astype(float)
    pdf = pd.DataFrame(x, columns=FEATURES).assign(id=np.arange(600), y=y, kind=np.where(x[:, 0] > 0, "p", "q"))
    return spark.createDataFrame(pdf).persist()


def _additive(spark, data, estimator, margin):
    model = estimator.fit(data)
    explained, base = X.tree_contributions(data, model.stages[-1], FEATURES)
    both = model.transform(explained).select(margin.alias("m"), "contributions").toPandas()
    total = base + np.stack(both["contributions"]).sum(1)
    np.testing.assert_allclose(total, both["m"], atol=1e-8)


def test_forest_contributions_add_up(spark, data):
    _additive(spark, data, M.random_forest(FEATURES, "y", trees=8, depth=9), vector_to_array("probability")[1])


def test_boosting_contributions_add_up(spark, data):
    # boosting's margin is its raw score of class 1
    _additive(spark, data, M.boosting(FEATURES, "y", rounds=6, depth=4, rate=0.2), vector_to_array("rawPrediction")[1])


def test_tree_contributions_match_all_coalitions(spark, data):
    from itertools import combinations
    from math import factorial

    model = M.decision_tree(FEATURES, "y", depth=3, min_leaf=5).fit(data).stages[-1]
    leaves, base = X.leaves_of(spark, model)
    row = data.orderBy("id").first()
    x = np.array([row[f] for f in FEATURES])

    def value(coalition):
        total = 0.0
        for leaf, used, tests, cover in leaves:
            part = leaf
            for f, t, c in zip(used, tests, cover):
                part *= float(X._passes(x[f : f + 1], t)[0]) if f in coalition else c
            total += part
        return total

    expected = []
    for i in range(5):
        rest = [j for j in range(5) if j != i]
        expected.append(sum(
            factorial(s) * factorial(4 - s) / factorial(5) * (value({*g, i}) - value(set(g))) for s in range(5) for g in combinations(rest, s)
        ))
    got = X.tree_contributions(data.where(F.col("id") == row["id"]), model, FEATURES)[0].first()["contributions"]
    np.testing.assert_allclose(got, expected, atol=1e-9)
    assert base == pytest.approx(value(set()))


def test_sampled_contributions_add_up_for_one_background_row(spark, data):
    model = M.logistic_regression(FEATURES, "y", 600).fit(data)
    background = data.where("id = 0")
    rows = data.where("id between 1 and 20")
    made = X.sampled_contributions(rows, background, model, "id", FEATURES, permutations=3)
    p = {r["id"]: r["p"] for r in model.transform(data).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    for r in made.collect():
        assert sum(r["contributions"]) == pytest.approx(p[r["id"]] - p[0], abs=1e-9)


def test_probabilities_and_scores(spark, data):
    model = M.logistic_regression(FEATURES, "y", 600).fit(data)
    out = M.scored(model, data, ["id"]).toPandas()
    np.testing.assert_allclose(out["prob_negative"] + out["prob_positive"], 1)
    scores = M.cross_validate(M.decision_tree(FEATURES, "y", 4), data, "id", "y", 3)
    assert len(scores) == 3 and all(0 <= s <= 1 for s in scores)


def test_failing_trials_are_skipped(spark, data):
    space = {"trees": ("int", 1, 2), "depth": ("int", 29, 33)}
    best, table = M.search(lambda **s: M.random_forest(FEATURES, "y", **s), space, data, "id", "y", trials=4, k=2, seed=3)
    states = [r["state"] for r in table.collect()]
    assert len(states) == 4
    assert (best is None) == all(s != "done" for s in states)


def test_stages_learn_on_train_and_survive_saving(spark, data):
    from pyspark.ml import PipelineModel

    keep = ["id", "y"]
    holed = data.withColumn("f3", F.when(F.col("id") % 6 == 0, None).otherwise(F.exp("f3")))
    rows, new = holed.where("id < 400"), holed.where("id >= 400")
    stages = [
        TableStage("impute", keep=keep), TableStage("outliers", keep=keep), TableStage("encode", keep=keep, target="y"),
        TableStage("scale", keep=keep, scaler="standard"), TableStage("select", keep=keep, target="y", share=1.0),
    ]
    prepared = prepare_only(rows, stages)
    out = prepared.transform(new)
    assert out.columns == prepared.transform(rows).columns
    assert all(out.where(F.col(c).isNull()).count() == 0 for c in out.columns)
    strange = new.withColumn("kind", F.lit("never seen"))
    assert prepared.transform(strange).count() == new.count()
    folder = scratch_folder(spark, "stages")
    prepared.write().overwrite().save(folder)
    again = PipelineModel.load(folder).transform(new)
    pd.testing.assert_frame_equal(again.orderBy("id").toPandas(), out.orderBy("id").toPandas())


def test_training_end_to_end(spark, data):
    config = TrainingConfig.from_dict({
        "data": {"target": "y", "row_id": "id"},
        "selection": {"share": 1.0},
        "modeling": {"models": ["logistic_regression", "random_forest"], "settings": {"random_forest": {"trees": 10, "depth": 5}}},
    })
    result = train(data, config)
    assert result.test_metrics["roc_auc"] > 0.7 > result.baseline["roc_auc"]
    assert result.leakage["leakage"] is False
    assert result.model.transform(data).count() == 600
    regression = TrainingConfig.from_dict({
        "data": {"target": "f0", "row_id": "id", "drop_columns": ["y"]},
        "selection": {"share": 1.0},
        "outliers": {"method": "isolation_forest", "treatment": "remove"},
        "modeling": {"task": "regression", "metric": "r2", "models": ["linear_regression"], "resampling": "none"},
    })
    assert set(train(data, regression).test_metrics) == {"mae", "rmse", "r2"}


def test_registry_picks(spark, data):
    registry = ModelRegistry(spark, scratch_folder(spark, "registry"))
    model = M.decision_tree(FEATURES, "y", 3).fit(data)
    first = registry.save(model, "tree", {"roc_auc": 0.7}, {"depth": 3}, FEATURES, champion=True)
    second = registry.save(model, "tree", {"roc_auc": 0.6}, {"depth": 3}, FEATURES)
    assert [r["version"] for r in registry.versions().collect()] == [second, first]
    assert registry.metadata(champion=True)["version"] == first
    assert registry.metadata()["version"] == second
    assert registry.load("tree", first).transform(data).count() == 600
    with pytest.raises(LookupError):
        registry.metadata("nothing")


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    model = url_model(spark, sf)
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed = stream_scores(spark, stream, model, str(tmp_path / "out"), str(tmp_path / "state")).drop("batch")
    batch = score_urls(pages, model)
    a = streamed.select("page_id", "probability", "label").orderBy("page_id").toPandas()
    b = batch.select("page_id", "probability", "label").orderBy("page_id").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_neighbour_imputation_and_shap_selection_stages(spark, data):
    keep = ["id", "y"]
    holed = data.drop("kind").withColumn("f3", F.when(F.col("id") % 6 == 0, None).otherwise(F.col("f3"))).withColumn(
        "f4", F.when(F.col("id") % 7 == 0, None).otherwise(F.col("f4"))
    )
    rows, new = holed.where("id < 400"), holed.where("id >= 400")
    stages = [
        TableStage("impute", keep=keep, numeric="knn", row_id="id", indicators=False),
        TableStage("select", keep=keep, target="y", method="shap", trees=10, share=0.6, row_id="id"),
    ]
    prepared = prepare_only(rows, stages)
    out = prepared.transform(new)
    assert "f0" in out.columns and len(out.columns) == 5
    assert out.count() == 200 and all(out.where(F.col(c).isNull()).count() == 0 for c in out.columns)
