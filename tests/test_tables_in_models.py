"""Learned tables of saved stages, and mappings of any number of levels."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from feldspark.config import TrainingConfig
from feldspark.operators import encode
from feldspark.operators.stages import TableStage
from feldspark.training import train


@pytest.mark.parametrize("broadcast_levels", [0, 100])
@pytest.mark.parametrize("counted", [True, False])
def test_mapping_joins(spark, broadcast_levels, counted):
    """Hot, rare, unseen and missing values, in one join and in two; a caller's columns keep their names."""
    values = ["hot"] * 400 + [f"v{i}" for i in range(300)] + [None] * 50 + ["unseen"] * 50
    rows = spark.createDataFrame([(i, v, i % 7) for i, v in enumerate(values)], "id int, level string, rows int").repartition(3)
    table = encode.frequency_table(rows.where("level <> 'unseen' or level is null"), "level")
    table = table if counted else table.drop("rows")
    got = encode.apply_table(rows, table, "level", -1.0, -2.0, broadcast_levels)
    assert got.columns == rows.columns and got.count() == len(values)
    expected = {"hot": 400 / 700, None: -2.0, "unseen": -1.0}
    assert all(r["level"] == pytest.approx(expected.get(values[r["id"]], 1 / 700)) and r["rows"] == r["id"] % 7 for r in got.collect())


def test_a_saved_stage_needs_only_its_folder(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, f"k{i % 1500}", float(rng.normal()) if i % 4 else None, float(rng.normal()), int(i % 5 == 0)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, k string, x double, z double, y int")
    stages = [
        TableStage("impute", keep=["id", "y"], numeric="knn", row_id="id", indicators=False),
        TableStage("engineer", groups=[{"group": "k", "column": "x"}, {"group": "k", "column": "z", "functions": ["max"]}]),
        TableStage("encode", keep=["id", "y"], target="y", group_rare=False),
    ]
    fitted, held = [], df.where("id < 3000")
    for stage in stages:
        fitted.append(stage.fit(held))
        held = fitted[-1].transform(held)
    model = PipelineModel(stages=fitted)
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert [sorted(s.tables) for s in again.stages] == [["donors"], ["group k"], ["levels k"]]
    assert again.stages[2].tables["levels k"].count() == 1500
    assert [f for f in again.stages[0].tables["donors"].inputFiles() if str(tmp_path) not in f] == []
    new = df.where("id >= 2990").withColumn("k", F.when(F.col("id") % 9 == 0, "never").when(F.col("id") % 9 > 1, F.col("k")))
    left, right = (sorted(map(tuple, m.transform(new).collect())) for m in (model, again))
    assert left == right and len(left) == 1010
    out = again.transform(new).where("id % 9 = 0").select("x_by_k_mean", "x_by_k_std", "z_by_k_max").distinct().collect()
    assert [tuple(r) for r in out] == [(None, None, None)]


def test_training_with_many_levels_and_groups(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 1200 % 5 == 0), f"c{i % 1200}", float(rng.normal()), "ab"[i % 2]) for i in range(2400)]
    df = spark.createDataFrame(rows, "id long, y int, code string, a double, t string")
    config = TrainingConfig.from_dict(
        {
            "data": {"target": "y", "row_id": "id"},
            "engineering": {"groups": [{"group": "t", "column": "a", "functions": ["mean", "max"]}]},
            "encoding": {"override": {"code": "target"}},
            "modeling": {"models": ["logistic_regression"], "resampling": "none"},
        }
    )
    result = train(df, config)
    result.model.write().save(str(tmp_path / "m"))
    out = PipelineModel.load(str(tmp_path / "m")).transform(df.limit(50))
    assert out.count() == 50 and "a_by_t_mean" in result.preprocessing.stages[2].transform(df).columns


@pytest.mark.parametrize("broadcast_levels", [0, 100_000])
def test_equal_columns_share_one_table(spark, monkeypatch, broadcast_levels):
    """Copies of a column in training share a table; where they differ in the rows to encode, each has its own value."""
    monkeypatch.setattr(encode, "BROADCAST_LEVELS", broadcast_levels)
    levels = [None if i % 11 == 0 else f"v{i % 60}" for i in range(400)]
    df = spark.createDataFrame([(i, k, i % 7, float(i % 3 == 0)) for i, k in enumerate(levels)], "id int, k string, other int, y double").repartition(4)
    kinds = ["ordinal", "target", "woe", "count"]
    train = df.select("id", "y", *[F.col("k").alias(f"k_{m}") for m in kinds], F.col("other").cast("string").alias("o_count"), F.col("k").alias("shown"))
    settings = {"target": "y", "group_rare": False}
    override = {**{f"k_{m}": m for m in kinds}, "o_count": "count", "shown": "onehot"}
    model = TableStage("encode", columns=list(override), override=override, **settings).fit(train)
    assert sorted(model.tables) == ["levels k_ordinal", "levels o_count", "pooled shown"]
    changed = train.withColumn("k_woe", F.when(F.col("id") % 5 == 0, "v1").when(F.col("id") % 5 == 1, None).otherwise(F.col("k_woe")))
    alone = {c: TableStage("encode", columns=[c], override={c: override[c]}, **settings).fit(train) for c in ("k_woe", "k_target", "shown")}
    for rows in (train, changed):
        made = model.transform(rows)
        got = {r["id"]: r.asDict() for r in made.collect()}
        assert len(got) == 400
        for c, stage in alone.items():
            expected = stage.transform(rows.select("id", c))
            assert [x for x in made.columns if x in expected.columns] == expected.columns
            assert all(got[r["id"]][x] == pytest.approx(r[x]) for r in expected.collect() for x in expected.columns)
