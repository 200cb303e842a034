"""Models, cross-validation, search and ensembles over MLlib."""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roles import dbl
from ..session import small_table
from .split import split_kfold

LARGER_IS_BETTER = {"roc_auc": True, "f1": True, "accuracy": True, "r2": True, "rmse": False, "mae": False}

# Boosting presets, as far as MLlib has the setting (63 leaves are a depth of 6). Rounds are an upper limit, training stops when validation stops improving.
BOOSTING_PRESETS = {
    "xgboost": {"rounds": 2000, "rate": 0.05, "depth": 6, "subsample": 0.8, "share": "0.8", "min_leaf": 5, "min_gain": 0.0},
    "lightgbm": {"rounds": 2000, "rate": 0.05, "depth": 6, "subsample": 0.8, "share": "0.8", "min_leaf": 20, "min_gain": 0.0},
    "catboost": {"rounds": 2000, "rate": 0.05, "depth": 6, "subsample": 1.0, "share": "all", "min_leaf": 1, "min_gain": 0.0},
}


def with_vector(stage, features: Sequence[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), stage])


def logistic_regression(features, label: str, n_rows: int, c: float = 1.0, l1: bool = False, weight: str | None = None) -> Pipeline:
    """L2 (or L1) penalty of strength 1/(C n), which matches an inverse penalty C on summed losses."""
    model = C.LogisticRegression(
        labelCol=label, regParam=1.0 / (c * n_rows), elasticNetParam=1.0 if l1 else 0.0, maxIter=1000, standardization=False
    )
    return with_vector(model.setWeightCol(weight) if weight else model, features)


def linear_regression(features, label: str) -> Pipeline:
    return with_vector(R.LinearRegression(labelCol=label, solver="normal"), features)


def decision_tree(features, label: str, depth: int = 5, min_leaf: int = 20, min_gain: float = 0.0, weight: str | None = None, seed: int = 42):
    model = C.DecisionTreeClassifier(labelCol=label, maxDepth=depth, minInstancesPerNode=min_leaf, minInfoGain=min_gain, seed=seed)
    return with_vector(model.setWeightCol(weight) if weight else model, features)


def random_forest(
    features, label: str, task: str = "classification", trees: int = 200, depth: int = 10, min_leaf: int = 2,
    weight: str | None = None, seed: int = 42,
):
    if task == "classification":
        model = C.RandomForestClassifier(
            labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", seed=seed
        )
    else:
        model = R.RandomForestRegressor(
            labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, featureSubsetStrategy="onethird", seed=seed
        )
    return with_vector(model.setWeightCol(weight) if weight else model, features)


def boosting(
    features,
    label: str,
    task: str = "classification",
    preset: str = "lightgbm",
    validation: str | None = None,
    weight: str | None = None,
    seed: int = 42,
    **changes,
):
    """Gradient boosting; ``validation`` names a boolean column of rows used for early stopping."""
    p = {**BOOSTING_PRESETS[preset], **changes}
    kind = C.GBTClassifier if task == "classification" else R.GBTRegressor
    model = kind(
        labelCol=label, maxIter=p["rounds"], stepSize=p["rate"], maxDepth=p["depth"], subsamplingRate=p["subsample"],
        featureSubsetStrategy=p["share"], minInstancesPerNode=p["min_leaf"], minInfoGain=p["min_gain"], seed=seed,
    )
    if validation:
        model = model.setValidationIndicatorCol(validation)
    if weight:
        model = model.setWeightCol(weight)
    return with_vector(model, features)


def perceptron(features, label: str, classes: int = 2, hidden: Sequence[int] = (100,), iterations: int = 200, seed: int = 42):
    model = C.MultilayerPerceptronClassifier(labelCol=label, layers=[len(features), *hidden, classes], maxIter=iterations, seed=seed)
    return with_vector(model, features)


def probability_column(model_output: DataFrame) -> Column:
    return vector_to_array("probability")[1]


def scored(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Kept columns plus ``prediction`` and, for classifiers, ``prob_negative``/``prob_positive`` or ``prob_class_i``."""
    out = model.transform(df)
    if "probability" not in out.columns:
        return out.select(*keep, "prediction")
    n = model.stages[-1].numClasses
    p = vector_to_array("probability")
    names = ["prob_negative", "prob_positive"] if n == 2 else [f"prob_class_{i}" for i in range(n)]
    return out.select(*keep, "prediction", *[p[i].alias(name) for i, name in enumerate(names)])


def evaluator(metric: str, label: str):
    if metric == "roc_auc":
        return BinaryClassificationEvaluator(labelCol=label, numBins=0)  # no binning of the scores
    if metric in ("f1", "accuracy"):
        return MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    return RegressionEvaluator(labelCol=label, metricName=metric)


def cross_validate(
    estimator, df: DataFrame, id_column: str, label: str, k: int = 5, metric: str = "roc_auc", stratified: bool = True,
    parallelism: int = 4, seed: int = 42,
) -> list[float]:
    """Score of each fold. Folds come from hash-rank intervals; fits run side by side."""
    folded = split_kfold(df, id_column, label if stratified else None, k, seed, "__fold").persist()
    try:
        return fold_scores(estimator, folded, label, k, metric, parallelism)
    finally:
        folded.unpersist()


def fold_scores(estimator, folded: DataFrame, label: str, k: int, metric: str, parallelism: int, stop: Callable[[], bool] = lambda: False) -> list[float]:
    """Score of each fold of rows that have theirs in ``__fold``; no fold starts once ``stop`` holds."""
    judge = evaluator(metric, label)

    def one(fold: int) -> float:
        if stop():
            raise TimeoutError
        model = estimator.fit(folded.where(F.col("__fold") != fold))
        return float(judge.evaluate(model.transform(folded.where(F.col("__fold") == fold))))

    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(folded.sparkSession)(one), range(k))


def mean_std(values: Sequence[float]) -> tuple[float, float]:
    mean = sum(values) / len(values)
    return mean, (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5


def cv_table(spark, scores: Sequence[float], validation: float | None = None) -> DataFrame:
    """Fold scores, mean, spread and (if given) whether validation is off by more than 0.05."""
    mean, spread = mean_std(scores)
    rows = [(f"fold_{i}", float(s)) for i, s in enumerate(scores)] + [("mean", mean), ("std", spread)]
    if validation is not None:
        rows += [("validation", float(validation)), ("gap_flag", float(abs(mean - validation) > 0.05))]
    return small_table(spark, rows, "name string, value double")


def better(metric: str, a: float, b: float) -> bool:
    return a > b if LARGER_IS_BETTER[metric] else a < b


# Search ranges by model family, as (kind, low, high).
SEARCH_SPACES = {
    "logistic_regression": {"c": ("log", 1e-3, 1e2)},
    "decision_tree": {"depth": ("int", 2, 10), "min_gain": ("real", 0.0, 0.05), "min_leaf": ("int", 5, 50)},
    "random_forest": {"trees": ("int", 100, 800), "depth": ("int", 3, 20), "min_leaf": ("int", 1, 20)},
    "boosting": {"rate": ("log", 0.01, 0.3), "depth": ("int", 3, 10), "subsample": ("real", 0.5, 1.0)},
}


def draw_settings(space: Mapping[str, tuple], trials: int, seed: int = 42) -> list[dict]:
    random_source = random.Random(seed)
    drawn = []
    for _ in range(trials):
        settings = {}
        for name, (kind, low, high) in space.items():
            if kind == "int":
                settings[name] = random_source.randint(low, high)
            elif kind == "log":
                settings[name] = low * (high / low) ** random_source.random()
            else:
                settings[name] = low + (high - low) * random_source.random()
        drawn.append(settings)
    return drawn


def search(
    build: Callable[..., Pipeline], space: Mapping[str, tuple], df: DataFrame, id_column: str, label: str,
    trials: int = 20, seconds: float = 3600, k: int = 5, metric: str = "roc_auc", seed: int = 42, parallelism: int = 4, side_by_side: int = 2,
) -> tuple[dict | None, DataFrame]:
    """Random search by cross-validated score: best settings and the table of trials.

    All trials share one table of folds, and ``side_by_side`` of them run at a time. A failing trial is recorded and skipped. At the time
    limit running trials are cancelled and no other starts; these are recorded as out of time. Of equal scores the earlier trial wins.
    """
    context, group, over = df.sparkSession.sparkContext, f"search-{uuid.uuid4().hex}", threading.Event()
    deadline = time.monotonic() + seconds
    late = lambda: time.monotonic() >= deadline
    folded = split_kfold(df, id_column, label, k, seed, "__fold").persist()

    def watch() -> None:
        over.wait(max(0.0, deadline - time.monotonic()))
        # A fit is many jobs, so one may begin between two cancellations.
        while not over.wait(0.2):
            context.cancelJobGroup(group)

    def one(trial: tuple[int, dict]) -> tuple:
        number, settings = trial
        if late():
            return number, settings, None, None, "out of time"
        context.setJobGroup(group, f"trial {number}", True)
        try:
            value, spread = mean_std(fold_scores(build(**settings), folded, label, k, metric, parallelism, late))
            return number, settings, value, spread, "done"
        except Exception as error:  # a bad setting must not end the search
            return number, settings, None, None, "out of time" if late() else f"failed: {type(error).__name__}"

    folded.count()
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        with ThreadPool(side_by_side) as pool:
            found = pool.map(inheritable_thread_target(df.sparkSession)(one), list(enumerate(draw_settings(space, trials, seed))), chunksize=1)
    finally:
        over.set()
        watcher.join()
        folded.unpersist()
    best = None
    for _, settings, value, _, state in found:
        if state == "done" and (best is None or better(metric, value, best[0])):
            best = (value, settings)
    rows = [(number, str(settings), *rest) for number, settings, *rest in found]
    table = small_table(df.sparkSession, rows, "trial int, settings string, score double, std double, state string")
    return (best[1] if best else None), table


def vote(outputs: Sequence[DataFrame], id_column: str, how: str = "soft", threshold: float = 0.5) -> DataFrame:
    """Join model outputs (id, p) and combine: mean probability, or majority (ties: class 0)."""
    joined = None
    for i, out in enumerate(outputs):
        named = out.select(id_column, F.col(out.columns[1]).alias(f"__p{i}"))
        joined = named if joined is None else joined.join(named, id_column)
    names = [F.col(f"__p{i}") for i in range(len(outputs))]
    mean = sum(names[1:], names[0]) / F.lit(float(len(names)))
    if how == "soft":
        return joined.select(id_column, mean.alias("probability"), (mean >= threshold).cast("int").alias("prediction"))
    votes = sum(((n >= threshold).cast("int") for n in names), F.lit(0))
    return joined.select(id_column, mean.alias("probability"), (votes * 2 > len(names)).cast("int").alias("prediction"))


def stack(
    bases: Mapping[str, Pipeline], meta: Callable[[Sequence[str]], Pipeline], train: DataFrame, test: DataFrame, id_column: str,
    label: str, features: Sequence[str], k: int = 5, passthrough: bool = False, seed: int = 42,
) -> tuple[DataFrame, PipelineModel]:
    """Meta-model on out-of-fold base probabilities; test rows are scored by bases refitted on all training rows."""
    folded = split_kfold(train, id_column, label, k, seed, "__fold").persist()
    columns = [f"oof_{name}" for name in bases]
    kept = [id_column, label, *(features if passthrough else [])]
    out_of_fold = None
    for fold in range(k):
        held = folded.where(F.col("__fold") == fold)
        part = held.select(id_column, label, *features)
        for name, base in bases.items():
            model = base.fit(folded.where(F.col("__fold") != fold))
            part = _append_probability(part, model, f"oof_{name}")
        part = part.select(*kept, *columns)
        out_of_fold = part if out_of_fold is None else out_of_fold.unionByName(part)
    inputs = [*columns, *(features if passthrough else [])]
    model = meta(inputs).fit(out_of_fold)
    ready = test.select(id_column, label, *features)
    for name, base in bases.items():
        ready = _append_probability(ready, base.fit(train), f"oof_{name}")
    folded.unpersist()
    return scored(model, ready, [id_column, label]), model


def _append_probability(df: DataFrame, model: PipelineModel, name: str) -> DataFrame:
    kept = df.columns
    return model.transform(df).select(*kept, vector_to_array("probability")[1].alias(name))


def choose_champion(
    candidates: Mapping[str, Pipeline], train: DataFrame, val: DataFrame, label: str, metric: str = "roc_auc",
    baseline: float | None = None, rows: Mapping[str, DataFrame] | None = None,
) -> tuple[str, PipelineModel, DataFrame]:
    """Fit every candidate, compare on validation, keep the best; a failing candidate is skipped.

    ``rows`` names other rows to fit a candidate on, such as those with the mark for early stopping.
    """
    fit_on = dict(rows or {})
    judge, rows, best = evaluator(metric, label), [], None
    for name, estimator in candidates.items():
        try:
            model = estimator.fit(fit_on.get(name, train))
            value = float(judge.evaluate(model.transform(val)))
        except Exception as error:
            rows.append((name, None, f"failed: {type(error).__name__}"))
            continue
        rows.append((name, value, "fitted"))
        if best is None or better(metric, value, best[2]):
            best = (name, model, value)
    if best is None:
        raise RuntimeError("no candidate could be fitted")
    if baseline is not None and not better(metric, best[2], baseline):
        rows.append(("baseline", baseline, "not beaten"))
    table = small_table(train.sparkSession, rows, "model string, score double, state string")
    return best[0], best[1], table.withColumn("champion", (F.col("model") == best[0]).cast("int"))


def impurity_importance(model: PipelineModel, features: Sequence[str]) -> dict[str, float]:
    values = model.stages[-1].featureImportances
    return {f: float(values[i]) for i, f in enumerate(features)}


def l1_importance(
    df: DataFrame, id_column: str, features: Sequence[str], label: str, task: str = "classification", k: int = 5,
    strengths: Sequence[float] = (0.001, 0.01, 0.1, 1.0, 10.0),
) -> dict[str, float]:
    """Absolute coefficients of the cross-validated L1 model."""
    n = df.count()
    best = None
    for c in strengths:
        if task == "classification":
            estimator, metric = logistic_regression(features, label, n, c, l1=True), "roc_auc"
        else:
            estimator = with_vector(R.LinearRegression(labelCol=label, regParam=c, elasticNetParam=1.0), features)
            metric = "r2"
        value, _ = mean_std(cross_validate(estimator, df, id_column, label, k, metric, task == "classification"))
        if best is None or value > best[0]:
            best = (value, estimator)
    model = best[1].fit(df).stages[-1]
    return {f: abs(float(model.coefficients[i])) for i, f in enumerate(features)}


def eliminate(
    df: DataFrame, id_column: str, features: Sequence[str], label: str, task: str = "classification", trees: int = 100, k: int = 5,
    least: int = 5, depth: int = 6,
) -> tuple[list[str], DataFrame]:
    """Recursive elimination: drop the least important feature, score every size by cross-validation."""
    current, steps = list(features), []
    metric = "roc_auc" if task == "classification" else "r2"
    least = min(least, len(features) - 1)
    sizes: dict[int, list[str]] = {}
    while True:
        forest = random_forest(current, label, task, trees, depth)
        value, spread = mean_std(cross_validate(forest, df, id_column, label, k, metric, task == "classification"))
        sizes[len(current)] = list(current)
        steps.append((len(current), value, spread))
        if len(current) <= least:
            break
        importance = impurity_importance(forest.fit(df), current)
        current.remove(min(current, key=lambda c: (importance[c], -current.index(c))))
    best = max(steps, key=lambda s: (s[1], -s[0]))
    return sizes[best[0]], small_table(df.sparkSession, steps, "n_features int, score double, std double")


def permutation_importance(
    model: PipelineModel, df: DataFrame, id_column: str, features: Sequence[str], label: str, metric: str = "roc_auc", repeats: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Mean and spread of the score lost when one feature is shuffled.

    A shuffle pairs each row with the value at the same rank of another hash order; all
    repeats of a feature are scored in one job and compared per repeat.
    """
    from .ordering import ranked_by_hash

    judge = evaluator(metric, label)
    base = float(judge.evaluate(model.transform(df)))
    rows = []
    slots = ranked_by_hash(df.select(id_column, label, *features), id_column, f"{seed}:rows").persist()
    for feature in features:
        drops = []
        for repeat in range(repeats):
            values = ranked_by_hash(df.select(id_column, F.col(feature).alias("__v")), id_column, f"{seed}:{feature}:{repeat}").select("rank", "__v")
            shuffled = slots.drop(feature).join(values, "rank").withColumnRenamed("__v", feature)
            drops.append(base - float(judge.evaluate(model.transform(shuffled))))
        rows.append((feature, *mean_std(drops)))
    slots.unpersist()
    return small_table(df.sparkSession, rows, "feature string, importance double, std double")


def early_stopping_rows(train: DataFrame, val: DataFrame) -> DataFrame:
    """Training and validation rows with the indicator column boosting needs."""
    return train.withColumn("is_val", F.lit(False)).unionByName(val.withColumn("is_val", F.lit(True)))


def numeric_label(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(label, dbl(label))


def training_curve(model: PipelineModel, train: DataFrame, val: DataFrame) -> DataFrame:
    """``round``, ``train_loss`` and ``val_loss`` of a boosted model after each of its rounds."""
    booster, ready = model.stages[-1], [model.stages[0].transform(d) for d in (train, val)]
    losses = [booster.evaluateEachIteration(d) for d in ready]
    rows = [(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(*losses))]
    return small_table(train.sparkSession, rows, "round int, train_loss double, val_loss double")


def pseudo_label(estimator: Pipeline, train: DataFrame, new: DataFrame, features: Sequence[str], label: str, at_least: float = 0.95) -> tuple[PipelineModel, DataFrame]:
    """Refit on the training rows and those new rows whose class the first fit is sure of: the model, and the rows added with their label.

    Where no row is sure enough the model is the first fit.
    """
    from .score import confident_rows

    first = estimator.fit(train)
    judged = scored(first, new, [c for c in new.columns if c != label])
    sure = confident_rows(judged, "prob_positive", at_least)
    if label != "label":
        sure = sure.withColumnRenamed("label", label)
    columns = [*features, label]
    added = sure.select(*[c for c in new.columns if c != label], label).persist()
    if added.isEmpty():
        return first, added
    return estimator.fit(train.select(*columns).unionByName(added.select(*columns))), added
