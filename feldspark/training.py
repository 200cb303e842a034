"""End-to-end training: split first, learn on training rows only, test once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import TrainingConfig
from .functions.roles import dbl, nan_to_null
from .operators import metrics as E
from .operators import models as M
from .operators.clean import drop_sparse_rows, validate_input
from .operators.forest import fit_isolation_forest, score_isolation_forest
from .operators.neighbours import fit_lof, score_lof
from .operators.outliers import treat
from .operators.split import check_leakage, split_holdout
from .operators.stages import TableModel, TableStage
from .operators.synthetic import needs_resampling, resample
from .session import cut_lineage


@dataclass
class TrainingResult:
    champion: str
    model: PipelineModel
    preprocessing: PipelineModel
    features: list[str]
    scores: DataFrame
    test_metrics: dict[str, float]
    baseline: dict[str, float]
    leakage: dict
    threshold: float = 0.5
    settings: dict = field(default_factory=dict)


def build_model(
    name: str, features, label: str, n_rows: int, task: str, settings: dict, early: str | None = None, weight: str | None = None
):
    """A model by name; ``weight`` names the column of row weights, for those that take weights."""
    if weight and name not in ("linear_regression", "mlp"):
        settings = {"weight": weight, **settings}
    if name == "logistic_regression":
        return M.logistic_regression(features, label, n_rows, **settings)
    if name == "linear_regression":
        return M.linear_regression(features, label)
    if name == "decision_tree":
        return M.decision_tree(features, label, **settings)
    if name == "random_forest":
        return M.random_forest(features, label, task, **settings)
    if name == "mlp":
        return M.perceptron(features, label, **settings)
    return M.boosting(features, label, task, validation=early, **settings)


def _multivariate(config: TrainingConfig, train: DataFrame, others: list[DataFrame], row_id: str, columns: list[str]):
    """Isolation forest or LOF on training rows; other rows are flagged, never removed."""
    o = config.outliers
    if o.method == "isolation_forest":
        fitted = fit_isolation_forest(train, row_id, columns, contamination=o.contamination, seed=config.modeling.seed)
        mark = lambda df: score_isolation_forest(df, fitted).drop("anomaly_score")
    else:
        fitted = fit_lof(train, row_id, columns, contamination=o.contamination)
        mark = lambda df: score_lof(df, row_id, fitted).drop("lof")
    marked = mark(train)
    if o.treatment == "remove":
        train = treat(marked, {}, "remove", F.col("is_outlier_multivariate") == 1).drop("is_outlier_multivariate")
        return train, others
    if "flag" in o.treatment:
        return marked, [mark(df) for df in others]
    return train, others


def train(df: DataFrame, config: TrainingConfig) -> TrainingResult:
    d, m = config.data, config.modeling
    target, row_id = d.target, d.row_id
    validate_input(df, target)
    keep = [row_id, target]
    label = target if m.task == "classification" else None

    raw = nan_to_null(df.drop(*[c for c in d.drop_columns if c not in keep])).withColumn(target, dbl(target))
    parted = cut_lineage(split_holdout(raw, row_id, label, d.test_size, d.val_size, m.seed))
    train_rows, val, test = (parted.where(F.col("split") == s).drop("split") for s in ("train", "val", "test"))
    checked = [c for c in raw.columns if c not in keep]
    leakage = check_leakage(train_rows, test, row_id, checked)

    if config.missing.drop_row_above:
        train_rows = drop_sparse_rows(train_rows, config.missing.drop_row_above, checked)
    o = config.outliers
    univariate = o.method in ("iqr", "zscore", "modified_zscore")
    if not univariate:
        # Known for training rows only, so it is carried along and never a feature of the model.
        keep = [*keep, "is_outlier_multivariate"]
    plan = [
        TableStage("impute", keep=keep, drop_above=config.missing.drop_column_above, numeric=config.missing.numeric,
                   categorical=config.missing.categorical, indicators=config.missing.indicators, row_id=row_id),
        TableStage("outliers", keep=keep, method=o.method if univariate else "iqr", threshold=o.threshold, treatment=o.treatment),
        TableStage("engineer", **config.engineering),
        TableStage("encode", keep=keep, threshold=config.encoding.threshold, high=config.encoding.high, target=target,
                   model_type=config.encoding.model_type, override=config.encoding.override),
        TableStage("scale", keep=keep, scaler=config.scaling.scaler, auto_transform=config.scaling.auto_transform),
        TableStage("select", keep=keep, target=target, variance=config.selection.variance, correlation=config.selection.correlation,
                   n=config.selection.n_features, share=config.selection.share, method=config.selection.method,
                   eliminate=config.selection.eliminate, row_id=row_id, task=m.task),
    ]
    fitted: list[TableModel] = []
    for stage in plan:
        learned = stage.fit(train_rows)
        if learned.getOrDefault("kind") == "outliers":
            if univariate and o.treatment == "remove":
                train_rows = treat(train_rows, {c: tuple(b) for c, b in learned.values()["bounds"].items()}, "remove")
            elif not univariate:
                columns = [c for c in learned.values()["bounds"]]
                train_rows, (val, test) = _multivariate(config, train_rows, [val, test], row_id, columns)
        fitted.append(learned)
        train_rows = learned.transform(train_rows)
    preprocessing = PipelineModel(stages=fitted)
    features = fitted[-1].values()["selected"]

    train_rows = cut_lineage(train_rows)
    if label and m.resampling != "none" and needs_resampling(train_rows, target):
        train_rows = cut_lineage(resample(train_rows, row_id, target, features, m.resampling, seed=m.seed))
    val_ready = cut_lineage(preprocessing.transform(val))
    n = train_rows.count()

    reference = E.baseline(train_rows, val_ready, target, m.task)
    weight = "weight" if label and m.resampling == "class_weight" and "weight" in train_rows.columns else None
    stops = {"boosting"}  # trained with validation rows, until those stop improving
    candidates = {
        name: build_model(name, features, target, n, m.task, m.settings.get(name, {}), "is_val" if name in stops else None, weight)
        for name in m.models
    }
    rows = {name: _with_validation(train_rows, val_ready, [*features, target], weight) for name in m.models if name in stops}
    name, model, scores = M.choose_champion(candidates, train_rows, val_ready, target, m.metric, reference.get(m.metric), rows)
    if m.trials:
        name, model = _tuned(config, name, model, train_rows, val_ready, row_id, features, n, weight)

    threshold = 0.5
    if label and model.stages[-1].hasParam("probabilityCol"):
        on_val = model.transform(val_ready).select(target, vector_to_array("probability")[1].alias("p"))
        threshold = E.best_threshold(on_val, target, "p").first()["threshold"]

    whole = PipelineModel(stages=[*fitted, *model.stages])
    out = whole.transform(test)
    if label:
        judged = out.select(target, "prediction", vector_to_array("probability")[1].alias("p"))
        measured = E.classification_metrics(judged, target, "prediction", "p")
    else:
        measured = E.regression_metrics(out, target, "prediction")
    return TrainingResult(name, whole, preprocessing, features, scores, measured, reference, leakage, threshold, m.settings.get(name, {}))


def _with_validation(train_rows, val_ready, columns, weight):
    """Training and validation rows with the mark for early stopping; validation rows weigh one each."""
    if weight:
        columns, val_ready = [*columns, weight], val_ready.withColumn(weight, F.lit(1.0))
    return M.early_stopping_rows(train_rows.select(*columns), val_ready.select(*columns))


def _tuned(config, name, model, train_rows, val_ready, row_id, features, n, weight):
    """Search around the champion, refit with early stopping where it exists, keep the better on validation."""
    m, target = config.modeling, config.data.target
    space = M.SEARCH_SPACES.get(name)
    if not space:
        return name, model
    fixed = {k: v for k, v in m.settings.get(name, {}).items() if k not in space}
    build = lambda **s: build_model(name, features, target, n, m.task, {**fixed, **s}, weight=weight)
    keyed = train_rows
    if "copy" in train_rows.columns:
        keyed = train_rows.withColumn(row_id, F.concat_ws(":", row_id, target, "copy"))
    best, _ = M.search(build, space, keyed, row_id, target, m.trials, m.seconds, m.folds, m.metric, m.seed)
    if best is None:
        return name, model
    if name == "boosting":
        both = _with_validation(train_rows, val_ready, [*features, target], weight)
        tuned = build_model(name, features, target, n, m.task, {**fixed, **best}, early="is_val", weight=weight).fit(both)
    else:
        tuned = build(**best).fit(train_rows)
    judge = M.evaluator(m.metric, target)
    scores = [float(judge.evaluate(x.transform(val_ready))) for x in (tuned, model)]
    return (name, tuned) if M.better(m.metric, *scores) else (name, model)


def prepare_only(df: DataFrame, stages: list[TableStage]) -> PipelineModel:
    """Fit a list of stages on training rows as one Spark pipeline."""
    held = df.persist()  # every stage reads the rows at least once
    try:
        return Pipeline(stages=stages).fit(held)
    finally:
        held.unpersist()
