"""Exact metrics as aggregates; curves over distinct scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import dbl
from ..session import small_table
from .aggregates import aggregate_row
from .ordering import running_totals

MAX_CLASSES = 1_000


def confusion(df: DataFrame, label: str, prediction: str) -> dict[tuple, int]:
    rows = df.groupBy(label, prediction).count().limit(MAX_CLASSES * MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES * MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes: {label!r} looks like a regression target")
    return {(r[0], r[1]): r[2] for r in rows}


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row per class, one count column per predicted class."""
    classes = sorted({c for pair in confusion(df, label, prediction) for c in pair})
    counts = [F.count(F.when(F.col(prediction) == c, 1)).alias(f"predicted_{c}") for c in classes]
    return df.groupBy(F.col(label).alias("label")).agg(*counts)


def class_scores(counts: dict[tuple, int]) -> dict:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    out = {}
    for c in sorted({x for pair in counts for x in pair}):
        hit = counts.get((c, c), 0)
        support = sum(n for (y, _), n in counts.items() if y == c)
        predicted = sum(n for (_, p), n in counts.items() if p == c)
        precision = hit / predicted if predicted else 0.0
        recall = hit / support if support else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        out[c] = (precision, recall, f1, support)
    return out


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    scores = class_scores(confusion(df, label, prediction))
    total = sum(s[3] for s in scores.values())
    rows = [(str(c), *map(float, s[:3]), s[3]) for c, s in scores.items()]
    k = len(scores)
    rows.append(("macro avg", *[float(sum(s[i] for s in scores.values()) / k) for i in range(3)], total))
    rows.append(("weighted avg", *[float(sum(s[i] * s[3] for s in scores.values()) / total) for i in range(3)], total))
    return small_table(df.sparkSession, rows, "class string, precision double, recall double, f1 double, support bigint")


def matthews(counts: dict[tuple, int]) -> float:
    classes = {x for pair in counts for x in pair}
    n = sum(counts.values())
    right = sum(counts.get((c, c), 0) for c in classes)
    truth = {c: sum(v for (y, _), v in counts.items() if y == c) for c in classes}
    guess = {c: sum(v for (_, p), v in counts.items() if p == c) for c in classes}
    cross = sum(truth[c] * guess[c] for c in classes)
    spread = (n * n - sum(v * v for v in guess.values())) * (n * n - sum(v * v for v in truth.values()))
    return (right * n - cross) / spread**0.5 if spread else 0.0


def roc_auc(df: DataFrame, label: str, score: str) -> float | None:
    """Area under the ROC curve, ties counted half: one row per distinct score, then running totals."""
    counted = df.where(F.col(score).isNotNull()).groupBy(dbl(score).alias("score")).agg(
        F.sum((dbl(label) == 1).cast("bigint")).alias("pos"), F.sum((dbl(label) != 1).cast("bigint")).alias("neg")
    )
    running = running_totals(counted, ["score"], ["pos", "neg"])
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / F.lit(2.0)
    area = F.sum(F.col("pos") * below) / F.first(F.col("all_pos").cast("double") * F.col("all_neg").cast("double"))
    row = running.where("all_pos > 0 and all_neg > 0").agg(area.alias("auc")).first()
    return row["auc"]


def classification_metrics(
    df: DataFrame, label: str, prediction: str, probability: str | None = None, average: str = "weighted"
) -> dict[str, float]:
    counts = confusion(df, label, prediction)
    scores = class_scores(counts)
    n = sum(counts.values())
    f1 = {
        "binary": scores.get(1, scores.get(1.0, (0, 0, 0.0, 0)))[2],
        "macro": sum(s[2] for s in scores.values()) / max(1, len(scores)),
        "weighted": sum(s[2] * s[3] for s in scores.values()) / max(1, n),
    }[average]
    out = {"accuracy": sum(v for (y, p), v in counts.items() if y == p) / max(1, n), "f1": float(f1), "mcc": matthews(counts)}
    if probability:
        out["roc_auc"] = roc_auc(df, label, probability)
    return out


def regression_metrics(df: DataFrame, label: str, prediction: str) -> dict[str, float]:
    """MAE, RMSE and R2 from two aggregates (the second needs the mean, for stability)."""
    mean = aggregate_row(df, {"m": F.avg(dbl(label))})["m"]
    error = dbl(label) - dbl(prediction)
    found = aggregate_row(
        df,
        {
            "mae": F.avg(F.abs(error)),
            "mse": F.avg(error * error),
            "var": F.avg((dbl(label) - F.lit(mean)) * (dbl(label) - F.lit(mean))),
        },
    )
    return {"mae": found["mae"], "rmse": found["mse"] ** 0.5, "r2": 1 - found["mse"] / found["var"] if found["var"] else 0.0}


def metrics_table(spark, metrics: dict[str, float], digits: int = 6) -> DataFrame:
    rows = [(k, None if v is None else round(float(v), digits) + 0.0) for k, v in metrics.items()]
    return small_table(spark, rows, "metric string, value double")


def threshold_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision and recall at every distinct score used as threshold."""
    counted = df.groupBy(dbl(score).alias("threshold")).agg(
        F.sum((dbl(label) == 1).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    running = running_totals(counted, ["threshold"], ["pos", "n"])
    hits = (F.col("all_pos") - F.col("cum_pos") + F.col("pos")).cast("double")
    taken = F.col("all_n") - F.col("cum_n") + F.col("n")
    return running.select(
        "threshold", (hits / taken).alias("precision"), F.when(F.col("all_pos") > 0, hits / F.col("all_pos")).otherwise(1.0).alias("recall")
    )


def best_thresholds(df: DataFrame, label: str, score: str, wanted: Sequence[str] = ("f1",)) -> DataFrame:
    """Per metric the lowest threshold with the highest score; (0.5, 0) when nothing scores above zero.

    All metrics come from one curve.
    """
    p, r = F.col("precision"), F.col("recall")
    choices = {"f1": 2 * p * r / (p + r + 1e-8), "precision": p, "recall": r, "gmean": F.sqrt(p * r)}
    unknown = [m for m in wanted if m not in choices]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}")
    best = threshold_curve(df, label, score).agg(
        *[F.max(F.when(choices[m] > 0, F.struct(choices[m].alias("s"), (-F.col("threshold")).alias("t")))).alias(m) for m in wanted]
    )
    rows = [
        F.struct(F.lit(m).alias("metric"), F.coalesce(-F.col(m)["t"], F.lit(0.5)).alias("threshold"), F.coalesce(F.col(m)["s"], F.lit(0.0)).alias("score"))
        for m in wanted
    ]
    return best.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def best_threshold(df: DataFrame, label: str, score: str, metric: str = "f1") -> DataFrame:
    return best_thresholds(df, label, score, [metric])


def baseline(train: DataFrame, val: DataFrame, label: str, task: str = "classification") -> dict[str, float]:
    """Validation metrics of the most frequent class, or of the mean."""
    if task == "classification":
        from .impute import modes

        guess = modes(train, [label])[label]
        guessed = val.withColumn("__guess", F.lit(guess).cast(val.schema[label].dataType))
        return {**{k: v for k, v in classification_metrics(guessed, label, "__guess").items() if k != "mcc"}, "roc_auc": 0.5}
    mean = aggregate_row(train, {"m": F.avg(dbl(label))})["m"]
    return regression_metrics(val.withColumn("__guess", F.lit(mean)), label, "__guess")
