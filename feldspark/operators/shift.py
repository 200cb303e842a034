"""Whether new rows look like the training rows: a model that tries to tell them apart, and the features it does so by."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, small_table
from .models import boosting, cross_validate, impurity_importance, mean_std

SIMILAR, SHIFTED = 0.55, 0.70
"""Fixed values: below the first AUC the rows are alike; above the second the shift is serious."""


class Shift(NamedTuple):
    """Features left when the rows are alike (or one is left), the last verdict, and a row for each round."""

    features: list[str]
    verdict: str
    rounds: DataFrame


def verdict_of(auc: float) -> str:
    return "similar" if auc < SIMILAR else "drop features" if auc <= SHIFTED else "shifted"


def adversarial_validation(
    train: DataFrame, new: DataFrame, id_column: str, features: Sequence[str], k: int = 5, drop: bool = True, seed: int = 42, **settings
) -> Shift:
    """Out-of-fold AUC of a boosted model that tells ``train`` from ``new``; with ``drop`` the feature it leans on most goes, until they are alike.

    Ids need only be unique on each side. ``settings`` go to the model. ``rounds`` has ``round``, ``auc``, ``std``, ``verdict`` and the
    feature dropped after it, if any.
    """
    sides = [df.select(F.concat_ws(":", F.lit(side), id_column).alias("__id"), *features, F.lit(float(side)).alias("__new")) for side, df in enumerate((train, new))]
    mixed = cut_lineage(sides[0].unionByName(sides[1]))
    current, rows = list(features), []
    while True:
        model = boosting(current, "__new", **{"rounds": 100, "depth": 5, "seed": seed, **settings})
        auc, spread = mean_std(cross_validate(model, mixed, "__id", "__new", k, seed=seed))
        found, worst = verdict_of(auc), None
        if drop and found != "similar" and len(current) > 1:
            importance = impurity_importance(model.fit(mixed), current)
            worst = max(current, key=lambda c: (importance[c], -current.index(c)))
        rows.append((len(rows) + 1, auc, spread, found, worst))
        if worst is None:
            break
        current.remove(worst)
    return Shift(current, found, small_table(train.sparkSession, rows, "round int, auc double, std double, verdict string, dropped string"))
