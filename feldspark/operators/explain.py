"""Additive explanations: trees, linear models and any model."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roles import dbl
from ..sources.tables import scratch_folder
from .aggregates import aggregate_row

TABLE_FEATURES = 8


def tree_nodes(spark, model) -> list[tuple[float, dict[int, dict]]]:
    """(weight, nodes by id) of every tree of an MLlib tree model, read from its saved form.

    The node table is as large as the model, never as the data.
    """
    folder = scratch_folder(spark, "model")
    model.write().overwrite().save(folder)
    saved = spark.read.parquet(f"{folder}/data")
    if "nodeData" not in saved.columns:
        saved = saved.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    trees: dict[int, dict] = {}
    for row in saved.collect():
        trees.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"].asDict(recursive=True)
    name = type(model).__name__
    if name.startswith("GBT"):
        weights = list(model.treeWeights)
    else:
        weights = [1.0 / len(trees)] * len(trees)
    return [(weights[i], trees[i]) for i in sorted(trees)]


def _leaf_value(node: Mapping, classifier: bool) -> float:
    if not classifier:
        return float(node["prediction"])
    stats = node["impurityStats"]
    return float(stats[1] / sum(stats))


def leaves_of(spark, model) -> tuple[list[tuple], float]:
    """Leaves as (value, features, tests, cover shares), and the average output over the trees.

    A forest of classification trees explains the probability of class 1; boosting explains
    its margin.
    """
    name = type(model).__name__
    shares_of_class = name in ("RandomForestClassificationModel", "DecisionTreeClassificationModel")
    found: list[tuple] = []
    base = 0.0

    def cover(node):
        stats = node["impurityStats"]
        return float(sum(stats)) if shares_of_class else float(stats[0])

    for weight, nodes in tree_nodes(spark, model):

        def walk(at: int, path: dict):
            nonlocal base
            node = nodes[at]
            if node["leftChild"] < 0:
                value = weight * _leaf_value(node, shares_of_class)
                share = float(np.prod([p[1] for p in path.values()])) if path else 1.0
                base += value * share
                if path:
                    features = sorted(path)
                    found.append((value, features, [path[f][0] for f in features], [path[f][1] for f in features]))
                return
            split, total = node["split"], cover(node)
            feature = split["featureIndex"]
            for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
                tests, share = path.get(feature, ([], 1.0))
                if split["numCategories"] < 0:
                    test = ("le" if left else "gt", float(split["leftCategoriesOrThreshold"][0]))
                else:
                    test = ("in" if left else "out", tuple(split["leftCategoriesOrThreshold"]))
                walk(child, {**path, feature: ([*tests, test], share * cover(nodes[child]) / total)})

        walk(0, {})
    return found, base


def _passes(x: np.ndarray, tests) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for kind, value in tests:
        if kind == "le":
            ok &= x <= value
        elif kind == "gt":
            ok &= x > value
        else:
            ok &= np.isin(x, value) == (kind == "in")
    return ok


def _leaf_shares(value: float, passed: np.ndarray, cover: Sequence[float]) -> np.ndarray:
    """Shapley values of one leaf for each pattern of passed tests.

    A coalition's value is the product of its members' outcomes and the other features'
    cover shares; the polynomial collects coalitions by size.
    """
    rows, m = passed.shape
    weights = [factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)]
    out = np.zeros((rows, m))
    for i in range(m):
        by_size = np.zeros((rows, m))
        by_size[:, 0] = 1.0
        for j in range(m):
            if j != i:
                grown = by_size * cover[j]
                grown[:, 1:] += by_size[:, :-1] * passed[:, j : j + 1]
                by_size = grown
        out[:, i] = value * (passed[:, i] - cover[i]) * (by_size @ np.array(weights))
    return out


def tree_contributions(df: DataFrame, model, features: Sequence[str]) -> tuple[DataFrame, float]:
    """Add ``contributions`` (one number per feature) and return the base value.

    Base plus contributions equals the model output of every row.
    """
    leaves, base = leaves_of(df.sparkSession, model)
    shared = df.sparkSession.sparkContext.broadcast(leaves)  # bounded by the size of the model
    width = len(features)

    def explain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables: dict[int, np.ndarray] = {}
        for vectors in batches:
            x = np.stack(list(vectors)) if len(vectors) else np.empty((0, width))
            total = np.zeros((len(x), width))
            for number, (value, used, tests, cover) in enumerate(shared.value):
                passed = np.stack([_passes(x[:, f], t) for f, t in zip(used, tests)], axis=1)
                code = passed @ (1 << np.arange(len(used)))
                if len(used) <= TABLE_FEATURES:
                    if number not in tables:
                        every = (np.arange(1 << len(used))[:, None] >> np.arange(len(used))) & 1
                        tables[number] = _leaf_shares(value, every.astype(float), cover)
                    total[:, used] += tables[number][code]
                else:
                    seen, first, back = np.unique(code, return_index=True, return_inverse=True)
                    total[:, used] += _leaf_shares(value, passed[first].astype(float), cover)[back]
            yield pd.Series(list(total))

    explain.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    vector = F.array(*[dbl(f) for f in features])
    return df.withColumn("contributions", F.pandas_udf(explain, "array<double>")(vector)), base


def linear_contributions(df: DataFrame, coefficients: Mapping[str, float], means: Mapping[str, float] | None = None) -> DataFrame:
    """coef * (x - mean) per feature."""
    if means is None:
        means = aggregate_row(df, {f: F.avg(dbl(f)) for f in coefficients})
    parts = [(dbl(f) - F.lit(float(means[f]))) * F.lit(float(w)) for f, w in coefficients.items()]
    return df.withColumn("contributions", F.array(*parts))


def sampled_contributions(
    df: DataFrame, background: DataFrame, model, id_column: str, features: Sequence[str], permutations: int = 8, seed: int = 42,
    output: str = "probability",
) -> DataFrame:
    """Shapley values of any fitted model by sampled feature orders.

    Every row meets a few (order, background row) pairs; features switch from the
    background's to the row's value one by one, and the change of the output belongs to the
    switched feature. ``background`` is a small table (its size is checked).
    """
    held = background.select(*[dbl(f).alias(f) for f in features]).limit(1001).collect()
    if not 0 < len(held) <= 1000:
        raise ValueError("the background must hold 1 to 1000 rows")
    width = len(features)
    rows = F.lit([[float(v) for v in r] for r in held])
    started = df.select(
        id_column, F.array(*[dbl(f) for f in features]).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("p")
    )
    tag = F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string"), F.lit(":"), F.col("p").cast("string"))
    order = F.transform(
        F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.struct(F.md5(F.concat(tag, F.lit(":"), j.cast("string"))).alias("h"), j.alias("j")))),
        lambda s: s["j"],
    )
    pick = F.pmod(F.xxhash64(tag), F.lit(len(held))).cast("int")
    mixed = (
        started.withColumn("order", order).withColumn("back", F.element_at(rows, pick + 1))
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(width))))
    )
    value = lambda j: F.when(F.array_position("order", F.lit(j)) <= F.col("step"), F.col("x")[j]).otherwise(F.col("back")[j])
    ready = mixed.select(id_column, "p", "step", "order", *[value(j).alias(f) for j, f in enumerate(features)])
    out = model.transform(ready)
    score = vector_to_array("probability")[1] if output == "probability" else F.col(output)
    scored = out.select(id_column, "p", "step", "order", score.alias("y"))
    path = scored.groupBy(id_column, "p", "order").agg(F.array_sort(F.collect_list(F.struct("step", "y"))).alias("path"))  # width + 1 entries
    gains = path.select(id_column, F.explode(F.sequence(F.lit(1), F.lit(width))).alias("s"), "order", "path").select(
        id_column,
        F.element_at("order", F.col("s")).alias("j"),
        (F.element_at("path", F.col("s") + 1)["y"] - F.element_at("path", F.col("s"))["y"]).alias("gain"),
    )
    return gains.groupBy(id_column).agg(*[F.avg(F.when(F.col("j") == j, F.col("gain"))).alias(f) for j, f in enumerate(features)]).select(
        id_column, F.array(*features).alias("contributions")
    )


def long_contributions(df: DataFrame, id_column: str, features: Sequence[str]) -> DataFrame:
    """(id, feature, value, contribution), one row per feature."""
    names = F.array(*[F.lit(f) for f in features])
    values = F.array(*[dbl(f) for f in features])
    zipped = F.explode(F.arrays_zip(names.alias("feature"), values.alias("value"), F.col("contributions").alias("contribution")))
    return df.select(id_column, zipped.alias("z")).select(
        id_column, F.col("z")["feature"].alias("feature"), F.col("z")["value"].alias("value"), F.col("z")["contribution"].alias("contribution")
    )


def importance_table(long: DataFrame) -> DataFrame:
    """Mean absolute contribution, mean, share of positive contributions and rank per feature."""
    stats = long.groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("mean_abs"),
        F.avg("contribution").alias("mean"),
        F.avg((F.col("contribution") > 0).cast("double")).alias("pct_positive"),
    )
    place = Window.partitionBy(F.lit(1)).orderBy(F.desc("mean_abs"), "feature")  # one row per feature
    return stats.withColumn("rank", F.row_number().over(place))


def top_reasons(df: DataFrame, features: Sequence[str], n: int = 5) -> DataFrame:
    """Add ``top_features``: the n largest contributions of each row, within the row (no shuffle)."""
    entries = [
        F.struct(
            (-F.abs(F.col("contributions")[i])).alias("k"), F.lit(i).alias("i"), F.lit(f).alias("feature"), dbl(f).alias("value"),
            F.col("contributions")[i].alias("shap"),
        )
        for i, f in enumerate(features)
    ]
    ordered = F.slice(F.array_sort(F.array(*entries)), 1, n)
    shown = F.transform(
        ordered,
        lambda e: F.struct(
            e["feature"].alias("feature"), e["value"].alias("value"), e["shap"].alias("shap"),
            F.when(e["shap"] > 0, "phishing").otherwise("legit").alias("direction"),
        ),
    )
    return df.withColumn("top_features", shown)


def dependence(long: DataFrame, feature: str) -> DataFrame:
    """(value, contribution) pairs of one feature."""
    return long.where(F.col("feature") == feature).drop("feature")


def waterfall(long: DataFrame, id_column: str, row_id, base: float) -> DataFrame:
    """Base value and contributions of one row, largest first, with the running output."""
    mine = long.where(F.col(id_column) == F.lit(row_id))
    order = Window.partitionBy(id_column).orderBy(F.desc(F.abs("contribution")), "feature")
    return mine.select(
        "feature", "value", "contribution", F.row_number().over(order).alias("step"),
        (F.lit(base) + F.sum("contribution").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("output"),
    )
