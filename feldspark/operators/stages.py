"""Fitted operators as pipeline stages: one ``fit`` learns plain values, ``transform`` projects.

A stage keeps its settings, and its model the learned values, as JSON parameters. What may have any number
of rows (levels of a column, groups, donors) is learned as tables. They are written as Parquet beside the metadata when
the model is saved, so a saved pipeline needs nothing outside its folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import dbl, numeric_columns, string_columns
from ..session import cut_lineage
from . import clean, encode, explain, features, impute, models, outliers, scale
from . import select as selection
from .aggregates import aggregate_row
from .neighbours import knn_fills

FITS: dict[str, Callable[[DataFrame, dict], dict]] = {}
TRANSFORMS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}
TABLES = "tables"
"""Learned tables by name, apart from the values."""


class _Held(Params):
    kind = Param(Params._dummy(), "kind", "operator", TypeConverters.toString)
    content = Param(Params._dummy(), "content", "settings or learned values as JSON", TypeConverters.toString)

    def values(self) -> dict:
        return json.loads(self.getOrDefault(self.content))


class TableStage(Estimator, _Held, DefaultParamsReadable, DefaultParamsWritable):
    """An operator still to be fitted: ``TableStage("scale", scaler="robust")``."""

    def __init__(self, operator: str | None = None, **settings):
        super().__init__()
        if operator is not None:
            if operator not in FITS:
                raise ValueError(f"unknown stage {operator!r}; expected one of {sorted(FITS)}")
            self._set(kind=operator, content=json.dumps(settings))

    def _fit(self, dataset: DataFrame) -> TableModel:
        kind = self.getOrDefault(self.kind)
        learned = dict(FITS[kind](dataset, self.values()))
        # The tables are written here, once: every use of the model reads the copy.
        tables = {name: cut_lineage(table) for name, table in learned.pop(TABLES, {}).items()}
        return TableModel(kind, learned, tables)


class TableModel(Model, _Held, DefaultParamsReadable, DefaultParamsWritable):
    """Learned values, and learned tables by name."""

    def __init__(self, operator: str | None = None, learned: dict | None = None, tables: dict[str, DataFrame] | None = None):
        super().__init__()
        self.tables = dict(tables or {})
        if operator is not None:
            self._set(kind=operator, content=json.dumps(learned))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return TRANSFORMS[self.getOrDefault(self.kind)](dataset, {**self.values(), TABLES: self.tables})

    def write(self):
        return _TableModelWriter(self)

    @classmethod
    def read(cls):
        return _TableModelReader(cls)


class _TableModelWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        names = sorted(self.instance.tables)
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, {TABLES: names})
        for i, name in enumerate(names):
            self.instance.tables[name].write.parquet(f"{path}/{TABLES}/{i}")


class _TableModelReader(DefaultParamsReader):
    def load(self, path: str) -> TableModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TableModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.tables = {name: self.sparkSession.read.parquet(f"{path}/{TABLES}/{i}") for i, name in enumerate(metadata.get(TABLES, []))}
        return model


def _free(df: DataFrame, settings: dict, columns: list[str]) -> list[str]:
    kept = set(settings.get("keep", []))
    return [c for c in columns if c not in kept]


def _fit_drop(df, s):
    return {"columns": s["columns"]}


def _do_drop(df, v):
    return df.drop(*v["columns"])


def _fit_impute(df, s):
    keep = s.get("keep", [])
    shares = clean.null_shares(df, [c for c in df.columns if c not in keep])
    drop = [c for c, share in shares.items() if share > s.get("drop_above", 0.6)]
    held = df.drop(*drop)
    holes = [c for c, share in shares.items() if share > 0 and c not in drop]
    numbers = [c for c in holes if c in set(numeric_columns(held))]
    texts = [c for c in holes if c in set(string_columns(held))]
    strategy = s.get("numeric", "median")
    learned = {"knn": None, "drop": drop, "indicators": numbers + texts if s.get("indicators", True) else [], "fills": {}, "chained": None, TABLES: {}}
    # Columns complete in training may still have holes later; they get the same statistic.
    spare = [c for c in _free(held, s, numeric_columns(held))]
    if strategy == "knn" and numbers:
        # donors are training rows, a table of the model
        learned[TABLES]["donors"] = held.select(s["row_id"], *numbers)
        # learned here: sums over the written donors may end in other digits than over the rows
        means = aggregate_row(held, {c: F.avg(dbl(c)) for c in numbers})
        learned["knn"] = {"id": s["row_id"], "columns": numbers, "k": s.get("k", 5), "means": means}
        learned["fills"] = impute.numeric_fills(held, spare)
    elif strategy == "iterative" and numbers:
        learned["chained"] = impute.fit_chained(held, numbers)
        learned["fills"] = impute.numeric_fills(held, spare)
    else:
        learned["fills"] = impute.numeric_fills(held, spare, strategy)
    learned["fills"].update(impute.categorical_fills(held, texts, s.get("categorical", "most_frequent"), s.get("constant", "MISSING")))
    return learned


def _do_impute(df, v):
    held = clean.missing_indicators(df.drop(*v["drop"]), [c for c in v["indicators"] if c in df.columns])
    if v["knn"]:
        n = v["knn"]
        held = knn_fills(held, n["id"], n["columns"], n["k"], v[TABLES]["donors"], n.get("means"))
    if v["chained"]:
        held = impute.apply_chained(held, v["chained"])
    return impute.fill(held, v["fills"])


def _fit_outliers(df, s):
    columns = s.get("columns") or [c for c in _free(df, s, numeric_columns(df)) if not c.endswith("_was_missing")]
    method, treatment = s.get("method", "iqr"), s.get("treatment", "cap")
    return {"bounds": outliers.fit_bounds(df, columns, method, s.get("threshold", 1.5)), "treatment": treatment}


def _do_outliers(df, v):
    # Rows are only ever removed from training data, by the training plan.
    treatment = "flag" if v["treatment"] == "remove" else v["treatment"]
    held = outliers.treat(df, {c: tuple(b) for c, b in v["bounds"].items()}, treatment)
    return held.drop(*[f"{c}_is_outlier" for c in v["bounds"]]) if v["treatment"] == "remove" else held


def _fit_encode(df, s):
    columns = s.get("columns") or _free(df, s, string_columns(df))
    kept = encode.fit_rare(df, columns, s.get("rare", 0.05)) if s.get("group_rare", True) else {}
    held = encode.apply_rare(df, kept) if kept else df
    low_method = s.get("low", "ordinal" if s.get("model_type") == "linear" else "onehot")
    routes = encode.route(held, columns, s.get("threshold", 10), s.get("override"))
    named = {"binary": "ordinal", "low": low_method, "high": s.get("high", "target")}
    learned = {"kept": kept, "onehot": {}, "mapped": {}, "hash": [], TABLES: {}}
    target = s.get("target")
    methods: dict[str, str] = {}
    for c, route in routes.items():
        method = named.get(route, route)
        if target is None and method in ("target", "woe"):
            method = "count"
        if method == "onehot":
            counts = cut_lineage(encode.level_counts(held, [c]))
            plan = encode.fit_onehot(held, [c], s.get("max_onehot", 15), counts)
            learned["onehot"].update(plan)
            learned[TABLES].update({f"pooled {c}": t for c, t in encode.onehot_tables(held, plan, counts).items()})
        elif method == "hash":
            learned["hash"].append(c)
        elif method in ("ordinal", "target", "woe", "count"):
            methods[c] = method
        else:
            raise ValueError(f"unknown encoding {method!r}")
    prior = held.agg(F.avg(dbl(target))).first()[0] if "target" in methods.values() else None
    rules = {
        "ordinal": {"unseen": -1, "missing": -1, "kind": "int"},
        "target": {"unseen": prior, "missing": prior, "kind": "double"},
        "woe": {"unseen": 0.0, "missing": 0.0, "kind": "double"},
        "count": {"unseen": 0.0, "missing": None, "kind": "double"},
    }
    # Columns that are copies of each other in training share one table of levels.
    for group in encode.equal_columns(held, list(methods)):
        name = f"levels {group[0]}"
        learned[TABLES][name] = encode.level_table(held, group[0], sorted({methods[c] for c in group}), target, s.get("smoothing", 5.0))
        learned["mapped"].update({c: {**rules[methods[c]], "table": name, "value": methods[c]} for c in group})
    return learned


def _same_columns(df, v):
    """Mapped columns by the table they share, in groups that are equal in the rows to encode as well.

    Only a large table is worth the comparison, a pass over the columns: a small one is broadcast for each of them.
    """
    shared: dict[str, list[str]] = {}
    for c, m in v["mapped"].items():
        shared.setdefault(m.get("table", f"levels {c}"), []).append(c)
    for name, columns in shared.items():
        large = len(columns) > 1 and not df.isStreaming and v[TABLES][name].count() > encode.BROADCAST_LEVELS
        for group in encode.equal_columns(df, columns) if large else [[c] for c in columns]:
            yield name, group


def _do_encode(df, v):
    held = encode.apply_rare(df, v["kept"]) if v["kept"] else df
    columns = held.columns
    groups = list(_same_columns(held, v))
    # Shuffles carry one of the equal columns, and the pooled levels before the wider values.
    held = held.drop(*[c for _, group in groups for c in group[1:]])
    held = encode.with_pooled(held, v["onehot"], {c: v[TABLES][f"pooled {c}"] for c, p in v["onehot"].items() if p["pooled"]})
    for name, group in groups:
        first, mapping = group[0], v[TABLES][name]
        # models saved before columns shared a table have one value in it
        value = {c: v["mapped"][c].get("value", mapping.columns[1]) for c in group}
        packed = F.struct(*[F.col(x) for x in sorted(set(value.values()))]).alias("value")
        held = encode.with_mapped(held, mapping.select("level", packed, "rows"), first, "__found", encode.BROADCAST_LEVELS)
        made = {}
        for c in group:
            m = v["mapped"][c]
            found = F.coalesce(F.col("__found")[value[c]], F.lit(m["unseen"]))
            made[c] = F.when(F.col(first).isNull(), F.lit(m["missing"])).otherwise(found).cast(m["kind"])
        held = held.withColumns(made).drop("__found")
    held = held.select(*columns, *[c for c in held.columns if c.startswith("__pooled_")])
    if v["onehot"]:
        held = encode.apply_onehot(held, v["onehot"])
    return encode.encode_hash(held, v["hash"]) if v["hash"] else held


def _fit_scale(df, s):
    columns = s.get("columns") or _free(df, s, numeric_columns(df))
    kind, method = s.get("scaler", "robust"), s.get("transform", "yeojohnson")
    if kind == "power":
        kind, method = "standard", "yeojohnson"
    skewed = scale.skewed_columns(df, columns, s.get("skew", 1.0)) if s.get("auto_transform", True) else []
    transform = scale.fit_transform(df, skewed, method) if skewed else None
    fitted_on = scale.apply_transform(df, transform) if transform and s.get("fit_on") != "raw" else df
    return {"transform": transform, "scaler": scale.fit_scaler(fitted_on, columns, kind)}


def _do_scale(df, v):
    held = scale.apply_transform(df, v["transform"]) if v["transform"] else df
    return scale.apply_scaler(held, {c: tuple(p) for c, p in v["scaler"].items()})


def _fit_engineer(df, s):
    learned = {**s, "edges": features.fit_bins(df, s["bins"], s.get("n_bins", 5), s.get("bin_strategy", "quantile")) if s.get("bins") else {}, TABLES: {}}
    groups: dict[str, DataFrame] = {}
    for g in s.get("groups", []):
        statistics = features.group_statistics(df, g["group"], g["column"], g.get("functions", ("mean", "std")))
        name = f"group {g['group']}"
        # All statistics of one grouping are one table and one join.
        groups[name] = groups[name].join(statistics, g["group"], "left") if name in groups else statistics
    for name, statistics in groups.items():
        group = name.removeprefix("group ")
        rows = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("__rows"))
        learned[TABLES][name] = statistics.join(rows, group)
    return learned


def _do_engineer(df, v):
    held = df
    if v.get("polynomial"):
        held = features.polynomial(held, v["polynomial"], v.get("degree", 2))
    if v.get("ratios"):
        held = features.ratios(held, [tuple(p) for p in v["ratios"]])
    if v["edges"]:
        held = features.apply_bins(held, v["edges"])
    if v.get("interactions"):
        held = features.interactions(held, [tuple(p) for p in v["interactions"]])
    for name, statistics in v[TABLES].items():
        held = _with_groups(held, statistics, name.removeprefix("group "))
    if v.get("text"):
        held = features.text_features(held, v["text"])
    if v.get("dates"):
        held = features.date_features(held, v["dates"], since=v.get("since"))
    return held


def _with_groups(df, statistics, group):
    """Statistics of each row's group; groups unseen in training, and a missing one, have none."""
    names = [c for c in statistics.columns if c not in (group, "__rows")]
    packed = statistics.select(F.col(group).cast("string").alias("level"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("value"), F.col("__rows").alias("rows"))
    held = encode.with_mapped(df, packed, group, "__statistics")
    return held.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col("__statistics")[c].alias(c) for c in names])


def _fit_select(df, s):
    columns = s.get("columns") or _free(df, s, numeric_columns(df))
    varying = selection.keep_varying(df, columns, s.get("variance", 0.01))
    similar = set(selection.correlation_drops(df, varying, s["target"], s.get("correlation", 0.95)))
    current = [c for c in varying if c not in similar]
    importance = _importance(df, current, s)
    chosen = selection.top_features(importance, s.get("n"), s.get("share", 0.5))
    if s.get("eliminate") and len(chosen) > 5:
        chosen, _ = models.eliminate(df, s["row_id"], chosen, s["target"], s.get("task", "classification"))
    return {
        "selected": chosen,
        "dropped_variance": [c for c in columns if c not in varying],
        "dropped_correlation": sorted(similar),
        "importance": importance,
        "all": columns,
    }


def _importance(df, columns, s) -> dict[str, float]:
    method, target, task = s.get("method", "mutual_info"), s["target"], s.get("task", "classification")
    if method == "mutual_info":
        return selection.mutual_information(df, columns, target, classification=task != "regression")
    if method == "lasso":
        return models.l1_importance(df, s["row_id"], columns, target, task)
    if method not in ("tree", "shap"):
        raise ValueError(f"unknown importance method {method!r}")
    forest = models.random_forest(columns, target, task, s.get("trees", 200), 6 if method == "shap" else 10).fit(df)
    if method == "tree":
        return models.impurity_importance(forest, columns)
    explained, _ = explain.tree_contributions(df, forest.stages[-1], columns)
    sizes = explained.agg(*[F.avg(F.abs(F.col("contributions")[i])).alias(f"v{i}") for i in range(len(columns))]).first()
    return dict(zip(columns, map(float, sizes)))


def _do_select(df, v):
    gone = set(v["all"]) - set(v["selected"])
    return df.drop(*gone)


for _name, _fit, _do in (
    ("drop", _fit_drop, _do_drop),
    ("impute", _fit_impute, _do_impute),
    ("outliers", _fit_outliers, _do_outliers),
    ("encode", _fit_encode, _do_encode),
    ("scale", _fit_scale, _do_scale),
    ("engineer", _fit_engineer, _do_engineer),
    ("select", _fit_select, _do_select),
):
    FITS[_name], TRANSFORMS[_name] = _fit, _do
