"""Model queries over the labelled documents. Fits are small settings of the real estimators.

What a fit finds has no SQL. These queries return the keys together with what must hold of the result, worked out
from the result itself, and the SQL states the keys and what the tables say.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.roles import rounded
from ..operators import models as M
from ..operators.scale import apply_scaler, fit_scaler
from ..session import small_table
from .catalog import query, table
from .fixtures import DOC_FEATURES, DOC_FEATURES_SQL, labelled_docs, md5_uniform
from .profile_queries import round_all

FEATURES = DOC_FEATURES


def docs(spark, sf, label="toxic"):
    return labelled_docs(spark, sf).select("doc_id", *FEATURES, F.col(label).cast("double").alias("label")).persist()


def parts(frame):
    return frame.where("doc_id % 4 <> 0"), frame.where("doc_id % 4 = 0")


_HELD = f"{DOC_FEATURES_SQL} where doc_id % 4 = 0"
_NAMES = ", ".join(f"('{f}')" for f in FEATURES)


def _close(a, b, by=1e-6):
    return F.abs(a - b) <= by


PROBABLE_SQL = f"select doc_id, toxic::double as label, true as sums_to_one, true as in_range, true as decides from {_HELD}"


def _probabilities(model, frame):
    """Every row with its label, and whether its two chances are chances and the prediction is the likelier class."""
    return _judged(M.scored(model, frame, ["doc_id", "label"]))


def _judged(out):
    low, high = F.col("prob_negative"), F.col("prob_positive")
    return out.select(
        "doc_id", "label", _close(low + high, F.lit(1.0)).alias("sums_to_one"), (low.between(0, 1) & high.between(0, 1)).alias("in_range"),
        ((F.col("prediction") == (high > low).cast("double")) | _close(low, high)).alias("decides"),
    )


RANKED_SQL = f"""select col0 as feature, true as is_share, true as in_order, true as chosen from (values {_NAMES})"""


def _ranked(spark, found, whole=True):
    """Every feature, whether its importance is one (a share of 1 if ``whole``), whether ranks follow it, and whether the best half is selected."""
    from ..operators.select import ranking_table, top_features

    chosen = top_features(found)
    total = sum(found.values())
    share = all(v >= 0 for v in found.values()) and (abs(total - 1) < 1e-6 or not whole)
    rows = ranking_table(spark, found, chosen).orderBy("rank").collect()
    in_order = all(a["importance"] >= b["importance"] for a, b in zip(rows, rows[1:]))
    return small_table(
        spark, [(r["feature"], share, in_order, (r["selected"] == 1) == (r["rank"] <= len(FEATURES) // 2)) for r in rows],
        "feature string, is_share boolean, in_order boolean, chosen boolean",
    )


@query("logreg", f"""select doc_id, toxic::double as label, (select round(avg(toxic), 2) from {DOC_FEATURES_SQL} where doc_id % 4 <> 0) as mean_chance,
  true as sums_to_one, true as in_range, true as decides from {_HELD}""")
def logreg(spark, sf):
    """The penalty leaves the intercept free, so the mean chance of the training rows is their share of positives."""
    train, val = parts(docs(spark, sf))
    model = M.logistic_regression(FEATURES, "label", train.count()).fit(train)
    mean = M.scored(model, train, ["doc_id"]).agg(F.avg("prob_positive")).first()[0]
    return _probabilities(model, val).withColumn("mean_chance", F.lit(round(mean, 2)))


@query("linreg", """select round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from lineitem""")
def linreg(spark, sf):
    model = M.linear_regression(["l_quantity"], "l_extendedprice").fit(table(spark, sf, "lineitem")).stages[-1]
    return small_table(spark, [(round(float(model.coefficients[0]), 4), round(float(model.intercept), 3))], "slope double, intercept double")


@query("decision_tree", f"select doc_id, toxic::double as label, true as in_leaf, true as is_share, true as pruned from {DOC_FEATURES_SQL} where doc_id % 4 <> 0")
def decision_tree(spark, sf):
    """Each training row in one leaf of the pruned tree, whose chance is the weighted share of positives of all its rows."""
    from ..operators.pruned_tree import fit_pruned_tree
    from ..operators.resample import class_weights

    train, _ = parts(docs(spark, sf))
    tree = fit_pruned_tree(train, "doc_id", FEATURES, "label")
    weight = class_weights(train, "label")
    leaves = [i for i, n in tree.nodes.items() if n.is_leaf]
    rows = train.select("doc_id", "label", tree.leaf().alias("leaf"), tree.probability().alias("p")).persist()
    weighed = F.when(F.col("label") == 1, F.lit(weight[1.0])).otherwise(F.lit(weight[0.0]))
    share = rows.groupBy("leaf").agg((F.sum(weighed * F.col("label")) / F.sum(weighed)).alias("share"), F.count(F.lit(1)).alias("n"))
    best = max(t[1] for t in tree.trials) == dict((t[0], t[1]) for t in tree.trials)[tree.alpha]
    return rows.join(F.broadcast(share), "leaf").select(
        "doc_id", "label", F.col("leaf").isin(leaves).alias("in_leaf"), (_close(F.col("p"), F.col("share")) & (F.col("n") >= 20)).alias("is_share"), F.lit(best).alias("pruned")
    )


@query("random_forest", PROBABLE_SQL)
def random_forest(spark, sf):
    train, val = parts(docs(spark, sf))
    return _probabilities(M.random_forest(FEATURES, "label", trees=50, depth=6).fit(train), val)


@query("select_tree", RANKED_SQL)
def select_tree(spark, sf):
    frame = docs(spark, sf)
    return _ranked(spark, M.impurity_importance(M.random_forest(FEATURES, "label", trees=50, depth=6).fit(frame), FEATURES))


@query("select_l1", RANKED_SQL)
def select_l1(spark, sf):
    frame = docs(spark, sf)
    scaled = apply_scaler(frame, fit_scaler(frame, FEATURES))
    return _ranked(spark, M.l1_importance(scaled, "doc_id", FEATURES, "label", k=3, strengths=(0.01, 1.0)), whole=False)


@query("rfecv", f"select n::int as n_features, true as is_score, true as best_kept from range(4, {len(FEATURES) + 1}) as t(n)")
def rfecv(spark, sf):
    """One step for each number of features, and the kept ones are as many as the best step has."""
    kept, steps = M.eliminate(docs(spark, sf), "doc_id", FEATURES, "label", trees=10, k=3, least=4, depth=4)
    best = steps.agg(F.max(F.struct("score", -F.col("n_features")))).first()[0]
    return steps.select("n_features", (F.col("score").between(0, 1) & (F.col("std") >= 0)).alias("is_score"), F.lit(len(kept) == -best[1]).alias("best_kept"))


@query("gbt", PROBABLE_SQL)
def gbt(spark, sf):
    train, val = parts(docs(spark, sf))
    both = M.early_stopping_rows(train, val)
    model = M.boosting(FEATURES, "label", validation="is_val", rounds=20, rate=0.1, depth=3).fit(both)
    return _probabilities(model, val)


@query("boost_curve", "select n::int as round, true as is_loss, true as falls from range(1, 16) as t(n)")
def boost_curve(spark, sf):
    """A loss for each round, and that of the training rows below the first one's."""
    train, val = parts(docs(spark, sf))
    curve = M.training_curve(M.boosting(FEATURES, "label", rounds=15, rate=0.1, depth=3, subsample=1.0).fit(train), train, val)
    first = curve.where("round = 1").first()["train_loss"]
    is_loss = (F.col("train_loss") >= 0) & (F.col("val_loss") >= 0)
    return curve.select("round", is_loss.alias("is_loss"), ((F.col("round") == 1) | (F.col("train_loss") < first)).alias("falls"))


@query("mlp", PROBABLE_SQL)
def mlp(spark, sf):
    frame = docs(spark, sf)
    train, val = parts(frame)
    scaler = fit_scaler(train, FEATURES)
    model = M.perceptron(FEATURES, "label", hidden=(20,), iterations=50).fit(apply_scaler(train, scaler))
    return _probabilities(model, apply_scaler(val, scaler))


_P = {n: md5_uniform(f"concat('{n}:', doc_id)") for n in "abc"}


@query("vote", f"""select doc_id, round(({_P['a']} + {_P['b']} + {_P['c']}) / 3, 6) as soft, (({_P['a']} + {_P['b']} + {_P['c']}) / 3 >= 0.5)::int as soft_label,
  (({_P['a']} >= 0.5)::int + ({_P['b']} >= 0.5)::int + ({_P['c']} >= 0.5)::int >= 2)::int as hard_label from documents""")
def vote(spark, sf):
    from ..operators.ordering import hash_uniform

    rows = table(spark, sf, "documents").select("doc_id")
    outputs = [rows.select("doc_id", hash_uniform(F.concat(F.lit(f"{n}:"), F.col("doc_id"))).alias("p")) for n in "abc"]
    soft = M.vote(outputs, "doc_id").select("doc_id", rounded("probability").alias("soft"), F.col("prediction").alias("soft_label"))
    hard = M.vote(outputs, "doc_id", "hard").select("doc_id", F.col("prediction").alias("hard_label"))
    return soft.join(hard, "doc_id")


@query("stack", PROBABLE_SQL)
def stack(spark, sf):
    train, val = parts(docs(spark, sf))
    n = train.count()
    bases = {"lr": M.logistic_regression(FEATURES, "label", n), "rf": M.random_forest(FEATURES, "label", trees=10, depth=4)}
    out, _ = M.stack(bases, lambda inputs: M.logistic_regression(inputs, "label", n), train, val, "doc_id", "label", FEATURES, k=3)
    return _judged(out)


@query("cv_scores", """select name, true as is_score, true as agrees from (select 'fold_' || n as name from range(0, 5) as t(n)
  union all select unnest(['mean', 'std', 'validation', 'gap_flag']))""")
def cv_scores(spark, sf):
    """Five folds; mean, spread and the flag agree with them."""
    train, val = parts(docs(spark, sf))
    estimator = M.logistic_regression(FEATURES, "label", train.count())
    scores = M.cross_validate(estimator, train, "doc_id", "label")
    validation = M.evaluator("roc_auc", "label").evaluate(estimator.fit(train).transform(val))
    rows = {r["name"]: r["value"] for r in M.cv_table(spark, scores, validation).collect()}
    folds = [v for n, v in rows.items() if n.startswith("fold_")]
    mean = sum(folds) / len(folds)
    agrees = {"mean": abs(rows["mean"] - mean) < 1e-9, "std": abs(rows["std"] ** 2 - sum((f - mean) ** 2 for f in folds) / len(folds)) < 1e-9}
    agrees["gap_flag"] = rows["gap_flag"] == float(abs(mean - rows["validation"]) > 0.05)
    return small_table(spark, [(n, 0 <= v <= 1, agrees.get(n, len(folds) == 5)) for n, v in rows.items()], "name string, is_score boolean, agrees boolean")


@query("tune_search", "select n::int as trial, true as inside, true as best from range(0, 3) as t(n)")
def tune_search(spark, sf):
    """Settings inside their ranges, and the best ones returned."""
    train, _ = parts(docs(spark, sf))
    space = {"trees": ("int", 5, 15), "depth": ("int", 2, 5)}
    best, trials = M.search(lambda **s: M.random_forest(FEATURES, "label", **s), space, train, "doc_id", "label", trials=3, k=3)
    top = trials.agg(F.max("score")).first()[0]
    rows = [(r["trial"], eval(r["settings"], {}), r["score"], r["state"]) for r in trials.collect()]  # written by the search itself
    inside = lambda s: all(low <= s[n] <= high for n, (_, low, high) in space.items())
    found = any(s == best and v == top for _, s, v, _ in rows)
    return small_table(spark, [(t, inside(s) and state == "done" and 0 <= v <= 1, found) for t, s, v, state in rows], "trial int, inside boolean, best boolean")


@query("champion", "select unnest(['logistic_regression', 'random_forest', 'boosting']) as model, true as fitted, true as best")
def champion(spark, sf):
    train, val = parts(docs(spark, sf))
    candidates = {
        "logistic_regression": M.logistic_regression(FEATURES, "label", train.count()),
        "random_forest": M.random_forest(FEATURES, "label", trees=20, depth=5),
        "boosting": M.boosting(FEATURES, "label", rounds=10, rate=0.1, depth=3),
    }
    name, model, table_ = M.choose_champion(candidates, train, val, "label", "roc_auc", baseline=0.5)
    top = table_.agg(F.max("score")).first()[0]
    again = float(M.evaluator("roc_auc", "label").evaluate(model.transform(val)))
    best = (F.col("champion") == (F.col("model") == name).cast("int")) & ((F.col("champion") == 0) | (F.col("score") == top) & F.lit(abs(again - top) < 1e-6))
    return table_.where("model <> 'baseline'").select("model", (F.col("state") == "fitted").alias("fitted"), best.alias("best"))


@query("permutation_importance", f"select col0 as feature, true as is_loss, true as used from (values {_NAMES}, ('unused'))")
def permutation_importance(spark, sf):
    """A feature the model does not use loses nothing when it is shuffled."""
    train, val = parts(docs(spark, sf))
    model = M.logistic_regression(FEATURES, "label", train.count()).fit(train)
    found = M.permutation_importance(model, val.withColumn("unused", F.col("doc_id").cast("double")), "doc_id", [*FEATURES, "unused"], "label", repeats=3)
    used = (F.col("feature") != "unused") | ((F.col("importance") == 0) & (F.col("std") == 0))
    return found.select("feature", (F.abs("importance") <= 1).alias("is_loss"), used.alias("used"))


@query("adversarial_validation", f"select col0 as feature, col0 <> 'f_length' as kept, true as alike from (values {_NAMES})")
def adversarial_validation(spark, sf):
    """Training rows against the same rows with one feature moved: that one is found, dropped, and the rest is alike."""
    from ..operators.shift import adversarial_validation as against

    train, val = parts(docs(spark, sf))
    moved = train.unionByName(val).withColumn("f_length", F.col("f_length") + 1_000_000.0)
    found = against(train, moved, "doc_id", FEATURES, k=3, rounds=10, rate=0.1, depth=3)
    return small_table(spark, [(f, f in found.features, found.verdict == "similar") for f in FEATURES], "feature string, kept boolean, alike boolean")


_CONFIDENT = md5_uniform("concat('pl:', doc_id)")


@query("pseudo_label_rows", f"select doc_id, ({_CONFIDENT} >= 0.5)::int as label from documents where greatest({_CONFIDENT}, 1 - {_CONFIDENT}) >= 0.95")
def pseudo_label_rows(spark, sf):
    from ..operators.ordering import hash_uniform
    from ..operators.score import confident_rows

    rows = table(spark, sf, "documents").select("doc_id", hash_uniform(F.concat(F.lit("pl:"), F.col("doc_id"))).alias("p"))
    return confident_rows(rows, "p", 0.95).select("doc_id", F.col("label").cast("int").alias("label"))


@query("pseudo_label", PROBABLE_SQL.replace("true as decides", "true as decides, true as added_are_sure"))
def pseudo_label(spark, sf):
    """Rows the first fit is sure of join the training rows with its answer."""
    train, val = parts(docs(spark, sf))
    estimator = M.logistic_regression(FEATURES, "label", train.count())
    model, added = M.pseudo_label(estimator, train, val.select("doc_id", *FEATURES), FEATURES, "label", 0.95)
    first = M.scored(estimator.fit(train), val.select("doc_id", *FEATURES), ["doc_id"])
    chance = F.greatest("prob_negative", "prob_positive")
    both = first.join(added.select("doc_id", F.col("label").alias("given")), "doc_id", "left")
    wrong = both.where(F.col("given").isNotNull() != (chance >= 0.95)).count() + both.where("given <> prediction").count()
    return _probabilities(model, val).withColumn("added_are_sure", F.lit(wrong == 0))
