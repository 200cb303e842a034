"""Explanation, registry, scoring, end-to-end training and streaming queries."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..config import TrainingConfig
from ..functions.roles import rounded
from ..operators import explain as X
from ..operators import models as M
from ..operators import score as P
from ..operators.ordering import hash_uniform
from ..operators.select import ranking_table, top_features
from ..operators.stages import TableStage
from ..operators.url_table import lexical_table
from ..session import small_table
from ..sources import registry as G
from ..sources.tables import scratch_folder
from ..streaming import scoring as S
from ..training import prepare_only, train
from .catalog import query, table, table_stream
from .fixtures import DOC_FEATURES, DOC_FEATURES_SQL, labelled_docs, md5_uniform
from .model_queries import PROBABLE_SQL, RANKED_SQL, _close, _HELD, _probabilities, _ranked, docs, parts
from .profile_queries import round_all

FEATURES = DOC_FEATURES


ADDS_UP_SQL = f"select doc_id, true as adds_up, true as explained from {_HELD}"


def _adds_up(explained, output, base):
    """Contributions and base make the model's output for every row, and there is one for each feature."""
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x) + F.lit(float(base))
    return explained.select("doc_id", _close(total, output, 1e-5).alias("adds_up"), (F.size("contributions") == len(FEATURES)).alias("explained"))


@query("tree_shap", ADDS_UP_SQL)
def tree_shap(spark, sf):
    rows, val = parts(docs(spark, sf))
    model = M.random_forest(FEATURES, "label", trees=20, depth=5).fit(rows)
    explained, base = X.tree_contributions(val, model.stages[-1], FEATURES)
    chances = M.scored(model, val, ["doc_id"]).select("doc_id", "prob_positive")
    return _adds_up(explained.join(chances, "doc_id"), F.col("prob_positive"), base)


@query("tree_shap_boosting", ADDS_UP_SQL)
def tree_shap_boosting(spark, sf):
    rows, val = parts(docs(spark, sf))
    model = M.boosting(FEATURES, "label", rounds=10, rate=0.1, depth=3).fit(rows)
    explained, base = X.tree_contributions(val, model.stages[-1], FEATURES)
    margin = model.transform(val).select("doc_id", vector_to_array("rawPrediction")[1].alias("margin"))
    return _adds_up(explained.join(margin, "doc_id"), F.col("margin"), base)


@query("select_shap", RANKED_SQL)
def select_shap(spark, sf):
    frame = docs(spark, sf)
    model = M.random_forest(FEATURES, "label", trees=20, depth=6).fit(frame)
    explained, _ = X.tree_contributions(frame, model.stages[-1], FEATURES)
    found = {r["feature"]: r["mean_abs"] for r in X.importance_table(X.long_contributions(explained, "doc_id", FEATURES)).collect()}
    return _ranked(spark, {f: found[f] for f in FEATURES}, whole=False)


# Fixed coefficients, so that the contributions can be checked by SQL.
COEFFICIENTS = {"f_length": 0.001, "f_spaces": -0.004, "f_dots": 0.02, "f_digits": 0.05, "f_upper": -0.01, "f_lines": 0.03}
_LIN = {f: f"({w} * ({f} - (select avg({f}) from {DOC_FEATURES_SQL})))" for f, w in COEFFICIENTS.items()}


@query("linear_shap", "select doc_id, " + ", ".join(f"round({e}, 6) + 0.0 as {f}" for f, e in _LIN.items()) + f" from {DOC_FEATURES_SQL}")
def linear_shap(spark, sf):
    explained = X.linear_contributions(labelled_docs(spark, sf), COEFFICIENTS)
    return explained.select("doc_id", *[rounded(F.col("contributions")[i]).alias(f) for i, f in enumerate(COEFFICIENTS)])


@query("sampled_shap", ADDS_UP_SQL)
def sampled_shap(spark, sf):
    """Against one background row every order of the features ends at the same sum: the row's output less the background's."""
    rows, val = parts(docs(spark, sf))
    model = M.logistic_regression(FEATURES, "label", rows.count()).fit(rows)
    background = rows.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(1).persist()
    made = X.sampled_contributions(val, background, model, "doc_id", FEATURES, permutations=4)
    base = M.scored(model, background, ["doc_id"]).first()["prob_positive"]
    chances = M.scored(model, val, ["doc_id"]).select("doc_id", "prob_positive")
    return _adds_up(made.join(chances, "doc_id"), F.col("prob_positive"), base)


def _linear_long(spark, sf):
    explained = X.linear_contributions(labelled_docs(spark, sf), COEFFICIENTS)
    return explained, X.long_contributions(explained, "doc_id", list(COEFFICIENTS))


_LONG = " union all ".join(f"select doc_id, '{f}' as feature, {f} as value, {e} as c from {DOC_FEATURES_SQL}" for f, e in _LIN.items())


@query("shap_importance", f"""select feature, round(avg(abs(c)), 6) as mean_abs, round(avg(round(c, 6)), 4) + 0.0 as mean, round(avg((c > 0)::int::double), 6) as pct_positive,
  (row_number() over (order by avg(abs(c)) desc, feature))::int as rank from ({_LONG}) group by 1""")
def shap_importance(spark, sf):
    _, long = _linear_long(spark, sf)
    made = X.importance_table(long)
    return made.select("feature", rounded("mean_abs").alias("mean_abs"), rounded("mean", 4).alias("mean"), rounded("pct_positive").alias("pct_positive"), "rank")


@query("top_reasons", f"""select doc_id, (row_number() over (partition by doc_id order by abs(c) desc, i))::int as place, feature, value, round(c, 6) + 0.0 as shap,
  case when c > 0 then 'phishing' else 'legit' end as direction from (""" + " union all ".join(
    f"select doc_id, {i} as i, '{f}' as feature, {f} as value, {e} as c from {DOC_FEATURES_SQL}" for i, (f, e) in enumerate(_LIN.items())) + ") qualify place <= 5")
def top_reasons(spark, sf):
    explained, _ = _linear_long(spark, sf)
    reasons = X.top_reasons(explained, list(COEFFICIENTS)).select("doc_id", F.posexplode("top_features").alias("pos", "t"))
    return reasons.select(
        "doc_id", (F.col("pos") + 1).cast("int").alias("place"), "t.feature", "t.value", rounded("t.shap").alias("shap"), "t.direction"
    )


@query("shap_dependence", f"select doc_id, value, round(c, 6) + 0.0 as contribution from ({_LONG}) where feature = 'f_digits'")
def shap_dependence(spark, sf):
    _, long = _linear_long(spark, sf)
    return round_all(X.dependence(long, "f_digits"))


@query("shap_waterfall", f"""with w as (select feature, value, c, (row_number() over (order by abs(c) desc, feature))::int as step from ({_LONG}) where doc_id = (select max(doc_id) from {DOC_FEATURES_SQL}))
  select feature, value, round(c, 6) + 0.0 as contribution, step, round(0.1 + sum(c) over (order by step), 6) + 0.0 as output from w""")
def shap_waterfall(spark, sf):
    explained, long = _linear_long(spark, sf)
    last = explained.agg(F.max("doc_id")).first()[0]
    return round_all(X.waterfall(long, "doc_id", last, 0.1))


_REG = "(select p_brand as model, min(p_partkey) as v, max(p_retailprice) as auc from part group by 1)"


@query("registry_list", f"""select model, concat('v', lpad(cast(v as varchar), 8, '0')) as version, round(auc / 3000, 6) as auc,
  (auc = (select max(auc) from {_REG}) and v = (select max(v) from {_REG} where auc = (select max(auc) from {_REG})))::int as is_champion from {_REG}""")
def registry_list(spark, sf):
    """A registry log made of one version per brand, the best price standing in for the metric."""
    brands = table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("v"), F.max("p_retailprice").alias("auc"))
    rows = [(r["p_brand"], "v" + str(r["v"]).zfill(8), r["auc"] / 3000, r["v"]) for r in brands.collect()]
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, timezone.utc)
    log = [("saved", m, v, at(i), f"/models/{m}/{v}", {"auc": a}, {}, []) for m, v, a, i in rows]
    best = max(rows, key=lambda r: (r[2], r[3]))
    log += [("champion", rows[0][0], rows[0][1], at(10**7), "", {}, {}, []), ("champion", best[0], best[1], at(10**7 + 1), "", {}, {}, [])]
    listed = G.list_versions(G.registry_rows(spark, log))
    return listed.select("model", "version", rounded(F.col("metrics")["auc"]).alias("auc"), "is_champion")


@query("registry_save_load", f"select doc_id, true as equal from {_HELD}")
def registry_save_load(spark, sf):
    rows, val = parts(docs(spark, sf))
    registry = G.ModelRegistry(spark, scratch_folder(spark, "registry"))
    held = None
    for name, estimator in (("lr", M.logistic_regression(FEATURES, "label", rows.count())), ("rf", M.random_forest(FEATURES, "label", trees=5, depth=3))):
        model = estimator.fit(rows)
        registry.save(model, name, {"roc_auc": M.evaluator("roc_auc", "label").evaluate(model.transform(val))}, {"kind": name}, FEATURES, champion=name == "lr")
        held = model if name == "lr" else held
    again = registry.load(champion=True)
    return _equal(M.scored(held, val, ["doc_id"]), M.scored(again, val, ["doc_id"]), "doc_id")


def _equal(left, right, *keys):
    """The keys of either side, and whether their rows are the same."""
    columns = [c for c in left.columns if c not in keys]
    packed = lambda df, name: df.select(*keys, F.struct(*[F.col(f"`{c}`") for c in columns]).alias(name))
    both = packed(left, "l").join(packed(right, "r"), list(keys), "full")
    return both.select(*keys, F.coalesce(F.to_json("l") == F.to_json("r"), F.lit(False)).alias("equal"))


def _stages():
    keep = ["doc_id", "label"]
    return [
        TableStage("impute", keep=keep), TableStage("outliers", keep=keep), TableStage("encode", keep=keep, target="label", threshold=5),
        TableStage("scale", keep=keep), TableStage("select", keep=keep, target="label", share=0.7),
    ]


def mixed_docs(spark, sf):
    holes = [F.expr(f"case when doc_id % {n} = 0 then null else {c} end").alias(c) for c, n in (("f_digits", 5), ("f_upper", 7))]
    return labelled_docs(spark, sf).select("doc_id", "f_length", "f_spaces", "f_dots", *holes, "lang", "source", F.col("toxic").cast("double").alias("label"))


@query("transform_new", f"select doc_id, toxic::double as label, true as complete, true as selected from {_HELD}")
def transform_new(spark, sf):
    """New rows keep key and label, and have a value for each selected feature and nothing else."""
    rows, val = parts(mixed_docs(spark, sf))
    model = prepare_only(rows, _stages())
    out = model.transform(val)
    features = model.stages[-1].values()["selected"]
    complete = F.array_contains(F.array(*[F.col(f"`{f}`").isNull() for f in features]), False) & ~F.array_contains(F.array(*[F.col(f"`{f}`").isNull() for f in features]), True)
    return out.select("doc_id", "label", complete.alias("complete"), F.lit(sorted(out.columns) == sorted(["doc_id", "label", *features])).alias("selected"))


@query("model_roundtrip", f"select doc_id, true as equal from {_HELD}")
def model_roundtrip(spark, sf):
    from pyspark.ml import PipelineModel

    rows, val = parts(mixed_docs(spark, sf))
    prepared = prepare_only(rows, _stages())
    folder = scratch_folder(spark, "prepared")
    prepared.write().overwrite().save(folder)
    return _equal(prepared.transform(val), PipelineModel.load(folder).transform(val), "doc_id")


@query("predict_proba", PROBABLE_SQL)
def predict_proba(spark, sf):
    rows, val = parts(docs(spark, sf))
    return _probabilities(M.random_forest(FEATURES, "label", trees=10, depth=4).fit(rows), val)


_PR = md5_uniform("concat('p:', page_id)")


def page_scores(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", hash_uniform(F.concat(F.lit("p:"), F.col("page_id"))).alias("probability"))


@query("decide", f"""select page_id, round({_PR}, 6) as probability, case when {_PR} >= 0.4 then 'PHISHING' else 'LEGITIMATE' end as label,
  case when {_PR} >= 0.4 then (case when {_PR} > 0.9 then 'HIGH' when {_PR} > 0.7 then 'MEDIUM' else 'LOW' end)
    else (case when {_PR} < 0.1 then 'HIGH' when {_PR} < 0.3 then 'MEDIUM' else 'LOW' end) end as confidence, 0.4::double as threshold from pages""")
def decide(spark, sf):
    return round_all(P.decide(page_scores(spark, sf), "probability", 0.4).drop("url"))


@query("prediction_log", f"""select md5(url) as url_hash, ({_PR} >= 0.5)::int as is_phishing, round({_PR}, 6) as probability, 'v1' as model_version, 0 as is_punycode,
  null::double as inference_ms, length(url)::double as length_url, (length(url) - length(replace(url, '.', '')))::double as qty_dot_url from pages""")
def prediction_log(spark, sf):
    scored = P.decide(lexical_table(page_scores(spark, sf), "url"), "probability")
    made = P.prediction_log(scored, "url", "probability", "label", "v1", ["length_url", "qty_dot_url"])
    return round_all(made.select("*", F.col("all_features")["length_url"].alias("length_url"), F.col("all_features")["qty_dot_url"].alias("qty_dot_url")).drop("all_features"))


URL_INPUTS = ["domain_length", "qty_dot_domain", "qty_hyphen_domain", "qty_vowels_domain", "length_url"]


def url_model(spark, sf):
    """A model on page URLs; the label marks hosts that advertise themselves in their name. A page without an address has neither features nor a label."""
    rows = lexical_table(table(spark, sf, "pages").select("page_id", "url").where(F.col("url").isNotNull()), "url")
    label = F.col("url").rlike("spam|cheap|casino|pills").cast("double")
    rows = rows.select("page_id", *URL_INPUTS, label.alias("label"))
    return M.logistic_regression(URL_INPUTS, "label", rows.count()).fit(rows)


_ACCEPTED = "(select * from pages where regexp_matches(url, '^https?://'))"


@query("batch_score", f"select page_id, url, true as in_range, true as decided, 0.5::double as threshold from {_ACCEPTED}")
def batch_score(spark, sf):
    """Pages with a web address, each with a chance and the label and confidence that follow from it."""
    scored = S.score_urls(table(spark, sf, "pages").select("page_id", "url"), url_model(spark, sf))
    p = F.col("probability")
    side = F.greatest(p, 1 - p)
    confidence = F.when(side > 0.9, "HIGH").when(side > 0.7, "MEDIUM").otherwise("LOW")
    decided = (F.col("label") == F.when(p >= 0.5, "PHISHING").otherwise("LEGITIMATE")) & (F.col("confidence") == confidence)
    return scored.select("page_id", "url", p.between(0, 1).alias("in_range"), decided.alias("decided"), "threshold")


def _page_stream(spark, sf):
    return table_stream(spark, sf, "pages").select("page_id", "url")


_SCORES = ["page_id", "url", "probability", "label", "confidence", "threshold"]


@query("stream_score", f"select page_id, true as equal from {_ACCEPTED}")
def stream_score(spark, sf):
    """The stream's rows are those of the batch."""
    base, model = scratch_folder(spark, "scores"), url_model(spark, sf)
    scored = S.stream_scores(spark, _page_stream(spark, sf), model, f"{base}/out", f"{base}/state").select(*_SCORES)
    batch = S.score_urls(table(spark, sf, "pages").select("page_id", "url"), model).select(*_SCORES)
    return _equal(batch, scored, "page_id")


@query("stream_prediction_log", f"""select md5(url) as url_hash, count(*) as n, true as in_range, true as decided, 'v1' as model_version from {_ACCEPTED} group by 1""")
def stream_prediction_log(spark, sf):
    """A log row for each accepted page, under the digest of its address."""
    base = scratch_folder(spark, "log")
    made = S.stream_prediction_log(spark, _page_stream(spark, sf), url_model(spark, sf), "v1", URL_INPUTS, f"{base}/out", f"{base}/state")
    p = F.col("probability")
    return made.groupBy("url_hash", "model_version").agg(
        F.count(F.lit(1)).alias("n"), F.every(p.between(0, 1)).alias("in_range"), F.every(F.col("is_phishing") == (p >= 0.5).cast("int")).alias("decided")
    )


_EV = md5_uniform("concat('m:', event_id)")
_MONITOR = f"""select date_trunc('hour', ts) as window_start, count(*) as n, round(avg(({_EV} >= 0.5)::int::double), 6) as positive_share,
  round(avg({_EV}), 6) as mean_probability, round(avg(value), 6) as mean_latency from events group by 1"""


def _scored_events(events):
    return events.select("ts", hash_uniform(F.concat(F.lit("m:"), F.col("event_id"))).alias("probability"), "value")


def _windows(df):
    return round_all(df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


@query("monitor_hourly", _MONITOR)
def monitor_hourly(spark, sf):
    return _windows(S.monitor(_scored_events(table(spark, sf, "events")), "ts", "probability", "value"))


@query("monitor_stream", _MONITOR)
def monitor_stream(spark, sf):
    base = scratch_folder(spark, "monitor")
    stream = table_stream(spark, sf, "events")
    return _windows(S.stream_monitor(spark, _scored_events(stream), "ts", "probability", "value", f"{base}/out", f"{base}/state"))


@query("train_end_to_end", f"""select true as is_best, true as says_so, true as in_range, true as threshold_in_range, doc_id, true as scored from {_HELD}""")
def train_end_to_end(spark, sf):
    """The champion has the best validation score, the table says so where the baseline is not beaten, and the whole pipeline scores rows it has not seen."""
    config = TrainingConfig.from_dict(
        {
            "data": {"target": "label", "row_id": "doc_id"},
            "encoding": {"threshold": 5},
            "modeling": {
                "models": ["logistic_regression", "random_forest", "boosting"],
                "settings": {"random_forest": {"trees": 20, "depth": 5}, "boosting": {"rounds": 10, "rate": 0.1, "depth": 3}},
            },
        }
    )
    rows, val = parts(mixed_docs(spark, sf))
    result = train(rows, config)
    table_ = {r["model"]: r for r in result.scores.collect()}  # a row for each candidate
    fitted = {name: r["score"] for name, r in table_.items() if r["state"] == "fitted"}
    reference = result.baseline.get("roc_auc")
    says_so = ("baseline" in table_) == (reference is not None and not max(fitted.values()) > reference)
    in_range = all(-1 <= float(v) <= 1 for v in result.test_metrics.values())
    chance = vector_to_array("probability")[1]
    out = result.model.transform(val)
    return out.select(
        "doc_id", F.lit(fitted[result.champion] == max(fitted.values())).alias("is_best"), F.lit(says_so).alias("says_so"), F.lit(in_range).alias("in_range"),
        F.lit(0 <= result.threshold <= 1).alias("threshold_in_range"), chance.between(0, 1).alias("scored"),
    )
