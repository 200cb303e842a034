"""Split, leakage, resampling, selection and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import resample as R
from ..operators import select as L
from ..operators import split as J
from ..session import small_table
from .catalog import query, table
from .fixtures import DOC_FEATURES, DOC_FEATURES_SQL, labelled_docs, md5_order, md5_uniform
from .profile_queries import round_all

_QUOTA = """
  {name}_i as (select {label}, n, floor({total} * n / sum(n) over ()) as f, {total} * n / sum(n) over () - floor({total} * n / sum(n) over ()) as d
    from {source}),
  {name} as (select {label}, (f + (row_number() over (order by d desc, {label}) <= {total} - sum(f) over ())::int)::bigint as q from {name}_i)"""

HOLDOUT_SQL = f"""with c as (select toxic, count(*) as n from labels group by 1),
  k as (select ceil(0.15 * sum(n)) as t, ceil(0.15 / (1 - 0.15) * (sum(n) - ceil(0.15 * sum(n)))) as v from c),
  {_QUOTA.format(name='tq', label='toxic', total='(select t from k)', source='c')},
  rest as (select c.toxic, c.n - tq.q as n from c join tq on c.toxic = tq.toxic),
  {_QUOTA.format(name='vq', label='toxic', total='(select v from k)', source='rest')},
  ranked as (select doc_id, toxic, row_number() over (partition by toxic order by {md5_order(42, 'doc_id')}) as rn from labels)
  select doc_id, r.toxic, case when rn <= tq.q then 'test' when rn <= tq.q + vq.q then 'val' else 'train' end as split
  from ranked r join tq on r.toxic = tq.toxic join vq on r.toxic = vq.toxic"""


@query("split_holdout", HOLDOUT_SQL)
def split_holdout(spark, sf):
    return J.split_holdout(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "toxic")


_KFOLD = f"select event_id, event_type, ntile(5) over (partition by event_type order by {md5_order(42, 'event_id')}) - 1 as fold from events"


@query("split_kfold", _KFOLD)
def split_kfold(spark, sf):
    return J.split_kfold(table(spark, sf, "events").select("event_id", "event_type"), "event_id", "event_type")


@query("split_folds", f"select event_id, i::int as in_fold, case when fold = i then 'val' else 'train' end as role from ({_KFOLD}), range(5) t(i)")
def split_folds(spark, sf):
    return J.fold_table(J.split_kfold(table(spark, sf, "events").select("event_id", "event_type"), "event_id", "event_type"), "event_id")


_TS = """(select event_id, position, case when position > n - 5 * (n // 6) then ((position - 1 - (n - 5 * (n // 6))) // (n // 6))::int else -1 end as test_fold
  from (select event_id, row_number() over (order by ts, event_id) as position, count(*) over () as n from events))"""


@query("split_timeseries", f"select * from {_TS}")
def split_timeseries(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    return J.split_timeseries(events, ["ts", "event_id"]).select("event_id", "position", "test_fold")


@query("split_timeseries_folds", f"select i::int as fold, case when test_fold = i then 'test' else 'train' end as role, count(*) as n, min(position) as first, max(position) as last from {_TS}, range(5) t(i) where test_fold <= i group by 1, 2")
def split_timeseries_folds(spark, sf):
    marked = J.split_timeseries(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"])
    roles = J.timeseries_fold_table(marked.select("position", "test_fold"), "position")
    return roles.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("position").alias("first"), F.max("position").alias("last"))


@query("split_group", """with g as (select user_id, sum((event_type = 'error')::int) as p, count(*) as n from events group by 1),
  r as (select user_id, (row_number() over (order by p desc, n desc, user_id) - 1) % 10 as m from g)
  select event_id, e.user_id, (case when m < 5 then m else 9 - m end)::int as fold from events e join r on e.user_id = r.user_id""")
def split_group(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", (F.col("event_type") == "error").cast("int").alias("y"))
    return J.split_group(events, "user_id", "y").select("event_id", "user_id", "fold")


@query("leak_ids", "select distinct o_custkey from orders where o_orderstatus = 'F' and o_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
def leak_ids(spark, sf):
    orders = table(spark, sf, "orders")
    return J.shared_ids(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"), "o_custkey")


_LEAK = "(select case when event_id % 9 = 0 then null else event_type end as event_type, user_id, floor(value / 50) as level, event_id from events)"


@query("leak_rows", f"""with a as (select event_type, user_id, level, count(*) as n from {_LEAK} where event_id % 3 <> 0 group by 1, 2, 3),
  b as (select event_type, user_id, level, count(*) as n from {_LEAK} where event_id % 3 = 0 group by 1, 2, 3)
  select a.event_type, a.user_id, a.level, a.n as n_train, b.n as n_test, a.n * b.n as pairs from a join b
  on a.event_type is not distinct from b.event_type and a.user_id = b.user_id and a.level = b.level""")
def leak_rows(spark, sf):
    rows = table(spark, sf, "events").select(
        F.expr("case when event_id % 9 = 0 then null else event_type end").alias("event_type"), "user_id",
        F.floor(F.col("value") / 50).cast("double").alias("level"), "event_id",
    )
    keys = ["event_type", "user_id", "level"]
    return J.shared_rows(rows.where("event_id % 3 <> 0").select(*keys), rows.where("event_id % 3 = 0").select(*keys))


@query("leak_ks", " union all ".join(f"""select '{c}' as "column", round(max(abs(ca / na - cb / nb)), 9) as statistic, any_value(na)::bigint as n1, any_value(nb)::bigint as n2 from (
    select distinct x, sum(a) over (order by x)::double as ca, sum(b) over (order by x)::double as cb, sum(a) over () as na, sum(b) over () as nb
    from (select {c} as x, (l_orderkey % 4 <> 0)::int as a, (l_orderkey % 4 = 0)::int as b from lineitem))""" for c in ["l_quantity", "l_extendedprice"]))
def leak_ks(spark, sf):
    lines = table(spark, sf, "lineitem")
    cols = ["l_quantity", "l_extendedprice"]
    found = J.ks_statistics(lines.where("l_orderkey % 4 <> 0").select(*cols), lines.where("l_orderkey % 4 = 0").select(*cols))
    return round_all(found.select("column", "statistic", "n1", "n2"), 9)


@query("split_summary", f"""with s as ({HOLDOUT_SQL}), c as (select split, toxic, count(*) as n from s group by 1, 2)
  select split, toxic, n, round(n / sum(n) over (), 6) as share_of_table, round(n / sum(n) over (partition by split), 6) as share_of_split, (select count(distinct toxic) from s) as n_classes from c""")
def split_summary(spark, sf):
    return round_all(J.split_summary(split_holdout(spark, sf), "split", "toxic"))


@query("class_weights", """select doc_id, toxic, round((select count(*) from labels) / (2.0 * count(*) over (partition by toxic)), 6) as weight from labels""")
def class_weights(spark, sf):
    return round_all(R.with_weights(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic"))


@query("pos_weight", "select round(count(*) filter (toxic = 0)::double / count(*) filter (toxic = 1), 2) as weight from labels")
def pos_weight(spark, sf):
    return small_table(spark, [(R.positive_weight(table(spark, sf, "labels"), "toxic"),)], "weight double")


OVERSAMPLE_SQL = f"""select doc_id, toxic, 0::bigint as copy from labels union all
  select r.doc_id, r.toxic, d.copy from
   (select toxic, i as copy, floor({md5_uniform("concat('42:', toxic, ':', i)")} * n)::bigint + 1 as rank
     from (select toxic, n, unnest(range(1, need + 1)) as i from
       (select toxic, count(*) as n, max(count(*)) over () - count(*) as need from labels group by 1) where need > 0)) d
   join (select doc_id, toxic, row_number() over (partition by toxic order by {md5_order(42, 'doc_id')}) as rank from labels) r
   on d.toxic = r.toxic and d.rank = r.rank"""


@query("oversample", OVERSAMPLE_SQL)
def oversample(spark, sf):
    return R.oversample(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "toxic")


UNDERSAMPLE_SQL = f"select doc_id, toxic from labels qualify row_number() over (partition by toxic order by {md5_order(42, 'doc_id')}) <= (select min(n) from (select count(*) as n from labels group by toxic))"


@query("undersample", UNDERSAMPLE_SQL)
def undersample(spark, sf):
    return R.undersample(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "toxic")


@query("resample_report", f"select 'before' as stage, toxic, count(*) as n from labels group by 2 union all select 'after', toxic, count(*) from ({OVERSAMPLE_SQL}) group by 2")
def resample_report(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    return R.resample_report(labels, oversample(spark, sf), "toxic")


# Scores with many ties: hash of the row id, shifted for positives.
SCORES_SQL = f"""(select event_id, (event_type = 'error')::int as label,
  round(0.7::double * {md5_uniform("concat('s:', event_id)")} + 0.3::double * (event_type = 'error')::int, 2) as score from events)"""


def scores(spark, sf):
    from ..operators.ordering import hash_uniform

    label = (F.col("event_type") == "error").cast("int")
    return table(spark, sf, "events").select(
        "event_id",
        label.alias("label"),
        F.round(F.lit(0.7) * hash_uniform(F.concat(F.lit("s:"), F.col("event_id"))) + F.lit(0.3) * label, 2).alias("score"),
    )


_THRESHOLDS = {"f1": "2 * p * r / (p + r + 1e-8)", "precision": "p", "recall": "r", "gmean": "sqrt(p * r)"}


@query("best_threshold", f"""with c as (select score, sum(label) as pos, count(*) as n from {SCORES_SQL} group by 1),
  k as (select score as t, sum(pos) over (order by score desc) / (sum(n) over (order by score desc))::double as p,
    sum(pos) over (order by score desc) / (sum(pos) over ())::double as r from c)
  """ + " union all ".join(f"select * from (select '{m}' as metric, t as threshold, round({e}, 6) as score from k order by {e} desc, t limit 1)" for m, e in _THRESHOLDS.items()))
def best_threshold(spark, sf):
    return round_all(M.best_thresholds(scores(spark, sf), "label", "score", list(_THRESHOLDS)))


_AUC = f"(select sum(pos * (below + neg / 2.0::double)) / (any_value(tp) * any_value(tn)) from (select pos, neg, sum(neg) over (order by score) - neg as below, sum(pos) over () as tp, sum(neg) over () as tn from (select score, sum(label)::double as pos, sum(1 - label)::double as neg from {SCORES_SQL} group by 1)))"
_CONF = f"(select count(*) filter (label = 1 and score >= 0.5)::double as tp, count(*) filter (label = 0 and score >= 0.5)::double as fp, count(*) filter (label = 1 and score < 0.5)::double as fn, count(*) filter (label = 0 and score < 0.5)::double as tn from {SCORES_SQL})"


@query("class_metrics", f"""select 'accuracy' as metric, round((tp + tn) / (tp + tn + fp + fn), 6) as value from {_CONF}
  union all select 'f1', round((2 * tp / (2 * tp + fp + fn) * (tp + fn) + 2 * tn / (2 * tn + fn + fp) * (tn + fp)) / (tp + tn + fp + fn), 6) from {_CONF}
  union all select 'mcc', round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) from {_CONF}
  union all select 'roc_auc', round({_AUC}, 6)""")
def class_metrics(spark, sf):
    rows = scores(spark, sf).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    return M.metrics_table(spark, M.classification_metrics(rows, "label", "prediction", "score"))


@query("reg_metrics", """with r as (select l_extendedprice as y, l_quantity * 1500 + 100 as p from lineitem)
  select 'mae' as metric, round(avg(abs(y - p)), 4) as value from r union all select 'rmse', round(sqrt(avg((y - p) * (y - p))), 4) from r
  union all select 'r2', round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) from r""")
def reg_metrics(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500 + 100).alias("p"))
    return M.metrics_table(spark, M.regression_metrics(rows, "y", "p"), 4)


@query("confusion", f"select label, count(*) filter (score < 0.5) as predicted_0, count(*) filter (score >= 0.5) as predicted_1 from {SCORES_SQL} group by 1")
def confusion(spark, sf):
    rows = scores(spark, sf).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    return M.confusion_matrix(rows, "label", "prediction")


@query("class_report", f"""with k as (select tn / (tn + fn) as p0, tn / (tn + fp) as r0, 2 * tn / (2 * tn + fn + fp) as f0, tn + fp as s0,
    tp / (tp + fp) as p1, tp / (tp + fn) as r1, 2 * tp / (2 * tp + fp + fn) as f1, tp + fn as s1 from {_CONF})
  select '0' as class, round(p0, 6) as precision, round(r0, 6) as recall, round(f0, 6) as f1, s0::bigint as support from k
  union all select '1', round(p1, 6), round(r1, 6), round(f1, 6), s1::bigint from k
  union all select 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), (s0 + s1)::bigint from k
  union all select 'weighted avg', round((p0 * s0 + p1 * s1) / (s0 + s1), 6), round((r0 * s0 + r1 * s1) / (s0 + s1), 6), round((f0 * s0 + f1 * s1) / (s0 + s1), 6), (s0 + s1)::bigint from k""")
def class_report(spark, sf):
    rows = scores(spark, sf).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    return round_all(M.classification_report(rows, "label", "prediction"))


_TRAIN, _VAL = f"(select * from {DOC_FEATURES_SQL} where doc_id % 4 <> 0)", f"(select * from {DOC_FEATURES_SQL} where doc_id % 4 = 0)"


@query("baseline_metrics", f"""with g as (select quality as c from {_TRAIN} group by 1 order by count(*) desc, 1 limit 1),
  v as (select count(*)::double as n, count(*) filter (quality = g.c)::double as hit from {_VAL}, g)
  select 'accuracy' as metric, round(hit / n, 6) as value from v union all select 'f1', round(2 * hit / (hit + n) * hit / n, 6) from v union all select 'roc_auc', 0.5""")
def baseline_metrics(spark, sf):
    docs = labelled_docs(spark, sf)
    return M.metrics_table(spark, M.baseline(docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0"), "quality"))


@query("baseline_regression", f"""with g as (select avg(f_length) as m from {_TRAIN})
  select 'mae' as metric, round(avg(abs(f_length - m)), 4) as value from {_VAL}, g union all select 'rmse', round(sqrt(avg((f_length - m) * (f_length - m))), 4) from {_VAL}, g
  union all select 'r2', round(1 - avg((f_length - m) * (f_length - m)) / var_pop(f_length), 4) from {_VAL}, g""")
def baseline_regression(spark, sf):
    docs = labelled_docs(spark, sf)
    return M.metrics_table(spark, M.baseline(docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0"), "f_length", "regression"), 4)


@query("select_variance", "select * from (" + " union all ".join(f"""select '{c}' as "column" from lineitem having var_pop({c}) > 0.01""" for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) + ")")
def select_variance(spark, sf):
    kept = L.keep_varying(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return small_table(spark, [(c,) for c in kept], "column string")


_PAIRS = [(a, b) for i, a in enumerate(DOC_FEATURES) for b in DOC_FEATURES[i + 1:]]


@query("select_correlation", "select distinct \"column\" from (" + " union all ".join(
    f"""select case when abs(corr({a}, toxic)) < abs(corr({b}, toxic)) then '{a}' else '{b}' end as "column" from {DOC_FEATURES_SQL} having abs(corr({a}, {b})) > 0.95""" for a, b in _PAIRS) + ")")
def select_correlation(spark, sf):
    dropped = L.correlation_drops(labelled_docs(spark, sf), DOC_FEATURES, "toxic", 0.95)
    return small_table(spark, [(c,) for c in dropped], "column string")


def _mi_sql(c):
    inner = ", ".join(f"quantile_cont({c}, {i / 10}) as q{i}" for i in range(1, 10))
    cmp = " + ".join(f"({c} >= q{i})::int" for i in range(1, 10))
    return f"""select '{c}' as feature, sum(n / t * ln(n * t / (l * r))) as mi from (select n, sum(n) over () as t, sum(n) over (partition by b) as l, sum(n) over (partition by y) as r
      from (select {cmp} as b, toxic as y, count(*)::double as n from {DOC_FEATURES_SQL}, (select {inner} from {DOC_FEATURES_SQL}) group by 1, 2))"""


_MI = " union all ".join(_mi_sql(c) for c in DOC_FEATURES)


@query("select_mi", f"select feature, round(mi, 6) + 0.0 as importance from ({_MI})")
def select_mi(spark, sf):
    found = L.mutual_information(labelled_docs(spark, sf), DOC_FEATURES, "toxic")
    return small_table(spark, [(c, round(v, 6) + 0.0) for c, v in found.items()], "feature string, importance double")


@query("select_topn", f"select feature, round(mi, 6) + 0.0 as importance, (row_number() over (order by mi desc))::int as rank, (row_number() over (order by mi desc) <= 3)::int as selected from ({_MI})")
def select_topn(spark, sf):
    found = L.mutual_information(labelled_docs(spark, sf), DOC_FEATURES, "toxic")
    return L.ranking_table(spark, found, L.top_features(found))
