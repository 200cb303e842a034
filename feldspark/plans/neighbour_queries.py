"""Neighbour-based queries.

The SQL counterparts compare all pairs of the labelled documents, a small table; the
larger tables run without one and are checked against brute force in the tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forest as IF
from ..operators import neighbours as N
from ..operators import synthetic as S
from .catalog import query, table
from .fixtures import DOC_FEATURES_SQL, labelled_docs
from .profile_queries import round_all

AXES = ["f_length", "f_digits", "f_upper"]
_D2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in AXES)
_D = f"(select doc_id, {', '.join(AXES)}, toxic from {DOC_FEATURES_SQL})"


def _near(k, where="true"):
    return f"""(select a.doc_id, b.doc_id as neighbour, sqrt({_D2}) as distance, a.toxic as own, b.toxic as other,
      (row_number() over (partition by a.doc_id order by {_D2}, b.doc_id))::int as rank
      from {_D} a join {_D} b on a.doc_id <> b.doc_id and {where} qualify rank <= {k})"""


@query("knn_join", f"select doc_id, neighbour, round(distance, 6) as distance, rank from {_near(5)}")
def knn_join(spark, sf):
    docs = labelled_docs(spark, sf)
    return round_all(N.nearest(docs, docs, "doc_id", "doc_id", AXES, 5, exclude_same_id=True))


@query("knn_join_events", """select event_id, neighbour, round(sqrt(d), 6) + 0.0 as distance, rank from (
  select a.event_id, b.event_id as neighbour, d,
    row_number() over (partition by a.event_id order by d, b.event_id)::int as rank
  from (select x.event_id as left_id, y.event_id as right_id,
      (x.value - y.value) * (x.value - y.value) + (x.user_id - y.user_id)::double * (x.user_id - y.user_id) as d
    from events x join events y on x.event_type = y.event_type and x.event_id <> y.event_id) p
  join events a on a.event_id = p.left_id join events b on b.event_id = p.right_id) where rank <= 5""")
def knn_join_events(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user"), "event_type")
    return round_all(N.nearest(events, events, "event_id", "event_id", ["value", "user"], 5, "event_type", True))


_HOLES = {"f_digits": 5, "f_upper": 7, "f_lines": 11}
_HOLED = "(select doc_id, " + ", ".join(f"case when doc_id % {m} = 0 then null else {c} end as {c}" for c, m in _HOLES.items()) + f" from {DOC_FEATURES_SQL})"
_SHARED = " + ".join(f"(a.{c} is not null and b.{c} is not null)::int" for c in _HOLES)
_PART = " + ".join(f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0)" for c in _HOLES)


def _fill_sql(c):
    return f"""(select doc_id, avg(v) as g from (select a.doc_id, b.{c} as v from {_HOLED} a join {_HOLED} b
      on a.{c} is null and b.{c} is not null and ({_SHARED}) > 0
      qualify row_number() over (partition by a.doc_id order by round(sqrt({_PART}) * sqrt(3.0::double / ({_SHARED})), 9), b.doc_id) <= 5) group by 1)"""


@query("impute_knn", "select h.doc_id, " + ", ".join(
    f"round(coalesce(h.{c}, g_{c}.g, (select avg({c}) from {_HOLED})), 6) as {c}" for c in _HOLES) + f" from {_HOLED} h " + " ".join(
    f"left join {_fill_sql(c)} g_{c} on g_{c}.doc_id = h.doc_id" for c in _HOLES))
def impute_knn(spark, sf):
    holes = [F.expr(f"case when doc_id % {m} = 0 then null else {c} end").alias(c) for c, m in _HOLES.items()]
    return round_all(N.knn_fills(labelled_docs(spark, sf).select("doc_id", *holes), "doc_id", list(_HOLES), 5))


@query("outlier_lof", f"""with n as (select * from {_near(20)}), kd as (select doc_id, max(distance) as kd from n group by 1),
  l as (select n.doc_id, 1 / (avg(greatest(n.distance, kd.kd)) + 1e-10) as lrd from n join kd on n.neighbour = kd.doc_id group by 1)
  select n.doc_id, round(avg(o.lrd) / any_value(l.lrd), 5) as lof from n join l o on n.neighbour = o.doc_id join l on n.doc_id = l.doc_id group by 1""")
def outlier_lof(spark, sf):
    return round_all(N.local_outlier_factor(labelled_docs(spark, sf), "doc_id", AXES, 20), 5)


@query("outlier_lof_novelty", f"""select doc_id, true as positive, true as flagged, (select count(*) from {_D} where doc_id % 4 <> 0) as n_train from {_D}""")
def outlier_lof_novelty(spark, sf):
    """Old and new rows scored against the training rows; flags are scores above the cut, which few training rows exceed."""
    docs = labelled_docs(spark, sf).select("doc_id", *AXES)
    train = docs.where("doc_id % 4 <> 0")
    scored = N.score_lof(docs, "doc_id", N.fit_lof(train, "doc_id", AXES, 20, 0.05)).persist()
    cut = scored.where("is_outlier_multivariate = 1").agg(F.min("lof")).first()[0]
    n = train.count()
    few = scored.where("doc_id % 4 <> 0 and is_outlier_multivariate = 1").count() <= 0.08 * n
    flagged = (F.col("is_outlier_multivariate") == (F.col("lof") >= F.lit(cut)).cast("int")) & F.lit(few)
    return scored.select("doc_id", (F.col("lof") > 0).alias("positive"), flagged.alias("flagged"), F.lit(n).cast("bigint").alias("n_train"))


@query("outlier_iforest", """select l_orderkey || '-' || l_linenumber || '-' || l_partkey as id, true as in_range, true as flagged,
  (select count(*) from lineitem) as n from lineitem""")
def outlier_iforest(spark, sf):
    """Scores between 0 and 1, and flags on the twentieth with the highest ones."""
    lines = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), "l_quantity", "l_extendedprice", "l_discount"
    )
    fitted = IF.fit_isolation_forest(lines, "id", ["l_quantity", "l_extendedprice", "l_discount"])
    scored = IF.score_isolation_forest(lines, fitted).select("id", "anomaly_score", "is_outlier_multivariate").persist()
    n, share = scored.agg(F.count(F.lit(1)), F.avg("is_outlier_multivariate")).first()
    flagged = (F.col("is_outlier_multivariate") == (F.col("anomaly_score") > F.lit(fitted["cutoff"])).cast("int")) & F.lit(0.03 < share <= 0.05)
    return scored.select("id", F.col("anomaly_score").between(0, 1).alias("in_range"), flagged.alias("flagged"), F.lit(n).cast("bigint").alias("n"))


def _made(spark, sf, rows, kinds=()):
    """By class: original and made rows, and whether each made one lies between its base and neighbour, both of its class."""
    docs = labelled_docs(spark, sf).select("doc_id", F.col("toxic").alias("own"), *AXES, *kinds)
    base = docs.select(F.col("doc_id").alias("a_id"), F.col("own").alias("a_own"), *[F.col(c).alias(f"a_{c}") for c in AXES])
    other = docs.select(F.col("doc_id").alias("b_id"), F.col("own").alias("b_own"), *[F.col(c).alias(f"b_{c}") for c in AXES])
    joined = rows.join(base, F.col("doc_id") == F.col("a_id"), "left").join(other, F.col("neighbour") == F.col("b_id"), "left")
    inside = (F.col("toxic") == F.col("a_own")) & (F.col("toxic") == F.col("b_own"))
    for c in AXES:
        low, high = F.least(f"a_{c}", f"b_{c}"), F.greatest(f"a_{c}", f"b_{c}")
        inside &= F.col(c).between(low - 1e-6, high + 1e-6)
    made = F.col("copy") > 0
    return joined.groupBy("toxic").agg(
        F.count(F.when(~made, 1)).alias("n_original"), F.count(F.when(made, 1)).alias("n_made"), F.every(~made | inside).alias("between")
    )


_GROWN_SQL = f"""select toxic, count(*) as n_original, (select max(n) from (select count(*) as n from {_D} group by toxic)) - count(*) as n_made,
  true as between from {_D} group by 1"""


@query("smote", _GROWN_SQL)
def smote(spark, sf):
    return _made(spark, sf, S.smote(labelled_docs(spark, sf), "doc_id", "toxic", AXES))


@query("smotenc", _GROWN_SQL.replace("true as between", "true as between, (select count(distinct lang) from documents) as n_kinds"))
def smotenc(spark, sf):
    """Made rows take a kind that exists."""
    rows = S.smotenc(labelled_docs(spark, sf), "doc_id", "toxic", AXES, ["lang"]).persist()
    kinds = rows.agg(F.count_distinct("lang")).first()[0]
    return _made(spark, sf, rows, ["lang"]).withColumn("n_kinds", F.lit(kinds).cast("bigint"))


@query("adasyn", f"select toxic, count(*) as n_original, true as near_goal, true as between from {_D} group by 1")
def adasyn(spark, sf):
    """Quotas are rounded row by row, so a class grows to the largest one give or take half a row for each of its own."""
    made = _made(spark, sf, S.adasyn(labelled_docs(spark, sf), "doc_id", "toxic", AXES)).persist()
    most = made.agg(F.max("n_original")).first()[0]
    near = F.abs(F.col("n_original") + F.col("n_made") - most) <= F.col("n_original") / 2
    return made.select("toxic", "n_original", (near | (F.col("n_original") == most)).alias("near_goal"), "between")


@query("tomek_links", f"""with n as (select * from {_near(1)}) select doc_id, toxic from {_D} where doc_id not in
  (select a.doc_id from n a join n b on a.neighbour = b.doc_id and b.neighbour = a.doc_id where a.own <> a.other)""")
def tomek_links(spark, sf):
    return S.remove_tomek_links(labelled_docs(spark, sf), "doc_id", "toxic", AXES, "all").select("doc_id", "toxic")


@query("enn", f"select doc_id, toxic from {_D} where doc_id not in (select doc_id from {_near(3)} where own <> other)")
def enn(spark, sf):
    return S.edited_neighbours(labelled_docs(spark, sf), "doc_id", "toxic", AXES).select("doc_id", "toxic")


_CLEANED_SQL = f"""select toxic, true as between, true as no_more, true as some_made from {_D} group by 1"""


def _cleaned(spark, sf, rows):
    """Cleaning only takes rows away: no class has more than the largest, made rows lie between rows, and the small class has some."""
    made = _made(spark, sf, rows).persist()
    docs = labelled_docs(spark, sf).groupBy("toxic").count().persist()
    most, fewest = docs.agg(F.max("count"), F.min("count")).first()
    held = made.join(docs, "toxic")
    no_more = (F.col("n_original") <= F.col("count")) & (F.col("n_original") + F.col("n_made") <= most)
    return held.select("toxic", "between", no_more.alias("no_more"), ((F.col("count") != fewest) == (F.col("n_made") == 0)).alias("some_made"))


@query("smote_tomek", _CLEANED_SQL)
def smote_tomek(spark, sf):
    return _cleaned(spark, sf, S.smote_clean(labelled_docs(spark, sf), "doc_id", "toxic", AXES, "tomek"))


@query("smote_enn", _CLEANED_SQL)
def smote_enn(spark, sf):
    return _cleaned(spark, sf, S.smote_clean(labelled_docs(spark, sf), "doc_id", "toxic", AXES, "enn"))
