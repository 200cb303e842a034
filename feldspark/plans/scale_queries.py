"""Transform, scaler and feature-engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.roles import rounded
from ..operators import features as X
from ..operators import scale as S
from .catalog import query, table
from .fixtures import EVENTS_NULLS_SQL, events_nulls
from .profile_queries import round_all

_SKEW = ["event_id", "user_id", "value"]


@query("skew_report", " union all ".join(
    f"""select '{c}' as "column", round(skewness({c}), 4) + 0.0 as skewness, round(abs(skewness({c})), 4) as abs_skewness,
    (abs(skewness({c})) > 1)::int as will_transform,
    case when abs(skewness({c})) > 2 then 'HIGH' when abs(skewness({c})) > 1 then 'MED' else 'OK' end as severity from events""" for c in _SKEW))
def skew_report(spark, sf):
    return round_all(S.skew_report(table(spark, sf, "events")))


def _yj_sql(x, p):
    up = f"ln(1 + {x})" if p == 0 else f"(power({x} + 1, {p}) - 1) / {p}"
    return f"case when {x} >= 0 then {up} else -(power(1 - {x}, {2 - p}) - 1) / {2 - p} end"


@query("transform_yeojohnson_fixed", f"select event_id, round({_yj_sql('(value - 50)', 0.4)}, 6) + 0.0 as shifted, round({_yj_sql('value', 0)}, 6) as value from events")
def transform_yeojohnson_fixed(spark, sf):
    events = table(spark, sf, "events").select("event_id", (F.col("value") - 50).alias("shifted"), "value")
    return round_all(S.apply_transform(events, {"method": "yeojohnson", "powers": {"shifted": 0.4, "value": 0.0}}))


def _peak_sql(value, transformed, jacobian):
    """The transformed values of events at the power, in hundredths, of the greatest likelihood."""
    grid = "(select i / 100.0::double as p from range(-500, 501) as t(i))"
    return f"""with v as (select {value} as x, count(*) as c from events group by 1), g as (select p, x, c, {transformed} as y from v, {grid}),
  m as (select p, sum(c) as n, sum(c * y) / sum(c) as mean from g group by 1),
  l as (select g.p, any_value(n) as n, sum(c * (y - mean) * (y - mean)) / any_value(n) as spread, sum(c * {jacobian}) as shift from g join m using (p) group by 1),
  best as (select p from l where spread > 0 order by -n / 2.0::double * ln(spread) + (p - 1) * shift desc limit 1)
  select event_id, (select p from best) as power, round({transformed}, 5) + 0.0 as value from (select event_id, {value} as x, (select p from best) as p from events)"""


def _at_peak(spark, sf, value, method):
    """The fitted power in hundredths, and the values it gives."""
    events = table(spark, sf, "events").select("event_id", value.alias("value"))
    fitted = S.fit_transform(events, ["value"], method)
    power = round(fitted["powers"]["value"], 2)
    out = S.apply_transform(events, {**fitted, "powers": {"value": power}})
    return out.select("event_id", F.lit(power).alias("power"), rounded("value", 5).alias("value"))


_YJ = """case when x >= 0 then case when abs(p) < 1e-12 then ln(1 + x) else ((x + 1) ** p - 1) / p end
  else case when abs(2 - p) < 1e-12 then -ln(1 - x) else -((1 - x) ** (2 - p) - 1) / (2 - p) end end"""


@query("transform_yeojohnson", _peak_sql("(value - 50)", _YJ, "(sign(x) * ln(1 + abs(x)))"))
def transform_yeojohnson(spark, sf):
    """Values on both sides of zero."""
    return _at_peak(spark, sf, F.col("value") - 50, "yeojohnson")


@query("transform_boxcox", _peak_sql("(value + 1)", "case when abs(p) < 1e-12 then ln(x) else (x ** p - 1) / p end", "ln(x)"))
def transform_boxcox(spark, sf):
    return _at_peak(spark, sf, F.col("value") + 1, "boxcox")


@query("transform_log_sqrt", "select event_id, round(ln(1 + value), 6) as logged, round(sqrt(value), 6) as rooted from events")
def transform_log_sqrt(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("value").alias("logged"), F.col("value").alias("rooted"))
    logged = S.apply_transform(events, S.fit_transform(events, ["logged"], "log1p"))
    return round_all(S.apply_transform(logged, S.fit_transform(events, ["rooted"], "sqrt")))


@query("transform_quantile", """with q as (select quantile_cont(value, 1 / 3.0::double) as low, quantile_cont(value, 2 / 3.0::double) as high, min(value) as least, max(value) as most from events)
  select event_id, (value > low)::int + (value > high)::int as third, value = least as is_least, value = most as is_most, true as bounded from events, q""")
def transform_quantile(spark, sf):
    """Values in the thirds of the normal distribution are those in the thirds of the column; the ends go to its ends."""
    events = table(spark, sf, "events").select("event_id", "value")
    out = S.apply_transform(events, S.fit_transform(events, ["value"], "quantile")).persist()
    least, most = out.agg(F.min("value"), F.max("value")).first()
    third = 0.430727299295457
    return out.select(
        "event_id", ((F.col("value") > -third + 1e-9).cast("int") + (F.col("value") > third + 1e-9).cast("int")).alias("third"),
        (F.col("value") == least).alias("is_least"), (F.col("value") == most).alias("is_most"), (F.abs("value") < 5.3).alias("bounded"),
    )


_NUM = ["l_quantity", "l_extendedprice"]


def _scale_query(name, kind, centre, scale):
    sql = "select l_orderkey, l_linenumber, l_partkey, " + ", ".join(
        f"round(({c} - c_{c}) / s_{c}, 6) + 0.0 as {c}" for c in _NUM
    ) + " from lineitem, (select " + ", ".join(
        f"{centre.format(c=c)} as c_{c}, {scale.format(c=c)} as s_{c}" for c in _NUM
    ) + " from lineitem)"

    @query(name, sql)
    def run(spark, sf):
        lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_NUM)
        return round_all(S.apply_scaler(lines, S.fit_scaler(lines, _NUM, kind)))


_scale_query("scale_standard", "standard", "avg({c})", "stddev_pop({c})")
_scale_query("scale_minmax", "minmax", "min({c})", "(max({c}) - min({c}))")
_scale_query("scale_robust", "robust", "quantile_cont({c}, 0.5)", "(quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05))")
_scale_query("scale_maxabs", "maxabs", "0.0", "max(abs({c}))")


@query("fe_polynomial", 'select l_orderkey as k, l_quantity, l_discount, l_tax, round(l_quantity * l_discount, 6) as "l_quantity l_discount", '
       'round(l_quantity * l_tax, 6) as "l_quantity l_tax", round(l_discount * l_tax, 6) as "l_discount l_tax", '
       'round(l_quantity * l_discount * l_tax, 6) as "l_quantity l_discount l_tax" from lineitem')
def fe_polynomial(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity", "l_discount", "l_tax")
    wide = X.polynomial(lines, ["l_quantity", "l_discount", "l_tax"], 3)
    return wide.select(*[rounded(F.col(f"`{c}`")).alias(c) if " " in c else c for c in wide.columns])


@query("fe_ratio", """select l_orderkey as k, round(l_extendedprice / (l_quantity + 1e-8), 6) as l_extendedprice_div_l_quantity,
  round(l_extendedprice / (l_extendedprice + l_quantity + 1e-8), 6) as l_extendedprice_pct_of_sum from lineitem""")
def fe_ratio(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_extendedprice", "l_quantity")
    return round_all(X.ratios(lines, [("l_extendedprice", "l_quantity")]).drop("l_extendedprice", "l_quantity"))


_QE = ", ".join(f"quantile_cont(value, {i / 5}) as q{i}" for i in range(1, 5))
_UE = ", ".join(f"min(o_totalprice) + (max(o_totalprice) - min(o_totalprice)) * {i} / 5 as q{i}" for i in range(1, 5))
_CMP = " + ".join("({c} >= q%d)::int" % i for i in range(1, 5))


@query("fe_bins", f"select event_id, value, {_CMP.format(c='value')} as value_bin from events, (select {_QE} from events)")
def fe_bins(spark, sf):
    events = table(spark, sf, "events").select("event_id", "value")
    return X.apply_bins(events, X.fit_bins(events, ["value"]))


@query("fe_bins_uniform", f"select o_orderkey, {_CMP.format(c='o_totalprice')} as o_totalprice_bin from orders, (select {_UE} from orders)")
def fe_bins_uniform(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return X.apply_bins(orders, X.fit_bins(orders, ["o_totalprice"], strategy="uniform")).drop("o_totalprice")


@query("fe_bins_kmeans", "select o_orderkey, true as nearest, 5::bigint as n_bins from orders")
def fe_bins_kmeans(spark, sf):
    """Each value lies nearest to the mean of its own bin, up to the last step of the iteration."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    binned = X.apply_bins(orders, X.fit_bins(orders, ["o_totalprice"], strategy="kmeans")).persist()
    means = [r[1] for r in binned.groupBy("o_totalprice_bin").agg(F.avg("o_totalprice").alias("m")).orderBy("o_totalprice_bin").collect()]  # a row a bin
    spread = (max(means) - min(means)) / len(means)
    distance = F.array(*[F.abs(F.col("o_totalprice") - F.lit(m)) for m in means])
    own = distance[F.col("o_totalprice_bin")]
    return binned.select("o_orderkey", (own <= F.array_min(distance) + 0.05 * spread).alias("nearest"), F.lit(len(means)).cast("bigint").alias("n_bins"))


@query("fe_interaction", "select o_orderkey, o_custkey, o_totalprice, round(o_custkey * o_totalprice, 4) as o_custkey_x_o_totalprice from orders")
def fe_interaction(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return X.interactions(orders, [("o_custkey", "o_totalprice")]).withColumn("o_custkey_x_o_totalprice", rounded("o_custkey_x_o_totalprice", 4))


@query("fe_cross", f"select event_id, concat(coalesce(event_type, 'nan'), '_', user_id) as event_type__user_id from {EVENTS_NULLS_SQL}")
def fe_cross(spark, sf):
    return X.interactions(events_nulls(spark, sf).select("event_id", "event_type", "user_id"), [("event_type", "user_id")]).select("event_id", "event_type__user_id")


@query("fe_group_agg", """with g as (select event_type, avg(value) as m, stddev_samp(value) as s, quantile_cont(value, 0.5) as d, count(distinct user_id) as u
    from events where event_type <> 'view' group by 1)
  select event_id, e.event_type, round(m, 6) as value_by_event_type_mean, round(s, 6) as value_by_event_type_std,
    round(d, 6) as value_by_event_type_median from events e left join g on e.event_type = g.event_type""")
def fe_group_agg(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    learned = X.group_statistics(events.where("event_type <> 'view'"), "event_type", "value", ["mean", "std", "median"])
    return round_all(X.add_group_statistics(events, learned, "event_type").drop("value"))


_SP = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"


@query("fe_text", f"""select doc_id, length(text) as text_length, len(regexp_extract_all(text, '[^{_SP}]+')) as text_word_count,
  len(regexp_extract_all(text, '\\p{{Nd}}')) as text_n_digits, len(regexp_extract_all(text, '[^a-zA-Z0-9{_SP}]')) as text_n_special,
  len(regexp_extract_all(text, '[A-Z]')) as text_n_upper from documents""")
def fe_text(spark, sf):
    return X.text_features(table(spark, sf, "documents").select("doc_id", "text"), ["text"]).drop("text")


_DATE = {
    "year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "hour": "hour(ts)", "minute": "minute(ts)", "weekday": "isodow(ts) - 1",
    "quarter": "quarter(ts)", "dayofyear": "dayofyear(ts)", "weekofyear": "weekofyear(ts)",
}


@query("fe_datetime", "select event_id, " + ", ".join(f"({e})::int as ts_{n}" for n, e in _DATE.items()) + " from events")
def fe_datetime(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    return X.date_features(events, ["ts"], flags=False, cycles=False)


@query("fe_date_flags", """select o_orderkey, (isodow(o_orderdate) >= 6)::int as o_orderdate_is_weekend, (day(o_orderdate) = 1)::int as o_orderdate_is_monthstart,
  (last_day(o_orderdate) = o_orderdate::date)::int as o_orderdate_is_monthend from orders""")
def fe_date_flags(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return X.date_features(orders, ["o_orderdate"], parts=False, cycles=False)


_CYC = {"hour": ("hour(ts)", 24), "month": ("month(ts)", 12), "weekday": ("(isodow(ts) - 1)", 7), "doy": ("dayofyear(ts)", 365)}


@query("fe_cyclical", "select event_id, " + ", ".join(
    f"round({f}(2 * pi() * {e} / {p}.0), 6) + 0.0 as ts_{n}_{f}" for n, (e, p) in _CYC.items() for f in ("sin", "cos")) + " from events")
def fe_cyclical(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    return round_all(X.date_features(events, ["ts"], parts=False, flags=False))


@query("fe_days_since", "select o_orderkey, floor((epoch(o_orderdate) - epoch(timestamp '2000-01-01 12:00:00')) / 86400)::bigint as o_orderdate_days_since_ref from orders")
def fe_days_since(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return X.date_features(orders, ["o_orderdate"], False, False, False, {"o_orderdate": "2000-01-01 12:00:00"})


@query("rfm", """with r as (select o_custkey, floor((epoch((select max(o_orderdate) from orders)) + 86400 - epoch(max(o_orderdate))) / 86400)::bigint as recency,
    count(o_orderdate) as frequency, sum(o_totalprice) as monetary from orders group by 1)
  select o_custkey, recency, frequency, round(monetary, 2) as monetary, round(monetary / frequency, 6) as avg_order_value,
    round(ln(1 + monetary), 6) as monetary_log, round(ln(1 + recency), 6) as recency_log from r""")
def rfm(spark, sf):
    made = X.rfm(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_totalprice")
    return made.select(
        "o_custkey", "recency", "frequency", rounded("monetary", 2).alias("monetary"), rounded("avg_order_value", 6).alias("avg_order_value"),
        rounded("monetary_log").alias("monetary_log"), rounded("recency_log").alias("recency_log"),
    )
