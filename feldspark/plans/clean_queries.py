"""Imputation and outlier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import impute as I
from ..operators import outliers as O
from ..session import small_table
from .catalog import query, table
from .fixtures import EVENTS_NULLS_SQL, events_nulls
from .profile_queries import round_all

E = EVENTS_NULLS_SQL


@query("impute_mean_median", f"""select event_id, round(coalesce(value, (select avg(value) from {E})), 6) as value_mean,
  round(coalesce(value, (select quantile_cont(value, 0.5) from {E})), 6) as value_median,
  round(coalesce(score, (select quantile_cont(score, 0.5) from {E})), 6) as score_median from {E}""")
def impute_mean_median(spark, sf):
    events = events_nulls(spark, sf)
    both = events.select("event_id", F.col("value").alias("value_mean"), F.col("value").alias("value_median"), F.col("score").alias("score_median"))
    fills = {**I.numeric_fills(both, ["value_mean"], "mean"), **I.numeric_fills(both, ["value_median", "score_median"])}
    return round_all(I.fill(both, fills))


@query("impute_mode", f"""select event_id, coalesce(event_type, (select event_type from {E} where event_type is not null
   group by 1 order by count(*) desc, event_type limit 1)) as by_mode, coalesce(event_type, 'MISSING') as by_constant from {E}""")
def impute_mode(spark, sf):
    events = events_nulls(spark, sf).select("event_id", F.col("event_type").alias("by_mode"), F.col("event_type").alias("by_constant"))
    return I.fill(events, {**I.categorical_fills(events, ["by_mode"]), **I.categorical_fills(events, ["by_constant"], "constant")})


def _group_sql(stat, fallback):
    return f"""with g as (select event_type, {stat} as s from {E} where event_type is not null and value is not null group by 1),
  f as (select e.event_id, e.event_type, coalesce(e.value, g.s) as v from {E} e left join g on e.event_type = g.event_type)
  select event_id, event_type, round(coalesce(v, ({fallback})), 6) as value from f"""


_MODE_OF = "select v from f where v is not null group by 1 order by count(*) desc, v limit 1"


@query("impute_group", _group_sql("quantile_cont(value, 0.5)", "select quantile_cont(v, 0.5) from f"))
def impute_group(spark, sf):
    return round_all(I.group_fill(events_nulls(spark, sf), "value", "event_type").select("event_id", "event_type", "value"))


@query("impute_group_mean", _group_sql("avg(round(value, 2))", _MODE_OF).replace("round(coalesce(v,", "round(coalesce(v,"))
def impute_group_mean(spark, sf):
    return round_all(I.group_fill(events_nulls(spark, sf), "value", "event_type", "mean").select("event_id", "event_type", "value"))


@query("impute_group_mode", f"""with c as (select event_type, value, count(*) as n from {E} where event_type is not null and value is not null group by 1, 2),
  g as (select event_type, value as s from c qualify row_number() over (partition by event_type order by n desc, value) = 1),
  f as (select e.event_id, e.event_type, coalesce(e.value, g.s) as v from {E} e left join g on e.event_type = g.event_type)
  select event_id, event_type, round(coalesce(v, ({_MODE_OF})), 6) as value from f""")
def impute_group_mode(spark, sf):
    return round_all(I.group_fill(events_nulls(spark, sf), "value", "event_type", "mode").select("event_id", "event_type", "value"))


_B = "order by ts, event_id rows between unbounded preceding and current row"
_A = "order by ts, event_id rows between current row and unbounded following"


@query("ts_ffill_bfill", f"""select event_id, coalesce(last_value(value ignore nulls) over ({_B}), first_value(value ignore nulls) over ({_A})) as value,
  coalesce(last_value(score ignore nulls) over ({_B}), first_value(score ignore nulls) over ({_A})) as score from {E}""")
def ts_ffill_bfill(spark, sf):
    return I.fill_in_time(events_nulls(spark, sf), "ts", "event_id", ["value", "score"]).select("event_id", "value", "score")


@query("ts_ffill_by_user", f"""select event_id, user_id, coalesce(last_value(value ignore nulls) over (partition by user_id {_B}),
  first_value(value ignore nulls) over (partition by user_id {_A})) as value from {E}""")
def ts_ffill_by_user(spark, sf):
    return I.fill_in_time(events_nulls(spark, sf), "ts", "event_id", ["value"], ["user_id"]).select("event_id", "user_id", "value")


@query("ts_interpolate", f"""with n as (select event_id, value, epoch_us(ts) / 1000000.0::double as t,
    last_value(value ignore nulls) over ({_B}) as pv, first_value(value ignore nulls) over ({_A}) as nv,
    last_value(case when value is not null then epoch_us(ts) / 1000000.0::double end ignore nulls) over ({_B}) as pt,
    first_value(case when value is not null then epoch_us(ts) / 1000000.0::double end ignore nulls) over ({_A}) as nt from {E})
  select event_id, round(case when value is not null then value when nv is null then pv when nt = pt then pv
    else pv + (nv - pv) * (t - pt) / (nt - pt) end, 6) as value from n""")
def ts_interpolate(spark, sf):
    return round_all(
        I.fill_in_time(events_nulls(spark, sf), "ts", "event_id", ["value"], method="interpolate").select("event_id", "value")
    )


@query("missing_advice", " union all ".join(
    f"""select '{c}' as "column", count(*) filter ({c} is null) as n_missing, round(avg(({c} is null)::int::double) * 100, 1) as pct_missing,
    case when avg(({c} is null)::int) > 0.6 then 'DROP' """ + (
        f"when avg(({c} is null)::int) > 0.3 then 'ADD_CATEGORY' else 'MODE' end" if c == "event_type" else
        f"when avg(({c} is null)::int) < 0.05 then 'MEDIAN' when abs(skewness({c})) > 1 then 'MEDIAN_SKEWED' when avg(({c} is null)::int) > 0.3 then 'KNN_OR_ITERATIVE' else 'MEDIAN' end"
    ) + f" as recommendation from {E}" for c in ["event_type", "value", "score"]))
def missing_advice(spark, sf):
    return I.advice(events_nulls(spark, sf))


@query("impute_iterative", """select l_orderkey, l_linenumber, case when l_orderkey % 5 <> 0 then l_quantity end as seen_quantity,
  case when l_partkey % 7 <> 0 then l_extendedprice end as seen_price, l_discount, true as filled, true as better from lineitem""")
def impute_iterative(spark, sf):
    """Values that are there stay, holes are filled, and the fills are nearer to what was blanked than the mean is."""
    whole = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    holes = {"l_quantity": "l_orderkey % 5 = 0", "l_extendedprice": "l_partkey % 7 = 0"}
    whole = whole.select("*", *[F.col(c).alias(f"true_{c}") for c in holes])
    lines = whole.withColumns({c: F.expr(f"case when {hole} then null else {c} end") for c, hole in holes.items()})
    fitted = I.fit_chained(lines, ["l_quantity", "l_extendedprice", "l_discount"])
    out = I.apply_chained(lines, fitted).persist()
    errors = {}
    for c, hole in holes.items():
        row = out.where(hole).agg(F.avg(F.abs(F.col(c) - F.col(f"true_{c}"))), F.stddev_pop(f"true_{c}")).first()
        errors[c] = row[0] < row[1]
    blank = {c: F.expr(hole) for c, hole in holes.items()}
    return out.select(
        "l_orderkey", "l_linenumber", F.when(~blank["l_quantity"], F.col("l_quantity")).alias("seen_quantity"),
        F.when(~blank["l_extendedprice"], F.col("l_extendedprice")).alias("seen_price"), "l_discount",
        (F.col("l_quantity").isNotNull() & F.col("l_extendedprice").isNotNull()).alias("filled"), F.lit(all(errors.values())).alias("better"),
    )


_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def bounds_frame(spark, bounds):
    return round_all(small_table(spark, [(c, float(a), float(b)) for c, (a, b) in bounds.items()], "column string, lower double, upper double"))


def _bounds_sql(low, high):
    return " union all ".join(
        f"select '{c}' as \"column\", round({low.format(c=c)}, 6) + 0.0 as lower, round({high.format(c=c)}, 6) + 0.0 as upper from lineitem" for c in _COLS
    )


_Q = "quantile_cont({c}, 0.25)", "quantile_cont({c}, 0.75)"


@query("outlier_iqr", _bounds_sql(f"{_Q[0]} - 1.5 * ({_Q[1]} - {_Q[0]})", f"{_Q[1]} + 1.5 * ({_Q[1]} - {_Q[0]})"))
def outlier_iqr(spark, sf):
    return bounds_frame(spark, O.iqr_bounds(table(spark, sf, "lineitem"), _COLS))


@query("outlier_zscore", _bounds_sql("avg({c}) - 3 * stddev_samp({c})", "avg({c}) + 3 * stddev_samp({c})"))
def outlier_zscore(spark, sf):
    return bounds_frame(spark, O.zscore_bounds(table(spark, sf, "lineitem"), _COLS))


@query("outlier_mad", " union all ".join(
    f"""select '{c}' as "column", round(m - 3.5 * mad / 0.6745, 6) + 0.0 as lower, round(m + 3.5 * mad / 0.6745, 6) + 0.0 as upper from
    (select any_value(m) as m, quantile_cont(abs({c} - m), 0.5) as mad from lineitem, (select quantile_cont({c}, 0.5) as m from lineitem))""" for c in _COLS))
def outlier_mad(spark, sf):
    return bounds_frame(spark, O.mad_bounds(table(spark, sf, "lineitem"), _COLS))


_EB = "(select quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) as lo, quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) as hi from events)"


@query("outlier_treat", f"""select event_id, round(greatest(lo, least(hi, value)), 6) as value, (value < lo or value > hi)::int as value_is_outlier
  from events, {_EB}""")
def outlier_treat(spark, sf):
    events = table(spark, sf, "events")
    return round_all(O.treat(events, O.iqr_bounds(events, ["value"]), "cap_and_flag").select("event_id", "value", "value_is_outlier"))


@query("outlier_remove", f"select event_id, value from events, {_EB} where value between lo and hi")
def outlier_remove(spark, sf):
    events = table(spark, sf, "events")
    return O.treat(events, O.iqr_bounds(events, ["value"]), "remove").select("event_id", "value")


@query("outlier_report", f"""select 'value' as "column", count(*) filter (value < lo or value > hi) as n_outliers,
  round(count(*) filter (value < lo or value > hi) / count(*)::double * 100, 2) as pct_outliers,
  round(any_value(lo), 4) as lower_bound, round(any_value(hi), 4) as upper_bound, 'cap' as action from events, {_EB}
  union all select 'user_id', count(*) filter (user_id < lo or user_id > hi), round(count(*) filter (user_id < lo or user_id > hi) / count(*)::double * 100, 2),
  round(any_value(lo), 4), round(any_value(hi), 4), 'cap' from events, {_EB.replace('value', 'user_id')}""")
def outlier_report(spark, sf):
    events = table(spark, sf, "events")
    return O.outlier_report(events, O.iqr_bounds(events, ["value", "user_id"]), "cap")
