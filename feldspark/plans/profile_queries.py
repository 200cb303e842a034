"""Profile queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.roles import rounded
from ..operators import profile as P
from ..session import small_table
from .catalog import query, table
from .fixtures import DOC_FEATURES, DOC_FEATURES_SQL, EVENTS_NULLS_SQL, events_nulls, labelled_docs

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(parts):
    return " union all ".join(parts)


def round_all(df, digits=6):
    return df.select(
        *[rounded(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else f.name for f in df.schema]
    )


@query("profile_types", """select column_name as "column", case when data_type in ('BIGINT', 'INTEGER') then 'integer'
  when data_type = 'DOUBLE' then 'float' when data_type = 'VARCHAR' then 'string/mixed'
  when data_type like 'TIMESTAMP%' then 'datetime' else 'other' end as kind
  from (describe orders)""".replace("from (describe orders)", "from duckdb_columns() where table_name = 'orders'"))
def profile_types(spark, sf):
    return P.types(table(spark, sf, "orders")).select("column", "kind")


_EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "score"]


@query("profile_missing", "select * from (" + _union(
    f"""select '{c}' as "column", count(*) filter ({c} is null) as n_missing,
    round(avg(({c} is null)::int::double) * 100, 2) as pct_missing from {EVENTS_NULLS_SQL}""" for c in _EVENT_COLUMNS
) + ") where n_missing > 0")
def profile_missing(spark, sf):
    return P.missing(events_nulls(spark, sf))


@query("profile_duplicates", f"""select '*' as "column", (count(*) - count(distinct (event_type, user_id, value)))::bigint as n_duplicated,
  round((count(*) - count(distinct (event_type, user_id, value))) / count(*)::double * 100, 2) as pct_duplicated
  from {EVENTS_NULLS_SQL} union all """ + _union(
    f"""select '{c}', count(*) - count(distinct {c}) - max(({c} is null)::int),
    round((count(*) - count(distinct {c}) - max(({c} is null)::int)) / count(*)::double * 100, 2) from {EVENTS_NULLS_SQL}"""
    for c in ["event_type", "user_id", "value"]))
def profile_duplicates(spark, sf):
    return P.duplicates(events_nulls(spark, sf).select("event_type", "user_id", "value"))


@query("profile_cardinality", "select \"column\", n_unique, round(n_unique / n_rows::double * 100, 2) as pct_unique, "
  "case when n_unique = 1 then 'CONSTANT' when n_unique = 2 then 'BINARY' when n_unique <= 10 then 'LOW' when n_unique <= 50 then 'MED' "
  "when n_unique / n_rows::double > 0.95 then 'QUASI-ID' else 'HIGH' end as kind from (" + _union(
    f"""select '{c}' as "column", count(distinct {c}) as n_unique, count(*) as n_rows from {EVENTS_NULLS_SQL}""" for c in _EVENT_COLUMNS
) + ")")
def profile_cardinality(spark, sf):
    return P.cardinality(events_nulls(spark, sf))


def _numeric_sql(source, columns):
    quantiles = ", ".join(f"round(quantile_cont({{c}}, {p}), 6) as {n}" for n, p in P.PERCENTILES.items())
    one = (
        "select '{c}' as \"column\", count({c}) as n, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, "
        "round(min({c})::double, 6) as min, round(max({c})::double, 6) as max, round(skewness({c}), 6) as skew, "
        "round(kurtosis({c}), 6) as kurtosis, " + quantiles + " from " + source
    )
    return _union(one.replace("{c}", c) for c in columns)


@query("profile_numeric", _numeric_sql("lineitem", LINE_NUMBERS))
def profile_numeric(spark, sf):
    return round_all(P.numeric_summary(table(spark, sf, "lineitem").select(*LINE_NUMBERS)))


def _classes_sql(column, source):
    return f"""select cast({column} as varchar) as target, n, round(n / sum(n) over () * 100, 6) as pct,
  round(max(n) over () / min(n) over (), 6) as imbalance_ratio,
  case when max(n) over () / min(n) over () > 10 then 'severe' when max(n) over () / min(n) over () > 3 then 'moderate'
    else 'balanced' end as level from (select {column}, count(*) as n from {source} group by 1)"""


@query("profile_target", _classes_sql("toxic", "labels"))
def profile_target(spark, sf):
    return round_all(P.target_profile(table(spark, sf, "labels"), "toxic"))


@query("profile_target_numeric", """select round(avg(o_totalprice), 6) as mean, round(stddev_samp(o_totalprice), 6) as std,
  round(skewness(o_totalprice), 6) as skew, (abs(skewness(o_totalprice)) > 1)::int as skewed from orders""")
def profile_target_numeric(spark, sf):
    return round_all(P.target_profile(table(spark, sf, "orders"), "o_totalprice"))


@query("target_distribution", _classes_sql("quality", "labels"))
def target_distribution(spark, sf):
    return round_all(P.class_counts(table(spark, sf, "labels"), "quality"))


_QUICK = f"""(select event_id, event_type, value, score, 'web' as channel, concat('e', event_id) as code from {EVENTS_NULLS_SQL})"""


def _quick_frame(spark, sf):
    return events_nulls(spark, sf).select(
        "event_id", "event_type", "value", "score", F.lit("web").alias("channel"),
        F.concat(F.lit("e"), F.col("event_id")).alias("code"),
    )


@query("quick_profile", f"""
select 'missing' as finding, "column", pct as value from (select 'event_type' as "column", round(avg((event_type is null)::int::double) * 100, 2) as pct from {_QUICK}
  union all select 'value', round(avg((value is null)::int::double) * 100, 2) from {_QUICK}
  union all select 'score', round(avg((score is null)::int::double) * 100, 2) from {_QUICK})
union all select 'duplicate_rows', '*', (select count(*) - (select count(*) from (select distinct * from {_QUICK} d)) from {_QUICK} a)::double
union all select 'constant', 'channel', count(distinct channel)::double from {_QUICK} having count(distinct channel) <= 1
union all select 'quasi_id', 'code', round(count(distinct code) / count(*), 6)::double from {_QUICK}
union all select 'skewed', 'value', round(skewness(value), 6) from {_QUICK} having abs(skewness(value)) > 2
union all select 'skewed', 'score', round(skewness(score), 6) from {_QUICK} having abs(skewness(score)) > 2""")
def quick_profile(spark, sf):
    return round_all(P.quick(_quick_frame(spark, sf)))


_HOLED = ["event_type", "value", "score"]


@query("missing_corr", _union(
    f"""select '{a}' as a, '{b}' as b, round(corr(({a} is null)::int::double, ({b} is null)::int::double), 6) + 0.0 as r
    from {EVENTS_NULLS_SQL}""" for a, b in combinations(_HOLED, 2)))
def missing_corr(spark, sf):
    return round_all(P.missing_correlation(events_nulls(spark, sf)))


def _hist_sql(source, columns, bins, extra=""):
    one = f"""select '{{c}}' as "column", bin, round(lo + bin * (hi - lo) / {bins}, 6) as left_edge, count(*) as n,
    case when abs(sk) > 2 then 'high' when abs(sk) > 1 then 'medium' else 'ok' end as skew_band{extra} from (
      select least(floor(({{c}} - lo) / (hi - lo) * {bins}), {bins - 1})::int as bin, lo, hi, sk from {source} s,
        (select min({{c}})::double as lo, max({{c}})::double as hi, skewness({{c}}) as sk from {source}) r where {{c}} is not null)
    group by bin, lo, hi, sk"""
    return _union(one.replace("{c}", c) for c in columns)


@query("histograms", _hist_sql("lineitem", LINE_NUMBERS, 40))
def histograms(spark, sf):
    return round_all(P.histograms(table(spark, sf, "lineitem").select(*LINE_NUMBERS), LINE_NUMBERS))


@query("class_histograms", """
with r as (select o_orderpriority, min(o_totalprice) as lo, max(o_totalprice) as hi, count(*) as total from orders group by 1)
select o.o_orderpriority, 'o_totalprice' as "column", least(floor((o_totalprice - lo) / (hi - lo) * 30), 29)::int as bin, count(*) as n,
  round(count(*) / (any_value(total) * ((any_value(hi) - any_value(lo)) / 30)), 12) as density
from orders o join r on o.o_orderpriority = r.o_orderpriority group by 1, 2, 3""")
def class_histograms(spark, sf):
    return round_all(P.class_histograms(table(spark, sf, "orders"), ["o_totalprice"], "o_orderpriority"), 12)


_DOC_NUMBERS = [c for c in DOC_FEATURES]


@query("corr_pairs", "select * from (" + _union(
    f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) + 0.0 as r from {DOC_FEATURES_SQL}" for a, b in combinations(_DOC_NUMBERS, 2)
) + ") where abs(r) > 0.7")
def corr_pairs(spark, sf):
    return round_all(P.correlation_pairs(labelled_docs(spark, sf), _DOC_NUMBERS, 0.7))


@query("category_topn", "select * from (" + _union(
    f"""select '{c}' as "column", {c} as value, count(*) as n, row_number() over (order by count(*) desc, {c}) as rank,
    count(*) over () as n_unique from part group by {c}""" for c in ["p_brand", "p_type", "p_name"]
) + ") where rank <= 15")
def category_topn(spark, sf):
    return P.top_categories(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"])


@query("boxplot_stats", _union(
    f"""select '{c}' as "column", round(q1, 6) as q1, round(med, 6) as median, round(q3, 6) as q3,
    round(min({c}) filter ({c} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as whisker_low,
    round(max({c}) filter ({c} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as whisker_high,
    count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as n_outliers
    from {src}, (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as med, quantile_cont({c}, 0.75) as q3 from {src})
    group by q1, med, q3""" for c, src in [("value", "events"), ("user_id", "events")]).replace("round(min(user_id)", "round(min(user_id::double)").replace("round(max(user_id)", "round(max(user_id::double)"))
def boxplot_stats(spark, sf):
    return round_all(P.boxplots(table(spark, sf, "events"), ["value", "user_id"]))


@query("profile_report", f"""
select 'n_rows' as figure, count(*)::double as value from {_QUICK} union all select 'n_columns', 6.0::double
union all select 'n_numeric', count(*) filter (t in ('BIGINT', 'DOUBLE'))::double from (select unnest([typeof(event_id), typeof(value), typeof(score), typeof(event_type), typeof(channel), typeof(code)]) as t from (select * from {_QUICK} limit 1))
union all select 'n_text', count(*) filter (t = 'VARCHAR')::double from (select unnest([typeof(event_id), typeof(value), typeof(score), typeof(event_type), typeof(channel), typeof(code)]) as t from (select * from {_QUICK} limit 1))
union all select 'missing_cells', (count(*) filter (event_type is null) + count(*) filter (value is null) + count(*) filter (score is null))::double from {_QUICK}
union all select 'pct_missing_cells', round(100 * (count(*) filter (event_type is null) + count(*) filter (value is null) + count(*) filter (score is null))::double / (count(*) * 6), 4) from {_QUICK}
union all select 'duplicate_rows', (select count(*) - (select count(*) from (select distinct * from {_QUICK} d)) from {_QUICK} a)::double
union all select 'n_alerts', (3 + 1 + 1 + (select (abs(skewness(value)) > 2)::int + (abs(skewness(score)) > 2)::int from {_QUICK}))::double""")
def profile_report(spark, sf):
    return P.report(_quick_frame(spark, sf))


@query("profile_alerts", f"""
select 'missing' as finding, c as "column" from (select unnest(['event_type', 'value', 'score']) as c,
  unnest([count(*) - count(event_type), count(*) - count(value), count(*) - count(score)]) as holes from {_QUICK}) where holes > 0
union all select 'constant', 'channel' from {_QUICK} having count(distinct channel) <= 1
union all select 'skewed', c from (select unnest(['value', 'score']) as c, unnest([skewness(value), skewness(score)]) as s from {_QUICK}) where abs(s) > 2
union all select 'high_cardinality', c from (select unnest(['event_type', 'code']) as c, unnest([count(distinct event_type), count(distinct code)]) as n from {_QUICK}) where n > 50
union all select 'duplicate_rows', '*' from (select (select count(*) - (select count(*) from (select distinct * from {_QUICK} d)) from {_QUICK} a) as n) where n > 0""")
def profile_alerts(spark, sf):
    return P.alerts(_quick_frame(spark, sf))


@query("head_tail", """select * from (select event_id, value, 'head' as part from events order by event_id limit 10)
  union all select * from (select event_id, value, 'tail' as part from events order by event_id desc limit 10)""")
def head_tail(spark, sf):
    return P.head_tail(table(spark, sf, "events").select("event_id", "value"), "event_id")


def _rank_sql(c, source):
    return f"(rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double)"


@query("spearman_pairs", "with r as (select " + ", ".join(f"{_rank_sql(c, 'd')} as {c}" for c in _DOC_NUMBERS)
       + f" from {DOC_FEATURES_SQL} d) " + _union(
    f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) + 0.0 as r from r" for a, b in combinations(_DOC_NUMBERS, 2)))
def spearman_pairs(spark, sf):
    return round_all(P.spearman_pairs(labelled_docs(spark, sf).select(*_DOC_NUMBERS), _DOC_NUMBERS))


@query("kendall_tau", """with c as (select l_quantity as x, l_discount as y, count(*)::double as n from lineitem group by 1, 2),
  p as (select sum(case when (a.x - b.x) * (a.y - b.y) > 0 then a.n * b.n else 0 end) / 2 as con,
    sum(case when (a.x - b.x) * (a.y - b.y) < 0 then a.n * b.n else 0 end) / 2 as dis from c a, c b),
  t as (select sum(n) as n from c),
  ta as (select sum(n * (n - 1) / 2) as t from (select x, sum(n) as n from c group by 1)),
  tb as (select sum(n * (n - 1) / 2) as t from (select y, sum(n) as n from c group by 1))
  select 'l_quantity' as a, 'l_discount' as b,
    round((con - dis) / sqrt((t.n * (t.n - 1) / 2 - ta.t) * (t.n * (t.n - 1) / 2 - tb.t)), 6) + 0.0 as tau from p, t, ta, tb""")
def kendall_tau(spark, sf):
    lines = table(spark, sf, "lineitem")
    tau = P.kendall_tau(lines, "l_quantity", "l_discount")
    return small_table(spark, [("l_quantity", "l_discount", round(tau, 6) + 0.0)], "a string, b string, tau double")


@query("kendall_prices", """with c as (select l_extendedprice as x, l_quantity as y, count(*) as n from lineitem group by 1, 2),
  levels as (select distinct y as v from c),
  met as (select c.y, c.n, v, sum(case when c.y = v then c.n else 0 end) over
    (partition by v order by c.x groups between unbounded preceding and 1 preceding) as earlier from c, levels),
  d as (select sum(case when v < y then n * earlier else 0 end)::bigint as con, sum(case when v > y then n * earlier else 0 end)::bigint as dis from met),
  t as (select sum(n)::bigint as n from c),
  ta as (select sum(n * (n - 1))::bigint // 2 as t from (select x, sum(n)::bigint as n from c group by 1)),
  tb as (select sum(n * (n - 1))::bigint // 2 as t from (select y, sum(n)::bigint as n from c group by 1))
  select 'l_extendedprice' as a, 'l_quantity' as b, con as concordant, dis as discordant, ta.t as tied_a, tb.t as tied_b,
    round((con - dis) / sqrt((t.n * (t.n - 1) // 2 - ta.t)::double * (t.n * (t.n - 1) // 2 - tb.t)::double), 9) + 0.0 as tau from d, t, ta, tb""")
def kendall_prices(spark, sf):
    # Small ranges, so that counting within and between ranges takes part at every size.
    found = P.kendall_counts(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", local_rows=10_000)
    row = ("l_extendedprice", "l_quantity", found.concordant, found.discordant, found.tied_a, found.tied_b, round(found.tau, 9) + 0.0)
    return small_table(spark, [row], "a string, b string, concordant bigint, discordant bigint, tied_a bigint, tied_b bigint, tau double")


@query("association", f"""with c as (select lang, source, count(*)::double as n from {DOC_FEATURES_SQL} group by 1, 2),
  t as (select sum(n) as n from c),
  e as (select c.n, sum(c.n) over (partition by lang) as l, sum(c.n) over (partition by source) as s from c),
  r as (select {_rank_sql('f_length', 'd')} as a, {_rank_sql('f_upper', 'd')} as b from {DOC_FEATURES_SQL} d)
  select 'lang' as a, 'source' as b, 'cramers_v' as measure,
    round(sqrt((sum(e.n * e.n / (l * s)) - 1) / (least((select count(distinct lang) from c), (select count(distinct source) from c)) - 1)), 6) as value from e
  union all select 'f_length', 'f_upper', 'spearman', round(corr(a, b), 6) + 0.0 from r""")
def association(spark, sf):
    return round_all(P.association(labelled_docs(spark, sf), ["f_length", "f_upper"], ["lang", "source"]))


@query("interactions", """select least(floor((l_quantity - 1) / (q - 1) * 10), 9)::int as bin_a,
  least(floor((l_tax - tl) / (th - tl) * 10), 9)::int as bin_b, count(*) as n from lineitem,
  (select max(l_quantity) as q, min(l_tax) as tl, max(l_tax) as th from lineitem) group by 1, 2""")
def interactions(spark, sf):
    return P.interactions(table(spark, sf, "lineitem"), "l_quantity", "l_tax")


_CAPPED = "(select least(value, 100.0::double) as value from events)"


@query("before_after", f"select *, 'before' as stage from ({_hist_sql('events', ['value'], 50)}) union all "
       f"select *, 'after' as stage from ({_hist_sql(_CAPPED, ['value'], 50)})")
def before_after(spark, sf):
    events = table(spark, sf, "events")
    capped = events.select(F.least("value", F.lit(100.0)).alias("value"))
    return round_all(P.before_after(events, capped, ["value"]))


@query("qq_table", "select (i + 0.5) / 20 as share, round((select quantile_cont(value, [" + ", ".join(str((i + 0.5) / 20) for i in range(20))
       + "]) from events)[(i + 1)::int], 6) as observed from range(20) t(i)")
def qq_table(spark, sf):
    return P.normal_quantile_plot(table(spark, sf, "events"), "value").select("share", rounded("observed").alias("observed"))
