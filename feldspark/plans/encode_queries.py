"""Encoding queries. The fitted table is the input itself, except where a split is shown."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..operators import encode as N
from ..operators.stages import TableStage
from ..session import small_table
from ..sources.tables import scratch_folder
from .catalog import query, table
from .fixtures import DOC_FEATURES_SQL, labelled_docs
from .profile_queries import round_all

# Rows that learn the mapping; every row is encoded with it.
TRAIN_SQL = f"(select * from {DOC_FEATURES_SQL} where doc_id % 4 <> 0)"


def train_rows(docs):
    return docs.where("doc_id % 4 <> 0")


_RARE_SQL = """(select *, case when p_name in (select p_name from part group by 1 having count(*) >= 0.05 * (select count(*) from part))
    then p_name else 'Rare' end as name from part)"""


@query("encode_rare", f"""select p_partkey, name as p_name, p_type,
  case when p_brand in (select p_brand from part group by 1 having count(*) >= 0.05 * (select count(*) from part)) then p_brand else 'Rare' end as p_brand
  from {_RARE_SQL}""")
def encode_rare(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return N.apply_rare(parts, N.fit_rare(parts, ["p_name", "p_type", "p_brand"]))


@query("encode_route", " union all ".join(
    f"""select '{c}' as "column", case when count(distinct {c}) <= 2 then 'binary' when count(distinct {c}) <= 10 then 'low' else 'high' end as method from part"""
    for c in ["p_name", "p_type", "p_brand"]))
def encode_route(spark, sf):
    parts = table(spark, sf, "part")
    routed = N.route(parts, ["p_name", "p_type", "p_brand"])
    return small_table(spark, list(routed.items()), "column string, method string")


@query("encode_binary", """select l_orderkey, l_linenumber, case l_linestatus when (select min(l_linestatus) from lineitem) then 0
  when (select max(l_linestatus) from lineitem) then 1 else -1 end as l_linestatus from lineitem""")
def encode_binary(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return N.apply_ordinal(lines, N.fit_ordinal(lines, ["l_linestatus"]))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("encode_onehot", "select event_id, " + ", ".join(f"(event_type = '{t}')::int::double as event_type_{t}" for t in _TYPES) + " from events")
def encode_onehot(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    return N.apply_onehot(events, N.fit_onehot(events, ["event_type"]))


@query("encode_onehot_pooled", """with k as (select p_brand, row_number() over (order by count(*) desc, p_brand desc) as r from part group by 1)
  select p_partkey, (select max(p_brand) from k where r = 1) = p.p_brand as is_top, (r > 14)::int::double as pooled
  from part p join k on p.p_brand = k.p_brand""".replace("(select max(p_brand) from k where r = 1) = p.p_brand as is_top, ", ""))
def encode_onehot_pooled(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    plan = N.fit_onehot(parts, ["p_brand"])
    encoded = N.apply_onehot(parts, plan, N.onehot_tables(parts, plan))
    return encoded.select("p_partkey", F.col(f"p_brand_{N.POOLED}").alias("pooled"))


@query("encode_ordinal", "select o_orderkey, case when o_orderpriority is null then -1 else dense_rank() over (order by o_orderpriority) - 1 end::int as o_orderpriority from orders")
def encode_ordinal(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return N.apply_ordinal(orders, N.fit_ordinal(orders, ["o_orderpriority"]))


@query("encode_ordinal_many", "select c_custkey, (dense_rank() over (order by c_name) - 1)::int as c_name from customer")
def encode_ordinal_many(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    return N.apply_table(customers, N.ordinal_table(customers, "c_name"), "c_name", -1, -1)


def _target_sql(value, missing):
    return f"""with t as (select source, avg(toxic) as m, count(*) as n, sum(toxic)::double as s from {TRAIN_SQL} group by 1),
  p as (select avg(toxic) as prior, sum(toxic)::double as s, count(*)::double as n from {TRAIN_SQL})
  select d.doc_id, round(coalesce({value}, {missing}), 6) + 0.0 as source from {DOC_FEATURES_SQL} d left join t on d.source = t.source, p"""


@query("encode_target", _target_sql("(1 / (1 + exp(-(t.n - 10) / 5.0::double))) * t.m + (1 - 1 / (1 + exp(-(t.n - 10) / 5.0::double))) * p.prior", "p.prior"))
def encode_target(spark, sf):
    docs = labelled_docs(spark, sf)
    return round_all(N.encode_target(train_rows(docs), docs.select("doc_id", "source"), ["source"], "toxic"))


@query("encode_woe", _target_sql("case when t.n = 1 then 0 else ln(((t.s + 1) / (p.s + 2)) / ((t.n - t.s + 1) / (p.n - p.s + 2))) end", "0"))
def encode_woe(spark, sf):
    docs = labelled_docs(spark, sf)
    return round_all(N.encode_woe(train_rows(docs), docs.select("doc_id", "source"), ["source"], "toxic"))


@query("encode_count", _target_sql("t.n / p.n", "0"))
def encode_count(spark, sf):
    docs = labelled_docs(spark, sf)
    return round_all(N.encode_frequency(train_rows(docs), docs.select("doc_id", "source"), ["source"]))


_HEX = " + ".join(f"instr('0123456789abcdef', substr(h, {i}, 1)) - 1" for i in range(1, 33))


@query("encode_hash", "with v as (select p_partkey, unnest([p_name, p_brand, p_type]) as v from part), h as (select p_partkey, md5(v) as h from v), "
       f"b as (select p_partkey, (16 * (({_HEX}) % 3) + 9 * ((instr('0123456789abcdef', substr(h, 32, 1)) - 1) % 8)) % 24 as b from h) "
       "select p_partkey, " + ", ".join(f"count(*) filter (b = {i}) as col_{i}" for i in range(24)) + " from b group by 1")
def encode_hash(spark, sf):
    return N.encode_hash(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type"), ["p_name", "p_brand", "p_type"])


@query("encode_ordinal_custom", "select o_orderkey, case o_orderpriority when '5-LOW' then 0 when '3-MEDIUM' then 1 when '1-URGENT' then 2 end as o_orderpriority from orders")
def encode_ordinal_custom(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return N.encode_ordinal_custom(orders, "o_orderpriority", ["5-LOW", "3-MEDIUM", "1-URGENT"])


@query("encode_override", f"""with c as (select p_name, count(*) as n from part group by 1),
  t as (select p_type, dense_rank() over (order by p_type) - 1 as code from (select distinct p_type from part))
  select p_partkey, round(c.n / (select count(*) from part)::double, 9) + 0.0 as p_name, t.code::int as p_type
  from part join c using (p_name) join t using (p_type)""")
def encode_override(spark, sf):
    """Named methods in place of the routed ones, as the stage applies them."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    stage = TableStage("encode", columns=["p_name", "p_type"], override={"p_name": "count", "p_type": "ordinal"}, group_rare=False)
    return stage.fit(parts).transform(parts).select("p_partkey", F.round("p_name", 9).alias("p_name"), "p_type")


def reloaded(spark, stages, rows):
    """The fitted stages, written to a folder and read back."""
    folder = scratch_folder(spark, "stages")
    fitted, held = [], rows
    for stage in stages:
        fitted.append(stage.fit(held))
        held = fitted[-1].transform(held)
    PipelineModel(stages=fitted).write().save(folder)
    return PipelineModel.load(folder)


_LINES_SQL = "(select *, (l_returnflag = 'R')::int::double as y, (l_orderkey + l_linenumber) % 3 <> 0 as train from lineitem)"


@query("encode_levels_stage", f"""with b as {_LINES_SQL},
  t as (select l_orderkey::varchar as k, avg(y) as m, count(*) as n, sum(y) as s, row_number() over (order by l_orderkey::varchar) - 1 as code from b where train group by 1),
  p as (select avg(y) as prior, sum(y) as s, count(*)::double as n from b where train),
  parts as (select l_partkey, row_number() over (order by count(*) desc, l_partkey::varchar desc) as place from b where train group by 1)
  select b.l_orderkey, b.l_linenumber, coalesce(t.code, -1)::int as k_ordinal,
    round(coalesce((1 / (1 + exp(-(t.n - 10) / 5.0::double))) * t.m + (1 - 1 / (1 + exp(-(t.n - 10) / 5.0::double))) * p.prior, p.prior), 6) + 0.0 as k_target,
    round(coalesce(case when t.n = 1 then 0 else ln(((t.s + 1) / (p.s + 2)) / ((t.n - t.s + 1) / (p.n - p.s + 2))) end, 0), 6) + 0.0 as k_woe,
    round(coalesce(t.n / p.n, 0), 9) + 0.0 as k_count, coalesce(parts.place > 14, false)::int::double as pooled
  from b cross join p left join t on t.k = b.l_orderkey::varchar left join parts on parts.l_partkey = b.l_partkey""")
def encode_levels_stage(spark, sf):
    """Every encoding of a column with as many levels as there are orders, from a saved model."""
    kinds = ["ordinal", "target", "woe", "count"]
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("double").alias("y"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 3 != 0).alias("train"),
        *[F.col("l_orderkey").cast("string").alias(f"k_{k}") for k in kinds], F.col("l_partkey").cast("string").alias("part"),
    )
    override = {**{f"k_{k}": k for k in kinds}, "part": "onehot"}
    stage = TableStage("encode", columns=list(override), target="y", override=override, group_rare=False)
    model = reloaded(spark, [stage], lines.where("train"))
    out = model.transform(lines)
    return out.select(
        "l_orderkey", "l_linenumber", "k_ordinal", F.round("k_target", 6).alias("k_target"), F.round("k_woe", 6).alias("k_woe"),
        F.round("k_count", 9).alias("k_count"), F.col(f"part_{N.POOLED}").alias("pooled"),
    )


@query("fe_group_stage", """with g as (select user_id, avg(value) as m, stddev_samp(value) as s, quantile_cont(value, 0.5) as d, count(distinct event_type) as u
    from events where event_id % 3 <> 0 group by 1),
  k as (select event_type, max(value) as most from events where event_id % 3 <> 0 and event_type <> 'view' group by 1)
  select event_id, round(m, 6) + 0.0 as value_by_user_id_mean, round(s, 6) + 0.0 as value_by_user_id_std, round(d, 6) + 0.0 as value_by_user_id_median,
    u as event_type_by_user_id_nunique, round(most, 6) + 0.0 as value_by_event_type_max,
    floor((epoch(ts) - epoch(timestamp '2020-01-01')) / 86400)::bigint as ts_days_since_ref
  from events left join g using (user_id) left join k using (event_type)""")
def fe_group_stage(spark, sf):
    """Group statistics and days since a date, from a saved model; groups it has not seen have none."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "ts")
    # Typed as text in training and scoring alike; one type of event is unseen in training.
    known = events.where("event_id % 3 <> 0").withColumn("event_type", F.when(F.col("event_type") != "view", F.col("event_type")))
    every = {"user_id": ("mean", "std", "median"), "event_type": ("max",)}
    groups = [{"group": g, "column": "value", "functions": f} for g, f in every.items()]
    typed = {"group": "user_id", "column": "kind", "functions": ("nunique",)}
    stage = TableStage("engineer", groups=[*groups, typed], dates=["ts"], since={"ts": "2020-01-01"})
    kinds = events.select("event_id", F.col("event_type").alias("kind"))
    out = reloaded(spark, [stage], known.join(kinds, "event_id")).transform(events.withColumn("kind", F.col("event_type")))
    return out.select(
        "event_id", *[F.round(f"value_by_user_id_{f}", 6).alias(f"value_by_user_id_{f}") for f in ("mean", "std", "median")],
        F.col("kind_by_user_id_nunique").alias("event_type_by_user_id_nunique"),
        F.round("value_by_event_type_max", 6).alias("value_by_event_type_max"), "ts_days_since_ref",
    )
