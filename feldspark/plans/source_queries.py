"""Source, sink and sampling queries; filters and input checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..sources import tables as S
from ..session import small_table
from .catalog import query, table
from .fixtures import EVENTS_NULLS_SQL, events_nulls, labelled_docs, md5_order, DOC_FEATURES_SQL

ORDERS_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
_ORDERS = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders"


def orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("load_table", "select * from customer")
def load_table(spark, sf):
    return S.load(spark, f"{sf}/customer.parquet")


@query("feather_io", _ORDERS)
def feather_io(spark, sf):
    folder = S.scratch_folder(spark, "feather") + ".feather"
    S.save(orders(spark, sf), folder)
    return S.load(spark, folder, ORDERS_SCHEMA)


@query("save_table", _ORDERS)
def save_table(spark, sf):
    path = S.save(orders(spark, sf), S.scratch_folder(spark, "orders") + ".csv")
    return S.load(spark, path, ORDERS_SCHEMA)


@query("save_json", _ORDERS)
def save_json(spark, sf):
    path = S.scratch_folder(spark, "orders") + ".json"
    orders(spark, sf).write.mode("overwrite").json(path)
    return spark.read.schema(ORDERS_SCHEMA).json(path)


@query("sample_fraction", f"""select event_id, user_id from events
  qualify row_number() over (order by {md5_order(7, 'event_id')}) <= (select round_even(count(*) * 0.3, 0) from events)""")
def sample_fraction(spark, sf):
    return S.sample_fraction(table(spark, sf, "events"), 0.3, "event_id", 7).select("event_id", "user_id")


@query("sample_n", f"select event_id, user_id from events order by {md5_order(7, 'event_id')} limit 2500")
def sample_n(spark, sf):
    return S.sample_n(table(spark, sf, "events"), 2500, "event_id", 7).select("event_id", "user_id")


@query("incremental_csv", "select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def incremental_csv(spark, sf):
    source = S.scratch_folder(spark, "increments")
    orders(spark, sf).repartition(4, "o_orderkey").write.csv(source, header=True)
    base = S.scratch_folder(spark, "incremental")
    loaded = S.load_incremental(spark, source, ORDERS_SCHEMA, f"{base}/table", f"{base}/state", files_per_batch=2)
    return loaded.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("map_batches", "select o_orderkey, round(o_totalprice * 0.5, 4) as half, upper(o_orderstatus) as status from orders")
def map_batches(spark, sf):
    def halve(batch):
        return batch.assign(half=(batch["o_totalprice"] * 0.5).round(4), status=batch["o_orderstatus"].str.upper())[
            ["o_orderkey", "half", "status"]
        ]

    return S.map_batches(orders(spark, sf), halve, "o_orderkey bigint, half double, status string")


@query("table_info", f"""select count(*) as n_rows, 6::bigint as n_cols,
  sum((event_type is null)::bigint + (value is null)::bigint + (score is null)::bigint)::bigint as n_missing,
  (count(*) - count(distinct (event_id, ts, user_id, event_type, value, score)))::bigint as n_duplicates
  from {EVENTS_NULLS_SQL}""")
def table_info(spark, sf):
    return S.table_info(events_nulls(spark, sf))


@query("select_numeric", "select c_custkey, c_nationkey, c_acctbal from customer")
def select_numeric(spark, sf):
    from ..functions.roles import numeric_columns

    customers = table(spark, sf, "customer")
    return customers.select(*numeric_columns(customers))


@query("drop_duplicates", "select distinct o_orderstatus, o_orderpriority, o_custkey from orders")
def drop_duplicates(spark, sf):
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey").dropDuplicates()


@query("sentinel_to_null", """select event_id, user_id, nullif(case when event_id % 7 = 0 then -1 else value end, -1) as value
  from events""")
def sentinel_to_null(spark, sf):
    coded = table(spark, sf, "events").select(
        "event_id", "user_id", F.expr("case when event_id % 7 = 0 then -1 else value end").alias("value")
    )
    return C.sentinel_to_null(coded)


@query("validate_input", """select count(*) as n_rows, count(*) filter (quality is null) as n_null_target,
  (count(*) < 100)::int as few_rows from labels""")
def validate_input(spark, sf):
    found = C.validate_input(table(spark, sf, "labels"), "quality")
    return small_table(spark, [(found["n_rows"], found["n_null_target"], int(found["few_rows"]))], "n_rows bigint, n_null_target bigint, few_rows int")


_SPARSE = """(select event_id, user_id, case when event_id % 4 <> 0 then null else value end as sparse_value,
  case when event_id % 3 = 0 then null else event_type end as some_type from events)"""


def sparse_events(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        "user_id",
        F.expr("case when event_id % 4 <> 0 then null else value end").alias("sparse_value"),
        F.expr("case when event_id % 3 = 0 then null else event_type end").alias("some_type"),
    )


@query("drop_sparse_columns", f"select event_id, user_id, some_type from {_SPARSE}")
def drop_sparse_columns(spark, sf):
    return C.drop_sparse_columns(sparse_events(spark, sf), 0.6)


@query("drop_sparse_rows", f"""select * from {_SPARSE}
  where ((sparse_value is null)::int + (some_type is null)::int) / 4.0::double <= 0.3""")
def drop_sparse_rows(spark, sf):
    return C.drop_sparse_rows(sparse_events(spark, sf), 0.3)


@query("missing_indicators", f"""select *, (event_type is null)::int as event_type_was_missing,
  (value is null)::int as value_was_missing, (score is null)::int as score_was_missing from {EVENTS_NULLS_SQL}""")
def missing_indicators(spark, sf):
    events = events_nulls(spark, sf)
    with_nulls = [c for c, share in C.null_shares(events).items() if share > 0]
    return C.missing_indicators(events, with_nulls)


@query("validate_no_missing", f"""select count(*) filter (event_type is null) + count(*) filter (value is null)
  + count(*) filter (score is null) as n_missing, 0 as is_complete from {EVENTS_NULLS_SQL}""")
def validate_no_missing(spark, sf):
    return C.missing_summary(events_nulls(spark, sf))


@query("binary_columns", """select 'quality' as "column" union all select 'toxic'""")
def binary_columns(spark, sf):
    docs = labelled_docs(spark, sf).select("doc_id", "f_length", "quality", "toxic")
    return small_table(spark, [(c,) for c in C.binary_columns(docs)], "column string")


@query("split_tables", f"""select split, count(*) as n, round(sum(value), 3) as total from (
  select value, case when event_id % 10 < 7 then 'train' when event_id % 10 < 9 then 'val' else 'test' end as split from events)
  where split <> 'val' group by 1""")
def split_tables(spark, sf):
    from ..operators.split import read_splits, write_splits

    marked = table(spark, sf, "events").withColumn(
        "split", F.expr("case when event_id % 10 < 7 then 'train' when event_id % 10 < 9 then 'val' else 'test' end")
    )
    folder = write_splits(marked, S.scratch_folder(spark, "splits"))
    held = read_splits(spark, folder, ["train", "test"])
    return held.groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("write_predictions", f"""select doc_id, (f_digits / (f_length + 1) >= 0.01)::int as prediction,
  round(f_digits / (f_length + 1), 4) as probability from {DOC_FEATURES_SQL}""")
def write_predictions(spark, sf):
    scored = labelled_docs(spark, sf).select("doc_id", (F.col("f_digits") / (F.col("f_length") + 1)).alias("p"))
    scored = scored.withColumn("label", (F.col("p") >= 0.01).cast("int"))
    path = S.scratch_folder(spark, "predictions") + ".csv"
    S.write_predictions(scored, "label", "p", path)
    return S.load(spark, path, "doc_id bigint, p double, label int, prediction int, probability double").select(
        "doc_id", "prediction", "probability"
    )
