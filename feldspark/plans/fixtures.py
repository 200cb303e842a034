"""Derived tables shared by the queries, in Spark and as SQL text.

The given tables hold no nulls. ``events_nulls`` keeps every row and blanks some cells
by a fixed rule, so that the missing-value operators have work to do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import table

EVENTS_NULLS_SQL = """(select event_id, ts, user_id,
  case when event_id % 10 = 0 then null else event_type end as event_type,
  case when event_id % 5 = 0 then null else value end as value,
  case when (event_id + user_id) % 9 = 0 then null else cast(user_id * 3 + event_id % 7 as double) end as score
  from events)"""


def events_nulls(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.expr("case when event_id % 10 = 0 then null else event_type end").alias("event_type"),
        F.expr("case when event_id % 5 = 0 then null else value end").alias("value"),
        F.expr(
            "case when (event_id + user_id) % 9 = 0 then null else cast(user_id * 3 + event_id % 7 as double) end"
        ).alias("score"),
    )


DOC_FEATURES_SQL = """(select d.doc_id, cast(length(text) as double) as f_length,
  cast(length(text) - length(replace(text, ' ', '')) as double) as f_spaces,
  cast(length(text) - length(replace(text, '.', '')) as double) as f_dots,
  cast(length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) as double) as f_digits,
  cast(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as double) as f_upper,
  cast(length(text) - length(replace(text, chr(10), '')) as double) as f_lines,
  lang, source, quality, toxic from documents d join labels l on d.doc_id = l.doc_id)"""

DOC_FEATURES = ["f_length", "f_spaces", "f_dots", "f_digits", "f_upper", "f_lines"]


def labelled_docs(spark, sf):
    """Documents with labels and a few counts of their whole text."""
    text = F.col("text")
    size = F.length(text)
    return (
        table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
            "doc_id",
            size.cast("double").alias("f_length"),
            (size - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("double").alias("f_spaces"),
            (size - F.length(F.replace(text, F.lit("."), F.lit("")))).cast("double").alias("f_dots"),
            (size - F.length(F.regexp_replace(text, "[0-9]", ""))).cast("double").alias("f_digits"),
            (size - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("double").alias("f_upper"),
            (size - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("double").alias("f_lines"),
            "lang",
            "source",
            "quality",
            "toxic",
        )
    )


def md5_order(seed, column):
    """SQL text of the hash order key."""
    return f"md5(concat('{seed}:', cast({column} as varchar)))"


def md5_uniform(text_sql):
    return f"(cast(('0x' || substr(md5({text_sql}), 1, 13)) as bigint) / 4503599627370496.0::double)"
