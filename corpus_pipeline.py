"""Corpus preparation in stages; each takes (spark, docs, sf_dir) and returns the documents it keeps.

Toxic documents go first, then all but one document of each group of near copies, then documents
that hold benchmark items. Secrets are replaced by their kind, and the rest is repeated or sampled
so that the sources take their target shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feldspark.llm import decontaminate, mixing, near_duplicates, secrets, toxicity
from feldspark.session import cut_lineage


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, or the first longer form of it that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject; a null or empty text is scored like any other.

    Repeated rows get equal answers; without labelled rows nothing is rejected; columns stay, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id, null ids last; of equal rows one.

    Rows whose text is null or has no words are no copies and stay; columns stay, whatever their names.
    """
    return near_duplicates.without_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item; null and empty texts and items hold nothing.

    Repeated rows go or stay together; without items all stay; columns stay, whatever their names.
    """
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with every secret of the text replaced by its kind, and ``n_chars``, where there is one, brought up to date.

    Null texts stay null; repeated rows get equal texts. What was found is in a column no caller has, and does not leave this stage.
    """
    held = _unused(docs, "found_secrets")
    found = secrets.secret_spans(docs, into=held)
    fresh = F.when(F.size(held) > 0, secrets.redacted(F.col("text"), F.col(held))).otherwise(F.col("text"))
    # One column after another, so that the length is of the text as it was found.
    if "n_chars" in docs.columns:
        length = F.when(F.size(held) > 0, F.length(fresh)).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return found.withColumn("text", fresh).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, with ``repetition`` from 1 (under a longer name where a column has that one).

    Null is a source like others; null texts have no words; rows of one id, null ids too, are taken equally often.
    """
    return mixing.repeated(docs, number=_unused(docs, "repetition"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_benchmark),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The trained stage has no SQL; tests hold the stages against plain versions of the rest.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
