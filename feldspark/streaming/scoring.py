"""Scoring streams with the batch code, and monitoring them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import is_web_url
from ..operators.score import decide, prediction_log
from ..operators.url_table import url_features


def score_urls(df: DataFrame, model: PipelineModel, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """Reject what is no web URL, compute features, score and decide. Batch and stream alike."""
    accepted = df.where(is_web_url(F.col(url)))
    out = model.transform(url_features(accepted, url))
    kept = [c for c in out.columns if c not in ("features", "rawPrediction", "probability", "prediction")]
    return decide(out.select(*kept, vector_to_array("probability")[1].alias("probability")), "probability", threshold)


def rejected_urls(df: DataFrame, url: str = "url") -> DataFrame:
    return df.where(~F.coalesce(is_web_url(F.col(url)), F.lit(False)))


def run_in_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, state: str) -> None:
    """Apply batch code to every micro-batch and store its result under the batch's number.

    A batch that is repeated after a failure overwrites its own folder, so every input row
    counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def stream_scores(spark: SparkSession, source: DataFrame, model: PipelineModel, out: str, state: str, threshold: float = 0.5) -> DataFrame:
    run_in_batches(source, lambda batch: score_urls(batch, model, threshold=threshold), out, state)
    return spark.read.parquet(out)


def stream_prediction_log(
    spark: SparkSession, source: DataFrame, model: PipelineModel, version: str, features, out: str, state: str
) -> DataFrame:
    def work(batch: DataFrame) -> DataFrame:
        return prediction_log(score_urls(batch, model), "url", "probability", "label", version, features)

    run_in_batches(source, work, out, state)
    return spark.read.parquet(out)


def monitor(scored: DataFrame, at: str, probability: str, latency: str, every: str = "1 hour", late: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Count, positive share, mean probability and mean latency per event-time window.

    With ``late`` (streams) rows older than the watermark are dropped.
    """
    timed = scored.withColumn("__at", F.col(at).cast("timestamp"))
    if late:
        timed = timed.withWatermark("__at", late)
    return timed.groupBy(F.window("__at", every)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(probability) >= threshold).cast("double")).alias("positive_share"),
        F.avg(probability).alias("mean_probability"),
        F.avg(latency).alias("mean_latency"),
    ).select(F.col("window.start").alias("window_start"), "n", "positive_share", "mean_probability", "mean_latency")


def stream_monitor(spark: SparkSession, scored: DataFrame, at: str, probability: str, latency: str, out: str, state: str, every="1 hour", late="2 hours") -> DataFrame:
    """Latest figures of every window, from the windows each micro-batch updated."""
    updates = monitor(scored, at, probability, latency, every, late)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    (
        updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state)
        .trigger(availableNow=True).start().awaitTermination()
    )
    names = ["n", "positive_share", "mean_probability", "mean_latency"]
    latest = spark.read.parquet(out).groupBy("window_start").agg(F.max_by(F.struct(*names), "batch").alias("v"))
    return latest.select("window_start", *[F.col(f"v.{n}").alias(n) for n in names])
