"""Scoring: feature contract, decision, log rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align_to_contract(
    df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """Exactly the contracted features, in order; absent ones become null (or an error)."""
    missing = [f for f in features if f not in df.columns]
    if strict and missing:
        raise ValueError(f"features missing from the input: {missing}")
    return df.select(
        *keep,
        *[F.lit(None).cast("double").alias(f) if f in missing else F.col(f"`{f}`").cast("double").alias(f) for f in features],
    )


def decide(df: DataFrame, probability: str, threshold: float = 0.5) -> DataFrame:
    """Add ``label``, ``confidence`` and ``threshold`` to scored rows."""
    p = F.col(probability)
    positive = p >= F.lit(float(threshold))
    high = F.when(positive, p > 0.90).otherwise(p < 0.10)
    medium = F.when(positive, p > 0.70).otherwise(p < 0.30)
    return df.withColumns(
        {
            "label": F.when(positive, "PHISHING").otherwise("LEGITIMATE"),
            "confidence": F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW"),
            "threshold": F.lit(float(threshold)),
        }
    )


def prediction_log(
    df: DataFrame, url: str, probability: str, label: str, model_version: Column | str, features: Sequence[str],
    latency: Column | None = None,
) -> DataFrame:
    """Log rows that carry md5 of the URL in place of the URL."""
    version = F.lit(model_version) if isinstance(model_version, str) else model_version
    pairs = [x for f in features for x in (F.lit(f), F.col(f"`{f}`").cast("double"))]
    return df.select(
        F.md5(F.col(url)).alias("url_hash"),
        (F.col(label) == "PHISHING").cast("int").alias("is_phishing"),
        F.col(probability).alias("probability"),
        version.alias("model_version"),
        F.col("is_punycode").cast("int").alias("is_punycode") if "is_punycode" in df.columns else F.lit(0).alias("is_punycode"),
        (latency if latency is not None else F.lit(None).cast("double")).alias("inference_ms"),
        F.create_map(*pairs).alias("all_features"),
    )


def confident_rows(df: DataFrame, probability: str, at_least: float = 0.95) -> DataFrame:
    """Rows whose likelier class has at least the given probability, with it as ``label``."""
    p = F.col(probability)
    return df.where(F.greatest(p, 1 - p) >= F.lit(at_least)).withColumn("label", (p >= 0.5).cast("double"))
