"""URL tables: IDN decoding, host facts as of the request time, the full feature row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U


def _decode_host(name: str) -> str:
    try:
        import idna

        return idna.decode(name)
    except Exception:
        return name


def _decode_hosts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for hosts in batches:
        yield hosts.assign(__dec=hosts["__auth"].map(_decode_host))


def decode_idn(df: DataFrame, url_column: str) -> DataFrame:
    """Add ``url_decoded``, ``is_punycode``, ``n_unicode_chars`` and ``homograph_score``.

    Only hosts that decoding could change (an ``xn--`` label, upper case or other
    characters outside plain host names) reach Python, each once.
    """
    named = df.withColumn("__auth", U.authority(F.col(url_column)))
    odd = F.col("__auth").contains("xn--") | F.col("__auth").rlike("[^a-z0-9.-]")
    decoded = (
        named.where(odd).select("__auth").distinct().mapInPandas(_decode_hosts, "__auth string, __dec string")
        .where(F.col("__dec") != F.col("__auth"))
    )
    # Plain hosts cannot change and need no join; a missing address is neither odd nor plain.
    plain = ~F.coalesce(odd, F.lit(False))
    joined = named.where(plain).withColumn("__dec", F.lit(None).cast("string")).unionByName(
        named.where(~plain).join(decoded, "__auth", "left")
    )
    changed = F.col("__dec").isNotNull() & (F.col("__auth") != "")
    readable = F.when(changed, F.replace(F.col(url_column), F.col("__auth"), F.col("__dec"))).otherwise(F.col(url_column))
    return joined.select(
        *df.columns,
        readable.alias("url_decoded"),
        U.flag(changed).alias("is_punycode"),
        U.non_ascii_count(readable).cast("double").alias("n_unicode_chars"),
        F.when(changed & (U.non_ascii_count(F.col("__dec")) > 0), 1.0).otherwise(0.0).alias("homograph_score"),
    )


def lexical_table(df: DataFrame, url_column: str) -> DataFrame:
    """Input columns plus every text feature of ``url_column``."""
    features = U.lexical_features(url_column)
    return U.with_components(df, url_column).select(*df.columns, *[c.alias(n) for n, c in features.items()])


def host_facts_as_of(
    urls: DataFrame,
    facts: DataFrame,
    key: str,
    host: str,
    at: str,
    fact_host: str = "host",
    observed_at: str = "observed_at",
) -> DataFrame:
    """Attach to each row of ``urls`` the latest facts of its host known at its time.

    The as-of join runs on the union of both tables ordered within each host: facts and
    requests interleave by time and the last fact carries forward. One shuffle, no pair
    of request and observation is ever formed, and a host with very many rows is split
    over range partitions.
    """
    from .ordering import surrounding_values

    fields = [c for c in facts.columns if c not in (fact_host, observed_at)]
    packed = facts.select(
        F.lit(None).cast(urls.schema[key].dataType).alias("__id"),
        F.col(fact_host).alias("__host"),
        F.col(observed_at).cast("timestamp").alias("__at"),
        F.lit(0).alias("__kind"),
        F.struct(F.col(observed_at).alias("__seen"), *fields).alias("__fact"),
    )
    asked = urls.select(
        F.col(key).alias("__id"),
        F.col(host).alias("__host"),
        F.col(at).cast("timestamp").alias("__at"),
        F.lit(1).alias("__kind"),
        F.lit(None).cast(packed.schema["__fact"].dataType).alias("__fact"),
    )
    merged = surrounding_values(
        packed.unionByName(asked), ["__at", "__kind", "__id"], {"fact": F.col("__fact")}, group=["__host"]
    )
    known = merged.where("__kind = 1").select(F.col("__id").alias(key), "prev_fact", "__at")

    def days(later, earlier):
        seconds = later.cast("timestamp").cast("double") - earlier.cast("timestamp").cast("double")
        return F.greatest(F.lit(0.0), F.floor(seconds / 86400)).cast("double")

    found = {}
    for name in U.HOST_FACTS:
        if name == "time_domain_activation":
            found[name] = F.when(F.col("prev_fact.created_at").isNotNull(), days(F.col("__at"), F.col("prev_fact.created_at")))
        elif name == "time_domain_expiration":
            found[name] = F.when(F.col("prev_fact.expires_at").isNotNull(), days(F.col("prev_fact.expires_at"), F.col("__at")))
        elif name in fields:
            value = F.col(f"prev_fact.{name}").cast("double")
            found[name] = F.coalesce(value, F.lit(0.0)) if name == "tls_ssl_certificate" else value
        elif name in ("url_google_index", "domain_google_index", "tls_ssl_certificate"):
            found[name] = F.lit(0.0)
        else:
            found[name] = F.lit(None).cast("double")
    return urls.join(known.select(key, *[c.alias(n) for n, c in found.items()]), key, "left")


def url_features(df: DataFrame, url_column: str) -> DataFrame:
    """Decode, then compute every text and IDN feature on the decoded URL."""
    decoded = decode_idn(df, url_column)
    return lexical_table(decoded, "url_decoded")
