"""Lexical URL features as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters counted in every URL component, by feature name.
COUNTED_CHARACTERS = {
    "dot": ".",
    "hyphen": "-",
    "underline": "_",
    "slash": "/",
    "questionmark": "?",
    "equal": "=",
    "at": "@",
    "and": "&",
    "exclamation": "!",
    "space": " ",
    "tilde": "~",
    "comma": ",",
    "plus": "+",
    "asterisk": "*",
    "hashtag": "#",
    "dollar": "$",
    "percent": "%",
}

# Top-level domains whose occurrences are counted.
COMMON_TLDS = [
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "aero",
    "coop", "museum", "co", "io", "me", "tv", "cc", "us", "uk", "de", "fr", "br",
    "ru", "cn", "jp", "kr", "in", "au", "ca", "id", "xyz", "top", "site", "online",
    "club", "app", "dev", "tech", "store", "shop", "blog", "cloud", "ai", "ly",
]

# Hosts of link shorteners.
SHORTENER_HOSTS = [
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "is.gd", "cli.gs",
    "ow.ly", "rebrand.ly", "bl.ink", "short.io", "cutt.ly", "buff.ly",
    "soo.gd", "tiny.cc", "lnkd.in", "db.tt", "qr.ae", "adf.ly",
    "bit.do", "mcaf.ee", "su.pr", "yourls.org", "v.gd", "tr.im",
]

# Second-level labels that make a three-label root domain.
SECOND_LEVEL_LABELS = ["co", "com", "org", "net", "ac", "gov", "edu"]

# The facts about a host that are looked up, not computed from the text.
HOST_FACTS = [
    "time_response",
    "qty_redirects",
    "qty_ip_resolved",
    "ttl_hostname",
    "qty_nameservers",
    "qty_mx_servers",
    "domain_spf",
    "time_domain_activation",
    "time_domain_expiration",
    "tls_ssl_certificate",
    "asn_ip",
    "url_google_index",
    "domain_google_index",
]

# Patterns.
URL_PATTERN = r"^([a-zA-Z][a-zA-Z0-9+.-]*:)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#.*)?"
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
IPV4_PATTERN = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"


def occurrences(column: str, piece: str) -> str:
    """SQL text: non-overlapping occurrences of a literal piece."""
    gone = f"(length(`{column}`) - length(replace(`{column}`, '{piece}', '')))"
    return gone if len(piece) == 1 else f"({gone} div {len(piece)})"


def authority(url: Column) -> Column:
    return F.regexp_extract(url, URL_PATTERN, 3)


def host(url: Column) -> Column:
    """Lower-case authority up to the first colon (user info is not treated specially)."""
    return F.substring_index(F.lower(authority(url)), ":", 1)


def path(url: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    return F.regexp_replace(F.regexp_extract(url, URL_PATTERN, 4), ";[^/]*$", "")


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, URL_PATTERN, 6)


def directory(url_path: Column) -> Column:
    cut = F.length(url_path) - F.length(F.substring_index(url_path, "/", -1)) - 1
    return F.when(url_path.contains("/"), F.substring(url_path, F.lit(1), cut)).otherwise("")


def file_name(url_path: Column) -> Column:
    return F.when(url_path.contains("/"), F.substring_index(url_path, "/", -1)).otherwise("")


def root_domain(name: Column) -> Column:
    labels = F.split(name, r"\.")
    second_last = F.element_at(labels, -2)
    return (
        F.when(F.size(labels) <= 2, name)
        .when(second_last.isin(SECOND_LEVEL_LABELS), F.array_join(F.slice(labels, -3, 3), "."))
        .otherwise(F.array_join(F.slice(labels, -2, 2), "."))
    )


def tld_occurrences(column: str) -> str:
    """SQL text: occurrences of every known top-level domain in a lower-case column."""
    return " + ".join(occurrences(column, f".{name}") for name in COMMON_TLDS)


def distinct_query_keys(query: Column) -> Column:
    """Distinct decoded keys that have a non-blank value."""
    pairs = F.filter(F.split(query, "&"), lambda p: (F.locate("=", p) > 0) & (F.length(p) > F.locate("=", p)))

    def decoded(pair: Column) -> Column:
        key = F.substring_index(pair, "=", 1)
        return F.coalesce(F.try_url_decode(key), key)

    return F.size(F.array_distinct(F.transform(pairs, decoded)))


def non_ascii_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))


def is_web_url(url: Column) -> Column:
    return url.rlike("^https?://")


def character_counts(column: str, component: str, escaped_space: bool = True) -> dict[str, Column]:
    counts = {}
    for name, character in COUNTED_CHARACTERS.items():
        n = occurrences(column, character)
        if character == " " and escaped_space:
            n = f"{n} + {occurrences(column, '%20')}"
        counts[f"qty_{name}_{component}"] = F.expr(f"cast({n} as double)")
    return counts


def _null_when_empty(column: str, features: dict[str, Column]) -> dict[str, Column]:
    return {k: F.when(F.length(column) > 0, v) for k, v in features.items()}


def flag(condition: Column) -> Column:
    return condition.cast("double")


def _size(column: str) -> Column:
    return F.length(column).cast("double")


def url_counts(url: str) -> dict[str, Column]:
    return {"length_url": _size(url), **character_counts(url, "url")}


def url_marks(url: str, lowered: str, name: str) -> dict[str, Column]:
    return {
        "qty_tld_url": F.expr(f"cast(greatest(1, {tld_occurrences(lowered)}) as double)"),
        "email_in_url": flag(F.col(url).rlike(EMAIL_PATTERN)),
        "url_shortened": flag(F.col(name).isin(SHORTENER_HOSTS)),
    }


def domain_features(name: str) -> dict[str, Column]:
    text = F.col(name)
    return {
        **character_counts(name, "domain", escaped_space=False),
        "qty_vowels_domain": (F.length(text) - F.length(F.translate(text, "aeiou", ""))).cast("double"),
        "domain_length": _size(name),
        "domain_in_ip": flag(text.rlike(IPV4_PATTERN)),
        "server_client_domain": flag(text.contains("server") | text.contains("client")),
    }


def directory_features(column: str) -> dict[str, Column]:
    features = {**character_counts(column, "directory"), "directory_length": _size(column)}
    return {k: F.when((F.length(column) > 0) & (F.col(column) != "/"), v) for k, v in features.items()}


def file_features(column: str) -> dict[str, Column]:
    return _null_when_empty(column, {**character_counts(column, "file"), "file_length": _size(column)})


def params_features(column: str) -> dict[str, Column]:
    features = _null_when_empty(
        column,
        {
            **character_counts(column, "params"),
            "params_length": _size(column),
            "qty_params": distinct_query_keys(F.col(column)).cast("double"),
        },
    )
    names = "|".join(COMMON_TLDS)
    present = F.lower(column).rlike(rf"\.({names})")
    features["tld_present_params"] = F.when(present, F.lit(1.0)).otherwise(F.lit(-1.0))
    return features


def with_components(df: DataFrame, url_column: str) -> DataFrame:
    """Add ``__low``, ``__host``, ``__dir``, ``__file`` and ``__query``, each parsed once."""
    url = F.col(url_column)
    parsed = df.select("*", host(url).alias("__host"), path(url).alias("__path"), query_string(url).alias("__query"))
    return parsed.select(
        *df.columns,
        F.lower(url).alias("__low"),
        "__host",
        directory(F.col("__path")).alias("__dir"),
        file_name(F.col("__path")).alias("__file"),
        "__query",
    )


def lexical_features(url_column: str) -> dict[str, Column]:
    """Every text feature of a table prepared by ``with_components``."""
    return {
        **url_counts(url_column),
        **url_marks(url_column, "__low", "__host"),
        **domain_features("__host"),
        **directory_features("__dir"),
        **file_features("__file"),
        **params_features("__query"),
    }


def model_blind_columns() -> list[str]:
    """Fixed rule: the columns a URL model does not see (everything but host shape, IDN and TLS)."""
    parts = ["url", "directory", "file", "params"]
    kept_domain_counts = {"dot", "hyphen", "underline"}
    blind = ["id", "customer_id"]
    blind += [f"qty_{c}_{p}" for p in parts for c in COUNTED_CHARACTERS]
    blind += [f"qty_{c}_domain" for c in COUNTED_CHARACTERS if c not in kept_domain_counts]
    blind += ["length_url", "qty_tld_url", "email_in_url", "directory_length", "file_length", "params_length"]
    blind += ["qty_params", "tld_present_params"]
    blind += [fact for fact in HOST_FACTS if fact != "tls_ssl_certificate"]
    return blind


def url_column_names() -> list[str]:
    """Names of the text features, in order."""
    names = ["length_url", *[f"qty_{c}_url" for c in COUNTED_CHARACTERS], "qty_tld_url", "email_in_url", "url_shortened"]
    names += [f"qty_{c}_domain" for c in COUNTED_CHARACTERS]
    names += ["qty_vowels_domain", "domain_length", "domain_in_ip", "server_client_domain"]
    for part in ("directory", "file", "params"):
        names += [*[f"qty_{c}_{part}" for c in COUNTED_CHARACTERS], f"{part}_length"]
    return [*names, "qty_params", "tld_present_params"]
