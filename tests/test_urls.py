import urllib.parse

import pytest
from pyspark.sql import functions as F

from feldspark.functions import urls as U
from feldspark.operators.url_table import host_facts_as_of, url_features

CASES = [
    "https://example.com/login",
    "http://bit.ly/a_b-c",
    "http://192.168.0.1:8080/admin/server.php?x=1",
    "https://user:pw@host.co.id/a/b/c.html?q=&r=1&r=2&s",
    "https://a.b.example.com",
    "http://example.com/file",
    "http://example.com/dir/",
    "http://example.com/a;p=1/b;v=2?u=http://x.com/%20y z#frag",
    "HTTP://EXAMPLE.com/Upper",
    "http://example.com/?mail=me@site.org&k%20ey=1&k+ey=2",
    "http://example.com?noslash=1",
    "http:///nohost/path",
    "http://[::1]:80/x",
    "http://example.com/ü/é?ä=1",
    "not a url",
    "http://a.com//x",
    "http://a.com//",
    "http://a.com///x",
]


def expected(url):
    parsed = urllib.parse.urlparse(url)
    name = parsed.netloc.lower().split(":")[0]
    path = parsed.path
    directory, _, last = path.rpartition("/") if "/" in path else ("", "", "")
    directory = "" if directory == "/" else directory
    out = {"length_url": len(url), "qty_dot_url": url.count("."), "qty_space_url": url.count(" ") + url.count("%20")}
    out["qty_tld_url"] = max(1, sum(url.lower().count("." + t) for t in U.COMMON_TLDS))
    out["domain_length"] = len(name)
    out["qty_vowels_domain"] = sum(c in "aeiou" for c in name)
    out["directory_length"] = len(directory) or None
    out["file_length"] = len(last) or None
    out["qty_slash_directory"] = directory.count("/") if directory else None
    query = parsed.query
    out["params_length"] = len(query) or None
    out["qty_params"] = len(urllib.parse.parse_qs(query)) if query else None
    out["tld_present_params"] = 1.0 if any("." + t in query.lower() for t in U.COMMON_TLDS) else -1.0
    out["url_shortened"] = float(name in U.SHORTENER_HOSTS)
    return out


def test_features_match_the_standard_parser(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(CASES)], "i int, url string")
    parts = U.with_components(df, "url")
    rows = parts.select("i", *[c.alias(n) for n, c in U.lexical_features("url").items()]).collect()
    assert len(rows[0]) == 1 + 98
    for row in rows:
        for name, value in expected(CASES[row["i"]]).items():
            assert row[name] == value, (CASES[row["i"]], name)


def test_homograph_host_is_decoded(spark):
    pytest.importorskip("idna")
    df = spark.createDataFrame([("https://xn--pple-43d.com/login",), ("https://example.com/login",)], "url string")
    rows = {r["url"]: r for r in url_features(df, "url").collect()}
    odd = rows["https://xn--pple-43d.com/login"]
    assert odd["url_decoded"] == "https://аpple.com/login"
    assert (odd["is_punycode"], odd["homograph_score"], odd["n_unicode_chars"]) == (1.0, 1.0, 1.0)
    assert odd["domain_length"] == 9
    assert rows["https://example.com/login"]["is_punycode"] == 0.0


def test_root_domains(spark):
    names = ["a.com", "docs.github.com", "x.y.co.id", "www.gov.uk", "localhost", "a.b.com.br"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(U.root_domain(F.col("n"))).collect()]
    assert got == ["a.com", "github.com", "y.co.id", "www.gov.uk", "localhost", "b.com.br"]


def test_model_blind_columns_leave_twelve_inputs():
    everything = set(U.url_column_names()) | {"is_punycode", "n_unicode_chars", "homograph_score"} | set(U.HOST_FACTS)
    blind = U.model_blind_columns()
    assert len(blind) == len(set(blind)) == 104
    assert len(everything) == 114 and len(everything - set(blind)) == 12


def test_facts_as_of_the_request(spark):
    facts = spark.createDataFrame(
        [("h", "2024-01-01 00:00:00", 1.0, None), ("h", "2024-01-03 00:00:00", 2.0, None), ("g", "2024-01-02 00:00:00", 3.0, 1.0)],
        "host string, at string, ttl_hostname double, tls_ssl_certificate double",
    ).selectExpr(
        "host", "cast(at as timestamp) observed_at", "cast('2023-12-31' as timestamp) created_at", "cast('2024-01-02' as timestamp) expires_at",
        "ttl_hostname", "tls_ssl_certificate",
    )
    asked = spark.createDataFrame(
        [(1, "h", "2024-01-02 12:00:00"), (2, "h", "2023-12-01 00:00:00"), (3, "h", "2024-01-03 00:00:00"), (4, "g", "2025-01-01 00:00:00"), (5, "z", "2025-01-01 00:00:00")],
        "id int, host string, at string",
    ).withColumn("at", F.col("at").cast("timestamp"))
    got = {r["id"]: r for r in host_facts_as_of(asked, facts, "id", "host", "at").collect()}
    assert [got[i]["ttl_hostname"] for i in range(1, 6)] == [1.0, None, 2.0, 3.0, None]
    assert got[1]["time_domain_activation"] == 2.0 and got[1]["time_domain_expiration"] == 0.0
    assert got[1]["tls_ssl_certificate"] == 0.0 and got[4]["tls_ssl_certificate"] == 1.0
    assert got[5]["url_google_index"] == 0.0 and got[2]["asn_ip"] is None
