"""URL feature queries over ``pages`` and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.roles import rounded
from ..operators import url_table as T
from .catalog import query, table

# Every page URL, plus awkward forms derived from it: user info, last-segment parameters
# with a busy query, an IDN host, a port with an address host, and a bare host.
VARIANTS = {
    0: "url",
    1: "replace(url, '://', '://user:pw@')",
    2: "concat(url, '/a.b;x=1?next=http://bit.ly/a.com%20b&q=&r=1&r=2&me@x.io')",
    3: "concat('http://xn--pple-43d.com/login/', cast(page_id as string), '/i ndex.html')",
    4: "concat('https://10.0.0.', cast(page_id % 200 as string), ':8080/server/?p=', cast(page_id as string))",
    5: "concat('http://www.client', cast(page_id as string), '.co.id')",
}
_SQL_VARIANTS = " union all ".join(
    f"select page_id, {i} as variant, {e.replace('as string', 'as varchar')} as url from pages" for i, e in VARIANTS.items()
)


def page_urls(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    rows = [F.struct(F.lit(i).alias("variant"), F.expr(e).alias("url")) for i, e in VARIANTS.items()]
    return pages.select("page_id", F.explode(F.array(*rows)).alias("v")).select("page_id", "v.variant", "v.url")


def _counts_sql(expr, part, escaped=True):
    out = {}
    for name, ch in U.COUNTED_CHARACTERS.items():
        n = f"length({expr}) - length(replace({expr}, '{ch}', ''))"
        if ch == " " and escaped:
            n += f" + (length({expr}) - length(replace({expr}, '%20', ''))) // 3"
        out[f"qty_{name}_{part}"] = f"({n})::double"
    return out


_TLDS = " + ".join(
    f"(length(lower(url)) - length(replace(lower(url), '.{t}', ''))) // {len(t) + 1}" for t in U.COMMON_TLDS
)
_SQL_PARTS = f"""
parsed as (
  select *, regexp_extract(url, '{U.URL_PATTERN}', 3) as auth,
    split_part(lower(regexp_extract(url, '{U.URL_PATTERN}', 3)), ':', 1) as dom,
    regexp_replace(regexp_extract(url, '{U.URL_PATTERN}', 4), ';[^/]*$', '') as pth,
    regexp_extract(url, '{U.URL_PATTERN}', 6) as qs from src),
parts as (
  select *, case when contains(pth, '/') then regexp_replace(pth, '/[^/]*$', '') else '' end as dir,
    case when contains(pth, '/') then regexp_extract(pth, '([^/]*)$', 1) else '' end as fil from parsed)
"""
_URL = {"length_url": "length(url)::double", **_counts_sql("url", "url")}
_MARKS = {
    "qty_tld_url": f"greatest(1, {_TLDS})::double",
    "email_in_url": f"regexp_matches(url, '{U.EMAIL_PATTERN}')::int::double",
    "url_shortened": "(dom in (" + ", ".join(f"'{h}'" for h in U.SHORTENER_HOSTS) + "))::int::double",
}
_DOMAIN = {
    **_counts_sql("dom", "domain", escaped=False),
    "qty_vowels_domain": "length(regexp_replace(dom, '[^aeiou]', '', 'g'))::double",
    "domain_length": "length(dom)::double",
    "domain_in_ip": f"regexp_matches(dom, '{U.IPV4_PATTERN}')::int::double",
    "server_client_domain": "(contains(dom, 'server') or contains(dom, 'client'))::int::double",
}


def _nonempty(expr, features):
    return {k: f"case when {expr} <> '' then {v} end" for k, v in features.items()}


_DIRECTORY = _nonempty("nullif(dir, '/')", {**_counts_sql("dir", "directory"), "directory_length": "length(dir)::double"})
_FILE = _nonempty("fil", {**_counts_sql("fil", "file"), "file_length": "length(fil)::double"})
_PARAMS = {
    **_nonempty(
        "qs",
        {
            **_counts_sql("qs", "params"),
            "params_length": "length(qs)::double",
            "qty_params": "len(list_distinct([url_decode(split_part(p, '=', 1)) for p in string_split(qs, '&') "
            "if contains(p, '=') and length(p) > instr(p, '=')]))::double",
        },
    ),
    "tld_present_params": "case when "
    + " or ".join(f"contains(lower(qs), '.{t}')" for t in U.COMMON_TLDS)
    + " then 1.0::double else -1.0::double end",
}
_ALL = {**_URL, **_MARKS, **_DOMAIN, **_DIRECTORY, **_FILE, **_PARAMS}


def _sql(features, source=_SQL_VARIANTS, keys="page_id, variant"):
    items = ", ".join(f"{e} as {n}" for n, e in features.items())
    return f"with src as ({source}), {_SQL_PARTS} select {keys}, {items} from parts"


def _part_query(name, make, features):
    @query(name, _sql(features))
    def run(spark, sf):
        parts = U.with_components(page_urls(spark, sf), "url")
        return parts.select("page_id", "variant", *[c.alias(n) for n, c in make().items()])


_part_query("url_counts", lambda: U.url_counts("url"), _URL)
_part_query("url_tld_count", lambda: {"qty_tld_url": U.url_marks("url", "__low", "__host")["qty_tld_url"]}, {"qty_tld_url": _MARKS["qty_tld_url"]})
_part_query("url_email", lambda: {"email_in_url": U.url_marks("url", "__low", "__host")["email_in_url"]}, {"email_in_url": _MARKS["email_in_url"]})
_part_query("url_shortener", lambda: {"url_shortened": U.url_marks("url", "__low", "__host")["url_shortened"]}, {"url_shortened": _MARKS["url_shortened"]})
_part_query("url_domain", lambda: U.domain_features("__host"), _DOMAIN)
_part_query("url_directory", lambda: U.directory_features("__dir"), _DIRECTORY)
_part_query("url_file", lambda: U.file_features("__file"), _FILE)
_part_query("url_params", lambda: U.params_features("__query"), _PARAMS)

_SQL_ROOT = """case when len(string_split(dom, '.')) <= 2 then dom
  when string_split(dom, '.')[-2] in ('co', 'com', 'org', 'net', 'ac', 'gov', 'edu')
    then array_to_string(string_split(dom, '.')[-3:], '.')
  else array_to_string(string_split(dom, '.')[-2:], '.') end"""


@query("url_root_domain", f"""with src as ({_SQL_VARIANTS}), {_SQL_PARTS}
  select {_SQL_ROOT} as root_domain, count(*) as n, round(avg(length(url)), 6) as mean_length from parts group by 1""")
def url_root_domain(spark, sf):
    named = page_urls(spark, sf).select("url", U.root_domain(U.host(F.col("url"))).alias("root_domain"))
    return named.groupBy("root_domain").agg(
        F.count("*").alias("n"), rounded(F.avg(F.length("url"))).alias("mean_length")
    )


@query("url_idn", f"""with src as ({_SQL_VARIANTS})
  select page_id, variant, replace(url, 'xn--pple-43d', 'аpple') as url_decoded,
    contains(url, 'xn--')::int::double as is_punycode, contains(url, 'xn--')::int::double as homograph_score,
    length(regexp_replace(replace(url, 'xn--pple-43d', 'аpple'), '[\\x00-\\x7F]', '', 'g'))::double as n_unicode_chars
  from src""")
def url_idn(spark, sf):
    decoded = T.decode_idn(page_urls(spark, sf), "url")
    return decoded.select("page_id", "variant", "url_decoded", "is_punycode", "homograph_score", "n_unicode_chars")


# Observations of hosts, derived from the page table: each page is seen as one probe of its host.
_FACTS = {
    "time_response": "cast(length(html) % 300 as double)",
    "qty_redirects": "cast(page_id % 3 as double)",
    "qty_ip_resolved": "cast(case when page_id % 5 = 0 then null else page_id % 4 end as double)",
    "ttl_hostname": "cast(60 * (page_id % 7) as double)",
    "qty_nameservers": "cast(2 as double)",
    "qty_mx_servers": "cast(page_id % 2 as double)",
    "domain_spf": "cast(page_id % 2 as double)",
    "tls_ssl_certificate": "cast(case when page_id % 4 = 0 then null else 1 end as double)",
    "asn_ip": "cast(1000 + page_id % 50 as double)",
}
_HOSTS_SQL = f"split_part(lower(regexp_extract(url, '{U.URL_PATTERN}', 3)), ':', 1)"


def host_observations(spark, sf):
    pages = table(spark, sf, "pages")
    start = F.lit("2024-01-01").cast("timestamp")
    return pages.select(
        U.host(F.col("url")).alias("host"),
        (start + F.make_dt_interval(hours=(F.col("page_id") % 500).cast("int"))).alias("observed_at"),
        (start - F.make_dt_interval(days=(F.col("page_id") % 900).cast("int"))).alias("created_at"),
        (start + F.make_dt_interval(days=(F.col("page_id") % 400 - 100).cast("int"))).alias("expires_at"),
        *[F.expr(e).alias(n) for n, e in _FACTS.items()],
        F.col("page_id").alias("probe"),
    )


def url_requests(spark, sf):
    start = F.lit("2024-01-01").cast("timestamp")
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("request_id"),
        "url",
        U.host(F.col("url")).alias("host"),
        (start + F.make_dt_interval(hours=(F.col("page_id") * 7 % 700).cast("int"))).alias("asked_at"),
    )


_FACT_SQL = f"""
obs as (select {_HOSTS_SQL} as host, timestamp '2024-01-01' + to_hours((page_id % 500)::int) as observed_at,
    timestamp '2024-01-01' - to_days((page_id % 900)::int) as created_at,
    timestamp '2024-01-01' + to_days((page_id % 400 - 100)::int) as expires_at,
    {", ".join(f"{e} as {n}" for n, e in _FACTS.items())} from pages),
req as (select page_id as request_id, url, {_HOSTS_SQL} as host,
    timestamp '2024-01-01' + to_hours((page_id * 7 % 700)::int) as asked_at from pages),
latest as (select * from (select r.*, o.* exclude (host), row_number() over (partition by request_id order by observed_at desc) as rn
    from req r left join obs o on o.host = r.host and o.observed_at <= r.asked_at) where rn = 1)
"""
_FACT_COLUMNS = {
    **{n: n for n in _FACTS if n != "tls_ssl_certificate"},
    "tls_ssl_certificate": "coalesce(tls_ssl_certificate, 0.0::double)",
    "time_domain_activation": "greatest(0, floor((epoch(asked_at) - epoch(created_at)) / 86400))::double",
    "time_domain_expiration": "greatest(0, floor((epoch(expires_at) - epoch(asked_at)) / 86400))::double",
    "url_google_index": "0.0::double",
    "domain_google_index": "0.0::double",
}
# greatest() skips nulls, so hosts without a fact are blanked explicitly
_FACT_COLUMNS["time_domain_activation"] = f"case when created_at is not null then {_FACT_COLUMNS['time_domain_activation']} end"
_FACT_COLUMNS["time_domain_expiration"] = f"case when expires_at is not null then {_FACT_COLUMNS['time_domain_expiration']} end"


@query("host_facts_asof", f"with {_FACT_SQL} select request_id, host, "
       + ", ".join(f"{e} as {n}" for n, e in _FACT_COLUMNS.items()) + " from latest")
def host_facts_asof(spark, sf):
    joined = T.host_facts_as_of(url_requests(spark, sf), host_observations(spark, sf).drop("probe"), "request_id", "host", "asked_at")
    return joined.select("request_id", "host", *U.HOST_FACTS)


@query("url_features", f"""with {_FACT_SQL}, src as (select *, url as original from latest), {_SQL_PARTS}
  select request_id, original as url, {", ".join(f"{e} as {n}" for n, e in _ALL.items())},
    0.0::double as is_punycode, 0.0::double as n_unicode_chars, 0.0::double as homograph_score,
    {", ".join(f"{e} as {n}" for n, e in _FACT_COLUMNS.items())} from parts""")
def url_features(spark, sf):
    requests = url_requests(spark, sf)
    known = T.host_facts_as_of(requests, host_observations(spark, sf).drop("probe"), "request_id", "host", "asked_at")
    return T.url_features(known, "url").drop("host", "asked_at", "url_decoded")


@query("valid_urls", """select page_id, variant, url, (regexp_matches(url, '^https?://'))::int as accepted
  from (select page_id, variant, case when page_id % 4 = 0 then replace(url, 'http', 'ftp') else url end as url
        from (""" + _SQL_VARIANTS + "))")
def valid_urls(spark, sf):
    urls = page_urls(spark, sf).withColumn(
        "url", F.expr("case when page_id % 4 = 0 then replace(url, 'http', 'ftp') else url end")
    )
    return urls.withColumn("accepted", U.is_web_url(F.col("url")).cast("int"))


@query("drop_columns", f"with src as ({_SQL_VARIANTS}), {_SQL_PARTS} select page_id, variant, url, "
       + ", ".join(f"{e} as {n}" for n, e in _ALL.items() if n not in U.model_blind_columns()) + " from parts")
def drop_columns(spark, sf):
    return T.lexical_table(page_urls(spark, sf), "url").drop(*U.model_blind_columns())


@query("align_features", f"""with src as ({_SQL_VARIANTS}), {_SQL_PARTS}
  select page_id, variant, {_DOMAIN['domain_length']} as domain_length, null::double as asn_ip,
    {_URL['length_url']} as length_url from parts""")
def align_features(spark, sf):
    from ..operators.score import align_to_contract

    wide = T.lexical_table(page_urls(spark, sf), "url")
    return align_to_contract(wide, ["domain_length", "asn_ip", "length_url"], keep=["page_id", "variant"])
