"""One query per operator with its production parameters, and the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch_folder
from . import conversations, languages, licenses, mixing, personal, quality, secrets, toxicity, tries, warc, whitening
from .decontaminate import contained_items
from .near_duplicates import near_duplicates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shingles_sql(source: str, id_column: str, width: int) -> str:
    """Distinct shingles of every text; fewer words than ``width`` are one shingle."""
    run = " || ' ' || ".join(f"ws[i + {k}]" for k in range(width))
    return f"""select distinct {id_column}, unnest(
            case when len(ws) = 0 then []::varchar[] when len(ws) < {width} then [array_to_string(ws, ' ')]
            else list_transform(range(1, len(ws) - {width} + 2), lambda i: {run}) end) as sh
        from (select {id_column}, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {WORDS}) as ws from {source})"""


def groups_sql(source: str, width: int, percent: int) -> str:
    """CTEs ``s``, ``sizes``, ``reach``: the smallest document linked to each, directly or through others."""
    return f"""s as materialized ({shingles_sql(source, 'doc_id', width)}),
    sizes as (select doc_id, count(*) as n from s group by 1),
    common as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (sh) where a.doc_id <> b.doc_id group by 1, 2),
    links as materialized (select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y
        where 100 * c >= {percent} * (p.n + q.n - c)),
    reach as (select doc_id as a, doc_id as b from {source} union select reach.a, links.y from reach join links on links.x = reach.b)"""


@query(
    "op9_near_duplicates",
    f"""with recursive {groups_sql('documents', 3, 85)}
    select d.doc_id, coalesce(z.n, 0)::bigint as n_shingles, r.c as component_id, r.c = d.doc_id as kept
    from documents d join (select a, min(b) as c from reach group by 1) r on r.a = d.doc_id
    left join sizes z on z.doc_id = d.doc_id""",
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), width=3, threshold_percent=85)


def containment_sql(source: str) -> str:
    """Pairs of a document and a benchmark item of which it holds 80 % of the distinct five-word shingles."""
    return f"""iw as (select item_id, regexp_extract_all({LOWER.format('text')}, {WORDS}) as ws from benchmark where text is not null),
    it as (select item_id, least(5, len(ws)) as w, unnest(list_distinct(list_transform(range(1, len(ws) - least(5, len(ws)) + 2),
        lambda i: array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ')))) as sh from iw where len(ws) > 0),
    widths as (select distinct w from it),
    dw as (select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {WORDS}) as ws from {source}),
    dt as (select distinct doc_id, w, unnest(list_transform(range(1, len(ws) - w + 2), lambda i: array_to_string(ws[i:i + w - 1], ' '))) as sh
        from dw, widths where len(ws) >= w),
    sized as (select item_id, count(*) as n from it group by 1),
    contained as (select dt.doc_id, it.item_id, any_value(sized.n) as n_item_shingles, count(*) as n_shared
        from it join dt using (w, sh) join sized using (item_id) group by 1, 2
        having count(*) * 100 >= 80 * any_value(sized.n))"""


@query(
    "op4_decontamination",
    f"""with {containment_sql('documents')}
    select doc_id, item_id, n_item_shingles, n_shared, n_shared / n_item_shingles as containment from contained""",
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def held_out(modulus: int, remainder: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels").where(~held_out(3, 1)))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def matches_sql(text: str, pattern: str, group: int = 0) -> str:
    """A list of start, end, value and group of the matches in ``text``."""
    pattern = pattern.replace("'", "''")
    return f"""(select coalesce(list({{'s': s, 'e': s + length(w), 'w': w, 'p': p}} order by i), []) from (
            select i, w, p, (sum(length(b)) over (order by i) + coalesce(sum(length(w)) over (order by i rows between unbounded preceding and 1 preceding), 0))::bigint as s
            from (select unnest(range(1, len(ws) + 1)) as i, unnest(ws) as w, unnest(ps) as p, unnest(bs[1:len(ws)]) as b from
                (select regexp_extract_all({text}, '{pattern}', 0) as ws, regexp_extract_all({text}, '{pattern}', {group}) as ps,
                    string_split_regex({text}, '{pattern}') as bs))))"""


def _secrets_sql() -> str:
    every = " union all ".join(
        f"""select k, doc_id, {i} as place, '{r.kind}' as kind, unnest({matches_sql("t", r.pattern, r.part)}) as m from docs
        where regexp_matches(t, '{r.pattern.replace("'", "''")}')"""
        for i, r in enumerate(secrets.BASE + secrets.EXTRA)
    )
    least = " or ".join(f"place = {i} and length(m.p) < {r.least}" for i, r in enumerate(secrets.BASE) if r.least)
    kinds = ", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secrets.BASE)
    return f"""with docs as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
    found as (select * from ({every}) where not ({least})),
    strings as (select k, {kinds},
        string_agg(kind || ':' || m.s || ':' || m.e, ',' order by m.s, place) filter (place < 3) as base,
        string_agg(kind || ':' || m.s || ':' || m.e, ',' order by m.s, place) as spans from found group by 1)
    select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secrets.BASE)},
        sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from docs left join strings using (k)"""


@query("op2_secrets", _secrets_sql())
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_digest(secrets.secret_spans(table(spark, folder, "documents").select("doc_id", "text")))


def mix_sql(source: str) -> str:
    """CTEs ``sized`` and ``mixed``: size, source_size, target and times of every row of ``source``."""
    return f"""sized as materialized (select doc_id, source, md5('1:' || coalesce(doc_id::varchar, '')) as draw,
        coalesce(len(regexp_extract_all(text, {WORDS})), 0)::bigint as size from {source}),
    sources as (select source, sum(size)::bigint as source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight
        from sized group by 1),
    filled as (select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by source_size / weight, weight, source
            rows between unbounded preceding and 1 preceding), 0))::bigint
        / (sum(weight) over () - coalesce(sum(weight) over (order by source_size / weight, weight, source
            rows between unbounded preceding and 1 preceding), 0))::bigint as level from sources),
    plan as (select source, source_size, least(weight * (select level from filled where level * weight <= 3 * source_size order by source_size / weight, weight, source limit 1),
        3.0::double * source_size) as target from sources),
    drawn as (select s.*, p.source_size, p.target, p.target - floor(p.target / nullif(p.source_size, 0)) * p.source_size as rest,
        sum(size) over (partition by s.source order by draw) as reached, sum(size) over (partition by s.source, draw) as own
        from sized s join plan p on s.source is not distinct from p.source),
    mixed as (select *, coalesce(floor(target / nullif(source_size, 0)), 0)::bigint
        + (source_size > 0 and 2 * reached - own <= 2 * rest)::bigint as times from drawn)"""


@query("op6_mixing", f"with {mix_sql('documents')} select doc_id, size, source_size::bigint as source_size, target, (size * times)::bigint as taken from mixed")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


@query("op1_languages")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    draw = F.crc32(F.col("doc_id").cast("string")) % 5
    found = languages.identify(table(spark, folder, "documents"), train=draw > 1, calibrate=draw == 1)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "accepted")


@query("op7_quality")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly", *[f"anomaly_{g}" for g in quality.GROUPS]
    )


@query(
    "op8_warc",
    """with p as (select page_id, coalesce(html, '') as t, sha256(coalesce(html, '')) as d, strlen(coalesce(html, ''))::bigint as n from pages),
    f as (select *, case when n >= 100 then min(page_id) over (partition by d) else page_id end as first from p)
    select page_id, n as payload_bytes, d as payload_digest, case when first = page_id then 'response' else 'revisit' end as record_type,
        case when first <> page_id then first end as refers_to from f""",
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    archives = scratch_folder(spark, "warc")
    written = warc.write(table(spark, folder, "pages"), archives)
    return warc.read(spark, archives, written, payloads=False, strict=True).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query(
    "op3_conversations",
    """with t as (select conv_id, coalesce(turn, 9223372036854775807) as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
    c as (select conv_id, list({'r': role, 't': text} order by turn, role, text) as ts from t group by 1),
    prefixes as (select distinct ts[1:k] as ts from (select ts, unnest(range(1, len(ts))) as k from c)),
    kept as (select min(conv_id) as conv_id, ts from c where ts not in (select ts from prefixes) group by ts)
    select conv_id, 0::bigint as part, len(ts) as n_turns,
        array_to_string(list_transform(ts, lambda x: '<|' || x.r || '|>' || chr(10) || x.t || '<|end|>' || chr(10)), '') as text from kept""",
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.maximal_conversations(table(spark, folder, "conversations"))


@query("op5_personal")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return personal.personal_digest(personal.personal_spans(docs, personal.fit(docs)))


def licenses_sql(source: str) -> str:
    """The contract's columns with every block compared with every template."""
    width = licenses.block_words(licenses.TEMPLATES)
    templates = ", ".join(f"({i}, '{label}', {sorted(set(text.split()))})" for i, (label, text) in enumerate(licenses.TEMPLATES))
    bases = " union all ".join(
        f"""select k, '{label}' as label, i - 1 as place from w, unnest(range(1, len(ws) - {len(p.split()) - 2})) as t(i)
        where ws[i:i + {len(p.split()) - 1}] = {p.split()}"""
        for label, p in licenses.PHRASES
    )
    return f"""with w as materialized (select row_number() over () as k, doc_id,
        regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from {source}),
    base as materialized ({bases}),
    templates(t, label, ts) as (values {templates}),
    blocks as (select k, b, list_distinct(ws[b * {width // 2} + 1:b * {width // 2} + {width}]) as held
        from w, unnest(range(0, (len(ws) + {width // 2} - 1) // {width // 2})) as u(b)),
    met as (select k, b, t, label, list_intersect(ts, held) as shared, len(list_intersect(ts, held)) / len(ts) as c from blocks, templates
        where 100 * len(list_intersect(ts, held)) >= {licenses.THRESHOLD_PERCENT} * len(ts)),
    best as (select * from met x where not exists (select 1 from met y where x.k = y.k and x.b = y.b and list_has_all(y.shared, x.shared)
        and y.c >= x.c and (y.c > x.c or len(y.shared) > len(x.shared)))),
    labelled as (select k, label from base union select k, label from best),
    strings as (select k, string_agg(label, ',' order by label) as labels from labelled group by 1),
    based as (select k, count(*) as n, min(place) as f, max(place) as l, string_agg(distinct label, ',' order by label) as labels from base group by 1)
    select doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_base, f::bigint as first_word, l::bigint as last_word,
        coalesce(based.labels, '') as base_labels, coalesce(strings.labels, '') as labels,
        case when n > 0 then 1.0::double else coalesce((select max(c) from best where best.k = w.k), 0.0)::double end as score
    from w left join based using (k) left join strings using (k)"""


@query("op13_licenses", licenses_sql("documents"))
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_labels(table(spark, folder, "documents"))


@query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(table(spark, folder, "embeddings"), components=8)
    # A sum of squares that no bigint holds is null.
    return white.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::bigint)),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda z, k: case when z & 1 = 1 then xor(z >> 1, 3988292384) else z >> 1 end)))"""


@query(
    "op11_tries",
    f"""with turns as (select conv_id as c, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null),
    own as materialized (select c, list({{'r': r, 'x': x}} order by turn nulls first, r, md5(length(r) || ':' || r || x)) as ts from turns group by 1),
    told as (select o.c, o.ts, b.ts as bs, {CRC32.format("o.c::varchar")} % 4 as h from own o left join own b on b.c = o.c - o.c % 20),
    rebuilt as materialized (select c, list_concat(coalesce(bs[1:h], []), ts[h + 1:]) as ts from told),
    prefixes as (select c, d, ts[1:d] as p, len(ts) = d as ends from rebuilt, unnest(range(0, len(ts) + 1)) as t(d)),
    nodes as materialized (select p, d, min(c) as first, count(*) as n, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as e
        from prefixes group by 1, 2),
    below as (select p[1:d - 1] as p, count(*) as n from nodes where d > 0 group by 1),
    valued as materialized (select nodes.*, coalesce(below.n, 0) as children, case when d = 0 then 0 else (nodes.n - 1) *
        len(regexp_extract_all(coalesce(nodes.p[d].x, ''), {WORDS})) end as own from nodes left join below using (p)),
    climbed as (select p[1:k] as p, sum((children = 0)::bigint) as leaves, sum(own) as saved from valued, unnest(range(0, d + 1)) as t(k) group by 1)
    select v.first as conv_id, v.d as depth, up.first as parent_conv_id, v.n as n_convs, v.children::bigint as n_children,
        leaves::bigint as n_leaves, saved::bigint as saved_tokens, v.e as ends_sha256
    from valued v join climbed using (p) left join nodes up on v.d > 0 and up.p = v.p[1:v.d - 1]""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    told = tries.sequences(table(spark, folder, "conversations"))
    heads = told.where(F.col("id") % 20 == 0).select(F.col("id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    borrowed = (F.crc32(F.col("id").cast("string")) % 4).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), borrowed), F.array().cast(tries.TURNS))
    rest = F.slice("turns", borrowed + 1, F.greatest(F.size("turns"), F.lit(1)))
    rebuilt = told.join(heads, F.col("id") - F.col("id") % 20 == F.col("base"), "left").select("id", F.concat(head, rest).alias("turns"))
    nodes, ends = tries.prefix_nodes(rebuilt)
    digests = tries.end_digests(ends)
    return nodes.join(digests, F.col("node") == F.col("end"), "left").select(
        F.col("first").alias("conv_id"), "depth", F.col("parent_first").alias("parent_conv_id"), F.col("members").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
