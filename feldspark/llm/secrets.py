"""Secrets in texts through a trigram inverted index.

Every rule's expression gives a Boolean query over lower-case trigrams: each of its clauses needs
all trigrams of one of its alternatives. Postings of the trigrams that occur in any query are
intersected per document; only documents that satisfy a rule's query are verified with the
expression itself. A rule without mandatory trigrams is scanned in every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .spans import joined, matches, where

MOST_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    """``least`` is the shortest length of group ``part`` that counts; a shorter match is dropped."""

    kind: str
    pattern: str
    part: int = 0
    least: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([either_case("password"), either_case("passwd"), either_case("secret"), either_case("token"), either_case("api") + "_?" + either_case("key")])
BASE = (
    Rule("assign", rf"({_KEYS})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
EXTRA = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("login", r"://[A-Za-z0-9._%+-]{1,64}:[^\x20\x09-\x0D/@:]{4,64}@"),
)

Clause = list[frozenset[str]]


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that every match satisfies: all trigrams of one alternative each. Empty: nothing is mandatory."""
    return [c for c in _clauses(parser.parse(pattern)) if c]


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _strings(tokens) -> set[str] | None:
    """All lower-cased strings that the tokens match, if they are few."""
    found = {""}
    for op, value in tokens:
        options = _options(op, value)
        if options is None or len(found) * len(options) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in options}
    return found


def _options(op, value) -> set[str] | None:
    if op is parser.LITERAL:
        return {chr(value).lower()}
    if op is parser.IN and all(o is parser.LITERAL for o, _ in value):
        return {chr(v).lower() for _, v in value}
    if op is parser.SUBPATTERN:
        return _strings(value[3])
    if op is parser.BRANCH:
        every = [_strings(branch) for branch in value[1]]
        return None if any(e is None for e in every) else set().union(*every)
    if op is parser.MAX_REPEAT and value[1] == 1:
        inner = _strings(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _clauses(tokens) -> list[Clause]:
    clauses: list[Clause] = []
    current = {""}

    def flush() -> None:
        if all(len(s) >= 3 for s in current):
            every = {_trigrams(s) for s in current}
            # An alternative that asks for more than another one adds nothing.
            clauses.append(sorted((a for a in every if not any(b < a for b in every)), key=sorted))

    for op, value in tokens:
        options = _options(op, value)
        if options is not None and len(current) * len(options) <= MOST_STRINGS:
            current = {a + b for a in current for b in options}
            continue
        flush()
        current = options or {""}
        if options is None and op is parser.SUBPATTERN:
            clauses += _clauses(value[3])
        elif options is None and op is parser.MAX_REPEAT and value[0] >= 1:
            clauses += _clauses(value[2])
    flush()
    return clauses


def postings(docs: DataFrame, key: str, text: str, grams: list[str]) -> DataFrame:
    """The inverted index: (gram, key) for each of ``grams`` and each text that holds it, in either case."""
    wanted = F.array(*[F.lit(g) for g in grams])
    # The lower-cased text is an element of an array, so that it is made once for all grams.
    held = F.transform(F.array(F.lower(text)), lambda low: F.filter(wanted, lambda g: F.contains(low, g)))[0]
    return docs.select(F.explode(held).alias("gram"), key)


def candidates(index: DataFrame, key: str, queries: dict[str, list[Clause]]) -> DataFrame:
    """``key`` and the kinds whose whole query its postings satisfy, for documents with any."""

    def satisfied(clauses: list[Clause]) -> Column:
        result = F.lit(True)
        for clause in clauses:
            one = F.lit(False)
            for grams in clause:
                every = F.array(*[F.lit(g) for g in sorted(grams)])
                one |= F.size(F.array_except(every, "grams")) == 0
            result &= one
        return result

    met = F.array(*[F.when(satisfied(clauses), F.lit(kind)) for kind, clauses in queries.items()])
    # At most one posting for each gram of the queries, so the set is small.
    return index.groupBy(key).agg(F.collect_set("gram").alias("grams")).select(key, F.array_compact(met).alias("kinds")).where(F.size("kinds") > 0)


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE + EXTRA, into: str = "secrets") -> DataFrame:
    """``docs`` with ``into``: structs of start, end, order, kind and value, sorted by start, then order of the rules.

    Places are in code points, the end exclusive. A null or empty text has no secrets. The id only
    serves to find candidates: rows that repeat an id are verified together, and a null id is replaced
    by a hash of the text. An empty table gives an empty result; other columns stay as they are, and a
    column called ``into`` is replaced. The values are there in clear: keep them out of what is written.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for clauses in queries.values() for clause in clauses for alternative in clause for g in alternative})
    # One struct carries the row through the join, so no column of the caller can clash.
    named = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("#"), F.xxhash64(text).cast("string")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), named.alias("key"))
    index = cut_lineage(postings(rows.select("key", F.col(f"row.{text}").alias("text")), "key", "text", grams))
    marked = rows.join(candidates(index, "key", queries), "key", "left")
    body = F.coalesce(F.col(f"row.{text}"), F.lit(""))

    def spans_of(place: int, rule: Rule) -> Column:
        asked = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) if rule.kind in queries else body.rlike(rule.pattern)
        found = where(asked, matches(body, rule.pattern, rule.part))
        if rule.least:
            found = F.filter(found, lambda s: F.length(s["part"]) >= rule.least)
        return F.transform(
            found,
            lambda s: F.struct(s["start"], s["end"], F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), s["value"]),
        )

    every = F.array_sort(
        F.transform(
            F.concat(*[spans_of(i, r) for i, r in enumerate(rules)]),
            lambda s: F.struct(s["start"], s["place"], s["end"], s["kind"], s["value"]),
        )
    )
    return marked.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() != into.lower()], every.alias(into))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind; spans that overlap an earlier one end with it."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        before = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.when(fresh, F.concat(state["out"], before, F.lit("<"), s["kind"], F.lit(">"))).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], s["end"]).alias("at"),
        )

    return F.aggregate(
        spans, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))
    )


def secret_digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts by base kind, a digest of the base spans, and all spans as text."""
    names = [r.kind for r in BASE]
    base = F.filter("secrets", lambda s: s["kind"].isin(names))
    held = F.transform("secrets", lambda s: s["kind"])
    counts = [(F.size("secrets") - F.size(F.array_remove(held, k))).cast("bigint").alias(f"n_{k}") for k in names]
    return found.select(
        id_column, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans")
    )
