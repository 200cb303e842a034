"""Personal data: generators with high recall propose spans, boosted trees judge them.

Four kinds have exact rules and always stay. Looser generators propose further spans, which may overlap.
Trees boosted on format and context score them. What they learn is not whether a rule holds: every datum that
the rules find is written anew without what makes the rule hold (the plus of a phone, the sign of an address, the
check digit of a card) as an example of personal data, and its digits and words are written at the same place
as a date, a version or an order number as examples of other data. Proposals of which neither is known are
neither errors nor hits. The trees see a bounded sample of rows; a threshold per generator, calibrated on all rows
that they did not see, selects the spans. The fitted trees are written as one column expression, so scoring is part
of the projection.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .spans import bound, joined, matches, where

KINDS = ("email", "ip", "card", "phone")
GENERATORS = {
    "local_phone": r"(?<![0-9])[(]?[0-9]{3}[)]?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "number": r"(?<![0-9A-Za-z])[0-9][0-9\x20().-]{5,30}[0-9](?![0-9A-Za-z])",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}[\x20]?(?:@|[(]at[)]|\[at\])[\x20]?[A-Za-z0-9.-]{2,64}",
}
TRAIN_ROWS = 20_000
"""At most about this many rows of the table train the trees; all others calibrate the thresholds."""
PRECISION = 0.9
TREES, DEPTH = 20, 4
_MARK, _OTHER = "\ue000", "\ue001"
_DATE = r"^(?:(?:19|20)[0-9]{2}[-./][0-9]{1,2}(?:[-./\x20]|$)|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-(?:19|20)[0-9]{2}$)"
_NUMBERED = r"(?i)(?<![a-z])(order|invoice|item|version|release|build|ref|isbn|serial|section|no|nr)[^A-Za-z0-9]{0,3}$"


def _text(text: Column) -> Column:
    """The text without the character that marks separators, place by place."""
    return F.translate(F.coalesce(text, F.lit("")), _MARK, _OTHER)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def step(total: Column, x: Column) -> Column:
        return total + x

    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(d == "", F.lit(0)).otherwise(
            F.when(i % 2 == 0, d.cast("int")).otherwise(F.pmod(d.cast("int") * 2 - 1, F.lit(9)) + F.when(d == "0", F.lit(-8)).otherwise(F.lit(1)))
        ),
    )
    return F.aggregate(doubled, F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> Column:
    """A struct of the spans of the four kinds, by rules that hold whatever the length of a run.

    Repeated groups would recurse once per repetition, so separators inside a run are marked first
    and the run is then one character class.
    """
    email = rf"(?:\G|(?<![A-Za-z0-9._%+{_MARK}-]))[A-Za-z0-9._%+{_MARK}-]++@[A-Za-z0-9-]++{_MARK}[A-Za-z0-9{_MARK}-]++"
    ip = r"(?<![0-9])[0-9]++[.][0-9]++[.][0-9]++[.][0-9]++"
    phone = r"\+[0-9][\x20().0-9-]+[0-9]"

    def small(s: Column) -> Column:
        return F.forall(
            F.split(s["value"], "[.]"),
            lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255),
        )

    def of(body: Column) -> Column:
        dots = F.regexp_replace(body, r"(?<=[A-Za-z0-9-])[.](?=[A-Za-z0-9-])", _MARK)
        gaps = F.regexp_replace(body, r"(?<=[0-9])[\x20-](?=[0-9])", _MARK)
        card = bound(gaps, lambda g: matches(g, f"[0-9][0-9{_MARK}]+"))
        # Lengths come first: most runs of digits are short, and only the rest is summed.
        card = F.filter(card, lambda s: F.when(F.length(_digits(s["value"])).between(13, 19), luhn(_digits(s["value"]))).otherwise(False))
        return F.struct(
            where(F.contains(body, F.lit("@")), bound(dots, lambda d: matches(d, email))).alias("email"),
            F.filter(where(body.rlike(r"[0-9][.][0-9]+[.]"), matches(body, ip)), small).alias("ip"),
            where(body.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), card).alias("card"),
            F.filter(
                where(body.rlike(r"\+[0-9]"), matches(body, phone)), lambda s: F.length(_digits(s["value"])).between(9, 15)
            ).alias("phone"),
        )

    return bound(_text(text), of)


def _count(value: Column, pattern: str) -> Column:
    return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))).cast("double")


def _features(body: Column, code: int, s: Column) -> Column:
    """Format of the value itself, and the characters around it; not what makes a rule hold, such as a leading plus."""
    value = s["value"]
    left = F.substring(body, F.greatest(s["start"] - 15, F.lit(1)), F.least(s["start"], F.lit(16)))
    right = F.substring(body, s["end"] + 1, F.lit(2))
    return F.array(
        F.lit(float(code)),
        F.length(value).cast("double"),
        _count(value, "[0-9]"),
        _count(value, "[A-Za-z]"),
        _count(value, r"\x20"),
        _count(value, "-"),
        _count(value, "[.]"),
        _count(value, "[()]"),
        _count(value, "@"),
        F.when(value.rlike(r"^[(]?[0-9]{3}[)]?[\x20.-]"), 1.0).otherwise(0.0),
        F.when(value.rlike(r"[0-9]{4}$"), 1.0).otherwise(0.0),
        F.when(left.rlike(r"(?i)(tel|phone|call|fax|mail|contact|card|visa|addr)[^A-Za-z]{0,4}$"), 1.0).otherwise(0.0),
        F.when(left.rlike(r"[=:\x22\x27]\x20?$"), 1.0).otherwise(0.0),
        F.when(right.rlike(r"^[A-Za-z0-9_]"), 1.0).otherwise(0.0),
        F.least(F.length(F.regexp_extract(value, "([0-9]+)$", 1)), F.lit(12)).cast("double"),
        F.when(value.rlike(_DATE), 1.0).otherwise(0.0),
        F.when(value.rlike(r"[.][A-Za-z]{2,}$"), 1.0).otherwise(0.0),
        F.when(value.rlike(r"(?:@|[(]at[)]|\[at\])\x20?[A-Za-z0-9-]+[.]"), 1.0).otherwise(0.0),
        F.when(left.rlike(_NUMBERED), 1.0).otherwise(0.0),
        F.least(F.length(F.regexp_extract(value, "^[(]?([0-9]+)", 1)), F.lit(20)).cast("double"),
    )


def _proposal(body: Column, code: int, kind: str):
    return lambda s: F.struct(s["start"], s["end"], F.lit(kind).alias("kind"), _features(body, code, s).alias("x"))


def candidates(text: Column) -> Column:
    """All proposals as structs of start, end, kind and features."""

    def of(body: Column) -> Column:
        every = []
        for code, (kind, pattern) in enumerate(GENERATORS.items()):
            guard = body.rlike(r"[0-9][0-9\x20().-]{5}") if kind != "address" else F.contains(body, F.lit("@")) | body.rlike(r"[(\[]at[)\]]")
            every.append(F.transform(where(guard, matches(body, pattern)), _proposal(body, code, kind)))
        return F.concat(*every)

    return bound(_text(text), of)


def _same(b: Column, c: Column) -> Column:
    """Whether either span covers more than half of the other."""
    common = F.least(b["end"], c["end"]) - F.greatest(b["start"], c["start"])
    return (2 * common > b["end"] - b["start"]) & (2 * common > c["end"] - c["start"])


def _meets(base: Column, c: Column) -> Column:
    return F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


def _tree_columns(description: str, x: Column) -> tuple[list[Column], list[float]]:
    """The trees of an ensemble's description as nested conditions."""
    weights = [float(w) for w in re.findall(r"Tree \d+ \(weight ([0-9.eE+-]+)\)", description)]
    trees = re.split(r"Tree \d+ \(weight [0-9.eE+-]+\):\n", description)[1:]

    def build(lines: list[str]) -> Column:
        line = lines.pop(0).strip()
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1]))
        feature, bound = re.match(r"If \(feature (\d+) <= ([0-9.eE+-]+)\)", line).groups()
        below = build(lines)
        lines.pop(0)
        above = build(lines)
        return F.when(x[int(feature)] <= float(bound), below).otherwise(above)

    return [build(t.splitlines()) for t in trees], weights


class Judge:
    """Boosted trees as a column of the chance that a proposal is personal data, and a threshold per generator."""

    def __init__(self, description: str):
        self.description = description
        self.thresholds: dict[str, float] = {}

    def chance(self, x: Column) -> Column:
        trees, weights = _tree_columns(self.description, x)
        margin = F.lit(0.0)
        for tree, weight in zip(trees, weights):
            margin = margin + tree * F.lit(weight)
        return 1 / (1 + F.exp(-2 * margin))

    def selects(self, c: Column) -> Column:
        limit = F.lit(2.0)
        for kind, value in self.thresholds.items():
            limit = F.when(c["kind"] == kind, F.lit(value)).otherwise(limit)
        return self.chance(c["x"]) >= limit


def _all_base(text: Column) -> Column:
    return bound(base_spans(text), lambda s: F.concat(*[s[k] for k in KINDS]))


def _likely(text: Column) -> Column:
    """Holds for every text with a proposal."""
    return text.rlike(r"[0-9][0-9\x20().-]{5}") | F.contains(text, F.lit("@")) | text.rlike(r"[(\[]at[)\]]")


def _rewritten(kind: Column, value: Column) -> Column:
    """The datum in other forms: structs of lead (what is put before it), value and label.

    Label 1 are forms of the same datum that the rule of its kind does not find, label 0 other data of its characters.
    A plain word as lead hides what stands before the datum, for both labels.
    """
    form = "array<struct<lead:string,value:string,label:double>>"

    def digit(d: Column, *cut: int) -> Column:
        return F.substring(d, *cut)

    def forms(label: float, *rows: tuple) -> Column:
        return F.array(*[F.struct(F.lit(lead).alias("lead"), v.alias("value"), F.lit(label).alias("label")) for lead, v in rows])

    def join(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def numbers(d: Column) -> Column:
        return forms(
            0.0,
            ("", join("20", digit(d, 1, 2), "-0", digit(d, 3, 1), "-1", digit(d, 4, 1))),
            ("", join("1", digit(d, 2, 1), ".0", digit(d, 5, 1), ".19", digit(d, 6, 2))),
            ("", join("20", digit(d, 3, 2), "/1", digit(d, 1, 1), "/2", digit(d, 2, 1))),
            ("", join("19", digit(d, 1, 2), "-20", digit(d, 5, 2))),
            ("", join(digit(d, 1, 1), ".", digit(d, 2, 7))),
            ("version ", join(digit(d, 1, 1), ".", digit(d, 2, 2), ".", digit(d, 4, 3))),
            ("about ", join("20", digit(d, 1, 2), "-0", digit(d, 3, 1), "-1", digit(d, 4, 1))),
            ("about ", join(digit(d, 1, 1), ".", digit(d, 2, 7))),
            ("about ", join("19", digit(d, 1, 2), "-20", digit(d, 5, 2))),
            ("order ", digit(d, 1, 8)),
            ("order no. ", d),
            ("invoice ", join("20", digit(d, 1, 2), "-", digit(d, 3, 6))),
            ("ISBN ", join("978-", digit(d, 1, 1), "-", digit(d, 2, 4), "-", digit(d, 6, 4), "-", digit(d, 1, 1))),
            ("ref ", join(digit(d, 1, 3), "-", digit(d, 4, 3), "-", digit(d, 1, 4))),
        )

    def phones(d: Column) -> Column:
        ten = F.right(d, F.lit(10))
        a, b, c = digit(ten, 1, 3), digit(ten, 4, 3), digit(ten, 7, 4)
        return F.concat(
            forms(
                1.0,
                ("", F.regexp_replace(value, r"^\+", "")),
                ("", F.regexp_replace(value, r"^\+[0-9]{1,3}[\x20.-]+", "")),
                ("", join(a, "-", b, "-", c)),
                ("", join(a, ".", b, ".", c)),
                ("", join(a, " ", b, " ", c)),
                ("", join("(", a, ") ", b, "-", c)),
                ("phone ", join(a, "-", b, "-", c)),
                ("about ", join(a, "-", b, "-", c)),
                ("about ", join("(", a, ") ", b, "-", c)),
                ("about ", join(a, " ", b, " ", c)),
            ),
            numbers(d),
        )

    def cards(d: Column) -> Column:
        # Another check digit.
        off = F.concat(F.regexp_replace(d, "[0-9]$", ""), ((F.right(d, F.lit(1)).cast("int") + 1) % 10).cast("string"))
        four = [F.substring(off, 1, 4), F.substring(off, 5, 4), F.substring(off, 9, 4), F.substring(off, 13, 7)]
        return F.concat(forms(1.0, ("", off), ("card ", off), ("about ", off), ("", F.concat_ws(" ", *four)), ("", F.concat_ws("-", *four))), numbers(d))

    def addresses(v: Column) -> Column:
        person, host = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
        short = F.substring_index(host, ".", -2)
        good = [("", join(person, at, h)) for at, h in (("(at)", host), (" (at) ", short), (" [at] ", host), ("[at]", short), (" @ ", host), (" @ ", short))]
        bad = [("", join(person, at, w)) for at, w in ((" @ ", "20"), ("@", person), (" (at) ", "home"), (" [at] ", "noon"), (" @ ", "12.50"), ("@", "work"))]
        return F.concat(forms(1.0, *good), forms(0.0, *bad))

    return (
        F.when(kind == "phone", bound(_digits(value), phones))
        .when(kind == "card", bound(_digits(value), cards))
        .when(kind == "email", bound(value, addresses))
        .otherwise(F.array().cast(form))
    )


def _examples(rows: DataFrame) -> DataFrame:
    """Kind, features and label of the proposals for data of the rules that are written in other forms."""
    body = rows.select(_text(F.col("text")).alias("text"))

    def named(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["value"], F.lit(kind).alias("kind")))

    found = bound(base_spans(F.col("text")), lambda s: F.concat(*[named(s[k], k) for k in KINDS if k != "ip"]))
    placed = body.select("text", found.alias("s")).select("text", F.explode("s").alias("s"))
    each = placed.select(
        F.substring("text", F.greatest(F.col("s.start") - 29, F.lit(1)), F.least(F.col("s.start"), F.lit(30))).alias("left"),
        F.substring("text", F.col("s.end") + 1, F.lit(20)).alias("right"),
        _rewritten(F.col("s.kind"), F.translate("s.value", _MARK, ".")).alias("v"),
    ).select("left", "right", F.explode("v").alias("v"))
    start = F.length("left") + F.length("v.lead")
    written = each.select(
        F.concat("left", "v.lead", "v.value", "right").alias("text"),
        F.struct(start.cast("int").alias("start"), (start + F.length("v.value")).cast("int").alias("end")).alias("at"),
        F.col("v.label").alias("label"),
    )
    proposed = written.select("at", "label", candidates(F.col("text")).alias("c"))
    shown = proposed.select("at", "label", F.explode("c").alias("c")).where(_same(F.col("at"), F.col("c")))
    return shown.select(F.col("c.kind").alias("kind"), F.col("c.x").alias("x"), "label")


def _labelled(rows: DataFrame) -> DataFrame:
    """Kind, features and label of the proposals in the texts of ``rows`` of which it is known.

    1 where a rule finds the same datum, 0 for dates and numbered things that meet none; others are left out. The
    data of the rules in other forms are added.
    """
    whole = rows.select(_text(F.col("text")).alias("text"), _all_base(F.col("text")).alias("base"), candidates(F.col("text")).alias("c"))
    shown = whole.select("text", "base", F.explode("c").alias("c"))
    value = F.substring("text", F.col("c.start") + 1, F.col("c.end") - F.col("c.start"))
    left = F.substring("text", F.greatest(F.col("c.start") - 15, F.lit(1)), F.least(F.col("c.start"), F.lit(16)))
    other = ~_meets(F.col("base"), F.col("c")) & (value.rlike(_DATE) | left.rlike(_NUMBERED))
    label = F.when(F.exists("base", lambda b: _same(b, F.col("c"))), 1.0).when(other, 0.0)
    return shown.select(F.col("c.kind").alias("kind"), F.col("c.x").alias("x"), label.alias("label")).where("label is not null").union(_examples(rows))


def fit(docs: DataFrame, text: str = "text", train_rows: int = TRAIN_ROWS, precision: float = PRECISION) -> Judge | None:
    """Train on at most about ``train_rows`` rows drawn by hash; None where they hold no datum of the rules.

    A threshold is the lowest chance, one half at least, from which on ``precision`` of the proposals are personal data.

    The bound is on the rows of the trees alone: thresholds come from the proposals of all other rows. A third of the
    drawn rows is always left to the thresholds, so a table under the bound has some too.
    """
    body = docs.select(F.col(text).alias("text")).where("text is not null").where(_likely(F.col("text")))
    n = body.count()
    share = min(1.0, train_rows / n) if n else 0.0
    drawn = (F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))) & (F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(3)) > 0)
    rows = cut_lineage(_labelled(body.where(drawn)))
    if rows.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(featuresCol="v", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=11)
    model = trees.fit(rows.select("label", array_to_vector("x").alias("v")).coalesce(4))
    judge = Judge(model.toDebugString)
    held = _labelled(body.where(~drawn)).select("kind", "label", F.floor(judge.chance(F.col("x")) * 200).alias("at"))
    tally = held.groupBy("kind", "at").agg(F.sum("label").alias("right"), F.count(F.lit(1)).alias("n")).collect()  # at most 201 rows a generator
    for kind in GENERATORS:
        own = sorted(((r["at"], r["right"], r["n"]) for r in tally if r["kind"] == kind), reverse=True)
        right = total = 0
        for at, good, n in own:
            right, total = right + good, total + n
            if at >= 100 and total >= 10 and right >= precision * total:
                judge.thresholds[kind] = at / 200
    return judge


def personal_spans(docs: DataFrame, judge: Judge | None, text: str = "text", into: str = "personal") -> DataFrame:
    """``docs`` with ``into``: structs of place (of the kind), start, end and kind, sorted by kind as listed, then start.

    Places are in code points, the end exclusive. A null or empty text has no spans. Repeated rows get equal
    answers, an empty table an empty one; other columns stay, and one called ``into`` is replaced. Of selected proposals
    that meet, the first by place of the kind, then start, stays.
    """
    order = {k: i for i, k in enumerate([*KINDS, *GENERATORS])}

    def named(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(order[kind]).alias("place"), s["start"], s["end"], F.lit(kind).alias("kind")))

    base = bound(base_spans(F.col(text)), lambda s: F.concat(*[named(s[k], k) for k in KINDS]))
    if judge is None or not judge.thresholds:
        return docs.withColumn(into, F.array_sort(base))
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])

    def selected() -> Column:
        return F.transform(
            F.filter(candidates(F.col(text)), judge.selects),
            lambda c: F.struct(place[c["kind"]].alias("place"), c["start"], c["end"], c["kind"]),
        )

    def apart(base: Column) -> Column:
        # Proposals on data that the rules have found add nothing, nor do second ones on the same data.
        return F.aggregate(
            F.array_sort(selected()), base, lambda held, c: F.when(_meets(held, c), held).otherwise(F.concat(held, F.array(c)))
        )

    return docs.withColumn(into, bound(F.array_sort(base), apart))


def personal_digest(found: DataFrame, id_column: str = "doc_id", spans: str = "personal") -> DataFrame:
    """Counts by base kind, a digest of the base spans, all spans as text, and how many of them the trees added."""
    held = F.transform(spans, lambda s: s["kind"])
    counts = [(F.size(spans) - F.size(F.array_remove(held, k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    base = F.filter(spans, lambda s: s["kind"].isin(list(KINDS)))
    more = F.size(F.filter(spans, lambda s: ~s["kind"].isin(list(KINDS)))).cast("bigint").alias("n_more")
    return found.select(id_column, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(spans)).alias("spans"), more)
