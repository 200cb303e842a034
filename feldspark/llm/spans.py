"""Places of regular expression matches, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string,part:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used, also inside other lambdas."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs of start, end (code points, exclusive), value and group.

    The text between matches comes from splitting by the same pattern, so lengths add up to places.
    """
    pieces = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("w"), F.split(text, pattern, -1).alias("b")]
    if group:
        pieces.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("p"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["b"])
        end = start + F.length(x["w"])
        span = F.struct(start.alias("start"), end.alias("end"), x["w"].alias("value"), x["p"].alias("part"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def places(x: Column) -> Column:
        between = F.slice(x["b"], F.lit(1), F.size(x["w"]))
        rows = F.zip_with(
            F.zip_with(x["w"], between, lambda w, b: F.struct(w.alias("w"), b.alias("b"))),
            x["p"] if group else x["w"],
            lambda y, p: F.struct(y["w"].alias("w"), y["b"].alias("b"), p.alias("p")),
        )
        begin = F.struct(F.lit(0).alias("at"), nothing().alias("spans"))
        return F.aggregate(rows, begin, step, lambda s: s["spans"])

    return bound(F.struct(*pieces), places)


def nothing() -> Column:
    return F.array().cast(SPAN)


def where(condition: Column, spans: Column) -> Column:
    """``spans`` where the condition holds; elsewhere they are not looked for."""
    return F.when(condition, spans).otherwise(nothing())


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, with commas."""
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
    )
