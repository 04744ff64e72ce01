"""Expressions that the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as C

from veilwork.functions import sql as F
from veilwork.functions.sql import Sql, let

MATCH = "array<struct<start:int,end:int,text:string>>"


def slice_of(text: Sql, start: Sql, end: Sql) -> Sql:
    """text[start:end] of 0-based offsets in characters; end is exclusive."""
    return F.substr(text, start + 1, end - start)


def _pieces(text: Sql, pattern: str) -> Sql:
    """Matches, and what is before, between and after them."""
    return F.struct(hits=F.regexp_extract_all(text, pattern, 0), gaps=F.split(text, pattern, -1))


def matches(text: Sql, pattern: str) -> Sql:
    """Leftmost matches that don't overlap, with their offsets: sums of what is between them and of themselves."""
    none = F.array().cast(MATCH)

    def place(both: Sql) -> Sql:
        def step(state: Sql, i: Sql) -> Sql:
            def add(m: Sql) -> Sql:
                end = m["start"] + F.length(m["text"])
                return F.struct(at=end, found=F.concat(state["found"], F.array(F.struct(start=m["start"], end=end, text=m["text"]))))

            return let(F.struct(start=state["at"] + F.length(F.get(both["gaps"], i)), text=F.get(both["hits"], i)), add)

        return F.aggregate(F.sequence(0, F.size(both["hits"]) - 1), F.struct(at=0, found=none), step, lambda s: s["found"])

    # one pass over most texts, that have no match, and two over others
    return let(F.regexp_extract_all(text, pattern, 0), lambda hits: F.when(F.size(hits) > 0, let(F.struct(hits=hits, gaps=F.split(text, pattern, -1)), place)).otherwise(none))


def map_matches(text: Sql, pattern: str, change: Callable[[Sql], Sql]) -> Sql:
    """The text with each match replaced by change(match)."""

    def join(b: Sql) -> Sql:
        return F.array_join(F.transform(b["gaps"], lambda gap, i: F.concat(gap, F.coalesce(let(F.get(b["hits"], i), change), ""))), "")

    return let(text, lambda t: F.when(t.rlike(pattern), let(_pieces(t, pattern), join)).otherwise(t))


def exploded(rows: DataFrame, *kept: str | Column, **values: Column) -> DataFrame:
    """kept, and a row for each element of an array, named by its keyword.

    Not by explode(): that lets Spark infer a filter on the array's size, which is pushed down with all that the array is
    made of, so that the whole scan is worked out twice.
    """
    (name, value), = values.items()
    return rows.select(*kept, C.explode_outer(value).alias(name)).where(C.col(name).isNotNull())
