"""Expressions as Spark SQL text, with the operators and functions of columns.

A rule set makes some ten thousand expression nodes. Built one by one as columns they take tens of seconds of calls to the
JVM; written as text they are parsed there in one. Sql.column is the column.
"""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

_fresh = count()


class Sql:
    """A piece of SQL that can stand anywhere in an expression."""

    __slots__ = ("text",)
    __hash__ = None

    def __init__(self, text: str) -> None:
        self.text = text

    def __str__(self) -> str:
        return self.text

    @property
    def column(self) -> Column:
        return F.expr(self.text)

    def __getitem__(self, name: str) -> Sql:
        return Sql(f"{self}.`{name}`")

    def _with(self, sign: str, other: object) -> Sql:
        return Sql(f"({self} {sign} {lit(other)})")

    def __add__(self, o: object) -> Sql:
        return self._with("+", o)

    def __sub__(self, o: object) -> Sql:
        return self._with("-", o)

    def __mul__(self, o: object) -> Sql:
        return self._with("*", o)

    def __truediv__(self, o: object) -> Sql:
        return self._with("/", o)

    def __eq__(self, o: object) -> Sql:  # type: ignore[override]
        return self._with("=", o)

    def __ne__(self, o: object) -> Sql:  # type: ignore[override]
        return self._with("<>", o)

    def __lt__(self, o: object) -> Sql:
        return self._with("<", o)

    def __le__(self, o: object) -> Sql:
        return self._with("<=", o)

    def __gt__(self, o: object) -> Sql:
        return self._with(">", o)

    def __ge__(self, o: object) -> Sql:
        return self._with(">=", o)

    def __and__(self, o: object) -> Sql:
        return self._with("AND", o)

    def __or__(self, o: object) -> Sql:
        return self._with("OR", o)

    def __invert__(self) -> Sql:
        return Sql(f"(NOT {self})")

    def isNull(self) -> Sql:  # noqa: N802
        return Sql(f"({self} IS NULL)")

    def isNotNull(self) -> Sql:  # noqa: N802
        return Sql(f"({self} IS NOT NULL)")

    def isin(self, *values: object) -> Sql:
        return Sql(f"({self} IN ({', '.join(str(lit(v)) for v in values)}))") if values else Sql("false")

    def cast(self, kind: str) -> Sql:
        return Sql(f"CAST({self} AS {kind})")

    def try_cast(self, kind: str) -> Sql:
        return Sql(f"TRY_CAST({self} AS {kind})")

    def rlike(self, pattern: str) -> Sql:
        return call("regexp_like", self, pattern)

    def contains(self, part: object) -> Sql:
        return call("contains", self, part)

    def startswith(self, part: object) -> Sql:
        return call("startswith", self, part)

    def endswith(self, part: object) -> Sql:
        return call("endswith", self, part)


class When(Sql):
    """CASE without its end; otherwise() ends it, and used as it is it gives null."""

    __slots__ = ("cases",)

    def __init__(self, cases: str) -> None:
        super().__init__(f"CASE {cases} END")
        self.cases = cases

    def when(self, condition: Sql, value: object) -> When:
        return When(f"{self.cases} WHEN {condition} THEN {lit(value)}")

    def otherwise(self, value: object) -> Sql:
        return Sql(f"CASE {self.cases} ELSE {lit(value)} END")


def lit(value: object) -> Sql:
    if isinstance(value, Sql):
        return value
    if value is None:
        return Sql("NULL")
    if isinstance(value, bool):
        return Sql("true" if value else "false")
    if isinstance(value, float):
        return Sql(f"{value!r}D")
    if isinstance(value, int):
        return Sql(str(value))
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return Sql(f"'{escaped}'")


def col(name: str) -> Sql:
    return Sql(".".join(f"`{n}`" for n in name.split(".")))


def call(name: str, *arguments: object) -> Sql:
    return Sql(f"{name}({', '.join(str(lit(a)) for a in arguments)})")


def when(condition: Sql, value: object) -> When:
    return When(f"WHEN {condition} THEN {lit(value)}")


def function(body: Callable[..., Sql]) -> Sql:
    """A lambda with fresh names."""
    names = [Sql(f"v{next(_fresh)}") for _ in signature(body).parameters]
    given = str(names[0]) if len(names) == 1 else f"({', '.join(map(str, names))})"
    return Sql(f"{given} -> {lit(body(*names))}")


def struct(**fields: object) -> Sql:
    return call("named_struct", *[x for name, value in fields.items() for x in (name, value)])


def _named(name: str) -> Callable[..., Sql]:
    return lambda *arguments: Sql(f"{name}({', '.join(str(function(a) if callable(a) else lit(a)) for a in arguments)})")


array, get, size, length, substr, sequence, flatten, concat = map(_named, "array get size length substr sequence flatten concat".split())
transform, filter, exists, aggregate, array_sort, coalesce, greatest, least = map(_named, "transform filter exists aggregate array_sort coalesce greatest least".split())
regexp_extract_all, regexp_extract, regexp_replace, split, translate, instr, abs, signum = map(_named, "regexp_extract_all regexp_extract regexp_replace split translate instr abs signum".split())
array_join, array_distinct, array_position, map_from_entries, map_filter, format_string = map(_named, "array_join array_distinct array_position map_from_entries map_filter format_string".split())


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """body(value), with the value worked out once."""
    return get(transform(array(value), body), 0)


def choose(key: Sql, pairs: dict[str, object]) -> Sql:
    """The value of a key of a fixed map, or null."""
    return Sql(f"CASE {key} {' '.join(f'WHEN {lit(k)} THEN {lit(v)}' for k, v in pairs.items())} END")
