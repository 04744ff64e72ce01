"""Tokens for spans, and the text with its spans replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as C
from pyspark.sql import Window as W

from veilwork.functions import sql as F
from veilwork.functions.columns import slice_of
from veilwork.functions.sql import Sql, let
from veilwork.functions.vocabulary import ENTITIES, Entity
from veilwork.operators.scan import FIELDS

#: What an entity of a masked text has.
ENTITY = (*FIELDS, "value", "token")


Types = dict[str, Entity]


def base_token(entity: Sql, types: Types = ENTITIES) -> Sql:
    """The type's token; an unknown type is its own name in brackets."""
    return F.coalesce(F.choose(entity, {e.name: e.token for e in types.values()}), F.concat("[", entity, "]"))


def numbered_token(token: Sql, number: Sql) -> Sql:
    """[NAME] and 2 give [NAME_2]; a token that has no bracket at its end gets _2."""
    suffix = F.concat("_", number.cast("string"))
    return F.when(token.endswith("]"), F.concat(F.substr(token, 1, F.length(token) - 1), suffix, "]")).otherwise(F.concat(token, suffix))


def fixed_tokens(text: Sql, spans: Sql, types: Types = ENTITIES) -> Sql:
    """Spans with value and the token of their type."""
    return F.transform(spans, lambda s: F.struct(**{f: s[f] for f in FIELDS}, value=slice_of(text, s["start"], s["end"]), token=base_token(s["entity"], types)))


def tokens_of_text(text: Sql, spans: Sql, numbered: frozenset[str], types: Types = ENTITIES) -> Sql:
    """As fixed_tokens, but those of the types in `numbered` count the different values of this text, in their order."""

    def number(all_: Sql) -> Sql:
        def one(s: Sql) -> Sql:
            values = F.array_distinct(F.transform(F.filter(all_, lambda x: x["entity"] == s["entity"]), lambda x: x["value"]))
            token = F.when(s["entity"].isin(*sorted(numbered)), numbered_token(s["token"], F.array_position(values, s["value"]))).otherwise(s["token"])
            return F.struct(**{f: s[f] for f in ENTITY if f != "token"}, token=token)

        return F.transform(all_, one)

    return let(fixed_tokens(text, spans, types), number) if numbered else fixed_tokens(text, spans, types)


def replaced(text: Sql, spans: Sql) -> Sql:
    """The text with each span's token in its place. Spans are disjoint and in order."""

    def step(s: Sql, x: Sql) -> Sql:
        return F.struct(out=F.concat(s["out"], slice_of(text, s["at"], x["start"]), x["token"]), at=x["end"])

    done = F.aggregate(spans, F.struct(out="", at=0), step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))
    return F.when(text.isNull() | (F.size(spans) == 0), text).otherwise(done)


def session_tokens(turns: DataFrame, numbered: frozenset[str]) -> DataFrame:
    """turns with a token in each of their spans, numbered through the session in the order of turns.

    turns has session_id, turn, normalized_text, and entities (spans with value and the type's token). Every row stays a row of
    its own: where several have one (session_id, turn), they count in the order of their texts, and turns that are null
    come first. All windows and the last aggregation share one partitioning, that of session_id, so what arrives partitioned
    by it isn't shuffled again; rows are told apart by a number that is given and used inside one task.
    """
    others = [c for c in turns.columns if c != "entities"]
    numbered_rows = turns.select("session_id", "turn", C.struct(*others).alias("rest"), C.col("normalized_text").alias("text"), "entities").withColumn("row", C.monotonically_increasing_id())
    rows = numbered_rows.select("session_id", "turn", "rest", "text", "row", C.posexplode_outer("entities").alias("at", "s"))
    tracked = C.col("s.entity").isin(*sorted(numbered))
    first = C.min(C.struct("turn", "text", "at")).over(W.partitionBy("session_id", "s.entity", "s.value"))
    rows = rows.withColumn("first", C.when(tracked, first))
    rows = rows.withColumn("number", C.dense_rank().over(W.partitionBy("session_id", "s.entity").orderBy(C.col("first").asc_nulls_last())))
    token = C.when(tracked, numbered_token(F.col("s.token"), F.col("number")).column).otherwise(C.col("s.token"))
    rows = rows.withColumn("token", token).withColumn("s", C.when(C.col("s").isNotNull(), C.struct(*[C.col(f"s.{f}").alias(f) for f in ENTITY if f != "token"], C.col("token").alias("token"))))
    listed = C.array_sort(C.collect_list(C.when(C.col("s").isNotNull(), C.struct("at", "s"))))
    done = rows.groupBy("session_id", "row").agg(C.first("rest").alias("rest"), listed.alias("listed"))
    return done.select("rest.*", C.transform("listed", lambda x: x["s"]).alias("entities"))


def numbered_pairs(entities: Sql, numbered: frozenset[str]) -> Sql:
    """The (entity, token, value) of the numbered types, each once and in order."""
    mine = F.filter(entities, lambda s: s["entity"].isin(*sorted(numbered)))
    return F.array_sort(F.array_distinct(F.transform(mine, lambda s: F.struct(entity=s["entity"], token=s["token"], value=s["value"]))))


def pseudonym_map(pairs: Sql) -> Sql:
    """type -> value -> token."""

    def build(all_: Sql) -> Sql:
        inner = lambda t: F.map_from_entries(F.transform(F.filter(all_, lambda p: p["entity"] == t), lambda p: F.struct(key=p["value"], value=p["token"])))
        return F.map_from_entries(F.transform(F.array_distinct(F.transform(all_, lambda p: p["entity"])), lambda t: F.struct(key=t, value=inner(t))))

    return let(pairs, build)


def non_empty(maps: Sql) -> Sql:
    """The map without the types that have no values."""
    return F.map_filter(maps, lambda _, v: F.size(v) > 0)


def with_snapshot(masked: DataFrame, numbered: frozenset[str]) -> DataFrame:
    """masked with pseudonym_map: all that was numbered in the session up to and including each turn (see session_tokens for
    the order of turns)."""
    upto = W.partitionBy("session_id").orderBy("turn", "normalized_text").rowsBetween(W.unboundedPreceding, 0)
    seen = C.flatten(C.collect_list(numbered_pairs(F.col("entities"), numbered).column).over(upto))
    rows = masked.withColumn("_seen", seen)
    return rows.withColumn("pseudonym_map", pseudonym_map(F.array_sort(F.array_distinct(F.col("_seen")))).column).drop("_seen")
