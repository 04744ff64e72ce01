"""Reports on how two masking runs differ, case by case and in all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as C

from veilwork.config import MaskConfig
from veilwork.functions import sql as F
from veilwork.functions.columns import exploded
from veilwork.functions.sql import Sql
from veilwork.plans.masking import mask_turns

NER_TYPES = ("PERSON", "LOCATION")
#: What masking adds to turns.
RESULT = ("original_text", "normalized_text", "masked_text", "entities", "pseudonym_map", "conflict_log", "diarization_available", "usability_tag", "fallback_mode")


def found_pairs(entities: Sql) -> Sql:
    """The (entity, value) of a text, each once and in order."""
    return F.array_sort(F.array_distinct(F.transform(entities, lambda s: F.struct(entity=s["entity"], value=s["value"]))))


def case_report(first: DataFrame, second: DataFrame, key: str = "turn_id") -> DataFrame:
    """A row for each case that both runs have, joined by key: whether the texts are alike, and what only one has found."""
    return _report(first.select(key, *_own("a")).join(second.select(key, *_own("b")), key), key)


def _own(x: str, conflicts: Column | None = None) -> list[Column]:
    conflicts = C.size("conflict_log") if conflicts is None else conflicts
    return [C.col("masked_text").alias(f"masked_{x}"), found_pairs(F.col("entities")).column.alias(f"found_{x}"), C.size("entities").alias(f"entities_{x}"), conflicts.alias(f"conflicts_{x}")]


def profile_report(turns: DataFrame, first: MaskConfig, second: MaskConfig, key: str = "turn_id") -> DataFrame:
    """case_report of two configurations over the same turns, each turn for itself: one pass and no join."""
    kept = [c for c in turns.columns if c not in RESULT]
    only = ("masked_text", "entities", "n_conflicts")
    rows = mask_turns(turns.select(*kept), first, only=only).select(*kept, *_own("a", C.col("n_conflicts")))
    names = [f"{n}_a" for n in ("masked", "found", "entities", "conflicts")]
    return _report(mask_turns(rows, second, only=only).select(key, *names, *_own("b", C.col("n_conflicts"))), key)


def report_lines(report: DataFrame, key: str = "turn_id") -> DataFrame:
    """(key, line): the report as text, a line for each case: verdict, entities and conflicts of both runs, and what only one has."""
    listed = lambda c: C.concat_ws(", ", C.transform(c, lambda p: C.concat(p["entity"], C.lit(":"), p["value"])))
    verdict = C.when(C.col("same"), C.lit("SAME")).otherwise(C.lit("DIFF"))
    line = C.format_string("%s entities %d/%d conflicts %d/%d only_a [%s] only_b [%s]", verdict, C.col("entities_a"), C.col("entities_b"), C.col("conflicts_a"), C.col("conflicts_b"), listed("only_a"), listed("only_b"))
    return report.select(key, line.alias("line"))


def _report(both: DataFrame, key: str) -> DataFrame:
    ner = lambda x: C.filter(f"found_{x}", lambda p: p["entity"].isin(*NER_TYPES))
    only = lambda x, y: C.array_sort(C.array_except(x, y))
    both = both.withColumns({"ner_a": ner("a"), "ner_b": ner("b")})
    return both.select(
        key, "masked_a", "masked_b", (C.col("masked_a").eqNullSafe(C.col("masked_b"))).alias("same"), "entities_a", "entities_b", "conflicts_a", "conflicts_b",
        only("found_a", "found_b").alias("only_a"), only("found_b", "found_a").alias("only_b"), only("ner_a", "ner_b").alias("ner_only_a"), only("ner_b", "ner_a").alias("ner_only_b"), (C.col("ner_a") != C.col("ner_b")).alias("ner_differs"),
    )


def summary(report: DataFrame) -> DataFrame:
    """One row: cases, those masked alike and differently, and those whose persons or places differ."""
    count = lambda c: C.sum(C.when(c, 1).otherwise(0)).cast("long")
    return report.select(C.count(C.lit(1)).alias("cases"), count(C.col("same")).alias("same"), count(~C.col("same")).alias("different"), count(C.col("ner_differs")).alias("ner_differs"))


def divergences(report: DataFrame) -> DataFrame:
    """All persons and places that only one run has found, over all cases, with the number of cases of each."""
    side = lambda x: exploded(report, C.lit(x).alias("side"), p=C.col(f"ner_only_{x}")).select("side", "p.entity", "p.value")
    return side("a").unionByName(side("b")).groupBy("side", "entity", "value").agg(C.count(C.lit(1)).alias("cases"))
