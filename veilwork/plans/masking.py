"""Plans that mask texts, turns and dialogues, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as C
from pyspark.sql import types as T

from veilwork.config import MaskConfig
from veilwork.functions import sql as F
from veilwork.functions.columns import exploded
from veilwork.functions.normalize import composed, normalize
from veilwork.functions.sql import Sql, let
from veilwork.operators.columns import KINDS, normal_text, results
from veilwork.operators.bank import conditional_amount, speaker_boost
from veilwork.operators.plain import masker
from veilwork.operators.quality import FALLBACK, USABLE, blank, labelled_ratio, usability
from veilwork.operators.replace import fixed_tokens, numbered_pairs, pseudonym_map, replaced, session_tokens, tokens_of_text, with_snapshot
from veilwork.operators.resolve import resolved
from veilwork.operators.scan import merged, ner_spans, no_spans, scan
from veilwork.session import shipped

TURNS = "session_id string, turn int, turn_id long, speaker string, text string, start_time double, end_time double, asr_confidence double"


def detected(text: Sql, config: MaskConfig, ner: Sql | None = None) -> Sql:
    """All spans of a text (normalised already, if the profile does that) before any rule of the bank."""
    spans = scan(text, config.all_rules)
    if ner is not None:
        spans = F.concat(spans, ner_spans(ner))
        if config.entities is not None:
            spans = F.filter(spans, lambda s: s["entity"].isin(*sorted(config.entities)))
    return F.filter(spans, lambda s: s["score"] >= config.threshold) if config.legacy else spans


def decided(text: Sql, spans: Sql, diarized: Sql, config: MaskConfig, second: Sql | None = None) -> Sql:
    """struct<spans, log>: the bank's rules, spans of a second source, and the conflicts decided."""
    if not config.lean:
        spans = speaker_boost(text, conditional_amount(spans), diarized, cumulative=config.legacy)
    if second is not None:
        spans = merged(spans, second)
    return let(spans, lambda s: resolved(s, config.legacy, config.all_types))


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return C.col(name).cast(kind) if name in df.columns else C.lit(None).cast(kind)


#: What mask_turns adds, in this order, and what it adds if that is asked for: the sizes of two of them, the winners of conflict_log
#: (start, end, entity), and the numbered tokens (entity, token, value) that the session, or the text, hasn't had before.
RESULTS = ("original_text", "diarization_available", "normalized_text", "entities", "conflict_log", "masked_text", "usability_tag", "fallback_mode", "pseudonym_map")
MORE = ("n_entities", "n_conflicts", "winners", "new_pairs")


def mask_turns(turns: DataFrame, config: MaskConfig = MaskConfig(), dialogues: bool = False, ner: str | None = None, llm: str | None = None, snapshot: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """Each turn masked.

    turns: text, and as far as they are there session_id, turn, speaker, asr_confidence, diarized; all other columns stay.
    With dialogues, a session's speakers decide whether it is diarized, and tokens are numbered through the session;
    otherwise each turn stands for itself. ner names a column array<struct<start,end,tag>> of a model's hits, llm one of
    more hits of places and persons that count only where nothing has the same place and type.

    Adds original_text, normalized_text, masked_text, entities, pseudonym_map, conflict_log, diarization_available,
    usability_tag and fallback_mode, or those of them and of n_entities, n_conflicts, winners and new_pairs that `only` names: what
    isn't named isn't sent from Python. new_pairs needs patterns that Python can take (see session_pairs). A null or blank text passes as it is: no entities, USABLE, not diarized. With snapshot,
    pseudonym_map has all of the session up to the turn, else what the turn itself has. Without dialogues nothing is
    shuffled; with them there is one exchange, by session_id, into as many partitions as the session's setting says, since the
    work that follows is in proportion to rows and not to their few bytes. Rows of one (session_id, turn) and rows without
    turn each keep their own text; they count in the order of their normalised texts, and turns that are null come first.

    Texts are masked in Python (operators/plain.py), a batch at a time; a configuration whose own rules Python may read
    otherwise than Java (plain.portable) is worked out by expressions.
    """
    wanted = tuple(RESULTS if only is None else only)
    if unknown := set(wanted) - {*RESULTS, *MORE}:
        raise ValueError(f"unknown results: {', '.join(sorted(unknown))}")
    rows = turns
    numbered = frozenset() if config.lean else config.all_numbered
    shipped(turns.sparkSession)
    in_python = masker(config).portable
    if "new_pairs" in wanted and not in_python:
        raise ValueError("new_pairs can't be made by expressions")
    if dialogues:
        if not {"session_id", "turn"} <= set(turns.columns):
            raise ValueError("dialogues need session_id and turn")
        rows = rows.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), C.col("session_id"))
        # before any Python: after it Spark takes rows for unpartitioned, and a window would exchange them, out of their order
        rows = rows.withColumn("diarized", labelled_ratio(_column(turns, "speaker", "string")) >= config.least_labelled)
        if in_python and numbered:
            # the order of the numbers and, of rows of one turn, of their texts
            rows = rows.withColumn("_normal", normal_text(C.col("text").cast("string"), config)).sortWithinPartitions("session_id", "turn", "_normal")
    text, body, diarized = F.col("original_text"), F.col("normalized_text"), F.col("diarization_available")
    rows = rows.withColumn("original_text", C.col("text").cast("string"))
    rows = rows.withColumn("diarization_available", C.coalesce(_column(rows, "diarized", "boolean"), C.lit(False)) & (~blank(text)).column)
    given = ["diarized"] if dialogues or "diarized" not in turns.columns else []
    if in_python:
        made = tuple(n for n in KINDS if n in wanted or (n == "n_entities" and "usability_tag" in wanted) or (n == "n_entities" and "fallback_mode" in wanted) or (n == "entities" and "pseudonym_map" in wanted) or (snapshot and n == "normalized_text"))
        normal = "_normal" in rows.columns
        rows = rows.withColumn("_done", results(config, made or ("n_entities",), C.col("_normal" if normal else "original_text"), normal, None if config.lean else C.col("diarization_available"), C.col(ner) if ner else None, C.col(llm) if llm else None, C.col("session_id").cast("string") if normal else None))
        rows = rows.withColumns({n: C.col(f"_done.{n}") for n in made}).drop("_done", "_normal", *given)
        if config.lean and "normalized_text" in made:
            rows = rows.withColumn("normalized_text", C.col("original_text"))
        if "masked_text" in made:
            # bytes that aren't UTF-8 stay where nothing is replaced
            rows = rows.withColumn("masked_text", C.when(blank(text).column, C.col("original_text")).otherwise(C.col("masked_text")))
    else:
        rows = _by_expressions(rows, config, dialogues, ner, llm).drop(*given)
        rows = rows.withColumns({"n_entities": C.size("entities"), "n_conflicts": C.size("conflict_log")})
        rows = rows.withColumn("winners", C.array_distinct(C.transform("conflict_log", lambda e: C.struct(*[e["winner"][f].alias(f) for f in ("start", "end", "entity")]))))
    asr = F.col("asr_confidence").cast("double") if "asr_confidence" in turns.columns else F.lit(None).cast("double")
    if {"usability_tag", "fallback_mode"} & set(wanted):
        tag = F.when(blank(text), USABLE).otherwise(usability(text, F.col("n_entities"), diarized, asr, config))
        rows = rows.withColumn("usability_tag", tag.column).withColumn("fallback_mode", C.col("usability_tag") == FALLBACK)
    if "pseudonym_map" in wanted:
        if snapshot and dialogues and numbered:
            rows = with_snapshot(rows, numbered)
        else:
            pairs = numbered_pairs(F.col("entities"), numbered) if numbered else F.array().cast("array<struct<entity:string,token:string,value:string>>")
            rows = rows.withColumn("pseudonym_map", pseudonym_map(pairs).column)
    return rows.select(*[c for c in turns.columns if c not in wanted and not (dialogues and c == "diarized")], *wanted)


def session_pairs(turns: DataFrame, config: MaskConfig = MaskConfig()) -> DataFrame:
    """session_id, entity, value and token of all that is numbered in each session, each once.

    Each turn gives those that are new in its session, so that nothing is exchanged after mask_turns; a configuration that is
    worked out by expressions gives those of each turn, and they are made distinct.
    """
    if masker(config).portable:
        return exploded(mask_turns(turns, config, dialogues=True, only=("new_pairs",)), "session_id", p=C.col("new_pairs")).select("session_id", "p.entity", "p.value", "p.token")
    pairs = exploded(mask_turns(turns, config, dialogues=True, only=("entities",)), "session_id", p=numbered_pairs(F.col("entities"), config.all_numbered).column)
    return pairs.select("session_id", "p.entity", "p.value", "p.token").distinct()


def _by_expressions(rows: DataFrame, config: MaskConfig, dialogues: bool, ner: str | None, llm: str | None) -> DataFrame:
    """rows with normalized_text, entities, conflict_log and masked_text, without Python."""
    text, body, diarized = F.col("original_text"), F.col("normalized_text"), F.col("diarization_available")
    rows = rows.withColumn("normalized_text", composed(C.col("original_text")) if config.nfc and not config.lean else C.col("original_text"))
    if not config.lean:
        rows = rows.withColumn("normalized_text", F.when(blank(text), text).otherwise(normalize(body)).column)
    raw = F.when(blank(text), no_spans()).otherwise(detected(body, config, F.col(ner) if ner else None))
    rows = rows.withColumn("_done", decided(body, raw, diarized, config, ner_spans(F.col(llm)) if llm else None).column)
    numbered, types = frozenset() if config.lean else config.all_numbered, config.all_types
    spans, entities = F.col("_done.spans"), F.col("entities")
    rows = rows.withColumn("entities", (fixed_tokens(body, spans, types) if dialogues or not numbered else tokens_of_text(body, spans, numbered, types)).column)
    rows = rows.withColumn("conflict_log", C.col("_done.log")).drop("_done")
    if dialogues and numbered:
        rows = session_tokens(rows, numbered)
    return rows.withColumn("masked_text", replaced(body, entities).column)


def mask_text(spark: SparkSession, text: str | None, session_id: str = "", config: MaskConfig = MaskConfig(), asr_confidence: float | None = None, diarized: bool = False) -> DataFrame:
    """One text as one row."""
    row = spark.createDataFrame([(session_id, text, asr_confidence, diarized)], "session_id string, text string, asr_confidence double, diarized boolean")
    return mask_turns(row, config)


def mask_dialogue(spark: SparkSession, turns: list[dict], session_id: str = "", config: MaskConfig = MaskConfig()) -> DataFrame:
    """A call given as a list of turns in order: speaker and text, and if known start_time, end_time, asr_confidence."""
    kept = ("speaker", "text", "start_time", "end_time", "asr_confidence")
    rows = [(session_id, i, i, *[t.get(k) for k in kept]) for i, t in enumerate(turns)]
    return mask_turns(spark.createDataFrame(rows, T._parse_datatype_string(TURNS)), config, dialogues=True, snapshot=True)


def entity_types(entities: Sql) -> Sql:
    """The types of a result's entities, each once and in order."""
    return F.array_sort(F.array_distinct(F.transform(entities, lambda s: s["entity"])))


def audit(masked: DataFrame, step: str = "Step1-5", stamped: bool = True, config: MaskConfig = MaskConfig()) -> DataFrame:
    """A row for each entity of masked turns, with the reasons for which it was masked; masked has conflict_log or winners."""
    winners = C.col("winners") if "winners" in masked.columns else C.transform("conflict_log", lambda e: e["winner"])
    rows = masked.select(_column(masked, "session_id", "string").alias("session_id"), "diarization_available", "usability_tag", winners.alias("winners"), C.explode_outer("entities").alias("s")).where("s IS NOT NULL")
    s = lambda f: C.col(f"s.{f}")
    subtype = C.when(s("pattern").isin("MOBILE", "LANDLINE"), s("pattern")).when(s("pattern") == "AMOUNT_TXN_VERB", C.lit("AMOUNT_TXN")).when(s("pattern").startswith("ADDR_"), s("pattern")).otherwise(C.lit(""))
    won = C.exists("winners", lambda w: (w["start"] == s("start")) & (w["end"] == s("end")) & (w["entity"] == s("entity")))
    flag = lambda c: C.when(c, C.lit("Y")).otherwise(C.lit("N"))
    described = C.coalesce(F.choose(F.col("s.entity"), {e.name: e.description for e in config.all_types.values()}).column, s("entity"))
    columns = {
        "session_id": C.col("session_id"),
        "step": C.lit(step),
        "rule_triggered": C.coalesce(s("recognizer"), C.lit("unknown")),
        "entity_type": s("entity"),
        "entity_subtype": C.coalesce(subtype, C.lit("")),
        "original_type_desc": described,
        "start": s("start"),
        "end": s("end"),
        "score": C.format_string("%.3f", s("score")),
        "token_applied": s("token"),
        "conflict_resolved": flag(won),
        "diarization_available": flag(C.col("diarization_available")),
        "usability_tag": C.col("usability_tag"),
    }
    if stamped:
        columns["timestamp"] = C.date_format(C.to_utc_timestamp(C.current_timestamp(), C.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return rows.select(*[c.alias(n) for n, c in columns.items()])
