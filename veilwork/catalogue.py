"""Registered queries, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as C

from veilwork.config import MaskConfig
from veilwork.functions import sql as F
from veilwork.functions.columns import exploded
from veilwork.functions.normalize import ce_years, composed, narrow, spaced, squeezed, zh_numbers
from veilwork.functions.rules import FULL, LEAN, LEGACY, RULES, Rule
from veilwork.functions.vocabulary import ENTITIES, NER_SCORE, Entity
from veilwork.operators import plain
from veilwork.operators.columns import DECISIONS, decisions_array, made, normal_text, spans_array
from veilwork.operators.quality import known_speaker
from veilwork.operators.replace import non_empty
from veilwork.operators.scan import RULE_STEP, SPANS, ner_spans
from veilwork.plans import compare, oracle
from veilwork.plans.masking import audit, entity_types, mask_turns, session_pairs
from veilwork.session import shipped
from veilwork.sources.turns import conversation_turns, read_table, transcripts, with_hits, with_provider

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LEAN_CONFIG, FULL_CONFIG, LEGACY_CONFIG = MaskConfig(profile=LEAN), MaskConfig(), MaskConfig(profile=LEGACY, threshold=0.50)
#: Turns as source of the SQL plans.
SOURCE = f"SELECT turn_id AS id, text AS t, * EXCLUDE (turn_id, text) FROM ({oracle.TURNS})"
DOCUMENTS = "SELECT doc_id AS id, text AS t FROM documents"
SPAN_COLUMNS = "id AS turn_id, CAST(s AS INT) AS start_at, CAST(e AS INT) AS end_at, entity, pattern, score, boost, word"


def register(sql: str | None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return keep


def _named(name: str, query: Query, sql: str | None) -> None:
    query.__name__ = name
    register(sql)(query)


def _spans(rows: DataFrame, spans: F.Sql, key: str = "turn_id") -> DataFrame:
    """A row for each span."""
    made = exploded(rows, key, x=spans.column)
    return made.select(key, C.col("x.start").alias("start_at"), C.col("x.end").alias("end_at"), "x.entity", "x.pattern", "x.score", "x.boost", "x.word")


def _normal(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", normal_text(C.col("text"), FULL_CONFIG, blanks=True))


# scans


def _made(rows: DataFrame, config: MaskConfig, make: Callable[..., list[plain.Span]], *others: Column, key: str = "turn_id") -> DataFrame:
    """A row for each span that make(masker, text as it is scanned, *others) gives."""
    return _spans(rows.withColumn("spans", made(SPANS, make, C.col("text"), config, spans_array, *others)), F.col("spans"), key)


def _detected(spark: SparkSession, sf_dir: str, config: MaskConfig, make: Callable[..., list[plain.Span]] = lambda m, t, *_: m.detected(t)) -> DataFrame:
    return _made(transcripts(shipped(spark), sf_dir), config, make)


def _scan(entity: str) -> Query:
    only = MaskConfig(entities=frozenset({entity}))
    return lambda spark, sf_dir: _detected(spark, sf_dir, only)


for _entity in dict.fromkeys(r.entity for r in RULES[FULL]):
    _only = MaskConfig(entities=frozenset({_entity}))
    _named(f"scan_{_entity.lower()}", _scan(_entity), oracle.with_ctes({"source": SOURCE, "texts": oracle.normalised("SELECT * FROM source"), "raw": oracle.all_spans("texts", _only)}, f"SELECT {SPAN_COLUMNS} FROM raw"))


def _scan_documents(entity: str) -> Query:
    only = MaskConfig(profile=LEAN, entities=frozenset({entity}))
    return lambda spark, sf_dir: _made(read_table(shipped(spark), sf_dir, "documents"), only, lambda m, t, *_: m.detected(t), key="doc_id")


for _entity in ("EMAIL_ADDRESS", "TW_CREDIT_CARD"):
    _only = MaskConfig(profile=LEAN, entities=frozenset({_entity}))
    _named(f"scan_documents_{_entity.lower()}", _scan_documents(_entity), oracle.with_ctes({"source": DOCUMENTS, "raw": oracle.all_spans("source", _only)}, f"SELECT {SPAN_COLUMNS.replace('turn_id', 'doc_id')} FROM raw"))


# normalisation


def _normalize(step: Callable[[F.Sql], F.Sql]) -> Query:
    return lambda spark, sf_dir: transcripts(spark, sf_dir).select("turn_id", step(F.col("text")).column.alias("text"))


def _step_sql(*steps: str) -> str:
    return oracle.with_ctes({"source": SOURCE}, f"SELECT id AS turn_id, t AS text FROM ({oracle.normalised('SELECT id, t FROM source', steps)})")


for _name, _step, _sql in (
    ("fullwidth", narrow, ("fullwidth",)),
    ("zh_numbers", zh_numbers, ("placed", "single", "runs")),
    ("roc", ce_years, ("roc",)),
    ("filler", squeezed, ("filler",)),
    ("space", spaced, ("space",)),
):
    _named(f"normalize_{_name}", _normalize(_step), _step_sql(*_sql))


@register("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def normalize_nfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(shipped(spark), sf_dir, "documents").select("doc_id", composed(C.col("text")).alias("text"))


@register(_step_sql(*oracle.STEPS))
def normalize_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normal(transcripts(shipped(spark), sf_dir)).select("turn_id", "text")


# bank rules


_RAW = {"source": SOURCE, "texts": oracle.normalised("SELECT * FROM source"), "raw": oracle.all_spans("texts", FULL_CONFIG)}
_TALK = {"questions": f"SELECT id, s, e FROM ({oracle.places('texts', oracle.re2(oracle.QUESTIONS))})", "answers": oracle.answer_places("texts")}


@register(oracle.with_ctes(_RAW | {"kept": oracle.conditional("raw")}, f"SELECT {SPAN_COLUMNS} FROM kept"))
def cond_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts near an account or card, and all other spans."""
    return _detected(spark, sf_dir, FULL_CONFIG, lambda m, t, *_: plain.conditional_amount(m.detected(t)))


@register(oracle.with_ctes(_RAW | _TALK | {"kept": oracle.boosted("raw", "texts")}, f"SELECT {SPAN_COLUMNS} FROM kept"))
def speaker_boost_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores after questions and answers, each counted once."""
    return _detected(spark, sf_dir, FULL_CONFIG, lambda m, t, *_: plain.speaker_boost(t, m.detected(t)))


_LEGACY_RAW = _RAW | {"raw": oracle.all_spans("texts", LEGACY_CONFIG)}


@register(oracle.with_ctes(_LEGACY_RAW | _TALK | {"kept": oracle.boosted("raw", "texts", cumulative=True)}, f"SELECT {SPAN_COLUMNS} FROM kept"))
def speaker_boost_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores after questions and answers, each match counted."""
    return _detected(spark, sf_dir, LEGACY_CONFIG, lambda m, t, *_: plain.speaker_boost(t, m.detected(t), cumulative=True))


@register(oracle.with_ctes(_LEGACY_RAW, f"SELECT {SPAN_COLUMNS} FROM raw"))
def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the first generation's rules that reach its threshold."""
    return _detected(spark, sf_dir, LEGACY_CONFIG)


_NO_BRANCHES = MaskConfig(branches=False)


@register(oracle.with_ctes(_RAW | {"raw": oracle.all_spans("texts", _NO_BRANCHES)}, "SELECT entity, pattern, count(*) AS n_spans FROM raw GROUP BY ALL"))
def requested_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by rule where branch codes aren't asked for."""
    return _detected(spark, sf_dir, _NO_BRANCHES).groupBy("entity", "pattern").agg(C.count(C.lit(1)).alias("n_spans"))


# duplicates, second sources, conflicts

_SHIFT = 100
_TWICE = _RAW | {"both_": f"SELECT * FROM raw UNION ALL ({oracle.all_spans('texts', MaskConfig(profile=LEGACY, threshold=0.0), _SHIFT)})"}


_LOOSE = MaskConfig(profile=LEGACY, threshold=0.0)


def _twice(m: plain.Masker, text: str) -> list[plain.Span]:
    """Spans of two generations of rules: most places come twice."""
    return m.detected(text) + [(*s[:2], s[2] + _SHIFT * RULE_STEP, *s[3:]) for s in plain.masker(_LOOSE).detected(text)]


@register(oracle.with_ctes(_TWICE | {"kept": oracle.deduped("both_")}, f"SELECT {SPAN_COLUMNS} FROM kept"))
def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span of each place and type."""
    return _detected(spark, sf_dir, FULL_CONFIG, lambda m, t, *_: plain.without_duplicates(_twice(m, t)))


_BEST = "max(struct_pack(score := score, back := -seq)) OVER (PARTITION BY id, s, e, entity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_DUP_SQL = (
    f"SELECT id AS turn_id, CAST(s AS INT) AS start_at, CAST(e AS INT) AS end_at, entity, CASE WHEN score > best.score THEN pattern ELSE other END AS winner, CASE WHEN score > best.score THEN other ELSE pattern END AS loser, "
    f"CASE WHEN score = best.score THEN 'EXACT_DUP:first_wins' ELSE 'EXACT_DUP:higher_score_wins' END AS reason FROM (SELECT a.*, b.pattern AS other FROM (SELECT *, {_BEST} AS best FROM both_) a JOIN both_ b ON b.id = a.id AND b.s = a.s AND b.e = a.e AND b.entity = a.entity AND b.seq = -a.best.back)"
)


@register(oracle.with_ctes(_TWICE, _DUP_SQL))
def dup_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each duplicate met: the best of its place and type so far."""
    rows = transcripts(shipped(spark), sf_dir)
    rows = rows.withColumn("log", made(DECISIONS, lambda m, t, *_: plain.duplicate_log(_twice(m, t)), C.col("text"), FULL_CONFIG, decisions_array))
    log = exploded(rows, "turn_id", x=C.col("log"))
    return log.select("turn_id", C.col("x.winner.start").alias("start_at"), C.col("x.winner.end").alias("end_at"), C.col("x.winner.entity").alias("entity"), C.col("x.winner.pattern").alias("winner"), C.col("x.loser.pattern").alias("loser"), C.col("x.reason").alias("reason"))


_PERSON = "王小明"
_HITS_SQL = f"SELECT id, instr(t, '{_PERSON}') - 1 AS s, instr(t, '{_PERSON}') + 2 AS e, 'PERSON' AS tag FROM texts WHERE contains(t, '{_PERSON}') UNION ALL SELECT id, instr(t, '台北') - 1, instr(t, '台北') + 1, 'GPE' FROM texts WHERE contains(t, '台北') UNION ALL SELECT id, 0, 1, 'ORG' FROM texts WHERE length(t) > 0"


def _hits(rows: DataFrame) -> DataFrame:
    """A stand-in for a model: hits of one name, one place, and of a tag that has no entity type."""
    places = C.array(*[C.when(C.instr("text", w) > 0, C.struct((C.instr("text", w) - 1).alias("start"), (C.instr("text", w) - 1 + len(w)).alias("end"), C.lit(t).alias("tag"))) for w, t in ((_PERSON, "PERSON"), ("台北", "GPE"))], C.struct(C.lit(0).alias("start"), C.lit(1).alias("end"), C.lit("ORG").alias("tag")))
    return exploded(rows, "turn_id", h=C.filter(places, lambda x: x.isNotNull())).select("turn_id", "h.*")


_NER = {"hits": _HITS_SQL, "ner": f"SELECT id, s, e, CASE tag WHEN 'PERSON' THEN 'PERSON' ELSE 'LOCATION' END AS entity, 'NER_' || tag AS pattern, {oracle.real(NER_SCORE)} AS score, 0E0 AS boost, CAST(NULL AS VARCHAR) AS word FROM hits WHERE tag <> 'ORG'"}


@register(oracle.with_ctes({"source": SOURCE, "texts": oracle.normalised("SELECT * FROM source")} | _NER, f"SELECT {SPAN_COLUMNS} FROM ner"))
def ner_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from a model's hits."""
    rows = _normal(transcripts(shipped(spark), sf_dir))
    return _spans(with_hits(rows, _hits(rows)), ner_spans(F.col("ner_hits")))


@register(oracle.with_ctes(_RAW | _NER, f"SELECT {SPAN_COLUMNS} FROM (SELECT id, s, e, entity, pattern, score, boost, word FROM ner UNION ALL SELECT id, s, e, entity, pattern, score, boost, word FROM raw r ANTI JOIN ner n ON r.id = n.id AND r.s = n.s AND r.e = n.e AND r.entity = n.entity)"))
def merge_llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a second source that the first doesn't have."""
    rows = transcripts(shipped(spark), sf_dir).select("turn_id", "text")
    return _made(with_hits(rows, _hits(_normal(rows))), FULL_CONFIG, lambda m, t, hits: plain.merged(plain.ner_spans(hits), m.detected(t)), C.col("ner_hits"))


_FULL = oracle.pipeline(SOURCE, FULL_CONFIG)
_LEAN = oracle.pipeline(SOURCE, LEAN_CONFIG)
_LEGACY = oracle.pipeline(SOURCE, LEGACY_CONFIG)
_LEAN_DOCUMENTS = oracle.pipeline(DOCUMENTS, LEAN_CONFIG)


def _masked(spark: SparkSession, sf_dir: str, config: MaskConfig, *only: str) -> DataFrame:
    return mask_turns(transcripts(spark, sf_dir), config, only=only)


def _entities(masked: DataFrame, key: str = "turn_id") -> DataFrame:
    return _spans(masked, F.col("entities"), key)


@register(oracle.with_ctes(_FULL, f"SELECT {SPAN_COLUMNS} FROM found"))
def resolve_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans that are left when conflicts are decided."""
    return _entities(_masked(spark, sf_dir, FULL_CONFIG, "entities"))


_LOG_SQL = (
    "SELECT f.id AS turn_id, f.round, w.entity AS winner, CAST(w.s AS INT) AS winner_start, CAST(w.e AS INT) AS winner_end, w.pattern AS winner_pattern, l.entity AS loser, CAST(l.s AS INT) AS loser_start, CAST(l.e AS INT) AS loser_end, l.pattern AS loser_pattern, '[R' || f.round || '] ' || f.reason AS reason "
    "FROM fold f JOIN ord w ON w.id = f.id AND w.rn = f.kept JOIN ord l ON l.id = f.id AND l.rn = f.loser WHERE f.loser IS NOT NULL"
)


@register(oracle.with_ctes(_FULL, _LOG_SQL))
def conflict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each decision between two spans, with its round and reason."""
    log = exploded(_masked(spark, sf_dir, FULL_CONFIG, "conflict_log"), "turn_id", x=C.col("conflict_log")).where("x.reason LIKE '[R%'")
    part = lambda w, f: C.col(f"x.{w}.{f}")
    columns = {"round": C.regexp_extract("x.reason", r"^\[R(\d+)\]", 1).cast("int")}
    for w in ("winner", "loser"):
        columns |= {w: part(w, "entity"), f"{w}_start": part(w, "start"), f"{w}_end": part(w, "end"), f"{w}_pattern": part(w, "pattern")}
    return log.select("turn_id", *[c.alias(n) for n, c in columns.items()], C.col("x.reason").alias("reason"))


@register(oracle.with_ctes(_LEAN_DOCUMENTS, "SELECT entity AS entity_type, count(*) AS n_entities, count(DISTINCT id) AS n_docs FROM found GROUP BY entity"))
def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitive spans of the documents: their number, and that of documents, by entity type."""
    rows = mask_turns(read_table(spark, sf_dir, "documents").select("doc_id", "text"), LEAN_CONFIG, only=("entities",))
    return exploded(rows, "doc_id", entity_type=C.col("entities.entity")).groupBy("entity_type").agg(C.count(C.lit(1)).alias("n_entities"), C.countDistinct("doc_id").alias("n_docs"))


# tokens and texts

_TEXTS = ("masked_text", "n_entities")


def _texts_sql(ctes: dict[str, str], config: MaskConfig) -> str:
    return oracle.with_ctes(ctes | {"tokens": oracle.numbered("found", config, "id", "s")}, f"SELECT id AS turn_id, masked AS masked_text, n_entities FROM ({oracle.MASKED})")


for _name, _ctes, _config in (("lean", _LEAN, LEAN_CONFIG), ("full", _FULL, FULL_CONFIG), ("legacy", _LEGACY, LEGACY_CONFIG)):
    _named(f"masked_text_{_name}", lambda spark, sf_dir, c=_config: _masked(spark, sf_dir, c, *_TEXTS).select("turn_id", "masked_text", C.col("n_entities").cast("long")), _texts_sql(_ctes, _config))


@register(oracle.with_ctes(_LEAN_DOCUMENTS | {"tokens": "SELECT *, base AS token FROM found"}, f"SELECT id AS doc_id, masked AS masked_text, n_entities FROM ({oracle.MASKED})"))
def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with tokens of their entities' types."""
    rows = mask_turns(read_table(spark, sf_dir, "documents").select("doc_id", "text"), LEAN_CONFIG, only=_TEXTS)
    return rows.select("doc_id", "masked_text", C.col("n_entities").cast("long"))


# dialogues

_RATIO = "avg(CASE WHEN speaker IN ('AGENT', 'CUSTOMER') THEN 1E0 ELSE 0E0 END) OVER (PARTITION BY session_id)"
_DIALOGUE = oracle.pipeline(f"SELECT *, {_RATIO} >= 0.8E0 AS diarized FROM ({SOURCE})", FULL_CONFIG, "diarized")
_DIALOGUE |= {"placed": "SELECT f.*, n.session_id, n.turn FROM found f JOIN norm n USING (id)", "tokens": oracle.numbered("placed", FULL_CONFIG, "session_id", "struct_pack(turn := turn, s := s)")}


def _dialogues(spark: SparkSession, sf_dir: str, *only: str, snapshot: bool = False) -> DataFrame:
    return mask_turns(transcripts(spark, sf_dir), FULL_CONFIG, dialogues=True, snapshot=snapshot, only=only)


_TAG = (
    "CASE WHEN asr_confidence < 0.7E0 THEN 'LOW_AUDIO_QUALITY' WHEN NOT diarized THEN CASE WHEN regexp_matches(original, {questions}) THEN 'FALLBACK_MODE' ELSE 'NO_DIARIZATION' END "
    "WHEN n_entities / greatest(length(original), 1) * 100 > 3E0 THEN 'DEGRADED_MASKING' ELSE 'USABLE' END"
).format(questions=oracle.re2(oracle.QUESTIONS))
_TAGGED = f"SELECT m.*, s.t AS original, m.n_entities FROM ({oracle.MASKED}) m JOIN source s USING (id)"


@register(oracle.with_ctes(_DIALOGUE, f"SELECT session_id, turn, masked AS masked_text, diarized AS diarization_available, usability_tag, usability_tag = 'FALLBACK_MODE' AS fallback_mode FROM (SELECT *, {_TAG} AS usability_tag FROM ({_TAGGED}))"))
def mask_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls masked turn by turn, with one numbering through each, and how usable each turn is."""
    return _dialogues(spark, sf_dir, "masked_text", "diarization_available", "usability_tag", "fallback_mode").select("session_id", "turn", "masked_text", "diarization_available", "usability_tag", "fallback_mode")


@register(oracle.with_ctes(_DIALOGUE, f"SELECT usability_tag, count(*) AS n_turns, count(DISTINCT session_id) AS n_sessions FROM (SELECT *, {_TAG} AS usability_tag FROM ({_TAGGED})) GROUP BY usability_tag"))
def usability_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and calls by usability."""
    return _dialogues(spark, sf_dir, "usability_tag").groupBy("usability_tag").agg(C.count(C.lit(1)).alias("n_turns"), C.countDistinct("session_id").alias("n_sessions"))


_CONVERSATIONS = "SELECT conv_id AS session_id, CAST(turn AS INT) AS turn, CASE role WHEN 'user' THEN 'CUSTOMER' WHEN 'assistant' THEN 'AGENT' END AS speaker FROM conversations"


@register(f"SELECT session_id, {_RATIO.replace(' OVER (PARTITION BY session_id)', '')} AS ratio, {_RATIO.replace(' OVER (PARTITION BY session_id)', '')} >= 0.8E0 AS diarized FROM ({_CONVERSATIONS}) GROUP BY session_id")
def labeled_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of turns with a known speaker, by conversation."""
    return conversation_turns(spark, sf_dir).groupBy("session_id").agg(C.avg(known_speaker(C.col("speaker"))).alias("ratio")).withColumn("diarized", C.col("ratio") >= 0.8)


@register(oracle.with_ctes(_DIALOGUE, "SELECT session_id, turn, entity, value, token, CAST(s AS INT) AS start_at FROM tokens"))
def pseudonym_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token of each entity of each call."""
    return exploded(_dialogues(spark, sf_dir, "entities"), "session_id", "turn", x=C.col("entities")).select("session_id", "turn", "x.entity", "x.value", "x.token", C.col("x.start").alias("start_at"))


_KINDS = f"entity IN ({', '.join(map(oracle.q, sorted(FULL_CONFIG.numbered)))})"


@register(oracle.with_ctes(_DIALOGUE, f"SELECT DISTINCT session_id, entity, value, token FROM tokens WHERE {_KINDS}"))
def pseudonym_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and tokens of each call, by type."""
    return session_pairs(transcripts(spark, sf_dir), FULL_CONFIG)


@register(oracle.with_ctes(_DIALOGUE, f"SELECT n.session_id, n.turn, k.entity, k.value, k.token FROM norm n JOIN (SELECT session_id, entity, value, token, min(turn) AS turn FROM tokens WHERE {_KINDS} GROUP BY ALL) k ON k.session_id = n.session_id AND k.turn <= n.turn"))
def pseudonym_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and tokens of each call as of each turn."""
    maps = exploded(_dialogues(spark, sf_dir, "pseudonym_map", snapshot=True), "session_id", "turn", m=C.map_entries(non_empty(F.col("pseudonym_map")).column))
    pairs = exploded(maps, "session_id", "turn", C.col("m.key").alias("entity"), p=C.map_entries("m.value"))
    return pairs.select("session_id", "turn", "entity", C.col("p.key").alias("value"), C.col("p.value").alias("token"))


@register(
    oracle.with_ctes(
        _DIALOGUE,
        "SELECT CAST(k.session_id AS VARCHAR) AS session_id, 'Step1-5' AS step, k.recognizer AS rule_triggered, k.entity AS entity_type, CASE WHEN k.pattern IN ('MOBILE', 'LANDLINE') THEN k.pattern WHEN k.pattern = 'AMOUNT_TXN_VERB' THEN 'AMOUNT_TXN' WHEN k.pattern LIKE 'ADDR\\_%' ESCAPE '\\' THEN k.pattern ELSE '' END AS entity_subtype, "
        + oracle.cases("k.entity", {e.name: e.description for e in ENTITIES.values()}, "k.entity")
        + f" AS original_type_desc, CAST(k.s AS INT) AS \"start\", CAST(k.e AS INT) AS \"end\", printf('%.3f', k.score) AS score, k.token AS token_applied, CASE WHEN EXISTS (SELECT 1 FROM won w WHERE w.id = k.id AND w.rn = k.rn) THEN 'Y' ELSE 'N' END AS conflict_resolved, CASE WHEN d.diarized THEN 'Y' ELSE 'N' END AS diarization_available, d.usability_tag FROM tokens k JOIN (SELECT *, {_TAG} AS usability_tag FROM ({_TAGGED})) d USING (id)",
    )
)
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all calls, without the time at which it was written."""
    return audit(_dialogues(spark, sf_dir, "diarization_available", "usability_tag", "winners", "entities"), stamped=False)


# reports



def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.profile_report(transcripts(spark, sf_dir), LEAN_CONFIG, FULL_CONFIG)


def _side(config: MaskConfig, ctes: dict[str, str]) -> str:
    """One row for each case: masked text, entities, conflicts, and sorted distinct (entity, value)."""
    inner = ctes | {"tokens": oracle.numbered("found", config, "id", "s")}
    pairs = "list_sort(list_distinct(list(struct_pack(entity := entity, value := value))))"
    return "(" + oracle.with_ctes(inner, f"SELECT m.id, m.masked, m.n_entities, coalesce(f.found, []) AS found, coalesce(c.n, 0) + coalesce(d.n, 0) AS n FROM ({oracle.MASKED}) m LEFT JOIN (SELECT id, {pairs} AS found FROM found GROUP BY id) f USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM fold WHERE loser IS NOT NULL GROUP BY id) c USING (id) LEFT JOIN (SELECT id, count(*) - count(DISTINCT struct_pack(s := s, e := e, entity := entity)) AS n FROM {'raw' if config.lean else 'boosted'} GROUP BY id) d USING (id)") + ")"


_BOTH = f"SELECT a.id AS turn_id, a.masked AS masked_a, b.masked AS masked_b, a.masked = b.masked AS same, a.found AS found_a, b.found AS found_b, CAST(a.n_entities AS INT) AS entities_a, CAST(b.n_entities AS INT) AS entities_b, CAST(a.n AS INT) AS conflicts_a, CAST(b.n AS INT) AS conflicts_b, list_filter(a.found, lambda p: p.entity IN ('PERSON', 'LOCATION')) AS ner_a, list_filter(b.found, lambda p: p.entity IN ('PERSON', 'LOCATION')) AS ner_b FROM {_side(LEAN_CONFIG, _LEAN)} a JOIN {_side(FULL_CONFIG, _FULL)} b USING (id)"
_ONLY = "len(list_filter({x}, lambda p: NOT list_contains({y}, p)))"


@register(f"SELECT turn_id, masked_a, masked_b, same, entities_a, entities_b, conflicts_a, conflicts_b, CAST({_ONLY.format(x='found_a', y='found_b')} AS INT) AS n_only_a, CAST({_ONLY.format(x='found_b', y='found_a')} AS INT) AS n_only_b, ner_a <> ner_b AS ner_differs FROM ({_BOTH})")
def compare_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lean and full masking side by side."""
    return _report(spark, sf_dir).select("turn_id", "masked_a", "masked_b", "same", "entities_a", "entities_b", "conflicts_a", "conflicts_b", C.size("only_a").alias("n_only_a"), C.size("only_b").alias("n_only_b"), "ner_differs")


@register(f"SELECT count(*) AS cases, count(*) FILTER (same) AS same, count(*) FILTER (NOT same) AS different, count(*) FILTER (ner_a <> ner_b) AS ner_differs FROM ({_BOTH})")
def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cases lean and full masking agree on."""
    return compare.summary(_report(spark, sf_dir))


_SIDES = " UNION ALL ".join(f"SELECT '{x}' AS side, unnest(list_filter(ner_{x}, lambda p: NOT list_contains(ner_{y}, p))) AS p FROM b" for x, y in (("a", "b"), ("b", "a")))


@register(f"WITH b AS ({_BOTH}) SELECT side, p.entity AS entity, p.value AS value, count(*) AS cases FROM ({_SIDES}) GROUP BY ALL")
def compare_divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons and places that only one of lean and full masking finds."""
    return compare.divergences(_report(spark, sf_dir))


_LISTED = "array_to_string(list_transform(list_filter({x}, lambda p: NOT list_contains({y}, p)), lambda p: p.entity || ':' || p.value), ', ')"


@register(f"SELECT turn_id, CASE WHEN same THEN 'SAME' ELSE 'DIFF' END || ' entities ' || entities_a || '/' || entities_b || ' conflicts ' || conflicts_a || '/' || conflicts_b || ' only_a [' || {_LISTED.format(x='found_a', y='found_b')} || '] only_b [' || {_LISTED.format(x='found_b', y='found_a')} || ']' AS line FROM ({_BOTH})")
def compare_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison of lean and full masking as text, a line for each case."""
    return compare.report_lines(_report(spark, sf_dir))


# results as a whole, repeated turns, one's own rules and models


@register(oracle.with_ctes(_FULL, "SELECT n.id AS turn_id, coalesce(f.types, '') AS entity_types, coalesce(f.n, 0) AS n_entities FROM norm n LEFT JOIN (SELECT id, array_to_string(list_sort(list_distinct(list(entity))), ',') AS types, count(*) AS n FROM found GROUP BY id) f USING (id)"))
def result_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types that each turn's entities have, and their number."""
    return _masked(spark, sf_dir, FULL_CONFIG, "entities").select("turn_id", C.array_join(entity_types(F.col("entities")).column, ",").alias("entity_types"), C.size("entities").cast("long").alias("n_entities"))


@register(oracle.with_ctes(_LEGACY, f"SELECT {SPAN_COLUMNS} FROM found"))
def legacy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that the first generation leaves, with 0.05 more for those that won a conflict."""
    return _entities(_masked(spark, sf_dir, LEGACY_CONFIG, "entities"))


#: Every fourth turn has the number of the one before it, every ninth has none.
_REPEATED = "CASE WHEN turn % 9 = 0 THEN NULL WHEN turn % 4 = 0 THEN turn - 1 ELSE turn END"
_REPEATED_SQL = oracle.pipeline(f"SELECT * REPLACE (CAST({_REPEATED} AS INT) AS turn), {_RATIO} >= 0.8E0 AS diarized FROM ({SOURCE})", FULL_CONFIG, "diarized")
_REPEATED_SQL |= {"placed": "SELECT f.*, n.session_id, n.turn, n.t FROM found f JOIN norm n USING (id)", "tokens": oracle.numbered("placed", FULL_CONFIG, "session_id", "struct_pack(turn := coalesce(turn, -1), t := t, s := s)")}


@register(oracle.with_ctes(_REPEATED_SQL, f"SELECT id AS turn_id, session_id, turn, masked AS masked_text FROM ({oracle.MASKED})"))
def mask_dialogues_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls in which turns have the same number or none: each keeps its row and its text."""
    rows = transcripts(spark, sf_dir).withColumn("turn", C.expr(_REPEATED).cast("int"))
    return mask_turns(rows, FULL_CONFIG, dialogues=True, only=("masked_text",)).select("turn_id", "session_id", "turn", "masked_text")


OWN_CONFIG = MaskConfig(
    rules=(Rule("BADGE", "BADGE_EMP", r"EMP\d{5}", 0.95, ("工號", "員工編號")), Rule("CAMPAIGN", "CAMPAIGN_AB", r"AB\d{4}", 0.90)),
    types=(Entity("BADGE", "[BADGE]", 99, 5, "識別證", numbered=True), Entity("CAMPAIGN", "[PROMO]", 30, 1, "行銷專案代碼")),
)
_OWN = oracle.pipeline(SOURCE, OWN_CONFIG)


@register(_texts_sql(_OWN, OWN_CONFIG))
def custom_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masking with a user's own rules, a type of their own and another token for a known one."""
    return _masked(spark, sf_dir, OWN_CONFIG, *_TEXTS).select("turn_id", "masked_text", C.col("n_entities").cast("long"))


def _name_finder() -> Callable[[list[str]], list[list[tuple[int, int, str]]]]:
    """A stand-in for a model that finds one name, and can't read texts with an address."""

    def find(texts: list[str]) -> list[list[tuple[int, int, str]]]:
        if any("@" in t for t in texts):
            raise ValueError("address")
        return [[(t.index(_PERSON), t.index(_PERSON) + 3, "PERSON")] if _PERSON in t else [] for t in texts]

    return find


@register(f"SELECT o_orderkey AS turn_id, CASE WHEN contains(text, '@') THEN NULL WHEN contains(text, '{_PERSON}') THEN 1 ELSE 0 END AS n_hits, CASE WHEN contains(text, '@') THEN 'ValueError: address' END AS error FROM (SELECT turn_id AS o_orderkey, text FROM ({oracle.TURNS}))")
def provider_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a model that runs in Arrow batches; a text for which it raises has its error and none of the others' rows."""
    rows = with_provider(transcripts(shipped(spark), sf_dir), _name_finder)
    return rows.select("turn_id", C.when(C.col("ner_hits").isNotNull(), C.size("ner_hits")).alias("n_hits"), C.col("ner_hits_error").alias("error"))


# guards and dimensions

_EDGES = [(1, None), (2, ""), (3, "  "), (4, "　\t"), (5, "我電話0912345678"), (6, "\n")]


@register("SELECT * FROM (VALUES (1, NULL, 'USABLE', 0), (2, '', 'USABLE', 0), (3, '  ', 'USABLE', 0), (4, '　\t', 'USABLE', 0), (5, '我電話[PHONE]', 'NO_DIARIZATION', 1), (6, chr(10), 'USABLE', 0)) v(turn_id, masked_text, usability_tag, n_entities)".replace("\\t", "\t"))
def blank_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and blank texts pass as they are."""
    rows = mask_turns(spark.createDataFrame(_EDGES, "turn_id int, text string"))
    return rows.select("turn_id", "masked_text", "usability_tag", C.size("entities").alias("n_entities"))


@register("SELECT * FROM (VALUES (1, 'PERSON', '王小明', '[NAME_1]'), (2, 'TXN_REF', '1', '[TXN_REF_1]')) v(id, entity, value, token)")
def empty_map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonym maps without the types that have no values."""
    rows = spark.createDataFrame([(1, {"PERSON": {"王小明": "[NAME_1]"}, "ATM_REF": {}}), (2, {"TXN_REF": {"1": "[TXN_REF_1]"}}), (3, {"PERSON": {}})], "id int, m map<string,map<string,string>>")
    inner = rows.select("id", C.explode(non_empty(F.col("m")).column).alias("entity", "inner"))
    return inner.select("id", "entity", C.explode("inner").alias("value", "token"))


@register("SELECT * FROM (VALUES " + ", ".join(f"({oracle.q(e.name)}, {oracle.q(e.token)}, {e.priority}, {e.risk}, {oracle.q(e.description)}, {e.numbered})" for e in ENTITIES.values()) + ") v(entity, token, priority, risk, description, numbered)")
def entity_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity types as a table, for joins in users' SQL."""
    return spark.createDataFrame([(e.name, e.token, e.priority, e.risk, e.description, e.numbered) for e in ENTITIES.values()], "entity string, token string, priority int, risk int, description string, numbered boolean")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
