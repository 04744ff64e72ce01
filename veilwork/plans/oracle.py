"""The masking plan as SQL for DuckDB, made of the same rules but none of the Spark expressions."""

from __future__ import annotations

from veilwork.config import MaskConfig
from veilwork.functions.normalize import ERA, FILLERS, NARROW, NUMERALS, PLACE_VALUES, VALUES, WIDE
from veilwork.functions.rules import ANSWERS, LEGACY_FLAGS, QUESTIONS, SHORT_ANSWER_RE2, Rule
from veilwork.functions.vocabulary import ENTITIES, TRIGGERS, Entity
from veilwork.operators.bank import ANSWER_BOOST, NEAR, QUESTION_BOOST, QUESTION_WINDOW
from veilwork.operators.scan import BOOST, RULE_STEP, WINDOW
from veilwork.sources.turns import TRANSCRIPTS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def real(x: float) -> str:
    return f"{x!r}E0"


def re2(pattern: str, legacy: bool = False) -> str:
    """A pattern for RE2: digits of both widths where Python has Unicode's."""
    return q(("(?is)" if legacy else "") + pattern.replace(r"\d", "[0-9０-９]"))


def cases(key: str, pairs: dict[str, object], other: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in pairs.items()) + f" ELSE {other} END"


TURNS = TRANSCRIPTS.format(orders="orders")


def interleaved(text: str, pattern: str, change: str) -> str:
    """SQL of text with `change` of each match m of the pattern."""
    return f"array_to_string(list_transform(regexp_split_to_array({text}, {q(pattern)}), lambda g, i: g || coalesce(list_transform(regexp_extract_all({text}, {q(pattern)}), lambda m: {change})[i], '')), '')"


_DIGIT = f"TRY_CAST(translate(c, {q(NUMERALS)}, {q(VALUES)}) AS INT)"
_UNIT = cases("c", {k: v for k, v in PLACE_VALUES.items()}, "0")
_EVERY = f"[{NUMERALS}{''.join(PLACE_VALUES)}]*"
_PLACED = f"{_EVERY}[{''.join(PLACE_VALUES)}]{_EVERY}"
#: A unit counts the digit just before it, or 1 if it is a leading ten; a last digit counts itself.
_TOTAL = (
    "(list_sum(list_transform(string_split(m, ''), lambda c, i: "
    f"CASE WHEN {_UNIT} > 0 THEN {_UNIT} * CASE WHEN i = 1 THEN CASE WHEN c = '十' THEN 1 ELSE 0 END ELSE coalesce(TRY_CAST(translate(string_split(m, '')[i - 1], {q(NUMERALS)}, {q(VALUES)}) AS INT), 0) END "
    f"WHEN i = length(m) THEN coalesce({_DIGIT}, 0) ELSE 0 END)))"
)
_YEAR = r"民(?:國|国)?\s*([0-9]{2,3})\s*年"
STEPS: dict[str, str] = {
    "nfc": "nfc_normalize(t)",
    "fullwidth": f"translate(t, {q(WIDE)}, {q(NARROW)})",
    "placed": interleaved("t", _PLACED, f"CASE WHEN {_TOTAL} > 0 THEN CAST(CAST({_TOTAL} AS BIGINT) AS VARCHAR) ELSE m END"),
    "single": None,
    "runs": interleaved("t", f"[{NUMERALS}]{{2,}}", f"translate(m, {q(NUMERALS)}, {q(VALUES)})"),
    "roc": interleaved("t", _YEAR, f"CASE WHEN TRY_CAST(regexp_extract(m, {q(_YEAR)}, 1) AS INT) BETWEEN 10 AND 150 THEN CAST(TRY_CAST(regexp_extract(m, {q(_YEAR)}, 1) AS INT) + {ERA} AS VARCHAR) || '年' ELSE m END"),
    "filler": None,
    "space": r"regexp_replace(regexp_replace(regexp_replace(t, '\r\n|\n|\t', ' ', 'g'), '\s{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')",
}
_single = "t"
for _c, _v in zip(NUMERALS, VALUES):
    _single = rf"regexp_replace({_single}, '{_c}([月日號點])', '{_v}\1', 'g')"
STEPS["single"] = _single
_filler = "t"
for _c in FILLERS:
    _filler = f"regexp_replace({_filler}, '{_c}{{3,}}', '{_c}{_c}', 'g')"
STEPS["filler"] = _filler


def normalised(source: str, steps: tuple[str, ...] = tuple(STEPS)) -> str:
    """SELECT of source (id, t, ...) with t after the steps."""
    sql = source
    for step in steps:
        sql = f"SELECT * REPLACE ({STEPS[step]} AS t) FROM ({sql})"
    return sql


def places(texts: str, pattern: str, extra: str = "") -> str:
    """(id, t, i, s, e, m) of each match; extra adds columns made of t."""
    return (
        "SELECT id, t, i, m, s, s + length(m) AS e" + (", " + ", ".join(x.split(" AS ")[1] for x in extra.split(";")) if extra else "") + " FROM (SELECT id, t, i, hits[i] AS m, "
        "CAST(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS INT) AS s"
        + (", " + ", ".join(extra.split(";")) if extra else "")
        + f" FROM (SELECT id, t, regexp_extract_all(t, {pattern}) AS hits, regexp_split_to_array(t, {pattern}) AS gaps, unnest(generate_series(1, len(regexp_extract_all(t, {pattern})))) AS i"
        + (", " + ", ".join(f"regexp_extract_all(t, {pattern}, {g}) AS g{g}" for g in (1, 2)) if "g1" in extra else "")
        + f" FROM {texts} WHERE regexp_matches(t, {pattern})))"
    )


def rule_spans(texts: str, place: int, rule: Rule) -> str:
    """(id, s, e, seq, entity, score, recognizer, pattern, boost, word) of one rule."""
    legacy = rule.flags == LEGACY_FLAGS
    pattern = re2(rule.re2 or rule.regex, legacy)
    head = f"{place * RULE_STEP} + i AS seq, {q(rule.entity)} AS entity"
    tail = f"{q(rule.recognizer)} AS recognizer, {q(rule.name)} AS pattern"
    if rule.kind == "group":
        return f"SELECT id, s + instr(m, n) - 1 AS s, s + instr(m, n) - 1 + length(n) AS e, {head}, {real(rule.score)} AS score, {tail}, {real(BOOST)} AS boost, {q(rule.note)} AS word FROM (SELECT id, s, i, m, CASE WHEN coalesce(a, '') <> '' THEN a ELSE b END AS n FROM ({places(texts, pattern, 'g1[i] AS a;g2[i] AS b')}))"
    if rule.kind == "after":
        inner = places(f"(SELECT struct_pack(id := id, e := e, m := m, i := i) AS id, substr(t, e + 1, {WINDOW}) AS t FROM ({places(texts, pattern)}))", re2(rule.then, legacy))
        return f"SELECT id.id AS id, s + id.e AS s, e + id.e AS e, {place * RULE_STEP} + id.i * 1000 + i AS seq, {q(rule.entity)} AS entity, {real(rule.score)} AS score, {tail}, {real(BOOST)} AS boost, id.m AS word FROM ({inner})"
    if not rule.words:
        return f"SELECT id, s, e, {head}, {real(rule.score)} AS score, {tail}, 0E0 AS boost, CAST(NULL AS VARCHAR) AS word FROM ({places(texts, pattern)})"
    around = f"substr(t, greatest(s - {WINDOW}, 0) + 1, least(e + {WINDOW}, length(t)) - greatest(s - {WINDOW}, 0))"
    word = "CASE " + " ".join(f"WHEN contains(w, {q(k)}) THEN {q(k)}" for k in rule.words) + " END"
    raised = f"CASE WHEN word IS NULL THEN {real(rule.score)} ELSE least(1E0, {real(rule.score)} + {real(BOOST)}) END"
    sql = f"SELECT id, s, e, {head}, {raised} AS score, {tail}, CASE WHEN word IS NULL THEN 0E0 ELSE {real(BOOST)} END AS boost, word FROM (SELECT *, {word} AS word FROM (SELECT *, {around} AS w FROM ({places(texts, pattern)})))"
    return sql + (" WHERE word IS NOT NULL" if rule.needed else "")


def all_spans(texts: str, config: MaskConfig, offset: int = 0) -> str:
    sql = " UNION ALL ".join(rule_spans(texts, i + offset, r) for i, r in config.all_rules)
    return f"SELECT * FROM ({sql}) WHERE score >= {real(config.threshold)}" if config.legacy else sql


def conditional(spans: str) -> str:
    trigger = f"entity IN ({', '.join(map(q, TRIGGERS))})"
    return f"SELECT * FROM {spans} a WHERE entity <> 'AMOUNT' OR EXISTS (SELECT 1 FROM (SELECT * FROM {spans} WHERE {trigger}) b WHERE b.id = a.id AND abs(a.s - b.s) <= {NEAR})"


def answer_places(texts: str) -> str:
    short = f"SELECT id, s, e - CASE WHEN regexp_matches(m, '[一-鿿]$') THEN 0 ELSE 1 END AS e FROM ({places(texts, re2(SHORT_ANSWER_RE2))})"
    return " UNION ALL ".join([f"SELECT id, s, e FROM ({places(texts, re2(p))})" for p in ANSWERS[:-1]] + [short])


def boosted(spans: str, texts: str, diarized: str = "FALSE", cumulative: bool = False) -> str:
    """spans with their scores after questions and answers; diarized is SQL over the span's text row."""
    asked = f"(SELECT count(*) FROM questions x WHERE x.id = a.id AND a.s >= x.e AND a.s <= x.e + {QUESTION_WINDOW})"
    said = "(SELECT count(*) FROM answers x WHERE x.id = a.id AND a.s >= x.s AND a.s < x.e)"
    if cumulative:
        total = f"list_reduce(list_concat([score], list_resize(CAST([] AS DOUBLE[]), CAST(nq AS BIGINT), {real(QUESTION_BOOST)}), list_resize(CAST([] AS DOUBLE[]), CAST(na AS BIGINT), {real(ANSWER_BOOST)})), lambda x, y: least(1E0, x + y))"
    else:
        total = f"CASE WHEN nq + na = 0 THEN score ELSE least(1E0, score + (CASE WHEN nq > 0 THEN {real(QUESTION_BOOST)} ELSE 0E0 END + CASE WHEN na > 0 THEN {real(ANSWER_BOOST)} ELSE 0E0 END)) END"
    return f"SELECT * EXCLUDE (nq, na, d) REPLACE (CASE WHEN d THEN score ELSE {total} END AS score) FROM (SELECT a.*, {asked} AS nq, {said} AS na, (SELECT {diarized} FROM {texts} x WHERE x.id = a.id) AS d FROM {spans} a)"


def deduped(spans: str) -> str:
    """Best of each place and type, with the first one's rank."""
    return f"SELECT * EXCLUDE (rk, first) REPLACE (first AS seq) FROM (SELECT *, row_number() OVER (PARTITION BY id, s, e, entity ORDER BY score DESC, seq) AS rk, min(seq) OVER (PARTITION BY id, s, e, entity) AS first FROM {spans}) WHERE rk = 1"


def fold(spans: str, legacy: bool = False, types: dict[str, Entity] = ENTITIES) -> dict[str, str]:
    """CTEs ord and fold: each step decides between a span and the last one kept."""
    risks, ranks = {e.name: e.risk for e in types.values()}, {e.name: e.priority for e in types.values()}
    if legacy:
        prio = "p * 0.4E0 + (r * 10) * 0.4E0 + score * 10E0 * 0.1E0 + CASE WHEN score > 0.7E0 THEN 10E0 ELSE 0E0 END * 0.1E0"
    else:
        prio = "CAST(r * 20 AS DOUBLE) + p * 0.1E0 + score * 5E0 + CASE WHEN boost > 0 OR coalesce(word, '') <> '' OR score >= 0.7E0 THEN 2E0 ELSE 0E0 END"
    ranked = f"SELECT *, {prio} AS prio FROM (SELECT *, {cases('entity', risks, '0')} AS r, {cases('entity', ranks, '0')} AS p FROM {spans})"
    la, lb = "(o.e - o.s)", "(l.e - l.s)"
    holds_a, holds_b = f"({la} > {lb} AND o.s <= l.s AND o.e >= l.e)", f"({lb} > {la} AND l.s <= o.s AND l.e >= o.e)"
    wins = f"CASE WHEN {holds_a} THEN TRUE WHEN {holds_b} THEN FALSE WHEN o.r <> l.r THEN o.r > l.r WHEN {la} <> {lb} THEN {la} > {lb} ELSE o.prio >= l.prio END"
    reason = (
        f"CASE WHEN o.s = l.s AND o.e = l.e AND o.entity <> l.entity THEN 'CROSS_TYPE_SAME_SPAN:' ELSE '' END || CASE WHEN {holds_a} OR {holds_b} THEN 'CONTAINS:longer_wins' "
        f"WHEN o.r <> l.r THEN 'RISK_LEVEL:' || greatest(o.r, l.r) || '>' || least(o.r, l.r) WHEN {la} <> {lb} THEN 'SPAN_LENGTH:' || greatest({la}, {lb}) || '>' || least({la}, {lb}) "
        "ELSE 'PRIORITY_SCORE:' || printf('%.1f', greatest(o.prio, l.prio)) || '>=' || printf('%.1f', least(o.prio, l.prio)) END"
    )
    meets = "(o.s < l.e AND o.e > l.s)"
    step = (
        f"SELECT o.id, o.rn, CASE WHEN {meets} AND NOT {wins} THEN f.kept ELSE o.rn END AS kept, CASE WHEN NOT {meets} THEN NULL WHEN {wins} THEN f.kept ELSE o.rn END AS loser, "
        f"f.round + CASE WHEN {meets} THEN 1 ELSE 0 END AS round, CASE WHEN {meets} THEN {reason} END AS reason FROM fold f JOIN ord o ON o.id = f.id AND o.rn = f.rn + 1 JOIN ord l ON l.id = f.id AND l.rn = f.kept"
    )
    return {
        "ord": f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, s - e, prio DESC, seq) AS rn FROM ({ranked})",
        "fold": f"SELECT id, rn, rn AS kept, CAST(NULL AS BIGINT) AS loser, 0 AS round, CAST(NULL AS VARCHAR) AS reason FROM ord WHERE rn = 1 UNION ALL {step}",
        "won": "SELECT DISTINCT id, kept AS rn FROM fold WHERE loser IS NOT NULL",
        "clean": "SELECT o.* FROM ord o ANTI JOIN (SELECT id, loser FROM fold WHERE loser IS NOT NULL) x ON o.id = x.id AND o.rn = x.loser",
    }


def pipeline(texts: str, config: MaskConfig, diarized: str = "FALSE") -> dict[str, str]:
    """CTEs from source rows (id, t: the original text, and more) to `clean` spans, each with value and base token."""
    ctes = {"source": texts}
    blank = "(t IS NULL OR NOT regexp_matches(t, '\\S'))"
    ctes["norm"] = "SELECT * FROM source" if config.lean else normalised("SELECT * FROM source")
    ctes["texts"] = f"SELECT n.* FROM norm n JOIN source o USING (id) WHERE NOT {blank.replace('t IS', 'o.t IS').replace('(t,', '(o.t,')}"
    ctes["raw"] = all_spans("texts", config)
    last = "raw"
    if not config.lean:
        ctes["cond"] = conditional("raw")
        ctes["questions"] = f"SELECT id, s, e FROM ({places('texts', re2(QUESTIONS))})"
        ctes["answers"] = answer_places("texts")
        ctes["boosted"] = boosted("cond", "texts", diarized, config.legacy)
        last = "boosted"
    if not config.legacy:
        ctes["deduped"] = deduped(last)
        last = "deduped"
    ctes |= fold(last, config.legacy, config.all_types)
    token = cases("entity", {e.name: e.token for e in config.all_types.values()}, "'[' || entity || ']'")
    bump = "CASE WHEN EXISTS (SELECT 1 FROM fold w WHERE w.id = c.id AND w.rn = c.rn AND w.kept = w.rn AND w.loser IS NOT NULL) THEN least(1E0, score + 0.05E0) ELSE score END" if config.legacy else "score"
    ctes["found"] = f"SELECT c.* REPLACE ({bump} AS score), substr(t.t, c.s + 1, c.e - c.s) AS value, {token} AS base FROM clean c JOIN texts t USING (id)"
    return ctes


def numbered(found: str, config: MaskConfig, session: str, order: str) -> str:
    """found with token: base, or numbered through the session (SQL over found's rows) in the given order."""
    if config.lean:
        return f"SELECT *, base AS token FROM {found}"
    kinds = f"entity IN ({', '.join(map(q, sorted(config.all_numbered)))})"
    first = f"SELECT *, min(({order})) OVER (PARTITION BY {session}, entity, value) AS first FROM {found}"
    return f"SELECT * EXCLUDE (first, n), CASE WHEN {kinds} THEN left(base, length(base) - 1) || '_' || n || ']' ELSE base END AS token FROM (SELECT *, dense_rank() OVER (PARTITION BY {session}, entity ORDER BY first) AS n FROM ({first}))"


#: Texts with their tokens: pieces by window, then put together.
MASKED = (
    "SELECT n.*, CASE WHEN p.id IS NULL THEN n.t ELSE p.head || substr(n.t, p.tail + 1) END AS masked, coalesce(p.n, 0) AS n_entities FROM norm n LEFT JOIN "
    "(SELECT id, string_agg(piece, '' ORDER BY s) AS head, max(e) AS tail, count(*) AS n FROM (SELECT k.id, k.s, k.e, substr(n.t, coalesce(lag(k.e) OVER (PARTITION BY k.id ORDER BY k.s), 0) + 1, k.s - coalesce(lag(k.e) OVER (PARTITION BY k.id ORDER BY k.s), 0)) || k.token AS piece "
    "FROM tokens k JOIN norm n USING (id)) GROUP BY id) p USING (id)"
)


def with_ctes(ctes: dict[str, str], select: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({s})" if n == "fold" else f"{n} AS MATERIALIZED ({s})" for n, s in ctes.items()) + " " + select
