"""Spans that rules propose in a text, and the words near them."""

from __future__ import annotations

from collections.abc import Iterable

from veilwork.functions import sql as F
from veilwork.functions.columns import matches, slice_of
from veilwork.functions.rules import Rule
from veilwork.functions.sql import Sql, let
from veilwork.functions.vocabulary import NER_SCORE, NER_TAGS

WINDOW = 30
BOOST = 0.35
#: Spans of a rule are numbered from its place times this on, so seq is the order in which rules and matches come.
RULE_STEP = 1_000_000
NER_PLACE = 900
LLM_PLACE = 950
SPAN = "struct<start:int,end:int,seq:int,entity:string,score:double,recognizer:string,pattern:string,boost:double,word:string>"
SPANS = f"array<{SPAN}>"
FIELDS = ("start", "end", "seq", "entity", "score", "recognizer", "pattern", "boost", "word")


def no_spans() -> Sql:
    return F.array().cast(SPANS)


def span(start: Sql, end: Sql, seq: Sql, entity: Sql, score: Sql, recognizer: Sql, pattern: Sql, boost: Sql, word: Sql) -> Sql:
    return F.struct(start=start, end=end, seq=seq, entity=entity, score=score, recognizer=recognizer, pattern=pattern, boost=boost, word=word)


def changed(s: Sql, **values: Sql) -> Sql:
    """A span with some fields changed; s must be a name, since it is written once for each field."""
    return span(**{f: values.get(f, s[f]) for f in FIELDS})


def near_word(text: Sql, start: Sql, end: Sql, words: tuple[str, ...]) -> Sql:
    """The first of the words, in the order of the list, that is in the text around a match, the match included."""
    if not words:
        return F.lit(None).cast("string")
    low = F.greatest(start - WINDOW, F.lit(0))
    around = slice_of(text, low, F.least(end + WINDOW, F.length(text)))
    return let(around, lambda w: F.coalesce(*[F.when(w.contains(k), k) for k in words]))


def _built(rule: Rule, place: int, text: Sql, m: Sql, i: Sql) -> Sql:
    def build(word: Sql) -> Sql:
        score = F.when(word.isNotNull(), F.least(F.lit(1.0), F.lit(rule.score) + F.lit(BOOST))).otherwise(F.lit(rule.score))
        return span(m["start"], m["end"], F.lit(place * RULE_STEP) + i, F.lit(rule.entity), score, F.lit(rule.recognizer), F.lit(rule.name), F.when(word.isNotNull(), F.lit(BOOST)).otherwise(F.lit(0.0)), word)

    return let(near_word(text, m["start"], m["end"], rule.words), build)


def _fixed(rule: Rule, place: int, m: Sql, i: Sql, word: Sql) -> Sql:
    return span(m["start"], m["end"], F.lit(place * RULE_STEP) + i, F.lit(rule.entity), F.lit(rule.score), F.lit(rule.recognizer), F.lit(rule.name), F.lit(BOOST if rule.note else 0.0), word)


def scan_rule(text: Sql, place: int, rule: Rule) -> Sql:
    """The spans of one rule."""
    found = matches(text, rule.java)
    if rule.kind == "group":
        # what the first group with text takes, at its first place in the match
        groups = [F.regexp_extract_all(text, F.lit(rule.java), F.lit(g)) for g in (1, 2)]

        def inner(all_: Sql) -> Sql:
            def one(m: Sql, i: Sql) -> Sql:
                number = F.when(F.get(all_["a"], i) != "", F.get(all_["a"], i)).otherwise(F.get(all_["b"], i))
                return let(number, lambda n: let(m["start"] + F.instr(m["text"], n) - 1, lambda s: F.struct(start=s, end=s + F.length(n))))

            return F.transform(all_["m"], one)

        places = let(F.struct(m=found, a=groups[0], b=groups[1]), inner)
        return F.when(text.rlike(rule.java), F.transform(places, lambda m, i: _fixed(rule, place, m, i, F.lit(rule.note)))).otherwise(no_spans())
    if rule.kind == "after":

        def answers(t: Sql) -> Sql:
            rest = F.substr(text, t["end"] + 1, F.lit(WINDOW))
            return F.transform(matches(rest, rule.flags + rule.then), lambda a: F.struct(start=a["start"] + t["end"], end=a["end"] + t["end"], text=t["text"]))

        return F.transform(F.flatten(F.transform(found, answers)), lambda m, i: _fixed(rule, place, m, i, m["text"]))
    if not rule.words:
        return F.transform(found, lambda m, i: _fixed(rule, place, m, i, F.lit(None).cast("string")))
    spans = F.transform(found, lambda m, i: _built(rule, place, text, m, i))
    return F.filter(spans, lambda s: s["word"].isNotNull()) if rule.needed else spans


def needs_digit(rule: Rule) -> bool:
    return not (rule.recognizer == "AddressRule" or rule.entity == "EMAIL_ADDRESS" or "|" in rule.then)


def scan(text: Sql, rules: Iterable[tuple[int, Rule]]) -> Sql:
    """All spans of the rules, as an array in the order of rules and matches. A text without digits skips most rules."""
    rules = list(rules)
    with_digits = [scan_rule(text, i, r) for i, r in rules if needs_digit(r)]
    others = [scan_rule(text, i, r) for i, r in rules if not needs_digit(r)]
    parts = ([F.when(text.rlike(r"(?U)\d"), F.flatten(F.array(*with_digits))).otherwise(no_spans())] if with_digits else []) + others
    spans = F.flatten(F.array(*parts)) if parts else no_spans()
    return F.array_sort(spans, lambda a, b: a["seq"] - b["seq"])


def ner_spans(hits: Sql) -> Sql:
    """Spans of a model's hits, array<struct<start, end, tag>>; tags without an entity type are dropped, and null is none."""
    entity = lambda h: F.choose(h["tag"], NER_TAGS)
    known = F.filter(hits, lambda h: h["tag"].isin(*NER_TAGS))
    made = F.transform(known, lambda h, i: span(h["start"].cast("int"), h["end"].cast("int"), F.lit(NER_PLACE * RULE_STEP) + i, entity(h), F.lit(NER_SCORE), F.lit("NerHits"), F.concat(F.lit("NER_"), h["tag"]), F.lit(0.0), F.lit(None).cast("string")))
    return F.coalesce(made, no_spans())


def merged(first: Sql, second: Sql) -> Sql:
    """first, then those of second whose place and type first doesn't have."""
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["entity"] == b["entity"])
    return let(first, lambda f: F.concat(f, F.filter(second, lambda s: ~F.exists(f, lambda p: same(p, s)))))


def values(text: Sql, spans: Sql) -> Sql:
    """The text of each span."""
    return F.transform(spans, lambda s: slice_of(text, s["start"], s["end"]))
