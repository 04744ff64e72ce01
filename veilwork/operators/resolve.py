"""Overlapping spans become disjoint ones, and each decision is logged."""

from __future__ import annotations

from collections.abc import Callable

from veilwork.functions import sql as F
from veilwork.functions.sql import Sql, let
from veilwork.functions.vocabulary import ENTITIES, Entity
from veilwork.operators.scan import FIELDS, SPAN, changed

RANKED = SPAN[:-1] + ",risk:int,prio:double,won:boolean>"
LOG = "array<struct<winner:struct<start:int,end:int,entity:string,pattern:string>,loser:struct<start:int,end:int,entity:string,pattern:string>,reason:string>>"
KEYWORD_SCORE = 0.70
WON_BUMP = 0.05


def brief(s: Sql) -> Sql:
    return F.struct(start=s["start"], end=s["end"], entity=s["entity"], pattern=s["pattern"])


def _won(s: Sql, **values: Sql) -> Sql:
    """A ranked span with some fields changed; s must be a name."""
    return F.struct(**{f: values.get(f, s[f]) for f in (*FIELDS, "risk", "prio", "won")})


def same_key(a: Sql, b: Sql) -> Sql:
    return (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["entity"] == b["entity"])


def _better(a: Sql, b: Sql) -> Sql:
    return F.when(b["score"] > a["score"], b).otherwise(a)


def _if_repeated(spans: Sql, then: Callable[[Sql], Sql], other: Callable[[Sql], Sql]) -> Sql:
    """then(spans) if two spans have one place and type, else other(spans)."""

    def choose(all_: Sql) -> Sql:
        keys = F.transform(all_, lambda s: F.struct(a=s["start"], b=s["end"], c=s["entity"]))
        return F.when(F.size(F.array_distinct(keys)) < F.size(all_), then(all_)).otherwise(other(all_))

    return let(spans, choose)


def without_duplicates(spans: Sql) -> Sql:
    """One span of each place and type: the best score, of equal ones the first; it keeps the first one's place in order."""

    def best(all_: Sql) -> Sql:
        firsts = F.filter(all_, lambda s: ~F.exists(all_, lambda x: same_key(x, s) & (x["seq"] < s["seq"])))
        return F.transform(firsts, lambda f: let(F.aggregate(F.filter(all_, lambda x: same_key(x, f)), f, lambda a, b: _better(a, b)), lambda s: changed(s, seq=f["seq"])))

    return _if_repeated(spans, best, lambda all_: all_)


def duplicate_log(spans: Sql) -> Sql:
    """What each duplicate met: the best before it of its place and type."""

    def log(all_: Sql) -> Sql:
        def one(s: Sql) -> Sql:
            before = F.filter(all_, lambda x: same_key(x, s) & (x["seq"] < s["seq"]))
            held = let(before, lambda b: F.aggregate(b, F.get(b, 0), lambda x, y: _better(x, y)))

            def entry(h: Sql) -> Sql:
                wins = s["score"] > h["score"]
                reason = F.when(s["score"] == h["score"], F.lit("EXACT_DUP:first_wins")).otherwise(F.lit("EXACT_DUP:higher_score_wins"))
                return F.when(h.isNotNull(), F.struct(winner=F.when(wins, brief(s)).otherwise(brief(h)), loser=F.when(wins, brief(h)).otherwise(brief(s)), reason=reason))

            return let(held, entry)

        return F.filter(F.transform(all_, one), lambda e: e.isNotNull())

    return _if_repeated(spans, log, lambda _: F.array().cast(LOG))


def has_keyword(s: Sql, legacy: bool = False) -> Sql:
    if legacy:
        return s["score"] > KEYWORD_SCORE
    return (s["boost"] > 0) | (s["word"].isNotNull() & (s["word"] != "")) | (s["score"] >= KEYWORD_SCORE)


def ranked(spans: Sql, legacy: bool = False, types: dict[str, Entity] = ENTITIES) -> Sql:
    """Spans with risk and priority, in the order in which they are decided: by start, the longest and strongest first."""
    risks, ranks = {e.name: e.risk for e in types.values()}, {e.name: e.priority for e in types.values()}

    def one(s: Sql) -> Sql:
        return let(F.struct(r=F.coalesce(F.choose(s["entity"], risks), 0), p=F.coalesce(F.choose(s["entity"], ranks), 0)), lambda d: scored(s, d["r"], d["p"]))

    def scored(s: Sql, r: Sql, p: Sql) -> Sql:
        if legacy:
            score = p * F.lit(0.4) + (r * 10) * F.lit(0.4) + s["score"] * F.lit(10) * F.lit(0.1) + F.when(has_keyword(s, True), F.lit(10.0)).otherwise(F.lit(0.0)) * F.lit(0.1)
        else:
            score = (r * 20).cast("double") + p * F.lit(0.1) + s["score"] * F.lit(5.0) + F.when(has_keyword(s), F.lit(2.0)).otherwise(F.lit(0.0))
        return _won(s, risk=r, prio=score, won=F.lit(False))

    def before(a: Sql, b: Sql) -> Sql:
        by = [a["start"] - b["start"], (b["end"] - b["start"]) - (a["end"] - a["start"]), F.signum(b["prio"] - a["prio"]).cast("int"), a["seq"] - b["seq"]]
        return F.coalesce(*[F.when(x != 0, x) for x in by], 0)

    return F.array_sort(F.transform(spans, one), before)


def one_decimal(x: Sql) -> Sql:
    """x with one decimal, by its exact binary value and half to even; for numbers of 16 to 500."""

    def whole(n: Sql) -> Sql:
        return let(F.struct(q=Sql(f"({n} * 10 div {1 << 48})"), r=Sql(f"({n} * 10 % {1 << 48})")), up)

    def up(d: Sql) -> Sql:
        q, r, half = d["q"], d["r"], 1 << 47
        return let(q + F.when((r > half) | ((r == half) & (Sql(f"({q} % 2)") == 1)), 1).otherwise(0), lambda v: F.concat(Sql(f"({v} div 10)").cast("string"), ".", Sql(f"({v} % 10)").cast("string")))

    return let((x * float(1 << 48)).cast("bigint"), whole)


def decision(a: Sql, b: Sql) -> Sql:
    """struct<a_wins, reason> for two spans that overlap; b came before a. A full tie goes to a."""
    la, lb = a["end"] - a["start"], b["end"] - b["start"]
    a_holds = (la > lb) & (a["start"] <= b["start"]) & (a["end"] >= b["end"])
    b_holds = (lb > la) & (b["start"] <= a["start"]) & (b["end"] >= a["end"])
    said = lambda kind, sign, x, y: F.concat(kind, F.greatest(x, y).cast("string"), sign, F.least(x, y).cast("string"))
    a_prio = a["prio"] >= b["prio"]
    by_prio = F.concat("PRIORITY_SCORE:", one_decimal(F.when(a_prio, a["prio"]).otherwise(b["prio"])), ">=", one_decimal(F.when(a_prio, b["prio"]).otherwise(a["prio"])))
    wins = F.when(a_holds, F.lit(True)).when(b_holds, F.lit(False)).when(a["risk"] != b["risk"], a["risk"] > b["risk"]).when(la != lb, la > lb).otherwise(a_prio)
    reason = F.when(a_holds | b_holds, F.lit("CONTAINS:longer_wins")).when(a["risk"] != b["risk"], said("RISK_LEVEL:", ">", a["risk"], b["risk"])).when(la != lb, said("SPAN_LENGTH:", ">", la, lb)).otherwise(by_prio)
    same = (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["entity"] != b["entity"])
    return F.struct(a_wins=wins, reason=F.concat(F.when(same, "CROSS_TYPE_SAME_SPAN:").otherwise(""), reason))


def resolved(spans: Sql, legacy: bool = False, types: dict[str, Entity] = ENTITIES) -> Sql:
    """struct<spans, log>: the spans that are left, disjoint and in order, and the log of all decisions.

    Spans come in order of their start, and those kept are disjoint, so a span can overlap none but the last one kept: the
    winner of the two is the last one then. A span that lost doesn't come back when its winner loses.
    """
    start = F.struct(done=F.array().cast(f"array<{RANKED}>"), last=F.lit(None).cast(RANKED), round=0, log=F.array().cast(LOG))

    def step(state: Sql, cur: Sql) -> Sql:
        last = state["last"]
        free = last.isNull() | (last["end"] <= cur["start"])
        kept = F.struct(done=F.when(last.isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(last))), last=cur, round=state["round"], log=state["log"])

        def decided(d: Sql) -> Sql:
            winner, loser = F.when(d["a_wins"], _won(cur, won=F.lit(True))).otherwise(last), F.when(d["a_wins"], last).otherwise(cur)
            return let(F.struct(winner=winner, loser=loser), lambda both: logged(d, both["winner"], both["loser"]))

        def logged(d: Sql, winner: Sql, loser: Sql) -> Sql:
            n = state["round"] + 1
            reason = d["reason"] if legacy else F.concat("[R", n.cast("string"), "] ", d["reason"])
            entry = F.struct(winner=brief(winner), loser=brief(loser), reason=reason)
            return F.struct(done=state["done"], last=winner, round=n, log=F.concat(state["log"], F.array(entry)))

        return F.when(free, kept).otherwise(let(decision(cur, last), decided))

    def finish(state: Sql) -> Sql:
        spans_ = F.when(state["last"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(state["last"])))
        if legacy:
            spans_ = F.transform(spans_, lambda s: _won(s, score=F.when(s["won"], F.least(1.0, s["score"] + WON_BUMP)).otherwise(s["score"])))
        return F.struct(spans=spans_, log=state["log"])

    def fold(order: Sql) -> Sql:
        return F.aggregate(order, start, step, finish)

    if legacy:
        return let(ranked(spans, True, types), fold)

    def both(all_: Sql) -> Sql:
        done = let(ranked(without_duplicates(all_), types=types), fold)
        return let(done, lambda d: F.struct(spans=d["spans"], log=F.concat(duplicate_log(all_), d["log"])))

    return let(spans, both)
