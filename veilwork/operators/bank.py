"""The bank's rules: amounts near an account, and questions and answers in calls without speakers."""

from __future__ import annotations

from veilwork.functions import sql as F
from veilwork.functions.columns import matches
from veilwork.functions.rules import ANSWERS, FLAGS, QUESTIONS
from veilwork.functions.sql import Sql, let
from veilwork.functions.vocabulary import TRIGGERS
from veilwork.operators.scan import changed

NEAR = 60
QUESTION_WINDOW = 30
QUESTION_BOOST = 0.15
ANSWER_BOOST = 0.10


def conditional_amount(spans: Sql) -> Sql:
    """Amounts stay only where an account or card begins within NEAR characters; all other spans stay."""

    def keep(all_: Sql) -> Sql:
        triggers = F.filter(all_, lambda s: s["entity"].isin(*TRIGGERS))
        return let(triggers, lambda t: F.filter(all_, lambda s: (s["entity"] != "AMOUNT") | F.exists(t, lambda x: F.abs(s["start"] - x["start"]) <= NEAR)))

    return let(spans, keep)


def questions(text: Sql) -> Sql:
    return matches(text, FLAGS + QUESTIONS)


def answers(text: Sql) -> Sql:
    return F.concat(*[matches(text, FLAGS + p) for p in ANSWERS])


def _after(q: Sql, s: Sql) -> Sql:
    return (s["start"] >= q["end"]) & (s["start"] <= q["end"] + QUESTION_WINDOW)


def _inside(a: Sql, s: Sql) -> Sql:
    return (s["start"] >= a["start"]) & (s["start"] < a["end"])


def speaker_boost(text: Sql, spans: Sql, diarized: Sql, cumulative: bool = False) -> Sql:
    """Without speakers, spans after a question and inside an answer score higher.

    Once for questions and once for answers, or, if cumulative, for each question and answer, never above 1.
    """

    def once(s: Sql, q: Sql, a: Sql) -> Sql:
        total = F.when(F.exists(q, lambda x: _after(x, s)), F.lit(QUESTION_BOOST)).otherwise(F.lit(0.0)) + F.when(F.exists(a, lambda x: _inside(x, s)), F.lit(ANSWER_BOOST)).otherwise(F.lit(0.0))
        return let(total, lambda t: F.when(t > 0, F.least(F.lit(1.0), s["score"] + t)).otherwise(s["score"]))

    def each(s: Sql, q: Sql, a: Sql) -> Sql:
        asked = F.aggregate(F.filter(q, lambda x: _after(x, s)), s["score"], lambda v, _: F.least(F.lit(1.0), v + F.lit(QUESTION_BOOST)))
        return F.aggregate(F.filter(a, lambda x: _inside(x, s)), asked, lambda v, _: F.least(F.lit(1.0), v + F.lit(ANSWER_BOOST)))

    score = each if cumulative else once

    def boost(b: Sql) -> Sql:
        def with_signals(qa: Sql) -> Sql:
            return F.transform(b["spans"], lambda s: changed(s, score=score(s, qa["q"], qa["a"])))

        return F.when(F.coalesce(diarized, False) | (F.size(b["spans"]) == 0), b["spans"]).otherwise(let(F.struct(q=questions(text), a=answers(text)), with_signals))

    return let(F.struct(spans=spans), boost)
