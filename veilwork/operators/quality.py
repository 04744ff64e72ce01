"""How usable a masked turn is, and whether its call has speakers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as C
from pyspark.sql import Window as W

from veilwork.config import MaskConfig
from veilwork.functions import sql as F
from veilwork.functions.rules import FLAGS, QUESTIONS
from veilwork.functions.sql import Sql
from veilwork.operators.plain import ASKED, WHITE

AGENT, CUSTOMER = "AGENT", "CUSTOMER"
USABLE, DEGRADED, NO_SPEAKERS, FALLBACK, LOW_AUDIO = "USABLE", "DEGRADED_MASKING", "NO_DIARIZATION", "FALLBACK_MODE", "LOW_AUDIO_QUALITY"


def blank(text: Sql) -> Sql:
    # the pattern is tried only where a text has nothing but what it takes for white space
    return text.isNull() | ((F.call("ltrim", WHITE, text) == "") & ~text.rlike(r"(?U)\S"))


def known_speaker(speaker: Column) -> Column:
    """1 for an agent or a customer, else 0."""
    return C.coalesce(speaker.isin(AGENT, CUSTOMER), C.lit(False)).cast("double")


def labelled_ratio(speaker: Column) -> Column:
    """Share of a session's turns whose speaker is known, as a window over session_id."""
    return C.avg(known_speaker(speaker)).over(W.partitionBy("session_id"))


def density(n_entities: Sql, text: Sql) -> Sql:
    """Entities for each hundred characters."""
    return n_entities / F.greatest(F.length(text), 1) * 100


def usability(text: Sql, n_entities: Sql, diarized: Sql, asr: Sql, config: MaskConfig) -> Sql:
    """The first that holds: poor audio, no speakers (with or without a question to go by), dense masking, usable."""
    asked = reduce(or_, [text.contains(k) for k in ASKED])
    unknown = F.when(asked & text.rlike(FLAGS + QUESTIONS), FALLBACK).otherwise(NO_SPEAKERS)
    return F.when(asr < config.least_asr, LOW_AUDIO).when(~diarized, unknown).when(density(n_entities, text) > config.most_density, DEGRADED).otherwise(USABLE)
