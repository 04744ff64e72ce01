"""Normalisation of speech-to-text: widths, Chinese numerals, years, fillers, white space."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import coalesce, pandas_udf, when
from pyspark.sql.types import StringType

from veilwork.functions import sql as F
from veilwork.functions.columns import map_matches
from veilwork.functions.sql import Sql, let

WIDE = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
NARROW = " " + "".join(chr(c) for c in range(0x21, 0x7F))
NUMERALS = "零〇一壹二貳三參四肆五伍六陸七柒八捌九玖"
VALUES = "00112233445566778899"
PLACE_VALUES = {"十": 10, "百": 100, "千": 1000}
FILLERS = "啊喔嗯欸哦呢吧吼哈呀哎唉那"
ERA = 1911
#: Texts of these characters alone are in composed form already.
COMPOSED = r"^[\x00-˿‐-‧‰-⁞、-゘゛-ヿㄅ-ㄯ㐀-䶿一-鿿가-힣＀-￯\x{1f000}-\x{1faff}]*$"


@pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """NFC. Only texts that may change go to Python."""
    return coalesce(_nfc(when(~text.rlike(COMPOSED), text)), text)


def narrow(text: Sql) -> Sql:
    """Full-width forms of ASCII, and the ideographic space, become ASCII."""
    return F.translate(text, WIDE, NARROW)


def place_value(number: Sql) -> Sql:
    """A numeral with 十, 百 or 千 in digits; a digit replaces one before it, and 0 in all leaves it as it is."""
    start = F.struct(total=0, now=0, first=True)

    def step(s: Sql, c: Sql) -> Sql:
        unit = F.choose(c, PLACE_VALUES)
        digit = F.translate(c, NUMERALS, VALUES).try_cast("int")
        now = F.when((c == "十") & s["first"] & (s["now"] == 0), 1).otherwise(s["now"])
        return F.struct(total=s["total"] + F.when(unit.isNull(), 0).otherwise(now * unit), now=F.coalesce(digit, 0), first=False)

    total = F.aggregate(F.split(number, ""), start, step, lambda s: s["total"] + s["now"])
    return let(total, lambda t: F.when(t > 0, t.cast("string")).otherwise(number))


def zh_numbers(text: Sql) -> Sql:
    """Numerals with place values, then single ones before 月 日 號 點, then runs of two or more, digit by digit."""
    every = f"[{NUMERALS}{''.join(PLACE_VALUES)}]*"
    text = map_matches(text, f"(?<!{every[:-1]}){every}[{''.join(PLACE_VALUES)}]{every}", place_value)
    plain = lambda m: F.translate(m, NUMERALS, VALUES)
    text = map_matches(text, f"[{NUMERALS}](?=[月日號點])", plain)
    return map_matches(text, f"[{NUMERALS}]{{2,}}", plain)


def ce_years(text: Sql) -> Sql:
    """Years 10 to 150 of the Republic become years of the common era."""
    year = r"(?U)民(?:國|国)?\s*([0-9]{2,3})\s*年"

    def change(m: Sql) -> Sql:
        y = F.regexp_extract(m, year, 1).cast("int")
        return F.when((y >= 10) & (y <= 150), F.concat((y + ERA).cast("string"), "年")).otherwise(m)

    return map_matches(text, year, change)


def squeezed(text: Sql) -> Sql:
    """Three or more of one filler become two."""
    return F.regexp_replace(text, rf"([{FILLERS}])\1{{2,}}", "$1$1")


def spaced(text: Sql) -> Sql:
    """Line ends and tabs become spaces, runs of white space one, and none is left at the ends."""
    text = F.regexp_replace(text, "\r\n|\n|\t", " ")
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s{2,}", " "), r"(?U)^\s+|\s+$", "")


def normalize(text: Sql) -> Sql:
    """All steps after composed(), in order; null stays null and the empty text empty."""
    return spaced(squeezed(ce_years(zh_numbers(narrow(text)))))
