"""Personal data and secrets: regular expressions propose, checksums confirm, context adjusts."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.tokens import chunks

WINDOW = 40
LEAST_SCORE = 0.5
CONTEXT = 0.2


def luhn(text: str) -> bool:
    """Luhn's check of a card number; other characters than digits are left out."""
    digits = [int(c) for c in text if c in "0123456789"][::-1]
    return len(digits) > 1 and len(set(digits)) > 1 and (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


#: Letters as the numbers from 10 on; spaces go.
_NUMBERS = str.maketrans({c: str(int(c, 36)) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {" ": None})


def mod97(text: str) -> bool:
    """ISO 7064 check of an account number with country and check digits first."""
    length = len(text) - text.count(" ")
    return 15 <= length <= 34 and int((text[4:] + text[:4]).upper().translate(_NUMBERS)) % 97 == 1


#: Characters of an account number by country.
ACCOUNT_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def account_lengths(text: str) -> list[int]:
    """Where an account number may end, as a following word may look like one more group: at each space and at the end of
    the text; at the country's length first, then the longest."""
    ends = [i for i, c in enumerate(text) if c == " "] + [len(text)]
    return sorted(ends, key=lambda n: (n - text.count(" ", 0, n) != ACCOUNT_LENGTHS.get(text[:2]), -n))


def octets(text: str) -> bool:
    return all(int(x) < 256 and (x == "0" or x[0] != "0") for x in text.split("."))


def social(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Rule:
    """A kind of span: `pattern` proposes it (its last group, if it has one), `valid` confirms it, at the first of `lengths`
    that it can, and a word of `context` within WINDOW characters adds CONTEXT to `score`, up to 1."""

    kind: str
    pattern: re.Pattern[str]
    score: float
    valid: Callable[[str], bool] | None = None
    context: tuple[str, ...] = ()
    needs: str = ""
    lengths: Callable[[str], list[int]] | None = None


RULES = (
    Rule("EMAIL", re.compile(r"(?<![\w.%+-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}", re.A), 0.8, context=("mail", "contact", "correo", "courriel"), needs="@"),
    Rule("IBAN", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.A), 0.7, mod97, ("iban", "account", "konto", "compte", "cuenta", "bank"), lengths=account_lengths),
    Rule("CREDIT_CARD", re.compile(r"(?<![\d.+-])[2-6]\d{3}(?:([ -]?)\d{4}\1\d{4}\1\d{1,7}|[ -]?\d{6}[ -]?\d{4,5})(?![\d])", re.A), 0.7, luhn, ("card", "visa", "credit", "carte", "karte", "tarjeta")),
    Rule("PHONE", re.compile(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\)[ ]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])", re.A), 0.6, context=("phone", "call", "tel", "mobile", "fax")),
    Rule("IP_ADDRESS", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", re.A), 0.6, octets, ("ip", "host", "server", "address")),
    Rule("SSN", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A), 0.5, social, ("ssn", "social", "security")),
    Rule("ACCESS_KEY", re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", re.A), 0.9, context=("key", "secret", "access"), needs="IA"),
    Rule("SECRET", re.compile(r"(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key)[ ]?[=:][ ]?[\"']?([^\s\"']{6,})", re.A | re.I), 0.8),
)
#: Texts without any of these have no span of any rule.
HINT = r"[0-9@]|AKIA|ASIA|(?i:password|passwd|pwd|secret|token|api[_-]?key)"


def free(spans: list[tuple[int, ...]], a: int, b: int) -> bool:
    """Whether [a, b) meets none of the disjoint spans, which are in order."""
    k = bisect_left(spans, (a,))
    return (k == len(spans) or b <= spans[k][0]) and (not k or spans[k - 1][1] <= a)


def confirmed(rule: Rule, text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Places of a rule's spans that don't meet those taken. What isn't confirmed takes no characters: the next proposal may
    begin inside it."""
    at, group = 0, 1 if rule.kind == "SECRET" else 0
    while m := rule.pattern.search(text, at):
        a, b = m.span(group)
        for n in rule.lengths(text[a:b]) if rule.lengths else [b - a]:
            if (not rule.valid or rule.valid(text[a : a + n])) and free(taken, a, a + n):
                yield a, a + n
                at = a + n if group == 0 else m.end()
                break
        else:
            at = m.start() + 1


def find(text: str) -> list[tuple[int, int, str, float]]:
    """Spans (start, end, kind, score) of a text, disjoint and in order; of spans that overlap, the best score stays, then
    the longest, then the first, then the rule that comes first."""
    found, accounts = [], []
    for i, rule in enumerate(RULES):
        if rule.needs and rule.needs not in text:
            continue
        for a, b in confirmed(rule, text, accounts if rule.kind == "CREDIT_CARD" else []):
            if rule.kind == "IBAN":
                accounts.append((a, b))  # their digits are no card's
            score = rule.score
            if rule.context:
                around = text[max(0, a - WINDOW) : a].lower() + " " + text[b : b + WINDOW].lower()
                if any(re.search(rf"(?<![^\W\d_]){w}", around) for w in rule.context):
                    score = min(1.0, round(score + CONTEXT, 6))
            if score >= LEAST_SCORE:
                found.append((-score, a - b, a, i, b, rule.kind))
    kept: list[tuple[int, int, str, float]] = []
    for score, _, a, _, b, kind in sorted(found):
        if free(kept, a, b):
            kept.insert(bisect_left(kept, (a,)), (a, b, kind, -score))
    return kept


def hinted(texts: pa.Array) -> list[int]:
    """Rows in which there can be a span."""
    return pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, HINT), False)).to_pylist()


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, score) of each span; start and end are in characters, end is exclusive.

    Whole texts are searched. Null and empty texts have no spans. Rows without doc_id give spans without doc_id; repeated
    rows give their spans each time. An empty table gives an empty result. Columns other than doc_id and text are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = []
            for i in hinted(batch.column("text")):
                spans = find(batch.column("text")[i].as_py())
                doc = batch.column("doc_id")[i].as_py() if spans else None
                rows += [(doc, kind, a, b, score) for a, b, kind, score in spans]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()))], ["doc_id", "kind", "start", "end", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, kind string, start int, end int, score double")


def mask(text: str) -> str:
    out, at = [], 0
    for a, b, kind, _ in find(text):
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def without_pii(docs: DataFrame) -> DataFrame:
    """docs with each span of find_pii replaced by its kind in brackets; all rows and columns stay.

    n_chars of a text that changes is counted again where docs has that column. Null texts stay null and empty ones empty;
    rows without doc_id and repeated rows are masked like others. Time is in proportion to a text's length. An empty table
    gives an empty result.
    """
    names = docs.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            i = names.index("text")
            texts = batch.column(i)
            changed = {k: new for k in hinted(texts) if (new := mask(old := texts[k].as_py())) != old}
            if changed:
                columns = list(batch.columns)
                values = texts.to_pylist()
                for k, new in changed.items():
                    values[k] = new
                columns[i] = pa.array(values, texts.type)
                if "n_chars" in names:
                    j = names.index("n_chars")
                    hit = pa.array([k in changed for k in range(batch.num_rows)])
                    columns[j] = pc.if_else(hit, pc.utf8_length(columns[i]).cast(columns[j].type), columns[j])
                batch = pa.RecordBatch.from_arrays(columns, names)
            yield batch

    return docs.mapInArrow(rewrite, docs.schema)
