"""Masking of one text in plain Python, rule by rule and decision by decision as the expressions of the other operators do it.

A turn of thirty characters has some ten spans. As expressions of higher-order functions, which Spark interprets node by
node, that takes two to five milliseconds; here it takes a tenth of one. Rules that Python's patterns don't read as Java's do
(see `portable`) stay with the expressions.
"""

from __future__ import annotations

import re
import re._constants as _c
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable
from functools import lru_cache
from operator import itemgetter

from veilwork.config import MaskConfig
from veilwork.functions.normalize import ERA, FILLERS, NARROW, NUMERALS, PLACE_VALUES, VALUES, WIDE
from veilwork.functions.rules import ANSWERS, FLAGS, LEGACY_FLAGS, NUMBER, QUESTIONS, RULES, RUN_START, Rule
from veilwork.functions.vocabulary import CHAINS, NER_SCORE, NER_TAGS, SECURITY_WORDS, SITES, TRIGGERS, VERBS, Entity
from veilwork.functions.vocabulary import NEAR as NEAR_WORDS
from veilwork.operators.bank import ANSWER_BOOST, NEAR, QUESTION_BOOST, QUESTION_WINDOW
from veilwork.operators.resolve import KEYWORD_SCORE, WON_BUMP
from veilwork.operators.scan import BOOST, NER_PLACE, RULE_STEP, WINDOW, needs_digit

#: start, end, seq, entity, score, recognizer, pattern, boost, word; an entity of a masked text has value and token too.
Span = tuple
#: (winner, loser, reason).
Decision = tuple

#: White space as Java's (?U) has it, which Python's \s isn't.
WHITE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_COUNT = re.compile(r"\{\d+(?:,\d*)?\}")
_RUNS = re.compile(r"\d+")
_PAIR = re.compile(r"[A-Z]\d", re.IGNORECASE)


def portable(regex: str) -> str | None:
    """The pattern for Python, or None where it may not read it as Java does with FLAGS."""
    out, i, inside, counted = [], 0, False, False
    while i < len(regex):
        c, was, counted = regex[i], counted, False
        if c == "\\":
            c = regex[i + 1 : i + 2]
            if c == "s" or (c == "S" and not inside):
                out.append(WHITE if inside else f"[{'^' if c == 'S' else ''}{WHITE}]")
            elif c in ("d", "D") or (c and not c.isalnum() and c.isascii()):
                out.append("\\" + c)
            else:
                return None
            i += 2
            continue
        if inside:
            if c == "[" or regex.startswith("&&", i):
                return None
            inside = c != "]"
        elif c == "[":
            inside = True
            if regex.startswith(("[]", "[^]"), i):
                return None
        elif c == "(" and regex.startswith("(?", i) and not regex.startswith(("(?:", "(?=", "(?!", "(?<=", "(?<!"), i):
            return None
        elif c == "{":
            if not (m := _COUNT.match(regex, i)):
                return None
            out.append(m.group())
            i, counted = m.end(), True
            continue
        elif c in "*+?":
            if was and c == "+":
                return None
            counted = not regex.startswith(("(?"), i - 1)
        out.append(c)
        i += 1
    return "".join(out)


def _compiled(regex: str, flags: str = FLAGS) -> re.Pattern | None:
    """None if the pattern isn't portable, or could match nothing at all."""
    text = portable(regex)
    if text is None or flags not in (FLAGS, LEGACY_FLAGS):
        return None
    try:
        if re._parser.parse(text).getwidth()[0] == 0:  # noqa: SLF001
            return None
        if flags != LEGACY_FLAGS:
            return re.compile(text)
        if "[A-Z]" in text:
            # of the signs that Python takes for i, k and s, Java takes these two in a range of capitals
            return re.compile(text.replace("[A-Z]", "[A-Za-z\u0131\u017f]"), re.DOTALL | re.MULTILINE)
        return re.compile(text, re.IGNORECASE | re.DOTALL | re.MULTILINE)
    except (re.error, RecursionError, OverflowError):
        return None


def _finder(rule: Rule) -> Callable[[str], Iterable[re.Match]] | None:
    """All matches of a rule's pattern, or None if it isn't portable."""
    if rule.flags == LEGACY_FLAGS and (rule.name, rule.regex) not in _KNOWN:
        return None
    if not rule.regex.startswith(RUN_START):
        found = _compiled(rule.regex, rule.flags)
        return found.finditer if found else None
    # tried where a run of characters begins, or where the last match ended
    body = rule.regex[len(RUN_START) :]
    here, later = _compiled(body, rule.flags), _compiled(RUN_START.replace(r"\G|", "") + body, rule.flags)
    if here is None or later is None:
        return None

    def find(text: str) -> Iterable[re.Match]:
        at = 0
        while m := here.match(text, at) or later.search(text, at):
            yield m
            at = m.end()

    return find if "@" not in body else lambda text: find(text) if "@" in text else ()


def _digits(tree: list) -> int | None:
    """The least number of digits that a part of a pattern takes, or None if it may take anything else."""
    total = 0
    for op, value in tree:
        if op is _c.IN:
            if not all((o is _c.CATEGORY and v is _c.CATEGORY_DIGIT) or (o is _c.LITERAL and 48 <= v < 58) or (o is _c.RANGE and 48 <= v[0] <= v[1] < 58) for o, v in value):
                return None
            total += 1
        elif op is _c.LITERAL and 48 <= value < 58:
            total += 1
        elif op is _c.MAX_REPEAT and (n := _digits(value[2])) is not None:
            total += value[0] * n
        elif op is _c.BRANCH and None not in (each := [_digits(b) for b in value[1]]):
            total += min(each)
        elif op is _c.SUBPATTERN and (n := _digits(value[3])) is not None:
            total += n
        else:
            return None
    return total


def _needs(found: re.Pattern) -> tuple[int, bool, str]:
    """What each match has: a run of so many digits, a letter before a digit, and these characters."""
    run = most = 0
    pair, letters, chars = False, False, ""
    for op, value in re._parser.parse(found.pattern):  # noqa: SLF001
        n = _digits([(op, value)])
        if n is not None:
            pair |= letters and n > 0
            run += n
            most = max(most, run)
            letters &= n == 0
            run = run if op is not _c.MAX_REPEAT or value[0] == value[1] else 0
            continue
        if op in (_c.ASSERT, _c.ASSERT_NOT):
            continue
        run = 0
        part = value[2] if op is _c.MAX_REPEAT and value[0] > 0 else [(op, value)]
        letters = len(part) == 1 and ((part[0][0] is _c.LITERAL and 65 <= part[0][1] < 91) or (part[0][0] is _c.IN and all(v in ((65, 90), (97, 122), 0x131, 0x17F) for _, v in part[0][1])))
        if op is _c.LITERAL and (not found.flags & re.IGNORECASE or chr(value).lower() == chr(value).upper()):
            chars += chr(value)
    return most, pair, chars


def _all_needs(rule: Rule) -> tuple[int, bool, frozenset[str], frozenset[str]]:
    """What a text must have for a rule to match: see _needs, and one of some characters, if any are given."""
    found = _compiled(rule.regex, rule.flags) if rule.kind == "pattern" else None
    run, pair, chars = _needs(found) if found else (0, False, "")
    known = (rule.name, rule.regex) in _KNOWN
    return run, pair or (known and rule.name == "STAFF_PREFIX"), frozenset(chars), _HINTS.get(rule.name, frozenset()) if known else frozenset()


#: Characters of which a text must have one, for rules of many steps a character, as the profiles have them.
_HINTS = {
    "ADDR_L1_ADMIN": frozenset("路街道巷弄"),
    "ADDR_L2_CHAIN": frozenset(w[0] for w in CHAINS),
    "ADDR_L3_LANDMARK": frozenset(w[0] for w in SITES),
    "ADDR_L3_PROXIMITY": frozenset(w[0] for w in NEAR_WORDS),
    "AMOUNT_TXN_VERB": frozenset(w[0] for w in VERBS),
    "VERIFICATION_TRIGGER": frozenset(w[0] for w in SECURITY_WORDS),
    "EMAIL": frozenset("@"),
    "DOB_SLASH": frozenset("/-"),
}
_KNOWN = {(r.name, r.regex): r for rules in RULES.values() for r in rules}
_ONLY_DIGITS = re.compile(r"\\d\{(\d+)(?:,(\d+))?\}")


def _needle(rule: Rule) -> str:
    """A text that each match of a rule has: the longest run of characters that its pattern gives as they are."""
    found = _compiled(rule.regex, rule.flags)
    best = run = ""
    for op, value in re._parser.parse(found.pattern) if found else ():  # noqa: SLF001
        same = op is _c.LITERAL and (not found.flags & re.IGNORECASE or chr(value).lower() == chr(value).upper())
        run = run + chr(value) if same else ""
        best = max(best, run, key=len)
    return best


def _counted(rule: Rule) -> tuple[int, int] | None:
    """(least, most) digits of a rule whose matches follow from the lengths of a text's runs of digits, if it has no comma."""
    if rule.kind != "pattern" or not rule.words:
        return None
    if rule.regex == NUMBER:
        return 1, sys.maxsize
    m = _ONLY_DIGITS.fullmatch(rule.regex)
    return (int(m[1]), int(m[2] or m[1])) if m else None


def _near_words(words: tuple[str, ...], place: int, text: str, words_of: list) -> list[str]:
    """Those of a rule's words that are in a text; words_of keeps them for other rules with the same list."""
    here = words_of[place]
    if here is None:
        here = words_of[place] = [k for k in words if k in text]
    return here


def _around(text: str, s: int, e: int, here: list[str]) -> str | None:
    """The first of some words that is near a match."""
    around = text[s - WINDOW if s > WINDOW else 0 : e + WINDOW]
    for k in here:
        if k in around:
            return k
    return None


def _scanner(place: int, rule: Rule, list_place: int) -> Callable[[str, list[Span], list], None] | None:
    """Adds the spans of a rule to a list, by a text and its words by list; None if the rule isn't portable."""
    finder, first = _finder(rule), place * RULE_STEP
    if finder is None:
        return None
    entity, score, recognizer, name, words, needed = rule.entity, rule.score, rule.recognizer, rule.name, rule.words, rule.needed
    raised, fixed = min(1.0, score + BOOST), BOOST if rule.note else 0.0

    if rule.kind == "group":
        if _compiled(rule.regex, rule.flags).groups < 2:
            return None

        def group(text: str, out: list[Span], _: list) -> None:
            for i, m in enumerate(finder(text)):
                number = m.group(1) or m.group(2) or ""
                s = m.start() + m.group().find(number)
                out.append((s, s + len(number), first + i, entity, score, recognizer, name, fixed, rule.note))

        return group
    if rule.kind == "after":
        then = _compiled(rule.then, rule.flags)
        if then is None:
            return None

        def after(text: str, out: list[Span], _: list) -> None:
            i = first
            for m in finder(text):
                e = m.end()
                for a in then.finditer(text[e : e + WINDOW]):
                    out.append((e + a.start(), e + a.end(), i, entity, score, recognizer, name, fixed, m.group()))
                    i += 1

        return after
    if not words:

        def plain(text: str, out: list[Span], _: list) -> None:
            for i, m in enumerate(finder(text)):
                out.append((m.start(), m.end(), first + i, entity, score, recognizer, name, fixed, None))

        return plain

    def near(text: str, out: list[Span], words_of: list) -> None:
        i = first
        for m in finder(text):
            s, e = m.span()
            here = words_of[list_place]
            if here is None:
                here = _near_words(words, list_place, text, words_of)
            word = None
            if here:
                word = here[0] if len(text) <= WINDOW else _around(text, s, e, here)
            if word is not None:
                out.append((s, e, i, entity, raised, recognizer, name, BOOST, word))
            elif not needed:
                out.append((s, e, i, entity, score, recognizer, name, 0.0, None))
            elif not here:
                return
            i += 1

    return near


# normalisation

_TO_NARROW = str.maketrans(WIDE, NARROW)
_TO_VALUES = str.maketrans(NUMERALS, VALUES)
_UNITS = "".join(PLACE_VALUES)
_PLACED = re.compile(f"(?<![{NUMERALS}{_UNITS}])[{NUMERALS}{_UNITS}]*[{_UNITS}][{NUMERALS}{_UNITS}]*")
_SINGLE = re.compile(f"[{NUMERALS}](?=[月日號點])")
_RUN = re.compile(f"[{NUMERALS}]{{2,}}")
_YEAR = re.compile(portable(r"民(?:國|国)?\s*([0-9]{2,3})\s*年"))
_FILLER = re.compile(rf"([{FILLERS}])\1{{2,}}")
_LINES = re.compile("\r\n|\n|\t")
_SPACES = re.compile(f"[{WHITE}]{{2,}}")
_WIDE_SIGNS, _UNIT_SIGNS, _NUMERAL_SIGNS, _FILLER_SIGNS, _WHITE_SIGNS = map(frozenset, (WIDE, _UNITS, NUMERALS, FILLERS, WHITE))


def _place_value(m: re.Match) -> str:
    total = now = 0
    for i, c in enumerate(m.group()):
        unit = PLACE_VALUES.get(c)
        if unit is None:
            now = int(c.translate(_TO_VALUES))
        else:
            total += (1 if c == "十" and i == 0 else now) * unit
            now = 0
    return str(total + now) if total + now > 0 else m.group()


def _values(m: re.Match) -> str:
    return m.group().translate(_TO_VALUES)


def _ce_year(m: re.Match) -> str:
    year = int(m.group(1))
    return f"{year + ERA}年" if 10 <= year <= 150 else m.group()


def normalized(text: str, nfc: bool = True) -> str:
    """A text after composed() and normalize()."""
    if nfc and not text.isascii():
        text = unicodedata.normalize("NFC", text)
    # each step only where the text has what it changes; none makes what a later one changes but spaces of wide spaces
    have = set(text)
    if not _WIDE_SIGNS.isdisjoint(have):
        text = text.translate(_TO_NARROW)
    if not _UNIT_SIGNS.isdisjoint(have):
        text = _PLACED.sub(_place_value, text)
    if not _NUMERAL_SIGNS.isdisjoint(have):
        text = _RUN.sub(_values, _SINGLE.sub(_values, text))
    if "民" in have:
        text = _YEAR.sub(_ce_year, text)
    if not _FILLER_SIGNS.isdisjoint(have):
        text = _FILLER.sub(r"\1\1", text)
    return text if _WHITE_SIGNS.isdisjoint(have) else _SPACES.sub(" ", _LINES.sub(" ", text)).strip(WHITE)


def blank(text: str | None) -> bool:
    return text is None or not text.strip(WHITE)


# the bank's rules

_QUESTIONS = re.compile(QUESTIONS)
#: How each of QUESTIONS begins.
ASKED = ("請問您", "可以", "需要", "確認一下您的", "報一下您的", "幫我")
_ANSWERS = [re.compile(portable(p)) for p in ANSWERS]
_TOLD = ("是", "我的", "對")


def conditional_amount(spans: list[Span]) -> list[Span]:
    starts, amounts = set(), False
    for s in spans:
        if s[3] == "AMOUNT":
            amounts = True
        elif s[3] in TRIGGERS:
            starts.add(s[0])
    if not amounts:
        return spans
    if not starts:
        return [s for s in spans if s[3] != "AMOUNT"]
    starts = sorted(starts)
    return [s for s in spans if s[3] != "AMOUNT" or _near(starts, s[0])]


def _near(starts: list[int], at: int) -> bool:
    i = bisect_left(starts, at - NEAR)
    return i < len(starts) and starts[i] <= at + NEAR


def speaker_boost(text: str, spans: list[Span], cumulative: bool = False) -> list[Span]:
    if not spans:
        return spans
    asked = []
    for k in ASKED:
        if k in text:
            asked = [m.end() for m in _QUESTIONS.finditer(text)]
            break
    said = [m.span() for p, k in zip(_ANSWERS[:3], _TOLD) if k in text for m in p.finditer(text)]
    if text[:1].isdigit():
        said += [m.span() for m in _ANSWERS[3].finditer(text)]
    # the last is of Han characters alone, so a span inside it begins with one
    for s in spans:
        if "一" <= text[s[0] : s[0] + 1] <= "鿿":
            said += [m.span() for m in _ANSWERS[4].finditer(text)]
            break
    if not asked and not said:
        return spans
    out = []
    for s in spans:
        at, score = s[0], s[4]
        nq = [e for e in asked if e <= at <= e + QUESTION_WINDOW] if asked else asked
        na = [a for a in said if a[0] <= at < a[1]]
        if nq or na:
            if cumulative:
                for _ in nq:
                    score = min(1.0, score + QUESTION_BOOST)
                for _ in na:
                    score = min(1.0, score + ANSWER_BOOST)
            else:
                score = min(1.0, score + ((QUESTION_BOOST if nq else 0.0) + (ANSWER_BOOST if na else 0.0)))
            s = (*s[:4], score, *s[5:])
        out.append(s)
    return out


# second sources, duplicates, conflicts


def ner_spans(hits: list[dict] | None) -> list[Span]:
    known = [h for h in hits or () if h is not None and h["tag"] in NER_TAGS]
    return [(h["start"], h["end"], NER_PLACE * RULE_STEP + i, NER_TAGS[h["tag"]], NER_SCORE, "NerHits", "NER_" + h["tag"], 0.0, None) for i, h in enumerate(known)]


def _key(s: Span) -> tuple:
    return s[0], s[1], s[3]


def merged(first: list[Span], second: list[Span]) -> list[Span]:
    seen = {_key(s) for s in first}
    return first + [s for s in second if _key(s) not in seen]


def without_duplicates(spans: list[Span]) -> list[Span]:
    return distinct(spans)[0]


def duplicate_log(spans: list[Span]) -> list[Decision]:
    return distinct(spans)[1]


def distinct(spans: list[Span]) -> tuple[list[Span], list[Decision]]:
    """without_duplicates and duplicate_log of spans in the order of seq."""
    best: dict[tuple, Span] = {}
    firsts: dict[tuple, int] = {}
    log = []
    for s in spans:
        key = (s[0], s[1], s[3])
        held = best.get(key)
        if held is None:
            best[key] = s
            firsts[key] = s[2]
            continue
        wins = s[4] > held[4]
        log.append((s if wins else held, held if wins else s, "EXACT_DUP:first_wins" if s[4] == held[4] else "EXACT_DUP:higher_score_wins"))
        if wins:
            best[key] = s
    if not log:
        return spans, log
    return [s if s[2] == firsts[key] else (s[0], s[1], firsts[key], *s[3:]) for key, s in best.items()], log


def ranked(spans: list[Span], legacy: bool, types: dict[str, Entity]) -> list[tuple]:
    """(start, -length, -priority, seq, place, risk, span) in the order in which they are decided."""
    out = []
    for i, s in enumerate(spans):
        kind = types.get(s[3])
        r, p = (kind.risk, kind.priority) if kind else (0, 0)
        score = s[4]
        if legacy:
            prio = p * 0.4 + (r * 10) * 0.4 + score * 10 * 0.1 + (10.0 if score > KEYWORD_SCORE else 0.0) * 0.1
        else:
            prio = float(r * 20) + p * 0.1 + score * 5.0 + (2.0 if s[7] > 0 or s[8] or score >= KEYWORD_SCORE else 0.0)
        out.append((s[0], s[0] - s[1], -prio, s[2], i, r, s))
    out.sort()
    return out


def _wins(a: tuple, b: tuple) -> bool:
    """Whether a wins over b, which came before it and overlaps it."""
    x, y = a[6], b[6]
    if a[1] < b[1]:
        if x[0] <= y[0] and x[1] >= y[1]:
            return True
    elif b[1] < a[1] and y[0] <= x[0] and y[1] >= x[1]:
        return False
    if a[5] != b[5]:
        return a[5] > b[5]
    return a[1] < b[1] if a[1] != b[1] else a[2] <= b[2]


def _reason(a: tuple, b: tuple) -> str:
    """Why one of two spans wins over the other."""
    x, y, ra, rb, la, lb = a[6], b[6], a[5], b[5], -a[1], -b[1]
    if (la > lb and x[0] <= y[0] and x[1] >= y[1]) or (lb > la and y[0] <= x[0] and y[1] >= x[1]):
        return "CONTAINS:longer_wins"
    if ra != rb:
        reason = f"RISK_LEVEL:{max(ra, rb)}>{min(ra, rb)}"
    elif la != lb:
        reason = f"SPAN_LENGTH:{max(la, lb)}>{min(la, lb)}"
    else:
        reason = f"PRIORITY_SCORE:{max(-a[2], -b[2]):.1f}>={min(-a[2], -b[2]):.1f}"
    return f"CROSS_TYPE_SAME_SPAN:{reason}" if x[:2] == y[:2] and x[3] != y[3] else reason


def resolved(spans: list[Span], legacy: bool, types: dict[str, Entity], reasons: bool = True) -> tuple[list[Span], list[Decision]]:
    """The spans that are left, disjoint and in order, and the log of all decisions; without reasons, those between spans of
    different places or types have none."""
    if not spans:
        return spans, []
    log: list[Decision] = []
    if not legacy:
        spans, log = distinct(spans)
    done, last, won, n = [], None, False, 0

    def keep() -> None:
        s = last[6]
        done.append((*s[:4], min(1.0, s[4] + WON_BUMP), *s[5:]) if legacy and won else s)

    for cur in ranked(spans, legacy, types):
        if last is None or last[6][1] <= cur[0]:
            if last is not None:
                keep()
            last, won = cur, False
            continue
        wins = _wins(cur, last)
        n += 1
        winner, loser = (cur, last) if wins else (last, cur)
        reason = None
        if reasons:
            reason = _reason(cur, last) if legacy else f"[R{n}] {_reason(cur, last)}"
        log.append((winner[6], loser[6], reason))
        if wins:
            last, won = cur, True
    keep()
    return done, log


def settled(spans: list[Span], ranks: dict[str, tuple[int, float]]) -> tuple[list[Span], int]:
    """The spans that resolved() leaves, of all profiles but legacy, and how many decisions it takes; ranks has each type's risk
    and what that and its priority count for."""
    best: dict[tuple, Span] = {}
    n = 0
    for s in spans:
        key = (s[0], s[1], s[3])
        held = best.get(key)
        if held is None:
            best[key] = s
        else:
            n += 1
            if s[4] > held[4]:
                best[key] = (s[0], s[1], held[2], *s[3:])
    if len(best) < 2:
        return list(best.values()), n
    order = []
    for i, s in enumerate(best.values()):
        risk, counts = ranks.get(s[3], _UNRANKED)
        score = s[4]
        order.append((s[0], s[0] - s[1], -(counts + score * 5.0 + (2.0 if s[7] > 0 or s[8] or score >= KEYWORD_SCORE else 0.0)), s[2], i, risk, s))
    order.sort()
    done, last = [], order[0]
    end = last[6][1]
    for cur in order[1:]:
        if end <= cur[0]:
            done.append(last[6])
        else:
            n += 1
            if not _wins(cur, last):
                continue
        last = cur
        end = cur[6][1]
    done.append(last[6])
    return done, n


#: Risk, and what it counts for, of a type that isn't known.
_UNRANKED = (0, 0.0)


# tokens


def numbered_token(token: str, number: int) -> str:
    return f"{token[:-1]}_{number}]" if token.endswith("]") else f"{token}_{number}"


def replaced(text: str, entities: list[Span]) -> str:
    if not entities:
        return text
    out, at = [], 0
    for s in entities:
        out += text[at : s[0]], s[10]
        at = s[1]
    out.append(text[at:])
    return "".join(out)


_MOST = 16
#: How many choices of rules and places of digits are kept.
_KEPT = 2_000
_SEQ = itemgetter(2)


class Masker:
    """The steps of one configuration, with its patterns compiled."""

    def __init__(self, config: MaskConfig) -> None:
        self.config, self.legacy, self.lean = config, config.legacy, config.lean
        self.types, self.numbered = config.all_types, frozenset() if config.lean else config.all_numbered
        self.tokens = {e.name: e.token for e in self.types.values()}
        self.ranks = {e.name: (e.risk, float(e.risk * 20) + e.priority * 0.1) for e in self.types.values()}
        rules = sorted(config.all_rules, key=lambda p: p[0])
        self.lists = list(dict.fromkeys(r.words for _, r in rules))
        made = [(_scanner(i, r, self.lists.index(r.words)), r) for i, r in rules]
        self.portable = all(s for s, _ in made)
        #: (scanner, needs a digit, longest run of digits, whether a letter is before a digit, all characters that a text must
        #: have, those of which it must have one, if any, a text that it must have), and those of the rules that count digits
        self.needs, self.counted = [], []
        if self.portable:
            for (i, r), (s, _) in zip(rules, made):
                run, pair, chars, some = _all_needs(r)
                if count := _counted(r):
                    self.counted.append((self.lists.index(r.words), r.needed, r.entity, r.score, min(1.0, r.score + BOOST), r.recognizer, r.name, r.regex == NUMBER, i * RULE_STEP, *count))
                    if r.regex != NUMBER:
                        continue
                    some = frozenset(",")
                self.needs.append((s, needs_digit(r), min(run, _MOST), pair, chars, some, _needle(r) if r.kind == "pattern" else ""))
        self.signs = frozenset().union(*[n[4] | n[5] for n in self.needs])
        self.chosen: dict[tuple, list] = {}
        self.naming = {s for s, r in made if r.entity in self.numbered}
        self.risks = {e.name: e.risk for e in self.types.values()}
        self.plans: dict[tuple, list] = {}

    def _choose(self, key: tuple[int, bool, frozenset[str]]) -> list[tuple[Callable, str]]:
        """(scanner, text that it needs) for texts with such a run of digits, a letter before one, and such of the signs."""
        run, pair, have = key
        found = [(s, needle) for s, digit, n, p, chars, some, needle in self.needs if (run or not digit) and n <= run and (pair or not p) and chars <= have and (not some or not some.isdisjoint(have))]
        if len(self.chosen) < _KEPT:
            self.chosen[key] = found
        return found

    def _plan(self, lengths: tuple[int, ...], comma: bool) -> list[tuple]:
        """(..., places) of each rule that counts digits; a place is (run, start in it, end in it, seq)."""
        plan = []
        for words, needed, entity, score, raised, recognizer, name, number, seq, least, most in self.counted:
            if comma and number:
                continue
            places = []
            for k, n in enumerate(lengths):
                at = 0
                while n - at >= least:
                    end = min(at + most, n)
                    places.append((k, at, end, seq))
                    at, seq = end, seq + 1
            if places:
                plan.append((words, needed, entity, score, raised, recognizer, name, places))
        if len(self.plans) < _KEPT and len(lengths) < 9 and sum(lengths) < 100:
            self.plans[lengths, comma] = plan
        return plan

    def normal(self, text: str) -> str:
        """The text as it is scanned."""
        return text if self.lean or blank(text) else normalized(text, self.config.nfc)

    def detected(self, text: str, ner: list[dict] | None = None, if_numbered: bool = False) -> list[Span]:
        """All spans before any rule of the bank; with if_numbered, none where no rule finds one of a numbered type."""
        out: list[Span] = []
        runs = [m.span() for m in _RUNS.finditer(text)]
        lengths = tuple([e - s for s, e in runs])
        words_of: list[list[str] | None] = [None] * len(self.lists)
        have = self.signs.intersection(text)
        if runs:
            short, comma = len(text) <= WINDOW, "," in text
            plan = self.plans.get((lengths, comma))
            for place, needed, entity, score, raised, recognizer, name, places in self._plan(lengths, comma) if plan is None else plan:
                here = words_of[place]
                if here is None:
                    here = _near_words(self.lists[place], place, text, words_of)
                if not here:
                    if not needed:
                        for k, a, b, seq in places:
                            s = runs[k][0]
                            out.append((s + a, s + b, seq, entity, score, recognizer, name, 0.0, None))
                    continue
                for k, a, b, seq in places:
                    s = runs[k][0]
                    word = here[0] if short else _around(text, s + a, s + b, here)
                    if word is not None:
                        out.append((s + a, s + b, seq, entity, raised, recognizer, name, BOOST, word))
                    elif not needed:
                        out.append((s + a, s + b, seq, entity, score, recognizer, name, 0.0, None))
        n = len(out)
        key = (min(max(lengths), _MOST) if runs else 0, bool(runs and _PAIR.search(text)), have)
        chosen = self.chosen.get(key)
        if chosen is None:
            chosen = self._choose(key)
        if if_numbered and not ner and not self._any_numbered(out):
            some: list[Span] = []
            for scan, needle in chosen:
                if scan in self.naming and needle in text:
                    scan(text, some, words_of)
            if not some:
                return []
        for scan, needle in chosen:
            if needle in text:
                scan(text, out, words_of)
        if n and len(out) > n:
            out.sort(key=_SEQ)
        if ner:
            out += ner_spans(ner)
            if self.config.entities is not None:
                out = [s for s in out if s[3] in self.config.entities]
        return [s for s in out if s[4] >= self.config.threshold] if self.legacy else out

    def proposed(self, text: str, diarized: bool = False, ner: list[dict] | None = None, llm: list[dict] | None = None) -> list[Span]:
        """Spans after the bank's rules, with those of a second source; text is normal()."""
        return self._banked(text, [] if blank(text) else self.detected(text, ner), diarized, llm)

    def _banked(self, text: str, spans: list[Span], diarized: bool, llm: list[dict] | None) -> list[Span]:
        if spans and not self.lean:
            spans = conditional_amount(spans)
            if not diarized:
                spans = speaker_boost(text, spans, self.legacy)
        return merged(spans, ner_spans(llm)) if llm else spans

    def _entities(self, text: str, spans: list[Span]) -> list[Span]:
        tokens = self.tokens
        return [(*s, text[s[0] : s[1]], tokens.get(s[3]) or f"[{s[3]}]") for s in spans]

    def kept(self, text: str, diarized: bool = False, ner: list[dict] | None = None, llm: list[dict] | None = None) -> tuple[list[Span], int]:
        """The entities of decided(), and the number of conflicts."""
        spans, n = self._settled(self.proposed(text, diarized, ner, llm))
        return self._entities(text, spans), n

    def _settled(self, spans: list[Span]) -> tuple[list[Span], int]:
        if self.legacy:
            spans, log = resolved(spans, True, self.types, False)
            return spans, len(log)
        return settled(spans, self.ranks)

    def _any_numbered(self, spans: list[Span]) -> bool:
        for s in spans:
            if s[3] in self.numbered:
                return True
        return False

    def _any_to_number(self, spans: list[Span]) -> bool:
        """Whether a numbered span may be left: not where one of the same place has a higher risk, since no other conflict tells
        spans of one place apart. The bank's rules take away none but amounts."""
        places, risks, most = [], self.risks, {}
        for s in spans:
            kind = s[3]
            if kind in self.numbered:
                if s[0] >= s[1]:
                    return True
                places.append((s[0], s[1], risks.get(kind, 0)))
            elif kind != "AMOUNT" and s[0] < s[1]:
                place, risk = s[:2], risks.get(kind, 0)
                if risk > most.get(place, -1):
                    most[place] = risk
        for start, end, risk in places:
            if risk >= most.get((start, end), risk):
                return True
        return False

    def kept_numbered(self, text: str, diarized: bool = False, ner: list[dict] | None = None, llm: list[dict] | None = None) -> list[Span]:
        """The entities of kept() that are numbered. Neither the bank's rules nor conflicts make one where none is detected."""
        spans = [] if blank(text) else self.detected(text, ner, not llm)
        if not llm and not self._any_to_number(spans):
            return []
        return self._entities(text, [s for s in self._settled(self._banked(text, spans, diarized, llm))[0] if s[3] in self.numbered])

    def decided(self, text: str, diarized: bool = False, ner: list[dict] | None = None, llm: list[dict] | None = None, reasons: bool = True) -> tuple[list[Span], list[Decision]]:
        """Entities with their types' tokens, and the conflicts decided; text is normal()."""
        kept, log = resolved(self.proposed(text, diarized, ner, llm), self.legacy, self.types, reasons)
        return self._entities(text, kept), log

    def with_numbers(self, entities: list[Span], seen: dict[str, dict[str, int]]) -> list[Span]:
        """Entities with numbered tokens; seen has the numbers that values of each type have so far, and gets new ones."""
        out = []
        for s in entities:
            if s[3] in self.numbered:
                values = seen.setdefault(s[3], {})
                s = (*s[:10], numbered_token(s[10], values.setdefault(s[9], len(values) + 1)))
            out.append(s)
        return out

    def new_pairs(self, entities: list[Span], seen: dict[str, dict[str, int]]) -> list[tuple[str, str, str]]:
        """(type, token, value) of the numbered entities that seen hasn't, and gets."""
        out = []
        for s in entities:
            if s[3] in self.numbered:
                values = seen.setdefault(s[3], {})
                if s[9] not in values:
                    values[s[9]] = len(values) + 1
                    out.append((s[3], numbered_token(s[10], values[s[9]]), s[9]))
        return out


@lru_cache(64)
def masker(config: MaskConfig) -> Masker:
    return Masker(config)
