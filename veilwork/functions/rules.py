"""Patterns that propose spans, in the order in which their spans rank.

Patterns are written so that Java (with FLAGS) and RE2 read them alike; a rule that RE2 can't read has its own `re2`.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from veilwork.functions.vocabulary import CHAINS, NEAR, PLACES, SECURITY_WORDS, SITES, VERBS, WORDS

#: Unicode classes, and a dot that leaves out the line feed alone.
FLAGS = "(?Ud)"
LEGACY_FLAGS = "(?Udism)"
HAN = "[一-鿿]"
LEAN, FULL, LEGACY = PROFILES = ("lean", "full", "legacy")


def digits(least: int, most: int | None = None) -> str:
    return r"\d{%s}" % (least if most is None else f"{least},{most}")


def capitals(least: int, most: int | None = None) -> str:
    return "[A-Z]" if least == most == 1 else "[A-Z]{%s}" % (least if most is None else f"{least},{most}")


def any_of(words: tuple[str, ...]) -> str:
    return f"(?:{'|'.join(words)})"


NUMBER = rf"\d+(?:,{digits(3)})*"
#: Where a long run of characters can't be matched, a pattern is tried at its beginning only (or where a match ended), so that
#: the time stays in proportion to the text; no match begins inside such a run that wouldn't at its beginning.
_LOCAL = "[0-9A-Za-z%+._-]"
RUN_START = rf"(?:\G|(?<!{_LOCAL}))"
_MONTH = "(?:0[1-9]|1[0-2])"


@dataclass(frozen=True)
class Rule:
    """A pattern of an entity type.

    kind: "pattern" takes the match; "group" the first group that isn't empty, "after" all matches of `then` in the
    `window` characters after each match. words raise the score by BOOST where one is near; with `needed`, a match without
    any is dropped. note: the word that is reported where the score isn't raised (X for the match itself).
    """

    entity: str
    name: str
    regex: str
    score: float
    words: tuple[str, ...] = ()
    needed: bool = False
    kind: str = "pattern"
    recognizer: str = "PatternRule"
    re2: str = ""
    then: str = ""
    note: str = ""
    flags: str = FLAGS

    @property
    def java(self) -> str:
        return self.flags + self.regex


def _patterns() -> list[Rule]:
    w = WORDS
    amount = w["amount"]
    verbs = any_of(VERBS)
    money = rf"({NUMBER}(?:元|塊|NTD|NT)?)"
    mail = rf"{_LOCAL}+@[0-9A-Za-z.-]+[.][A-Za-z]{{2,}}"
    street = f"(?:{HAN}?段)?" + "".join(f"(?:{digits(1, n)}{unit})?" for n, unit in ((4, "巷"), (4, "弄"), (4, "號"), (3, "樓")))
    return [
        Rule("TW_PHONE", "MOBILE", "09" + digits(8), 0.85, w["phone"]),
        Rule("TW_PHONE", "LANDLINE", "0[2-8]" + digits(7, 8), 0.75, w["phone"]),
        Rule("TW_ID_NUMBER", "TW_ID", "[A-Za-z][12]" + digits(8), 0.90, w["id"]),
        Rule("PASSPORT", "PASSPORT", capitals(1, 2) + digits(7, 9), 0.70, w["passport"]),
        Rule("DOB", "DOB_8", digits(8), 0.50, w["dob"]),
        Rule("DOB", "DOB_SLASH", "[/-]".join((digits(4), digits(2), digits(2))), 0.70, w["dob"]),
        Rule("TW_CREDIT_CARD", "CC_16", digits(16), 0.55, w["card"]),
        Rule("TW_BANK_ACCOUNT", "BANK_ACCT", f"(?!09{digits(8)}){digits(10, 14)}", 0.50, w["account"], re2=rf"(?:[1-9０-９]\d|0[0-8０-９]){digits(8, 12)}"),
        Rule("ATM_REF", "ATM_REF", digits(8, 20), 0.40, w["atm"]),
        Rule("LOAN_REF", "LOAN_REF_NUM", digits(8, 15), 0.45, w["loan"]),
        Rule("LOAN_REF", "LOAN_REF_ALPHA", capitals(1, 3) + digits(6, 12), 0.65, w["loan"]),
        Rule("TXN_REF", "TXN_NUM", digits(8, 20), 0.40, w["txn"]),
        Rule("TXN_REF", "TXN_ALPHA", capitals(1, 3) + digits(8, 15), 0.60, w["txn"]),
        Rule("POLICY_NO", "POLICY_ALPHA", capitals(1, 1) + digits(6, 12), 0.60, w["policy"]),
        Rule("POLICY_NO", "POLICY_NUM", "P" + digits(6, 10), 0.75, w["policy"]),
        Rule("AMOUNT", "AMOUNT_YUAN", rf"(?<!\d){NUMBER}元", 0.80, amount, re2=NUMBER + "元"),
        Rule("AMOUNT", "AMOUNT_KUAI", rf"(?<!\d){NUMBER}塊", 0.75, amount, re2=NUMBER + "塊"),
        Rule("AMOUNT", "AMOUNT_NT", r"NT[$]?\s*" + NUMBER, 0.80, amount),
        Rule("AMOUNT", "AMOUNT_NUM", NUMBER, 0.40, amount),
        Rule("AMOUNT_TXN", "AMOUNT_TXN_VERB", rf"{verbs}.{{0,20}}?{money}|(?<!\d){money}.{{0,10}}?{verbs}", 0.82, kind="group", recognizer="VerbAmountRule", note="(verb)", re2=f"{verbs}.{{0,20}}?{money}|{money}.{{0,10}}?{verbs}"),
        Rule("OTP", "OTP_6", digits(6), 0.50, w["otp"]),
        Rule("CVV", "CVV_3", digits(3), 0.30, w["cvv"], needed=True),
        Rule("EXPIRY", "EXPIRY_MMYY", _MONTH + digits(2), 0.45, w["expiry"]),
        Rule("EXPIRY", "EXPIRY_SLASH", f"{_MONTH}/{digits(2)}", 0.65, w["expiry"]),
        Rule("PIN", "PIN_46", digits(4, 6), 0.30, w["pin"], needed=True),
        Rule("LOCATION", "ADDR_L1_ADMIN", f"{any_of(PLACES)}{HAN}{{0,15}}?(?:路|街|大道){street}(?:之{digits(1, 3)})?", 0.85, recognizer="AddressRule"),
        Rule("LOCATION", "ADDR_L2_CHAIN", f"{any_of(CHAINS)}.{{0,4}}(?:店|門市|分店|賣場)?", 0.75, recognizer="AddressRule"),
        Rule("LOCATION", "ADDR_L3_LANDMARK", f"{HAN}{{2,6}}{any_of(SITES)}", 0.70, recognizer="AddressRule"),
        Rule("LOCATION", "ADDR_L3_PROXIMITY", f"{any_of(CHAINS + PLACES)}{HAN}{{0,8}}{any_of(NEAR)}", 0.72, recognizer="AddressRule"),
        Rule("STAFF_ID", "STAFF_ALPHA", capitals(1, 1) + digits(4, 8), 0.55, w["staff"]),
        Rule("STAFF_ID", "STAFF_PREFIX", any_of(("EMP", "STAFF", "E", "A")) + digits(4, 8), 0.70, w["staff"]),
        Rule("CAMPAIGN", "CAMPAIGN_CODE", capitals(2, 4) + digits(3, 6), 0.50, w["campaign"]),
        Rule("BRANCH", "BRANCH_NUM", digits(3, 4), 0.35, w["branch"], needed=True),
        Rule("BRANCH", "BRANCH_ALPHA", capitals(2, 4) + digits(2, 4), 0.55, w["branch"], needed=True),
        Rule("VERIFICATION_ANSWER", "VERIFICATION_TRIGGER", any_of(SECURITY_WORDS), 0.75, kind="after", recognizer="VerificationRule", then=digits(6, 8), note="X"),
        Rule("EMAIL_ADDRESS", "EMAIL", RUN_START + mail, 0.85, w["email"], re2=mail),
    ]


def _legacy(rule: Rule) -> Rule:
    """The rule as the first generation has it: no match needs a word, and patterns ignore case and take any character."""
    if rule.name == "BANK_ACCT":
        rule = replace(rule, regex=digits(10, 14), re2="")
    if rule.name == "OTP_6":
        rule = replace(rule, score=0.45)
    if rule.name == "ADDR_L1_ADMIN":
        rule = replace(rule, regex=rf"{any_of(PLACES)}.{{0,30}}?(?:路|街|大道|巷|弄)\d{{0,4}}號?")
    if rule.name == "VERIFICATION_TRIGGER":
        rule = replace(rule, then=f"{HAN}{{2,5}}|{rule.then}")
    return replace(rule, needed=False, flags=LEGACY_FLAGS if rule.recognizer == "PatternRule" else FLAGS)


RULES: dict[str, tuple[Rule, ...]] = {LEAN: tuple(_patterns()), FULL: tuple(_patterns()), LEGACY: tuple(_legacy(r) for r in _patterns())}

#: Turns of an agent that ask for something, and how a customer answers.
QUESTIONS = "|".join((r"請問您的.{0,15}(?:是|為)", r"請問您.{0,10}(?:嗎|？|[?])", "可以.{0,8}嗎", "需要.{0,6}驗證", "確認一下您的", "報一下您的", "幫我.{0,6}確認"))
_STOP = r"[，。,.\s]"
ANSWERS = (rf"是\s*{digits(4, 16)}", r"我的.{0,6}是\s*\d", r"對[，。,.]?\s*\d", f"^{digits(4, 16)}$", rf"{HAN}{{2,4}}(?={_STOP}|$)")
#: The last of ANSWERS for RE2: its match may have one character more, which isn't Han.
SHORT_ANSWER_RE2 = rf"{HAN}{{2,4}}(?:{_STOP}|$)"


def rules_of(profile: str, branches: bool = True, entities: frozenset[str] | None = None) -> tuple[tuple[int, Rule], ...]:
    """(place, rule) of a profile; without branches, or for some entities only, the other rules are never scanned."""
    if profile not in RULES:
        raise ValueError(f"profile must be one of {', '.join(PROFILES)}")
    return tuple((i, r) for i, r in enumerate(RULES[profile]) if (branches or r.entity != "BRANCH") and (entities is None or r.entity in entities))
