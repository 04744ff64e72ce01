"""Masking in Python against the expressions, on texts made at random of what rules and steps look for."""

import random
import time

import pytest
from pyspark.sql import functions as C

from veilwork.config import MaskConfig
from veilwork.functions.rules import QUESTIONS, Rule
from veilwork.functions.vocabulary import SECURITY_WORDS, WORDS
from veilwork.operators import plain
from veilwork.operators.plain import masker, normalized, portable
from veilwork.plans.masking import _by_expressions, audit, mask_turns

PARTS = [
    *"0 1 09 12 123 1234 12345678 0912345678 1234567890123456 ０９ ٣٤ 零 三 十 百 千 A b P NT $ EMP STAFF E ſ ı İ K é é 元 塊 , ， 。 . / - @ _ % + a@b.co x.y@c-d.org 路 街 大道 段 巷 弄 號 樓 之 台北市 三重 全聯 好市多 國小 附近 民國 民国 年 月 日 點 嗯嗯嗯 那那那 請問您 嗎 ？ 可以 需要 驗證 確認一下您的 幫我 確認 是 我的 對 王小明 店 門市 😀 - \\".split(),
    *SECURITY_WORDS[:3], *[w[0] for w in WORDS.values()], *WORDS["amount"][-4:], " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", " ", "　", "​", "\x0b", "甲乙丙丁", "1985/05/01", "01/27", "0127", "123,456",
]
COLUMNS = ["normalized_text", "entities", "conflict_log", "masked_text"]


def made(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.choice((1, 3, 8, 8, 15, 40)))) for _ in range(n)]


@pytest.mark.parametrize("profile", ["lean", "full", "legacy"])
def test_python_and_expressions_agree(spark, profile):
    config = MaskConfig(profile=profile)
    texts = made(profile, 500) + [None, "", " \n", "\x1c", "\x1c\x1d"] + [c * n + "12345678" for c in "ſıİKsiék" for n in (1, 2)]
    r = random.Random(1)
    hits = lambda t: sorted({(a, min(a + r.randint(1, 4), len(t)), r.choice(("PERSON", "GPE", "ORG"))) for a in (r.randrange(len(t)) for _ in range(r.randint(0, 2)))}) if t else None
    rows = spark.createDataFrame([(i, t, i % 3 == 0, hits(normalized(t)) if t and normalized(t) else None, hits(normalized(t)) if t and normalized(t) else None) for i, t in enumerate(texts)], "i int, text string, diarized boolean, ner array<struct<start:int,end:int,tag:string>>, llm array<struct<start:int,end:int,tag:string>>").repartition(4).cache()
    got = {r.i: r for r in mask_turns(rows, config, ner="ner", llm="llm").select("i", *COLUMNS).collect()}
    old = rows.withColumn("original_text", C.col("text")).withColumn("diarization_available", C.col("diarized") & C.expr(r"text IS NOT NULL AND regexp_like(text, '(?U)\\S')"))
    want = {r.i: r for r in _by_expressions(old, config, False, "ner", "llm").select("i", *COLUMNS).collect()}
    for i, t in enumerate(texts):
        for c in COLUMNS:
            assert got[i][c] == want[i][c], (t, c)
    assert sum(len(r.entities) for r in got.values()) > 500 and sum(len(r.conflict_log) for r in got.values()) > 500


def test_time_of_a_turn_and_of_a_long_text():
    """The expressions took some three milliseconds a turn, and over 160 s for 200,000 digits."""
    m = masker(MaskConfig())
    turns = ["我叫王小明，卡號是4123456789012345", "請問您的電話是0900001234，對，001234", "幫我轉帳12345元到帳號112345678901"] * 300
    began = time.process_time()
    for t in turns:
        m.decided(m.normal(t))
    assert time.process_time() - began < 1.5 * len(turns) / 1000
    began = time.process_time()
    m.decided(m.normal("7" * 200_000))
    assert time.process_time() - began < 60


@pytest.mark.parametrize("regex", [r"\bEMP\d+", r"a++", r"[a[bc]]", r"[a-z&&[b]]", r"(?i)a", r"\p{L}+", r"(?<n>a)", r"a{,3}", r"\Ga", r"[]a]"])
def test_patterns_that_python_reads_otherwise_stay_with_java(regex):
    assert portable(regex) is None


def test_own_rules_of_either_kind(spark):
    rows = spark.createDataFrame([(1, "工號EMP12345, x")], "i int, text string")
    for regex in (r"EMP\d{5}", r"\bEMP\d{5}\b"):
        config = MaskConfig(rules=(Rule("STAFF_ID", "OWN", regex, 0.99, ("工號",)),))
        assert masker(config).portable == (regex[0] != "\\")
        assert mask_turns(rows, config).first().masked_text == "工號[STAFF_ID], x"
        assert mask_turns(rows, config, only=("n_entities", "n_conflicts")).columns == ["i", "text", "n_entities", "n_conflicts"]


def test_questions_begin_as_they_are_looked_for():
    assert all(q.startswith(plain.ASKED) for q in QUESTIONS.split("|") if not q.startswith(("為)", "？", "[?])")))


@pytest.mark.parametrize("profile", ["lean", "full", "legacy"])
def test_entities_without_their_log(profile):
    """Where nobody asks for the conflicts, none is written down; what is left and their number are the same."""
    m, r = masker(MaskConfig(profile=profile)), random.Random(2)
    conflicts = 0
    for t in made(profile, 2000) + ["", " ", "09" * 30 + ",123,456", "1,234元 12345678 1234567890123456"]:
        t = m.normal(t)
        hits = [{"start": a, "end": a + 2, "tag": "PERSON"} for a in range(r.randint(0, 2))]
        entities, log = m.decided(t, bool(hits), hits, hits[:1])
        assert m.kept(t, bool(hits), hits, hits[:1]) == (entities, len(log)), t
        conflicts += len(log)
    assert conflicts > 2000


@pytest.mark.parametrize("profile", ["lean", "full", "legacy"])
def test_numbered_entities_alone(profile):
    """Where only numbered tokens are asked for, texts and spans that can't have any are passed over; what is left is the same."""
    m, r = masker(MaskConfig(profile=profile)), random.Random(3)
    n = passed = 0
    for t in made(profile, 2000) + ["", " ", "驗證碼是123456", "我電話0912345678", "09" * 30 + ",123,456", "1,234元 12345678 1234567890123456"]:
        t = m.normal(t)
        for k in (0, r.randint(1, 2)):
            hits = [{"start": a, "end": a + r.randint(0, 2), "tag": "PERSON"} for a in range(k)]
            want = [s for s in m.kept(t, bool(k), hits, hits[:1])[0] if s[3] in m.numbered]
            assert m.kept_numbered(t, bool(k), hits, hits[:1]) == want, t
            n += len(want)
        passed += not plain.blank(t) and not m._any_to_number(m.detected(t, None, True))
    assert profile == "lean" or (n > 1000 and passed > 200)


def test_patterns_are_tried_only_where_they_may_match():
    """Digits alone are told by the lengths of their runs; of a turn with one code, no pattern but those of codes is tried."""
    m = plain.Masker(MaskConfig())
    text = m.normal("驗證碼是123456")
    m.detected(text)
    ((_, chosen),) = m.chosen.items()
    tried = [needle for _, needle in chosen if needle in text]
    assert len(tried) <= 3 and len(m.plans[(6,), False]) == 5
    for n in range(3 * plain._KEPT):
        m.detected("1" * (n % 90 + 1) + " " + "2" * (n // 90 + 1))
    assert len(m.plans) <= plain._KEPT and len(m.chosen) <= plain._KEPT


def test_blank_texts_and_questions(spark):
    texts = [None, "", " 　\t", "\x1c", "\x85 ", " a", "x", "​", "請問您的電話是", "您的電話", "幫我再確認", "可以嗎", "可以"]
    rows = mask_turns(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), only=("usability_tag", "masked_text"))
    got = {r.i: r.usability_tag for r in rows.collect()}
    blank = [t is None or not t.strip(plain.WHITE) for t in texts]
    asked = [bool(t) and plain._QUESTIONS.search(t) is not None for t in texts]
    assert [got[i] for i in range(len(texts))] == ["USABLE" if b else "FALLBACK_MODE" if a else "NO_DIARIZATION" for b, a in zip(blank, asked)]


def test_winners_of_conflicts_alone(spark):
    """What an audit takes of the log is the same without the rest, in Python and by expressions."""
    rows = spark.createDataFrame(list(enumerate(made(4, 60))), "turn_id int, text string")
    for own in (r"EMP\d{5}", r"\bEMP\d{5}\b"):
        config = MaskConfig(rules=(Rule("STAFF_ID", "OWN", own, 0.99, ("工號",)),))
        for r in mask_turns(rows, config, only=("winners", "conflict_log")).collect():
            assert set(r.winners) == {(e.winner.start, e.winner.end, e.winner.entity) for e in r.conflict_log}
            assert len(r.winners) == len(set(r.winners))
    masked = [mask_turns(rows, only=("diarization_available", "usability_tag", "entities", c)) for c in ("winners", "conflict_log")]
    one, other = [sorted(map(str, audit(m, stamped=False).collect())) for m in masked]
    assert one == other and any("conflict_resolved='Y'" in x for x in one)
