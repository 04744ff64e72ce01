"""Goldens, each branch of the resolver, edges of windows and thresholds, and properties of masked texts."""

import csv

import pytest
from pyspark.sql import functions as C

from veilwork.config import MaskConfig
from veilwork.functions import sql as F
from veilwork.operators.replace import numbered_token
from veilwork.operators.resolve import one_decimal, resolved
from veilwork.operators.scan import SPANS
from veilwork.plans import compare
from veilwork.plans.masking import audit, mask_dialogue, mask_text, mask_turns, session_pairs
from veilwork.sources.turns import export_audit, read_turns, with_hits, write_audit

LEAN = MaskConfig(profile="lean")
GOLDEN = [
    ("我叫王小明，卡號是1234567890123456", "我叫[NAME]，卡號是[CARD]", "我叫[NAME_1],卡號是[CARD_1]"),
    ("我電話0912345678", "我電話[PHONE]", "我電話[PHONE]"),
    ("住在台北市忠孝東路100號", "住在[ADDRESS]", None),
    ("驗證碼是654321", "驗證碼是[OTP]", "驗證碼是[OTP]"),
    ("轉帳到帳號123456789012", "轉帳到帳號[ACCOUNT]", None),
    ("我家住在好市多隔壁的SEVEN樓上", "我家住在[ADDRESS]EVEN樓上", None),
    ("生日是民國七十四年五月一日", "生日是民國七十四年五月一日", "生日是1985年5月1日"),
    ("我的身分證A123456789", "我的身分證[ID]", None),
    ("我的Email是foo@example.com", "我的Email是[EMAIL]", "我的Email是[EMAIL]"),
    ("嗯嗯嗯嗯我的卡號是1234567890123456", "嗯嗯嗯嗯我的卡號是[CARD]", "嗯嗯我的卡號是[CARD_1]"),
    ("卡號末四碼是三三三五", "卡號末四碼是三三三五", "卡號末四碼是3335"),
    ("我叫王小明，我就是王小明", "我叫[NAME]，我就是[NAME]", "我叫[NAME_1],我就是[NAME_1]"),
    ("王小明跟陳美玲一起來分行", "[NAME]跟[NAME]一起來分行", "[NAME_1]跟[NAME_2]一起來分行"),
    ("今天氣溫30度，油價30元", "今天氣溫[AMOUNT]度，油價[AMOUNT]", "今天氣溫30度,油價30元"),
    ("幫我轉帳500元到帳號123456789012", "幫我轉帳[AMOUNT]到帳號[ACCOUNT]", "幫我轉帳[AMOUNT]到帳號[ACCOUNT_1]"),
    ("這張卡號1234567890123456扣了1000元", "這張卡號[CARD]扣了[AMOUNT]", "這張卡號[CARD_1]扣了[AMOUNT]"),
]


def golden(spark):
    turns = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(GOLDEN)], "turn_id int, text string")
    found = [(i, t.find(n, at), t.find(n, at) + 3, "PERSON") for i, (t, _, _) in enumerate(GOLDEN) for n in ("王小明", "陳美玲") for at in {0, t.rfind(n)} if n in t]
    return with_hits(turns, spark.createDataFrame(sorted(set((i, a, b, k) for i, a, b, k in found)), "turn_id int, start int, end int, tag string"))


@pytest.mark.parametrize("profile,column", [("lean", 1), ("full", 2)])
def test_golden(spark, profile, column):
    rows = mask_turns(golden(spark), MaskConfig(profile=profile), ner="ner_hits").select("turn_id", "masked_text").collect()
    for r in rows:
        want = GOLDEN[r.turn_id][column]
        assert want is None or r.masked_text == want


def test_properties(spark):
    rows = mask_turns(golden(spark), ner="ner_hits").collect()
    for r in rows:
        spans = r.entities
        assert all(a.end <= b.start for a, b in zip(spans, spans[1:]))
        out, at = "", 0
        for s in spans:
            assert r.normalized_text[s.start : s.end] == s.value
            out, at = out + r.normalized_text[at : s.start] + s.token, s.end
        assert out + r.normalized_text[at:] == r.masked_text


def test_trace(spark):
    row = mask_text(spark, "幫我轉帳500元到帳號123456789012").first()
    assert row.masked_text == "幫我轉帳[AMOUNT]到帳號[ACCOUNT_1]"
    reasons = [x.reason for x in row.conflict_log]
    assert reasons[0] == "[R1] CROSS_TYPE_SAME_SPAN:PRIORITY_SCORE:72.0>=71.6"
    assert reasons[1] == "[R2] CONTAINS:longer_wins"


def spans_of(spark, spans):
    rows = [(start, end, i, entity, score, "r", "p", boost, word) for i, (start, end, entity, score, boost, word) in enumerate(spans)]
    df = spark.createDataFrame([(rows,)], f"s {SPANS}")
    out = df.select(resolved(F.col("s")).column.alias("r")).first().r
    return [(s.start, s.end, s.entity, s.score) for s in out.spans], [x.reason for x in out.log]


@pytest.mark.parametrize(
    "spans,left,reasons",
    [
        ([(0, 5, "AMOUNT", 0.5, 0.0, None), (5, 9, "OTP", 0.5, 0.0, None)], [0, 1], []),
        ([(0, 9, "AMOUNT", 0.5, 0.0, None), (2, 5, "OTP", 0.5, 0.0, None)], [0], ["[R1] CONTAINS:longer_wins"]),
        ([(0, 5, "AMOUNT", 0.5, 0.0, None), (3, 8, "OTP", 0.5, 0.0, None)], [1], ["[R1] RISK_LEVEL:5>3"]),
        ([(0, 5, "AMOUNT", 0.5, 0.0, None), (3, 9, "AMOUNT_TXN", 0.5, 0.0, None)], [1], ["[R1] SPAN_LENGTH:6>5"]),
        ([(0, 5, "AMOUNT", 0.5, 0.0, None), (3, 8, "AMOUNT", 0.5, 0.0, None)], [1], ["[R1] PRIORITY_SCORE:67.5>=67.5"]),
        ([(0, 5, "OTP", 0.5, 0.0, None), (0, 5, "PIN", 0.5, 0.0, None)], [0], ["[R1] CROSS_TYPE_SAME_SPAN:PRIORITY_SCORE:110.0>=109.0"]),
        ([(0, 5, "OTP", 0.5, 0.0, None), (0, 5, "OTP", 0.6, 0.0, None)], [1], ["EXACT_DUP:higher_score_wins"]),
        ([(0, 5, "OTP", 0.5, 0.0, None), (0, 5, "OTP", 0.5, 0.35, "x")], [0], ["EXACT_DUP:first_wins"]),
        ([], [], []),
    ],
)
def test_resolver(spark, spans, left, reasons):
    kept, log = spans_of(spark, spans)
    assert kept == [spans[i][:4] for i in left]
    assert log == reasons


def test_one_decimal_is_exact(spark):
    values = [115.25, 70.75, 69.45, 88.55, 71.6, 100.0, 16.05, 72.350000000000001, 109.95]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", one_decimal(F.col("x")).column.alias("t")).collect()
    assert [r.t for r in rows] == [f"{r.x:.1f}" for r in rows]


def test_amount_band(spark):
    pad = lambda n: "1元" + "甲" * n + "9876543210123456"
    rows = spark.createDataFrame([(58, pad(58)), (59, pad(59))], "n int, text string")
    found = {r.n: [s.entity for s in r.entities] for r in mask_turns(rows).collect()}
    assert "AMOUNT" in found[58] and "AMOUNT" not in found[59]


def test_word_window(spark):
    text = lambda n: "密碼" + "甲" * n + "1234"
    rows = spark.createDataFrame([(28, text(28)), (29, text(29))], "n int, text string")
    found = {r.n: [s.pattern for s in r.entities] for r in mask_turns(rows, MaskConfig(entities=frozenset({"PIN"}))).collect()}
    assert found == {28: ["PIN_46"], 29: []}


def test_blank_and_odd_texts(spark):
    texts = [None, "", " ", "　\t", "\n", "x" * 20_000 + "0912345678", "😀0912345678"]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "i int, text string, entities_seen string")
    out = {r.i: r for r in mask_turns(rows).collect()}
    assert [out[i].masked_text for i in range(5)] == texts[:5] and all(out[i].usability_tag == "USABLE" and not out[i].entities for i in range(5))
    assert out[5].masked_text.endswith("[PHONE]") and out[6].masked_text == "😀[PHONE]"
    assert out[0].entities_seen == "kept"


def test_usability(spark):
    rows = spark.createDataFrame(
        [(1, "您好", 0.69, True), (2, "您好", 0.70, True), (3, "您好", None, False), (4, "請問您的卡號是", None, False), (5, "0912345678" + "甲" * 90, None, True), (6, "0912345678" * 4 + "甲" * 60, None, True)],
        "i int, text string, asr_confidence double, diarized boolean",
    )
    tags = {r.i: (r.usability_tag, r.fallback_mode) for r in mask_turns(rows).collect()}
    assert tags[1] == ("LOW_AUDIO_QUALITY", False) and tags[2] == ("USABLE", False) and tags[3] == ("NO_DIARIZATION", False)
    assert tags[4] == ("FALLBACK_MODE", True) and tags[5] == ("USABLE", False)


def test_dialogue_numbers_and_snapshots(spark):
    turns = [dict(speaker="AGENT", text="請問您的卡號是"), dict(speaker="CUSTOMER", text="1234567890123456，帳號123456789012"), dict(speaker="CUSTOMER", text="卡號1234567890123456,還有9999888877776666"), dict(speaker=None, text="好")]
    rows = mask_dialogue(spark, turns, "s").orderBy("turn").collect()
    assert rows[1].masked_text == "[CARD_1],帳號[ACCOUNT_1]" and rows[2].masked_text == "卡號[CARD_1],還有[CARD_2]"
    assert rows[1].pseudonym_map["TW_CREDIT_CARD"] == {"1234567890123456": "[CARD_1]"}
    assert rows[2].pseudonym_map["TW_CREDIT_CARD"] == {"1234567890123456": "[CARD_1]", "9999888877776666": "[CARD_2]"}
    assert not any(r.diarization_available for r in rows) and rows[0].usability_tag == "FALLBACK_MODE"
    assert all(r.diarization_available for r in mask_dialogue(spark, [dict(speaker=s, text="好") for s in ("AGENT", "AGENT", "CUSTOMER", "CUSTOMER", None)]).collect())


def test_repeated_and_missing_turns_keep_their_own_texts(spark):
    texts = [("s", 1, "我電話0912345678"), ("s", 1, "您好"), ("t", None, "a1"), ("t", None, "卡號1234567890123456"), ("u", 1, "您好您好您好,我電話0912345678"), ("u", 1, "a@b.co,c@d.co"), ("v", 2, "卡號1234567890123456"), ("v", 2, "卡號1234567890123456"), ("v", 1, "卡號9999888877776666"), (None, None, None)]
    rows = spark.createDataFrame([(*r, i, "kept") for i, r in enumerate(texts)], "session_id string, turn int, text string, row int, rest string")
    for snapshot in (False, True):
        got = {r.row: r for r in mask_turns(rows, dialogues=True, snapshot=snapshot).collect()}
        assert {i: r.original_text for i, r in got.items()} == {i: t for i, (_, _, t) in enumerate(texts)}
        assert [got[i].masked_text for i in range(10)] == ["我電話[PHONE]", "您好", "a1", "卡號[CARD_1]", texts[4][2].replace("0912345678", "[PHONE]"), "[EMAIL],[EMAIL]", "卡號[CARD_2]", "卡號[CARD_2]", "卡號[CARD_1]", None]
        assert all(r.rest == "kept" for r in got.values())


@pytest.mark.parametrize("only", [("masked_text",), ("entities",), None])
def test_dialogues_are_exchanged_once(spark, only):
    """A second exchange put rows out of the order of turns that the numbers follow, and in few and large parts."""
    rows = spark.createDataFrame([("s", 1, "AGENT", "a")], "session_id string, turn int, speaker string, text string")
    masked = mask_turns(rows, dialogues=True, only=only)
    assert masked._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert session_pairs(rows)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_numbers_follow_turns_when_sorting_spills(spark):
    n = 3000
    rows = spark.createDataFrame([("s", i, f"卡號4{i:015d}") for i in range(1, n + 1)], "session_id string, turn int, text string").repartition(7)
    conf, key = spark.sparkContext._jsc.sc().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    conf.set(key, "100")
    try:
        masked = mask_turns(rows, dialogues=True, only=("masked_text",)).collect()
        pairs = session_pairs(rows).collect()
    finally:
        conf.remove(key)
    assert {r.turn: r.masked_text for r in masked} == {i: f"卡號[CARD_{i}]" for i in range(1, n + 1)}
    assert sorted((r.value, r.token) for r in pairs) == [(f"4{i:015d}", f"[CARD_{i}]") for i in range(1, n + 1)]


@pytest.mark.parametrize("own", [r"EMP\d{5}", r"\bEMP\d{5}\b"])
def test_pairs_of_sessions(spark, own):
    """Each once, in Python and by expressions, also of turns without session or number, and in several batches."""
    from veilwork.functions.rules import Rule

    config = MaskConfig(rules=(Rule("STAFF_ID", "OWN", own, 0.99, ("工號",)),))
    texts = [("s", 1, "卡號1234567890123456，帳號123456789012"), ("s", 2, "卡號1234567890123456,還有9999888877776666"), ("s", 2, "卡號4444555566667777"), ("t", None, "卡號9999888877776666"), ("t", None, "卡號9999888877776666"), (None, 1, "卡號1234567890123456"), (None, 2, "卡號1234567890123456"), ("u", 1, "我電話0912345678"), ("u", 2, None), ("u", 3, " ")]
    rows = spark.createDataFrame(texts, "session_id string, turn int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = [tuple(r) for r in session_pairs(rows, config).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(r.session_id, s.entity, s.value, s.token) for r in mask_turns(rows, config, dialogues=True).collect() for s in r.entities if s.entity in config.all_numbered}
    assert len(got) == len(set(got)) and set(got) == want and len(want) == 6


def test_own_rules_need_a_type():
    from veilwork.functions.rules import Rule

    with pytest.raises(ValueError, match="BADGE"):
        MaskConfig(rules=(Rule("BADGE", "B", "x", 0.9),))


def test_model_errors_stay_with_their_texts(spark):
    from veilwork.sources.turns import with_provider

    def make():
        def find(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return [[(0, 3, "PERSON")] for _ in texts]

        return find

    rows = spark.createDataFrame([(1, "王小明在"), (2, "bad"), (3, None)], "turn_id int, text string").coalesce(1)
    got = {r.turn_id: r for r in mask_turns(with_provider(rows, make), LEAN, ner="ner_hits").collect()}
    assert got[1].masked_text == "[NAME]在" and got[2].masked_text == "bad" and got[3].masked_text is None
    assert got[2].ner_hits_error == "RuntimeError: no" and got[1].ner_hits_error is None and got[2].ner_hits is None


def test_reports_of_one_pass_and_of_two_runs_agree(spark):
    rows = golden(spark).drop("ner_hits")
    one = compare.profile_report(rows, LEAN, MaskConfig())
    two = compare.case_report(mask_turns(rows, LEAN), mask_turns(rows))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.select(*one.columns).collect()))
    assert "conflicts" in compare.report_lines(one).first().line


def test_empty_table(spark):
    none = spark.createDataFrame([], "session_id string, turn int, text string")
    assert mask_turns(none).count() == 0 and mask_turns(none, dialogues=True, snapshot=True).count() == 0 and audit(mask_turns(none)).count() == 0


def test_second_source(spark):
    rows = spark.createDataFrame([(1, "王小明在台北", [(0, 3, "PERSON"), (4, 6, "LOC"), (0, 1, "ORG")])], "turn_id int, text string, more array<struct<start:int,end:int,tag:string>>")
    assert mask_turns(rows, llm="more").first().masked_text == "[NAME_1]在[ADDRESS]"


def test_token_suffix(spark):
    rows = spark.createDataFrame([("[NAME]", 2), ("NAME", 3)], "t string, n int").select(numbered_token(F.col("t"), F.col("n")).column.alias("x")).collect()
    assert [r.x for r in rows] == ["[NAME_2]", "NAME_3"]


def test_audit_files(spark, tmp_path):
    rows = audit(mask_turns(spark.createDataFrame([("s", "住在台北市忠孝東路100號,電話0912345678")], "session_id string, text string")))
    path = tmp_path / "a" / "audit.csv"
    export_audit(rows, str(path))
    export_audit(rows, str(path), append=True)
    assert path.read_bytes().startswith(b"\xef\xbb\xbf")
    lines = list(csv.DictReader(path.open(encoding="utf-8-sig")))
    assert len(lines) == 4 and {x["entity_subtype"] for x in lines} == {"ADDR_L1_ADMIN", "MOBILE"} and lines[0]["score"] == "0.850"
    assert {"Y", "N"} >= {x["conflict_resolved"] for x in lines} and lines[0]["timestamp"].endswith("+00:00")
    write_audit(rows, str(tmp_path / "d"))
    write_audit(rows, str(tmp_path / "d"), append=True)
    assert read_turns(spark, str(tmp_path / "d"), "csv").count() == 4


def test_reports(spark):
    turns = golden(spark)
    report = compare.case_report(mask_turns(turns, LEAN, ner="ner_hits"), mask_turns(turns, ner="ner_hits"))
    one = compare.summary(report).first()
    assert one.cases == len(GOLDEN) and one.same + one.different == one.cases and one.same > 3


def test_types_are_pruned(spark):
    plan = mask_turns(spark.createDataFrame([("a",)], "text string"), MaskConfig(branches=False))._jdf.queryExecution().analyzed().toString()
    assert "BRANCH_NUM" not in plan


def test_bad_config():
    with pytest.raises(ValueError):
        MaskConfig(profile="other")
    with pytest.raises(ValueError):
        MaskConfig(entities=frozenset({"NOTHING"}))
