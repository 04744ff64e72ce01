import pytest

from veilwork.functions import sql as F
from veilwork.functions.normalize import composed, normalize
from pyspark.sql import functions as C

CASES = [
    (None, None),
    ("", ""),
    ("ＡＢＣ１２３，電話是０９１２３４５６７８", "ABC123,電話是0912345678"),
    ("電話\t是  \n 0912345678\r\n謝謝", "電話 是 0912345678 謝謝"),
    ("我電話是零九一二三四五六七八", "我電話是0912345678"),
    ("卡號末四碼四三二一", "卡號末四碼4321"),
    ("生日是民國113年5月1日", "生日是2024年5月1日"),
    ("生日是民國49年1月1日", "生日是1960年1月1日"),
    ("民國9年", "民國9年"),
    ("那那那那我要查帳單", "那那我要查帳單"),
    ("生日是民國一一三年三月二十六日", "生日是2024年3月26日"),
    ("生日是民國七十四年五月一日", "生日是1985年5月1日"),
    ("預約日期是三月二十六日", "預約日期是3月26日"),
    ("一百十五", "105"),
    ("一一三十", "30"),
    ("十分", "10分"),
    ("百貨", "百貨"),
    ("居民25年", "居1936年"),
    ("一百零三元", "103元"),
    ("été", "été"),
    ("😀　９", "😀 9"),
]


def test_all_cases(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES)], "i int, text string")
    out = rows.withColumn("text", composed(C.col("text"))).withColumn("text", normalize(F.col("text")).column).orderBy("i").collect()
    assert [r.text for r in out] == [b for _, b in CASES]


@pytest.mark.parametrize("text", ["民國151年", "民國10年"])
def test_year_bounds(spark, text):
    out = spark.createDataFrame([(text,)], "text string").select(normalize(F.col("text")).column.alias("t")).first().t
    assert out == {"民國151年": "民國151年", "民國10年": "1921年"}[text]
