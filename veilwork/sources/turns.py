"""Where turns come from, and where audit rows go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of files for each core below which rows are divided anew.
LEAST_SPLIT = 32 << 20
ROLES = {"user": "CUSTOMER", "assistant": "AGENT"}

#: Calls made of orders: eighteen kinds of turns, a session for each customer. The text reads alike in Spark and DuckDB.
TRANSCRIPTS = """
SELECT o_custkey AS session_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS turn, o_orderkey AS turn_id,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'AGENT' ELSE 'CUSTOMER' END AS speaker,
  CASE WHEN o_orderkey % 17 = 0 THEN 0.55E0 WHEN o_orderkey % 3 = 0 THEN NULL ELSE 0.9E0 END AS asr_confidence,
  CASE o_orderkey % 18
    WHEN 0 THEN '我叫王小明，卡號是4' || lpad(CAST((o_orderkey * 7919) % 1000000000000000 AS STRING), 15, '0')
    WHEN 1 THEN '我電話09' || lpad(CAST(o_custkey % 100000000 AS STRING), 8, '0')
    WHEN 2 THEN '住在台北市忠孝東路' || CAST(o_orderkey % 300 + 1 AS STRING) || '號'
    WHEN 3 THEN '驗證碼是' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0')
    WHEN 4 THEN '幫我轉帳' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '元到帳號1' || lpad(CAST((o_orderkey * 104729) % 100000000000 AS STRING), 11, '0')
    WHEN 5 THEN '今天氣溫' || CAST(o_orderkey % 40 AS STRING) || '度，油價' || CAST(o_orderkey % 100 AS STRING) || '元'
    WHEN 6 THEN '生日是民國' || CAST(o_orderkey % 145 + 5 AS STRING) || '年' || CAST(o_orderkey % 12 + 1 AS STRING) || '月1日'
    WHEN 7 THEN '嗯嗯嗯嗯我的卡號是5' || lpad(CAST((o_orderkey * 6007) % 1000000000000000 AS STRING), 15, '0')
    WHEN 8 THEN '我的身分證A1' || lpad(CAST(o_custkey AS STRING), 8, '0')
    WHEN 9 THEN '請問您的電話是09' || lpad(CAST(o_custkey AS STRING), 8, '0') || '，對，' || lpad(CAST(o_orderkey AS STRING), 6, '0')
    WHEN 10 THEN '母親生日是' || lpad(CAST(o_orderkey AS STRING), 8, '0') || '，有效期限0' || CAST(o_orderkey % 9 + 1 AS STRING) || '25'
    WHEN 11 THEN '我家住在好市多隔壁的SEVEN樓上，員工編號EMP' || lpad(CAST(o_orderkey % 100000 AS STRING), 5, '0')
    WHEN 12 THEN '我的Email是u' || CAST(o_custkey AS STRING) || '@example.com　謝謝  ＡＢ１２'
    WHEN 13 THEN '信用卡背面三碼是' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || '，到期0' || CAST(o_orderkey % 9 + 1 AS STRING) || '/27'
    WHEN 14 THEN '網銀密碼' || lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0') || '，幫我確認，是' || CAST(o_orderkey AS STRING) || '00000'
    WHEN 15 THEN '分行代碼' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || '，住在臺中市臺灣大道一段９９號，電話04' || lpad(CAST(o_custkey AS STRING), 8, '2')
    WHEN 16 THEN '護照AB' || lpad(CAST(o_orderkey AS STRING), 8, '1') || '，保單P' || lpad(CAST(o_custkey AS STRING), 7, '3') || '，活動AB1234，生於1985/05/01，付NT$1,200'
    ELSE '生日是民國七十四年五月一日，卡號末四碼是三三三五'
  END AS text
FROM {orders}
"""


def spread(rows: DataFrame) -> DataFrame:
    """rows of files that are too few or too small to give every core a part, divided evenly; others as they are.

    Masking takes long for each byte, and one small file with one row group would be one task. What is moved is at most
    LEAST_SPLIT bytes for each core, so inputs that fill the cluster are never shuffled for this.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size, conf = 0, spark._jsc.hadoopConfiguration()
    for name in rows.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
        if size > cores * LEAST_SPLIT:
            return rows
    return rows.repartition(2 * cores)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    return spark.sql(TRANSCRIPTS, orders=spread(orders))


def read_turns(spark: SparkSession, path: str, kind: str = "parquet", names: dict[str, str] | None = None) -> DataFrame:
    """Turns from Parquet, CSV or JSON files; names gives, for our columns, those of the files."""
    reader = spark.read.option("header", True) if kind == "csv" else spark.read
    rows = reader.format(kind).load(path)
    for ours, theirs in (names or {}).items():
        rows = rows.withColumnRenamed(theirs, ours)
    types = {"turn": "int", "turn_id": "long", "start_time": "double", "end_time": "double", "asr_confidence": "double"}
    return rows.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in rows.columns})


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table conversations as turns: users are customers, assistants are agents, others are unknown."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    speaker = F.coalesce(*[F.when(F.col("role") == k, F.lit(v)) for k, v in ROLES.items()])
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("turn"), speaker.alias("speaker"), "text")


#: Hits of a model in one text, and what went wrong.
HITS = "struct<hits:array<struct<start:int,end:int,tag:string>>,error:string>"


def with_provider(turns: DataFrame, make: Callable[[], Callable[[list[str]], list[list[tuple[int, int, str]]]]], text: str = "text", name: str = "ner_hits") -> DataFrame:
    """turns with the hits of a model as one array for each turn, and what it raised, as {name}_error.

    make() loads the model, once in each Python worker; the model takes a list of texts, an Arrow batch at a time, and gives
    (start, end, tag) for each. If it raises, its texts are given to it one by one, and only those for which it raises again
    have null hits and the error's text, so that masking goes on by rules alone. A null text has no hits. Nothing is
    shuffled, and other columns don't go to Python.
    """
    from pyspark.sql.functions import pandas_udf

    def find(texts):
        import pandas as pd

        model = _MODELS.get(make)
        if model is None:
            model = _MODELS[make] = make()
        known = [t for t in texts if t is not None]

        def one(t: str):
            try:
                return model([t])[0], None
            except Exception as e:  # noqa: BLE001 - a model's error is data here
                return None, f"{type(e).__name__}: {e}"

        try:
            found = [(h, None) for h in model(known)] if known else []
            if len(found) != len(known):
                raise ValueError("the model must give as many lists as texts")
        except Exception:  # noqa: BLE001
            found = [one(t) for t in known]
        rest = iter(found)
        pairs = [([], None) if t is None else next(rest) for t in texts]
        return pd.DataFrame({"hits": [None if h is None else [{"start": a, "end": b, "tag": k} for a, b, k in h] for h, _ in pairs], "error": [e for _, e in pairs]})

    find.__annotations__ = {"texts": _pandas().Series, "return": _pandas().DataFrame}
    both = turns.withColumn("_found", pandas_udf(find, HITS)(F.col(text).cast("string")))
    return both.withColumn(name, F.col("_found.hits")).withColumn(f"{name}_error", F.col("_found.error")).drop("_found")


#: Models by what makes them, in this worker.
_MODELS: dict = {}


def _pandas():
    import pandas

    return pandas


def with_hits(turns: DataFrame, hits: DataFrame, key: str = "turn_id", name: str = "ner_hits") -> DataFrame:
    """turns with the hits of a model (key, start, end, tag) as one array for each turn, in order."""
    found = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag"))).alias(name))
    return turns.join(found, key, "left")


def write_audit(audit: DataFrame, path: str, append: bool = False) -> None:
    """Audit rows as CSV files with a header; in append mode they are added to what is there."""
    audit.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def export_audit(audit: DataFrame, path: str, append: bool = False) -> None:
    """One CSV file in UTF-8 with a byte order mark, written row by row by the driver; for reports that people open.

    Folders are made. In append mode a file that exists is added to, without another header.
    """
    import csv
    from pathlib import Path

    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    more = append and target.exists()
    with target.open("a" if more else "w", encoding="utf-8" if more else "utf-8-sig", newline="") as out:
        writer = csv.writer(out)
        if not more:
            writer.writerow(audit.columns)
        writer.writerows(audit.toLocalIterator())
