"""Masking of a stream of turns, with tokens numbered through each call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as C
from pyspark.sql import Window as W
from pyspark.sql.streaming import DataStreamWriter

from veilwork.config import MaskConfig
from veilwork.functions import sql as F
from veilwork.functions.columns import exploded
from veilwork.operators.replace import ENTITY, base_token, numbered_token, replaced
from veilwork.plans.masking import mask_turns

KNOWN = "session_id string, entity string, value string, number int, batch_id long"
KEY = ["session_id", "entity", "value"]


def _exists(rows: DataFrame, folder: str) -> bool:
    at = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).exists(at)


def numbered_batch(masked: DataFrame, batch_id: int, folder: str, numbered: frozenset[str]) -> DataFrame:
    """A batch of masked turns with the tokens of their calls: values that earlier batches numbered keep their number, new
    ones go on from the highest, in the order of turns and places.

    What a batch numbers is written under folder/batch_id=N before its turns go out; a batch that is run again reads only
    the earlier ones and overwrites its own, so it comes to the same numbers.
    """
    spark = masked.sparkSession
    rows = masked.withColumn("session_id", C.col("session_id").cast("string"))
    found = exploded(rows, "session_id", "turn", s=C.col("entities")).where(C.col("s.entity").isin(*sorted(numbered)))
    values = found.groupBy("session_id", C.col("s.entity").alias("entity"), C.col("s.value").alias("value")).agg(C.min(C.struct("turn", C.col("s.start"))).alias("first"))
    known = spark.read.schema(KNOWN).parquet(folder).where(C.col("batch_id") < batch_id).drop("batch_id") if _exists(rows, folder) else spark.createDataFrame([], KNOWN).drop("batch_id")
    top = known.groupBy("session_id", "entity").agg(C.max("number").alias("top"))
    place = C.row_number().over(W.partitionBy("session_id", "entity").orderBy("first"))
    fresh = values.join(known, KEY, "left_anti").join(top, ["session_id", "entity"], "left").select(*KEY, (C.coalesce("top", C.lit(0)) + place).cast("int").alias("number"))
    fresh.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")
    numbers = known.unionByName(spark.read.schema("session_id string, entity string, value string, number int").parquet(f"{folder}/batch_id={batch_id}"))
    wanted = values.join(numbers, KEY).groupBy("session_id").agg(C.collect_list(C.struct("entity", "value", "number")).alias("_numbers"))

    def renamed(s: F.Sql) -> F.Sql:
        number = F.filter(F.col("_numbers"), lambda n: (n["entity"] == s["entity"]) & (n["value"] == s["value"]))
        token = F.let(F.get(number, 0), lambda n: F.when(n.isNull(), base_token(s["entity"])).otherwise(numbered_token(base_token(s["entity"]), n["number"])))
        return F.struct(**{f: s[f] for f in ENTITY if f != "token"}, token=token)

    done = rows.join(wanted, "session_id", "left").withColumn("entities", F.transform(F.col("entities"), renamed).column).drop("_numbers", "pseudonym_map")
    return done.withColumn("masked_text", replaced(F.col("normalized_text"), F.col("entities")).column)


def mask_stream(turns: DataFrame, folder: str, sink: Callable[[DataFrame, int], None], config: MaskConfig = MaskConfig()) -> DataStreamWriter:
    """A writer that masks each batch of a stream of turns (session_id, turn, text; as far as they are there speaker,
    asr_confidence, diarized) and gives it to sink(batch, batch_id).

    Detection is the plan of batch masking. Numbers are kept as a table under folder, which all executors share. Whether a
    call is diarized needs all of it, so a stream takes that from the column diarized. A turn that comes after later ones is
    numbered after them.
    """
    masked = mask_turns(turns, config)

    def each(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            sink(kept if config.lean else numbered_batch(kept, batch_id, folder, config.numbered), batch_id)
        finally:
            kept.unpersist()

    return masked.writeStream.foreachBatch(each)
