from veilwork.plans.masking import mask_turns
from veilwork.config import MaskConfig
from veilwork.streaming.masking import mask_stream, numbered_batch

KIND = "session_id string, turn int, text string, diarized boolean"


def test_stream_masks_and_numbers(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("s", 1, "卡號1234567890123456", True), ("s", 2, "卡號9999888877776666和1234567890123456", True), ("t", 1, "您好", True), ("t", 2, None, True)], KIND).coalesce(1).write.parquet(source)
    keep = lambda batch, n: batch.select("session_id", "turn", "masked_text").write.mode("append").parquet(out)
    query = mask_stream(spark.readStream.schema(KIND).parquet(source), str(tmp_path / "numbers"), keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    ended = query.awaitTermination(90)
    query.stop()
    assert ended
    got = {(r.session_id, r.turn): r.masked_text for r in spark.read.parquet(out).collect()}
    assert got == {("s", 1): "卡號[CARD_1]", ("s", 2): "卡號[CARD_2]和[CARD_1]", ("t", 1): "您好", ("t", 2): None}


def test_numbers_go_on_over_batches(spark, tmp_path):
    folder, config = str(tmp_path / "n"), MaskConfig()

    def run(batch_id, *turns):
        masked = mask_turns(spark.createDataFrame([("s", i, t) for i, t in turns], "session_id string, turn int, text string"), config)
        return {r.turn: r.masked_text for r in numbered_batch(masked, batch_id, folder, config.numbered).collect()}

    assert run(0, (1, "卡號1234567890123456")) == {1: "卡號[CARD_1]"}
    second = {2: "卡號[CARD_2]和[CARD_1]"}
    assert run(1, (2, "卡號9999888877776666和1234567890123456")) == second
    assert run(1, (2, "卡號9999888877776666和1234567890123456")) == second
