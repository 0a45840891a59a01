import json
from datetime import datetime, timedelta

from corvane.streaming import batch, live

START = datetime(2026, 1, 1)


def run(spark, stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, rows, schema, tmp_path, name):
    """A file stream of rows, one file after the other."""
    path = str(tmp_path / f"{name}-in")
    for i in range(0, len(rows), 4):
        spark.createDataFrame(rows[i : i + 4], schema).coalesce(1).write.mode("append").json(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)


def test_rate_limit_and_reblocking_match_their_batch_forms(spark, tmp_path):
    rows = [(k, float(t), t % 7 == 0) for t in range(0, 60, 4) for k in ("a", "b")]
    schema = "k string, s double, q boolean"
    want = sorted(map(tuple, batch.rate_limit(spark.createDataFrame(rows, schema), "k", "s", "q", 15.0).collect()))
    got = run(spark, live.rate_limit(source(spark, rows, schema, tmp_path, "rate"), "k", "s", "q", 15.0), tmp_path, "rate")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 4
    chunks = [("a", i, [float(10 * i + j) for j in range(i % 5)]) for i in range(12)]
    schema = "k string, i int, x array<double>"
    want = sorted((x["block"], x["samples"]) for x in batch.reblock(spark.createDataFrame(chunks, schema), "k", "i", "x", 4).collect())
    got = run(spark, live.reblock(source(spark, chunks, schema, tmp_path, "block"), "k", "i", "x", 4), tmp_path, "block")
    assert sorted((x["block"], x["samples"]) for x in got.collect()) == want and len(want) == 5


def test_recognizer_messages_and_final_dedup(spark, tmp_path):
    say = lambda text, end, **more: json.dumps({"header": {"event": "result-generated"}, "payload": {"output": {"sentence": {"text": text, "sentence_end": end, "sentence_id": 1, "begin_time": 0, "end_time": 5} | more}}})
    lines = [say("he", False), say("", False, heartbeat=True), say("hello", True), say("hello", True), json.dumps({"header": {"event": "task-finished"}}), "junk"]
    rows = [(START + timedelta(seconds=i), x) for i, x in enumerate(lines)]
    events = live.recognized(source(spark, rows, "ts timestamp, value string", tmp_path, "asr"))
    got = run(spark, live.drop_repeated_finals(events, "ts"), tmp_path, "asr")
    assert sorted((x["text"], x["is_final"]) for x in got.collect()) == [("he", False), ("hello", True)]
    text = [(1, 'data: {"choices":[{"delta":{"content":"Hi"}}]}'), (2, ": ping"), (3, 'data: {"choices":[{"delta":{"content":" you"}}]}'), (4, "data: [DONE]")]
    out = live.deltas(spark.createDataFrame(text, "i int, value string")).orderBy("i").collect()
    assert [x["delta"] for x in out] == ["Hi", " you"]


def test_queues_and_modes(spark):
    ops = [(1, i, op, i) for i, op in enumerate(["put", "put", "put", "take", "take", "take", "put"])]
    df = spark.createDataFrame(ops, "k int, i int, op string, item int")
    fates = lambda policy: [(x["item"], x["fate"]) for x in batch.bounded_queue(df, "k", "i", 2, policy).orderBy("i").collect()]
    assert fates("drop_new") == [(2, "dropped"), (0, "taken"), (1, "taken"), (None, "underrun")]
    assert fates("drop_oldest") == [(0, "dropped"), (1, "taken"), (2, "taken"), (None, "underrun")]
    blocks = spark.createDataFrame([(1, i, f"r{i}", f"e{i}", None) for i in range(4)], "k int, i int, raw string, enhanced string, quiet string")
    modes = spark.createDataFrame([(1, 1, "raw"), (1, 3, "quiet")], "k int, since int, mode string")
    assert [x["samples"] for x in batch.mode_blocks(blocks, modes, "k", "i").orderBy("i").collect()] == ["e0", "r1", "r2", "r3"]


def test_sink_errors_are_counted(spark):
    def write(df, i):
        if i:
            raise RuntimeError

    sink = live.CountingSink(write)
    sink(None, 0)
    sink(None, 1)
    assert (sink.batches, sink.errors) == (1, 1)


def test_hopping_windows_agree(spark, tmp_path):
    rows = [(START + timedelta(seconds=s), "x") for s in (0, 1, 1, 3, 30)]
    out = run(spark, live.hopping_counts(source(spark, rows, "ts timestamp, t string", tmp_path, "hop"), "ts", "2 seconds", "1 second", "1 second", "t"), tmp_path, "hop")
    want = batch.hopping_counts(spark.createDataFrame(rows, "ts timestamp, t string"), "ts", "2 seconds", "1 second", "t")
    done = {(x["start"], x["n"]) for x in out.collect()}
    assert done and done <= {(x["start"], x["n"]) for x in want.collect()}
