"""Live operators against their batch forms, over several micro-batches and a restart."""

import queue as standard
import random
import time

import pytest
from pyspark.sql import functions as F

from corvane.streaming import batch, live, progress
from corvane.streaming.queues import Queue


@pytest.fixture(scope="module")
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def write(spark, rows, schema, path, size):
    """One file for every so many rows, in order."""
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").json(path)
        time.sleep(0.01)


def run(stream, tmp_path, name, rows=0):
    """Run over what is there; the results stay in a folder, so that a second run goes on where the first ended.

    rows: of a query that never ends by itself, as its state has a time to live, so many rows are awaited.
    """
    q = stream.writeStream.format("json").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).option("path", str(tmp_path / f"{name}-out"))
    q = (q.trigger(processingTime="100 milliseconds") if rows else q.trigger(availableNow=True)).start()
    until, read = time.time() + 90, {}
    while time.time() < until and q.isActive and (not rows or sum(read.values()) < rows):
        time.sleep(0.2)
        read |= {p.batchId: p.numInputRows for p in q.recentProgress}
    q.stop()
    assert q.exception() is None and (not rows or sum(read.values()) == rows)


def restarted(spark, rows, schema, make, tmp_path, name, size=40, endless=False):
    """Rows of a live operator that is stopped half-way and started again from its checkpoint."""
    path = str(tmp_path / f"{name}-in")
    half = len(rows) // 2
    source = lambda: make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path))
    write(spark, rows[:half], schema, path, size)
    run(source(), tmp_path, name, half * endless)
    write(spark, rows[half:], schema, path, size)
    out = source()
    run(out, tmp_path, name, (len(rows) - half) * endless)
    return spark.read.schema(out.schema).json(str(tmp_path / f"{name}-out"))


def same(got, want):
    cols = want.columns
    key = lambda r: repr(tuple(r))
    a, b = ([[round(v, 9) if isinstance(v, float) else [round(w, 9) for w in v] if isinstance(v, list) else v for v in r] for r in d.select(*cols).collect()] for d in (got, want))
    assert sorted(a, key=key) == sorted(b, key=key)
    return len(a)


@pytest.mark.parametrize("policy", ["drop_new", "drop_oldest"])
def test_queue_rule_against_a_standard_queue(policy):
    r = random.Random(policy)
    mine, theirs, dropped, underruns, deepest = Queue(4, policy), standard.Queue(4), 0, 0, 0
    for i in range(2000):
        if r.random() < 0.55:
            lost = None
            try:
                theirs.put_nowait(i)
            except standard.Full:
                dropped += 1
                lost = i
                if policy == "drop_oldest":
                    lost = theirs.get_nowait()
                    theirs.put_nowait(i)
            assert mine.apply("put", i) == ([] if lost is None else [(lost, "dropped")])
            deepest = max(deepest, theirs.qsize())
        else:
            try:
                want = (theirs.get_nowait(), "taken")
            except standard.Empty:
                want, underruns = (None, "underrun"), underruns + 1
            assert mine.apply("take") == [want]
    n = mine.counts
    assert (n["dropped"], n["underruns"], n["deepest"]) == (dropped, underruns, deepest) and dropped > 100 and underruns > 20


def test_resync_drains_and_a_fault_is_silence():
    q = Queue(3, "drop_new", prefill=2, resync_on_drop=True)
    for i in range(5):
        q.apply("put", i)
    assert q.apply("take") == [(0, "drained"), (1, "drained"), (2, "drained"), (None, "silence")]
    assert q.apply("put", 9) == [] and q.apply("take") == [(None, "silence")] and q.apply("take") == [(9, "taken")] and q.apply("take") == [(None, "underrun")]
    q.apply("put", 10)
    assert q.apply("resync") == [(10, "drained")] and q.apply(None) == [] and q.apply("else", 1) == []
    q.apply("fail")
    assert q.apply("take") == [(None, "underrun")] and q.counts["resyncs"] == 2
    with pytest.raises(ValueError):
        Queue(2, "drop_new", prefill=3)


@pytest.mark.parametrize(("policy", "prefill", "on_drop"), [("drop_new", 2, True), ("drop_oldest", 0, False)])
def test_live_queues(spark, store, tmp_path, policy, prefill, on_drop):
    r = random.Random(7)
    rows = [(r.choice("ab"), i, r.choices(["put", "take", "resync", "fail", None], [50, 40, 3, 0.4, 1])[0], i) for i in range(400)]
    schema = "k string, i long, op string, item long"
    make = lambda d: live.bounded_queue(d, "k", "i", 3, policy, prefill, on_drop)
    got = restarted(spark, rows, schema, make, tmp_path, f"queue-{policy}")
    want = batch.bounded_queue(spark.createDataFrame(rows, schema), "k", "i", 3, policy, prefill, on_drop)
    assert same(got, want) > 200


def test_counters_while_a_query_runs(spark, store, tmp_path):
    """Counters of queues, what is observed in them, and high-water marks can be read while the query runs."""
    log = progress.ProgressLog(most=2)
    spark.streams.addListener(log)
    rows = [("ab"[i % 2], i, "put" if i % 5 else "take", i) for i in range(200)]
    schema = "k string, i long, op string, item long"
    path = str(tmp_path / "counters-in")
    write(spark, rows, schema, path, 50)
    counts = live.queue_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path), "k", "i", 6, "drop_oldest")
    seen = progress.observed(counts, "queues", dropped=F.sum("dropped"), deepest=F.max("deepest"))
    q = seen.writeStream.format("memory").queryName("counters").outputMode("update").option("checkpointLocation", str(tmp_path / "counters-state")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 120
        peaks = {}
        while time.time() < until and peaks.get("input_rows", (0,))[0] < 200:
            time.sleep(0.5)
            peaks = {x["metric"]: (x["total"], x["most"]) for x in log.peaks(spark).collect() if x["query"] == "counters"}
        assert q.isActive and peaks["input_rows"][0] == 200 and peaks["deepest"][1] == 6
        table = log.table(spark).where("query = 'counters'").collect()
        assert 1 <= len(table) <= 2 and all(x["batch_ms"] >= 0 for x in table)
    finally:
        q.stop()
        spark.streams.removeListener(log)
    last = {x["k"]: x for x in spark.table("counters").groupBy("k").agg(F.max("dropped").alias("dropped"), F.max("puts").alias("puts"), F.max("taken").alias("taken")).collect()}
    for k in "ab":
        mine = Queue(6, "drop_oldest")
        for key, _, op, item in rows:
            if key == k:
                mine.apply(op, item)
        assert (last[k]["dropped"], last[k]["puts"], last[k]["taken"]) == tuple(mine.counts[c] for c in ("dropped", "puts", "taken"))
    assert peaks["dropped"][1] == sum(x["dropped"] for x in last.values())


def test_live_resync_and_faults(spark, store, tmp_path):
    r = random.Random(5)
    rows = [(r.choice("ab"), i, [float(i), float(-i)], r.random() < 0.1 or None, r.random() < 0.004) for i in range(300)]
    schema = "k string, i long, x array<double>, mark boolean, bad boolean"
    df = spark.createDataFrame(rows, schema)
    got = restarted(spark, rows, schema, lambda d: live.resync(d, "k", "i", "x", "mark"), tmp_path, "resync")
    want = batch.resync(df, "k", "i", "x", "mark")
    assert same(got.withColumn("x", F.transform("x", lambda v: v + 0.0)), want.withColumn("x", F.transform("x", lambda v: v + 0.0))) == 300
    got = restarted(spark, rows, schema, lambda d: live.resync(d, "k", "i", "x", "mark", failed="bad"), tmp_path, "faults")
    quiet = batch.isolate(df, "k", "i", "x", "bad")
    want = batch.resync(quiet, "k", "i", "x", "mark").withColumn("x", F.transform("x", lambda v: v + 0.0))
    assert same(got.withColumn("x", F.transform("x", lambda v: v + 0.0)), want) == 300 and any(x[4] for x in rows)


def test_live_stale_results(spark, store, tmp_path):
    r = random.Random(8)
    rows, now = [], {"a": 0, "b": 0}
    for i in range(300):
        k = r.choice("ab")
        if r.random() < 0.3:
            now[k] += r.randint(0, 2)
            rows.append((k, i, None, now[k]))
        else:
            rows.append((k, i, now[k] - r.randint(-1, 3), None))
    schema = "k string, i long, version long, now long"
    got = restarted(spark, rows, schema, lambda d: live.current_at(d, "k", "i", most=1), tmp_path, "stale", endless=True)
    want = batch.current_at(spark.createDataFrame(rows, schema), "k", "i", most=1).select("k", "i", "version")
    assert 50 < same(got, want) < 200


@pytest.mark.parametrize(("rate_in", "rate_out"), [(16000, 48000), (7, 3), (48000, 44100), (1, 1)])
def test_resampling_does_not_depend_on_the_cut(spark, rate_in, rate_out):
    r = random.Random(1)
    stream = [r.uniform(-1, 1) for _ in range(400)]
    seen = set()
    for cut in range(4):
        chunks, at = [], 0
        while at < len(stream):
            n = [len(stream), 1, r.randint(0, 7), r.randint(0, 60)][cut]
            chunks.append(("a", len(chunks), stream[at : at + n]))
            at += n
        out = batch.resample_carried(spark.createDataFrame(chunks, "k string, i int, x array<double>"), "k", "i", "x", rate_in, rate_out).orderBy("i").collect()
        came = made = 0
        for x, c in zip(out, chunks, strict=True):
            came, made = came + len(c[2]), made + len(x["x"])
            assert made == x["total"] == round(came * rate_out / rate_in)
        seen.add(tuple(round(v, 9) for x in out for v in x["x"]))
    assert len(seen) == 1


def test_live_resampler(spark, store, tmp_path):
    r = random.Random(3)
    rows = [(r.choice("ab"), i, [r.uniform(-1, 1) for _ in range(r.randint(0, 9))]) for i in range(160)]
    schema = "k string, i long, x array<double>"
    got = restarted(spark, rows, schema, lambda d: live.resample(d, "k", "i", "x", 16000, 44100), tmp_path, "resample", size=20)
    assert same(got, batch.resample_carried(spark.createDataFrame(rows, schema), "k", "i", "x", 16000, 44100)) == 160
