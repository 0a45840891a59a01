"""Rules that no registered query reaches: sources, sinks, manifests, signals, sessions, ingestion."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import lineage as L
from corvane.functions import text as T
from corvane.operators import evaluation as E
from corvane.operators import meeting as MT
from corvane.operators import metrics as M
from corvane.operators import quality as Q
from corvane.operators import sessions as S
from corvane.operators import signal as G
from corvane.sources import documents as D
from corvane.sources import sinks, tables
from corvane.streaming import batch as B


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_sinks_and_what_reads_them(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    rows = spark.createDataFrame([(1, "a,b", None), (2, 'q"x', "z")], "id int, name string, note string")
    sinks.write_csv(rows, at("csv"), ["name", "id", "note"])
    back = tables.read_csv(spark, at("csv"), ["id"], strict=True).orderBy("id").collect()
    assert [tuple(r) for r in back] == [("a,b", "1", ""), ('q"x', "2", "z")]
    with pytest.raises(tables.SourceError):
        tables.read_csv(spark, at("csv"), ["none"])
    sinks.write_if_absent(rows, at("template"))
    sinks.write_if_absent(rows.limit(0), at("template"))
    assert spark.read.csv(at("template"), header=True).count() == 2
    sinks.write_partitioned(rows, at("parts"), "id")
    sinks.write_partitioned(rows.where("id = 1").withColumn("name", F.lit("new")), at("parts"), "id")
    assert {(r["id"], r["name"]) for r in spark.read.json(at("parts")).collect()} == {(1, "new"), (2, 'q"x')}
    whole = json.loads(sinks.as_json_array(rows, "id", ["note", "id"]).first()["json"])
    assert whole == [{"id": 1, "note": None}, {"id": 2, "note": "z"}]
    x = spark.createDataFrame([("k", [0.0, 0.5, -1.5])], "key string, x array<double>")
    made = sinks.encode_wav(x, "key", "x", 8000).first()
    samples, rate, bits = D.wav_samples(bytes(made["content"]))
    assert rate == 8000 and bits == 16 and np.allclose(samples[:, 0], [0, 0.5, -1], atol=1e-4)
    files = spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("b", "2026-01-01 00:59:00")], "path string, modified string").withColumn("modified", F.to_timestamp("modified"))
    assert [r["path"] for r in sinks.expired(files, "2026-01-01 01:00:00", 600).collect()] == ["a"]


def test_files_and_configurations(spark, tmp_path):
    (tmp_path / "j").mkdir()
    for n in ("b", "a"):
        (tmp_path / "j" / f"{n}.json").write_text(json.dumps({"v": n}))
    assert [(r["name"], r["v"]) for r in tables.read_json(spark, str(tmp_path / "j"), "v string").collect()] == [("a", "a"), ("b", "b")]
    digests = {r["path"].rsplit("/", 1)[1]: r for r in tables.file_digests(spark, str(tmp_path / "j")).collect()}
    assert digests["a.json"]["size"] == 10 and len(digests["a.json"]["sha256"]) == 64
    (tmp_path / "c.yaml").write_text('top: 1\naudio:\n  rate: 48000  # Hz\n  name: "x"\n')
    got = tables.read_config(spark, str(tmp_path / "c.yaml"), ["audio"])
    assert str(got["audio"]["rate"]) == "48000" and got["audio"]["name"] == "x"
    assert tables._two_levels("a:\n  b: 1\n# c\nd: 2") == {"a": {"b": "1"}, "d": "2"}
    with pytest.raises(tables.SourceError):
        tables.read_config(spark, str(tmp_path / "c.yaml"), ["none"])
    assert D.tone(spark, seconds=0.01, rate=1000).count() == 10


def test_manifest_columns(spark):
    f = lambda *v: [F.lit(x) for x in v]
    assert one(spark, E.audio_path(*f("clean_control", "c", "m"))) == "c" and one(spark, E.audio_path(*f("controlled_mix", "c", "m"))) == "m"
    assert one(spark, E.primary_path(*f("c", ""))) == "c" and one(spark, E.primary_path(*f("c", "m"))) == "m"
    assert one(spark, E.input_warnings(*f(44100, 48000, 2, 1, 0.1, -70.0, 0.0))) == ["INPUT_RESAMPLED", "INPUT_STEREO_DOWNMIXED", "INPUT_CLIPPED", "INPUT_NEAR_SILENT"]
    assert one(spark, E.input_warnings(*f(48000, 48000, 1, 1, 0.0, -20.0, 0.1))) == []
    seg = lambda *s: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text")) for a, b, t in s])
    assert one(spark, E.complete_transcript(seg((0.0, 1.0, "x")))) and not one(spark, E.complete_transcript(seg((2.0, 1.0, "x"))))
    names = spark.createDataFrame([("m/model_12.ckpt",), ("m/model_96.ckpt.best",), ("m/epoch-120",), ("m/readme",)], "path string")
    assert E.latest_checkpoint(names).first()["path"] == "m/model_96.ckpt.best"


def test_manifest_joins_and_reports(spark):
    manifest = spark.createDataFrame([("s1", "a", 48000, 1, 2.0), ("s2", "b", 48000, 1, 2.0), ("s3", "c", 48000, 1, 2.0)], "sample_id string, path string, sample_rate int, channels int, duration_seconds double")
    measured = spark.createDataFrame([("a", 48000, 1, 2.0), ("b", 48000, 2, 2.0)], "path string, sample_rate int, channels int, duration_seconds double")
    assert {(r["sample_id"], r["code"]) for r in Q.match_measured(manifest, measured).collect()} == {("s2", "MANIFEST_AUDIO_META"), ("s3", "MANIFEST_UNREADABLE")}
    expected = spark.createDataFrame([("s1", "x", "mix"), ("s9", "b", "clean")], "sample_id string, path string, kind string")
    found = {r["sample_id"]: (r["kind"], r["found_by"]) for r in Q.match_expected(manifest.select("sample_id", "path"), expected).collect()}
    assert found == {"s1": ("mix", "sample_id"), "s2": ("clean", "path"), "s3": (None, "none")}
    wavs = spark.createDataFrame([("ok", "mix", 48000, 1, 16, 3.0, 0.5, -20.0, 0.0, False), ("bad", "noise", 44100, 2, 8, 3.0, 0.0, None, 0.0, True), ("hot", "clean", 48000, 1, 16, 3.0, 0.9, -9.0, 0.0, False)], "path string, kind string, sample_rate int, channels int, bits int, duration_seconds double, peak double, rms_dbfs double, clipped double, truncated boolean")
    issues = Q.wav_issues(wavs)
    codes = {(r["path"], r["code"]) for r in issues.collect()}
    assert {("bad", c) for c in ("WAV_SAMPLE_RATE", "WAV_CHANNELS", "WAV_BIT_DEPTH", "WAV_DURATION", "WAV_TRUNCATED", "WAV_SILENT")} <= codes and ("hot", "WAV_CLEAN_PEAK_HIGH") in codes and not any(p == "ok" for p, _ in codes)
    r = Q.report(issues, 3, wavs).first()
    assert (r["expected"], r["checked"], r["warnings"], r["ok"]) == (3, 3, 1, False)
    assert Q.repeated(spark.createDataFrame([(1,), (1,), (2,)], "k int"), "k").collect()[0]["n"] == 2
    assert one(spark, Q.preview(F.array(*map(F.lit, "abcdefg")), 5)) == "a, b, c, d, e (+2)"
    rows = spark.createDataFrame([(k, i) for k in "ab" for i in range(5)], "k string, i int")
    assert sorted(r["i"] for r in Q.latest_by(rows, "k", "i", 2).collect()) == [3, 3, 4, 4]


def test_signal_columns(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, G.downmix(F.array(arr(1, 2), arr(3, 6)))) == [2.0, 4.0]
    assert one(spark, G.fit_length(arr(1, 2, 3), 2)) == [1.0, 2.0] and one(spark, G.fit_length(arr(1), 3)) == [1.0, 0.0, 0.0]
    c = one(spark, G.common_range(arr(1, -2, 9), arr(3, 1)))
    assert (c["a"], c["b"], c["top"]) == ([1.0, -2.0], [3.0, 1.0], 3.0)
    raw = spark.createDataFrame([("k", 0, 1), ("k", 1, 2)], "key string, block int, x int")
    assert B.align(raw, raw.where("block = 1").withColumnRenamed("x", "y"), "key", "block").collect()[0]["y"] == 2
    assert B.effective_interval("manual", 3) is None and B.effective_interval("active", 3) == 5.0 and B.effective_interval("other", 20) == 20
    assert one(spark, M.distance(F.lit("kitten"), F.lit("sitting"))) == 3


def test_lineage_and_text(spark):
    row = F.struct(F.lit(1).alias("a"), F.lit(None).cast("string").alias("b"))
    assert one(spark, L.canonical(row)) == '{"a":1,"b":null}'
    assert one(spark, T.escape_markdown(F.lit("*a_ [b](c)!"))) == r"\*a\_ \[b\]\(c\)\!"
    t = lambda rows: L.identity(spark.createDataFrame(rows, "id int, a string, b string"), "id", "a", "b").first()
    assert t([(1, "a,b", None)])["identity"] != t([(1, "a", "b")])["identity"] and t([(1, "x", "y"), (2, "z", None)]) == t([(2, "z", None), (1, "x", "y")])
    assert t([])["n"] == 0
    for text, n in (("语音 of the thing", 6), ("plain words 3.5", 3), ("", 0)):
        assert one(spark, T.token_count(F.lit(text))) == len(one(spark, T.tokens(F.lit(text)))) == n


def test_session_rows(spark):
    turns = spark.createDataFrame([(1, " hi\x00there ", "SELF_MIC", "boss", 1.7), (2, "  ", "x", "self", 0.5), (3, "key sk-abcdefgh1234", None, "Self", None)], "turn int, text string, source string, speaker_role string, speaker_confidence double")
    got = [tuple(r)[1:] for r in S.clean_turns(turns).orderBy("turn").collect()]
    assert got[0] == ("hi there", "self_mic", "unknown", 1.0) and got[1][0] == "key [密钥]" and len(got) == 2
    s = one(spark, S.set_section(F.lit(9).cast("long"), F.lit(2).cast("long")))
    assert (s["current"], s["started"], s["completed"]) == (2, [2], [0, 1])


def test_ingestion_is_all_or_nothing(spark):
    files = lambda rows: spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary")
    good = [("d/b.txt", "第一段。\n\n第二段".encode()), ("d/a.txt", "第一段。\n\n第二段".encode()), ("d/c.md", b"# T\nbody text")]
    new, chunks, problems = MT.ingest(files(good))
    docs = {r["name"]: r for r in new.collect()}
    assert set(docs) == {"a.txt", "c.md"} and docs["a.txt"]["kind"] == "txt" and docs["a.txt"]["chunk_count"] == 2 and problems.count() == 0
    assert {r["document_id"] for r in chunks.collect()} == {r["document_id"] for r in docs.values()}
    again, _, _ = MT.ingest(files(good), new)
    assert again.count() == 0
    for bad, reason in ((("x.exe", b"1"), "suffix"), (("x.txt", b""), "empty"), (("x.txt", None), "empty"), (("x.docx", b"no zip"), "unreadable")):
        new2, chunks2, why = MT.ingest(files([*good, bad]))
        assert [tuple(r) for r in why.collect()] == [(bad[0], reason)] and new2.count() == chunks2.count() == 0
    _, _, why = MT.ingest(files(good), max_files=1)
    assert [r["reason"] for r in why.collect()] == ["files"]
    _, _, why = MT.ingest(files(good), max_chars=5)
    assert {r["reason"] for r in why.collect()} == {"chars"}
    _, _, why = MT.ingest(files(good), max_bytes=3)
    assert {r["reason"] for r in why.collect()} == {"size"}


def test_request_tasks(spark):
    f = lambda t, left, after, close: one(spark, MT.task(F.lit(t), F.array(*map(F.lit, left)).cast("array<string>"), F.lit(after), F.lit(close)))
    assert f("question", [], "", False) == "answer" and f("manual_next", ["p"], "n", True) == "continue" and f("manual_next", [], "n", True) == "transition"
    assert f("manual_next", [], "", True) == "close" and f("manual_next", [], "", False) == "supplement"
    assert f("next_line", ["p"], "", False) == "prompt_continue" and f("next_line", [], "n", False) == "prompt_transition" and f("next_line", [], "", True) == "prompt"
    assert f("manual", ["p"], "n", True) == "decide"
