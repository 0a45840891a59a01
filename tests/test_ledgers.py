"""Ledgers, fingerprints, batches of files, maps of many sections, formats."""

import hashlib
import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import lineage as L
from corvane.operators import evaluation as E
from corvane.operators import meeting as MT
from corvane.operators import quality as Q
from corvane.operators import retrieval as R
from corvane.sources import formats, sinks

LEDGER = "asset_id string, source_original_path string, relative_path string, consent_status string, source_original_sha256 string, standardized_sha256 string, line int"
H, G = "ab" * 32, "cd" * 32


def consent(spark, rows):
    expected = spark.createDataFrame([("a", "/r/std/a.wav", H), ("b", "std/b.wav", G)], "asset_id string, path string, sha256 string")
    originals = spark.createDataFrame([("/r/source_original/a.wav", H), ("source_original/b.wav", G.upper())], "path string, sha256 string")
    ledger = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], LEDGER)
    return sorted(tuple(x) for x in Q.consent_problems(ledger, expected, originals, "/r").collect())


def test_consent_ledger_covers_exactly(spark):
    a = ("a", "source_original/a.wav", "std/a.wav", "yes", H.upper(), H)
    b = (" b ", "/r/x/../source_original/b.wav", "./std//b.wav", " Yes", G, G)
    assert consent(spark, [a, b]) == []
    assert consent(spark, []) == [("a", "ASSET_MISSING"), ("b", "ASSET_MISSING")]
    assert consent(spark, [a, a, b]) == [("a", "ASSET_REPEATED")]
    assert consent(spark, [a, b, (None, *a[1:]), ("z", *a[1:])]) == [("", "ASSET_BLANK"), ("z", "ASSET_UNEXPECTED")]
    bad = ("b", None, None, None, None, None)
    assert [c for _, c in consent(spark, [a, bad])] == ["CONSENT", "PATH", "SOURCE_BLANK", "SOURCE_DIGEST", "STANDARD_DIGEST"]
    for path, why in (("source_original/../a.wav", "SOURCE_OUTSIDE"), ("/r/source_originals/a.wav", "SOURCE_OUTSIDE"), ("source_original/c.wav", "SOURCE_MISSING")):
        assert consent(spark, [("a", path, *a[2:]), b]) == [("a", why)]
    assert consent(spark, [(*a[:4], G, G), b]) == [("a", "SOURCE_CHANGED"), ("a", "STANDARD_CHANGED")]


def test_licences_take_the_last_record(spark):
    tracked = spark.createDataFrame([("x", H), ("y", H), ("gone", None), ("z", H), ("x", H)], "path string, sha256 string")
    records = spark.createDataFrame([("x", "no", G, 1), ("x", "yes", H, 2), ("y", "YES", G, 3), ("gone", "yes", H, 4), (None, "yes", H, 5)], "path string, public string, sha256 string, line int")
    assert sorted(map(tuple, Q.licence_problems(tracked, records).collect())) == [("gone", "FILE_MISSING"), ("y", "DIGEST"), ("y", "NOT_PUBLIC"), ("z", "NO_RECORD")]


def test_fingerprints_fail_closed(spark):
    runs = spark.createDataFrame([(1, "m", H, G), (2, "m", G, None), (3, "n", H, G), (4, None, H, G)], "run int, model string, config string, weights string")
    expected = spark.createDataFrame([("m", f" {H.upper()} ", G), ("n", None, "")], "model string, config string, weights string")
    got = sorted(map(tuple, Q.fingerprint_problems(runs, expected, "run", "model", ["config", "weights"]).collect()))
    empty = [(r, f, "EXPECTATION_EMPTY") for r in (3, 4) for f in ("config", "weights")]
    assert got == [(2, "config", "MISMATCH"), (2, "weights", "MISMATCH"), *empty]


def test_code_fingerprint_is_of_paths_and_bytes(spark):
    files = spark.createDataFrame([("u", "b.py", bytearray(b"two\x00")), ("u", "a.py", bytearray(b"")), ("u", "other", bytearray(b"x")), ("v", "other", bytearray(b"y")), ("w", "a.py", None)], "bundle string, path string, content binary")
    got = {x[0]: x[1] for x in L.code_fingerprint(files, "bundle", ["b.py", "a.py"]).collect()}
    none = hashlib.sha256(b"b.py\0<missing>\0a.py\0<missing>\0").hexdigest()
    assert got == {"u": hashlib.sha256(b"b.py\0two\0\0a.py\0\0").hexdigest(), "v": none, "w": none}


def test_batches_are_judged_by_themselves(spark):
    rows = [(1, "a.txt", b"same text"), (1, "b.txt", b"same text"), (2, "a.txt", b"same text"), (2, "bad.exe", b"1"), (3, "c.md", b"# T\nbody"), (None, "d.txt", b"x"), (4, "e.txt", b"one"), (4, "f.txt", b"two"), (4, "g.txt", b"three")]
    files = spark.createDataFrame([(s, p, bytearray(c)) for s, p, c in rows], "session long, path string, content binary")
    new, chunks, problems = MT.ingest_all(files, "session", max_files=2)
    assert sorted((r["session"], r["name"], r["chunk_count"]) for r in new.collect()) == [(1, "a.txt", 1), (3, "c.md", 1)]
    assert sorted(map(tuple, problems.collect())) == [(2, "bad.exe", "suffix"), (4, "", "files")]
    one, many = MT.ingest(files.where("session = 1").drop("session"))[:2], [t.where("session = 1").drop("session") for t in (new, chunks)]
    assert all(sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect())) for a, b in zip(one, many, strict=True))
    again, _, why = MT.ingest_all(files.where("session IN (1, 3, 4)"), "session", new.withColumn("session", F.lit(4).cast("long")).union(new), max_files=4)
    assert again.count() == 0 and sorted(map(tuple, why.collect())) == [(4, "", "files")]
    assert all(t.count() == 0 for t in MT.ingest_all(files.limit(0), "session"))


def test_map_of_all_sections_is_that_of_each(spark):
    r = random.Random(5)
    words = ["latency", "risk", "budget", "index", "plan", "延迟", "预算", "风险", "build", "the"]
    heads = ["Latency · 第 1 行", "正文 · 第 2 行", "预算与风险 · 第 3 行", "Build plan · 第 4 行", "段落 3"]
    chunks = spark.createDataFrame([(f"c{i}", f"d{i % 4}", r.choice(heads), "".join(" ".join(r.choices(words, k=r.randint(3, 9))) + r.choice("。！；") for _ in range(r.randint(1, 6)))) for i in range(60)], "chunk_id string, document_id string, locator string, text string")
    agenda = ["latency risk", "开场：说明；目标", "预算和风险", " ", "Build plan/index", "nothing here zzz"]
    got = {x["section"]: x for x in MT.meeting_map(spark, agenda, [], chunks).collect()}
    assert sorted(got) == [0, 1, 2, 4, 5] and got[1]["points"] == ["说明", "目标"] and got[5]["points"] == ["nothing here zzz"]
    for i in (0, 2, 4):
        hits = R.retrieve(chunks, agenda[i], top_k=10, max_chars=8000).select("chunk_id", F.col("excerpt").alias("text"), F.substring("ref_id", 2, 9).cast("int").alias("ordinal"))
        points = R.section_points(hits.join(chunks.select("chunk_id", "locator"), "chunk_id"), agenda[i]).orderBy("point").collect()
        assert points and got[i]["points"] == [p["text"] for p in points]
    (focus,) = MT.meeting_map(spark, [], ["甲", "乙"], chunks).collect()
    assert focus["title"] == "会议重点" and focus["points"] == ["甲", "乙"]
    assert MT.meeting_map(spark, [], [], chunks).count() == 0


def test_fixed_matrix(spark):
    m = E.matrix(spark)
    assert m.count() == 27 and m.groupBy("speaker", "snr").agg(F.count_distinct("noise").alias("n")).where("n <> 3").count() == 0
    files = {x["path"] for x in E.artifacts(spark).collect()}
    assert len(files) == 42 and {"controlled/locked_test/mix_spkA_s03_traffic_snrm05.wav", "raw/real/real_spkB_fan_r01.wav", "controlled/dev/mix_spkC_s02_fan_snr000.wav"} <= files


def test_formats(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "w" / "deep").mkdir(parents=True)
    tone = [((i * 37) % 200 - 100) / 128 for i in range(400)]
    whole = sinks.wav_bytes(np.asarray(tone), 16_000)
    for i in range(30):
        (tmp_path / "w" / ("deep" if i % 2 else "") / f"t{i:02d}.wav").write_bytes(whole)
    (tmp_path / "w" / "cut.wav").write_bytes(whole[:-10])
    (tmp_path / "w" / "junk.wav").write_bytes(b"junk")
    (tmp_path / "w" / "note.txt").write_bytes(b"text")
    wav = spark.read.format("corvane_wav").option("pattern", "*.wav").option("partbytes", 4 * len(whole)).load(str(tmp_path / "w"))
    assert wav.rdd.getNumPartitions() == 8
    got = {x["path"].rsplit("/", 1)[1]: x for x in wav.collect()}
    assert len(got) == 32 and got["cut.wav"]["problem"] == "empty or truncated" and got["junk.wav"]["problem"].startswith("no plain WAV") and got["junk.wav"]["samples"] is None
    t = got["t07.wav"]
    assert (t["sample_rate"], t["channels"], t["bits"], t["frames"], t["problem"]) == (16_000, 1, 16, 400, None) and max(abs(a - b) for a, b in zip(t["samples"][0], tone, strict=True)) < 1e-4
    heads = spark.read.format("corvane_wav").schema("frames long, path string, problem string").option("pattern", "*.wav").load(str(tmp_path / "w"))
    assert {(x["path"].rsplit("/", 1)[1], x["frames"], (x["problem"] or "")[:8]) for x in heads.collect()} == {(n, x["frames"], (x["problem"] or "")[:8]) for n, x in got.items()}
    with pytest.raises(Exception, match="no_such"):
        spark.read.format("corvane_wav").load(str(tmp_path / "no_such")).count()
    assert [len(p.files) for p in formats.dealt([("c", 5), ("a", 9), ("b", 1)], 6)] == [1, 2]

    (tmp_path / "o").mkdir()
    assert spark.read.format("corvane_office").load(str(tmp_path / "o")).count() == 0
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", '<d xmlns:w="w"><w:p><w:t>one</w:t></w:p><w:p/><w:p><w:t>two</w:t></w:p></d>')
    (tmp_path / "o" / "a.docx").write_bytes(raw.getvalue())
    (tmp_path / "o" / "b.pptx").write_bytes(b"none")
    office = spark.read.format("corvane_office").load(str(tmp_path / "o")).collect()
    assert [(x["unit"], x["locator"], x["text"]) for x in office if x["path"].endswith("a.docx")] == [(1, "段落 1", "one"), (2, "段落 3", "two")]
    assert [x["problem"] for x in office if x["path"].endswith("b.pptx")] == ["no archive"]
