"""Paths, media, converters, pair lists and functions that a caller gives."""

import io
import posixpath
import random
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import paths as P
from corvane.operators import hooks as HK
from corvane.operators import metrics as M
from corvane.sources import media as MD
from corvane.sources import sinks as K
from corvane.sources import tables as B


def test_paths_against_the_standard_library(spark):
    r = random.Random(3)
    given = ["/".join(r.choice(["a", "b", "..", ".", "", "data", "x.wav"]) for _ in range(r.randint(0, 7))) for _ in range(300)] + ["/", "//a", "/..", "..", "", "/data", "/database/x", None]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, p string").coalesce(1)
    c = F.col("p")
    out = df.select("p", P.normal(c).alias("n"), P.resolved(F.lit("/srv/data"), c).alias("r"), P.in_folder(F.lit("/srv/data"), c).alias("f")).collect()
    for x in out:
        p = x["p"]
        if p is None:
            assert x["n"] is None and x["f"] is None
            continue
        norm = lambda s: posixpath.normpath(s).replace("//", "/") if s else "."  # noqa: E731  POSIX lets two leading slashes stand
        assert x["n"] == norm(p), p
        full = norm(posixpath.join("/srv/data", p))
        assert x["r"] == full, p
        own = p[4:].lstrip("/") or "." if p == "data" or p.startswith("data/") else p
        at = norm(posixpath.join("/srv/data", own))
        want = None if not p.strip() or not (at == "/srv/data" or at.startswith("/srv/data/")) else posixpath.relpath(at, "/srv/data")
        assert x["f"] == want, p


def wav(**more):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(more.get("channels", 1))
        w.setsampwidth(more.get("width", 2))
        w.setframerate(more.get("rate", 48_000))
        w.writeframes(b"\x01\x02" * 64)
    return out.getvalue()


def chunked(*parts):
    body = b"WAVE" + b"".join(n + struct.pack("<I", len(c)) + c + b"\0" * (len(c) % 2) for n, c in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def png(*parts, mark=MD.PNG_MARK):
    return mark + b"".join(struct.pack(">I", len(c)) + n + c + struct.pack(">I", zlib.crc32(n + c)) for n, c in parts)


FMT, DATA = (b"fmt ", struct.pack("<HHIIHH", *MD.WAV_FORM)), (b"data", b"ab" * 20)
HEAD = (b"IHDR", struct.pack(">IIBBBBB", 8, 4, 8, 0, 0, 0, 0))
PIXELS, END = zlib.compress(bytes(9 * 4)), (b"IEND", b"")


@pytest.mark.parametrize(
    ("kind", "data", "rule"),
    [
        ("wav", wav(), None), ("wav", wav(channels=2), "format"), ("wav", wav(rate=16_000), "format"), ("wav", wav(width=1), "format"), ("wav", wav()[:-1], "length"), ("wav", wav() + b"x", "length"), ("wav", b"", "size"), ("wav", b"RIFX" + wav()[4:], "form"),
        ("wav", chunked(FMT, (b"LIST", b"abc"), DATA), None), ("wav", chunked(DATA, FMT), "order"), ("wav", chunked(FMT, FMT, DATA), "repeated"), ("wav", chunked(FMT, (b"data", b"")), "frames"), ("wav", chunked(FMT, (b"data", b"abc")), "frames"), ("wav", chunked(FMT, (b"LIST", b"a" * 20)), "missing"),
        ("wav", chunked(FMT, (b"junk", b"a" * 5000), DATA), "header"), ("wav", chunked(FMT, DATA)[:20] + struct.pack("<I", 999) + chunked(FMT, DATA)[24:], "format"),
        ("png", png(HEAD, (b"IDAT", PIXELS), END), None), ("png", png(HEAD, (b"tEXt", b"k"), (b"IDAT", PIXELS[:5]), (b"IDAT", PIXELS[5:]), (b"tEXt", b"k"), END), None), ("png", png(HEAD, (b"IDAT", PIXELS), END) + b"\0", "chunk"), ("png", png(HEAD, (b"IDAT", PIXELS)), "end"), ("png", png((b"IDAT", PIXELS), HEAD, END), "header"),
        ("png", png(HEAD, (b"IDAT", PIXELS[:5]), (b"tEXt", b"k"), (b"IDAT", PIXELS[5:]), END), "pixels"), ("png", png(HEAD, (b"ABCD", b""), (b"IDAT", PIXELS), END), "unknown"), ("png", png(HEAD, (b"PLTE", b"abc"), (b"IDAT", PIXELS), END), "palette"), ("png", png(HEAD, (b"IDAT", zlib.compress(bytes(35))), END), "packed"),
        ("png", png(HEAD, (b"IDAT", PIXELS + b"x"), END), "packed"), ("png", png(HEAD, (b"IDAT", b"not packed" * 3), END), "packed"), ("png", png(HEAD, (b"IDAT", zlib.compress(b"\x05" * 36)), END), "filter"), ("png", png(HEAD, (b"IDAT", PIXELS), END).replace(b"IEND", b"IENd"), "checksum"),
        ("png", png((b"IHDR", struct.pack(">IIBBBBB", 99_999, 4, 8, 0, 0, 0, 0)), (b"IDAT", PIXELS), END), "header"), ("png", png((b"IHDR", struct.pack(">IIBBBBB", 8, 4, 8, 3, 0, 0, 0)), (b"IDAT", PIXELS), END), "palette"), ("png", png(HEAD, (b"IDAT", PIXELS), END, mark=b"\x89PNG\n\n\n\n"), "form"), ("gif", b"GIF89a", "kind"), ("wav", None, "size"),
    ],
)
def test_media_rules(kind, data, rule):
    assert MD.media_problem(kind, data) == rule


def test_media_files(spark):
    rows = spark.createDataFrame([(i, [0.1 * i, -0.5, 1.0, 0.0]) for i in range(3)], "i int, x array<double>")
    files = K.encode_wav(rows, "i", "x").withColumn("kind", F.lit("wav")).unionByName(K.encode_png(rows, "i", "x", 2).withColumn("kind", F.lit("png")))
    out = MD.check_media(files.unionByName(spark.createDataFrame([(9, None, "wav")], "i int, content binary, kind string")), "i").collect()
    assert sorted((x["i"], x["kind"], x["problem"]) for x in out if x["i"] < 9) == sorted((i, k, None) for i in range(3) for k in ("wav", "png"))
    assert [(x["bytes"], x["problem"]) for x in out if x["i"] == 9] == [(0, "size")]
    assert MD.png_bytes(bytes(16), 4).startswith(MD.PNG_MARK) and np.frombuffer(MD.png_bytes(bytes(16), 4), np.uint8).size > 45


def test_converter_takes_the_longest_phrase(spark, tmp_path):
    (tmp_path / "phrases.txt").write_text("# phrases\n頭髮\t头发\n發\t发 髮\n後來\t后来\n皇后\t皇后\n\nbroken\n後\t后\nabcd\tX\nab\tY\n", encoding="utf-8")
    (tmp_path / "characters.txt").write_text("頭\t头\n髮\t发\n發\t別\n來\t来\n", encoding="utf-8")
    convert = M.read_converter(spark, str(tmp_path / "phrases.txt"), str(tmp_path / "characters.txt"))
    assert convert("頭髮後來發abcdabc後") == "头发后来发XYc后" and convert("") == "" and convert("皇后") == "皇后"
    r = random.Random(4)
    table = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))): r.choice("xyz") for _ in range(25)}
    for _ in range(300):
        text, want, at = "".join(r.choice("abcd") for _ in range(r.randint(0, 20))), "", 0
        while at < len(text):
            n = next((n for n in (4, 3, 2, 1) if text[at : at + n] in table and at + n <= len(text)), 0)
            want += table[text[at : at + n]] if n else text[at]
            at += n or 1
        assert M.Converter(table)(text) == want
    rows = spark.createDataFrame([("頭髮", "头发")], "reference string, hypothesis string")
    assert M.normalize_text("頭髮！", convert) == "头发" and rows.count() == 1


def test_pair_lists(spark, tmp_path):
    path = f"{tmp_path}/lists/pairs.csv"
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists/pairs.csv").write_text("﻿sample_id,original_path,enhanced_path\ns1,../raw/./a.wav,/abs//b.wav\ns2,a.wav,x/../b.wav\n", encoding="utf-8")
    assert sorted(map(tuple, B.read_pairs(spark, path).collect())) == [("s1", f"{tmp_path}/raw/a.wav", "/abs/b.wav"), ("s2", f"{tmp_path}/lists/a.wav", f"{tmp_path}/lists/b.wav")]
    (tmp_path / "lists/blank.csv").write_text("sample_id,original_path,enhanced_path\n ,a,b\n", encoding="utf-8")
    with pytest.raises(B.SourceError):
        B.read_pairs(spark, f"{tmp_path}/lists/blank.csv")


def test_detectors_keep_their_contract(spark):
    bad = [("a", 0.5, 0.0, 1.0), ("b", 1.5, 0, 1), ("c", 0.5, 2, 1), ("d", float("nan"), 0, 1), (" ", 0.5, 0, 1), ("e", True, 0, 1), ("f", "0.5", 0, 1), ("g", 0.5, -1, 1), (1, 0.5, 0, 1), ("h", 0.5, 0), 7, ("i", 1, 0, 0), ("j", 10**400, 0, 1)]
    faults = [None, "range", "range", "number", "label", "number", "number", "range", "label", "shape", "shape", None, "number"]
    assert [HK.checked_event(x)[4] for x in bad] == faults
    df = spark.createDataFrame([(1, [0.5, 0.7]), (2, []), (3, None), (4, [9.0])], "i int, x array<double>")

    def detector(x, labels, least):
        if x is None:
            raise RuntimeError("none")
        for v in x:
            yield labels[0], v, 0.0, least

    got = sorted((r["i"], r["label"], r["score"], r["fault"]) for r in HK.detect(df, "x", detector, ["bang"], least=2.0).collect())
    assert got == [(1, "bang", 0.5, None), (1, "bang", 0.7, None), (3, None, None, "raised: RuntimeError"), (4, "bang", 9.0, "range")]


def test_processed_samples_are_strict_json(spark):
    df = spark.createDataFrame([(i, float(i), "ä") for i in range(6)], "i int, x double, s string")

    def function(row):
        if row["i"] == 5:
            raise KeyError
        return [{"status": "success", "s": row["s"]}, {"status": "odd"}, {"status": "partial", "x": float("inf")}, None, {"status": "failed", "x": {"deep": [1]}}][row["i"]]

    out = [tuple(x) for x in HK.process(df, "i", ["i", "s"], function).orderBy("i").collect()]
    assert out == [(0, "success", '{"s":"ä","status":"success"}', None), (1, "failed", None, "status"), (2, "failed", None, "json"), (3, "failed", None, "mapping"), (4, "failed", '{"status":"failed","x":{"deep":[1]}}', None), (5, "failed", None, "raised: KeyError")]
