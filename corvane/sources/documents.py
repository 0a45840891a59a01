"""Document scans: text and Markdown units as plans, office files by an Arrow-batched reader, WAV samples."""

from __future__ import annotations

import io
import posixpath
import re
import wave
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

MAX_ENTRIES, MAX_INFLATED, MAX_RATIO, MAX_PAGES = 5000, 100 << 20, 100, 500
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _lines(files: DataFrame) -> DataFrame:
    """(document_id, line, value) of text files (document_id, text); a byte-order mark and one line end at the end go."""
    body = F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), f"(?:{LINE_ENDS})$", "")
    return files.where(~F.col("text").contains("\x00")).select("document_id", F.posexplode(F.split(body, LINE_ENDS, -1)).alias("line", "value")).withColumn("line", F.col("line") + 1)


def text_units(files: DataFrame) -> DataFrame:
    """(document_id, unit, locator, text): paragraphs between blank lines, with the lines they span. Files with NULs are refused."""
    rows = _lines(files).withColumn("blank", (T.clean(F.col("value")) == "").cast("int"))
    rows = rows.withColumn("island", F.sum("blank").over(W.partitionBy("document_id").orderBy("line"))).where("blank = 0")
    return _units(rows, F.concat(F.lit("第 "), F.min("line").cast("string"), F.lit("-"), F.max("line").cast("string"), F.lit(" 行")))


def markdown_units(files: DataFrame) -> DataFrame:
    """(document_id, unit, locator, text): a section for each heading, the heading's line included; before the first, the body."""
    heading = r"(?U)^\s{0,3}(#{1,6})\s+(.+?)\s*$"
    rows = _lines(files).withColumn("head", F.when(F.col("value").rlike(heading), T.clean(F.regexp_extract("value", heading, 2))))
    rows = rows.withColumn("island", F.count("head").over(W.partitionBy("document_id").orderBy("line")))
    name = F.coalesce(F.max("head"), F.lit("正文"))
    return _units(rows, F.concat(name, F.lit(" · 第 "), F.min("line").cast("string"), F.lit("-"), F.max("line").cast("string"), F.lit(" 行")))


def _units(rows: DataFrame, locator) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n")
    out = rows.groupBy("document_id", "island").agg(F.min("line").alias("unit"), locator.alias("locator"), T.clean(text).alias("text")).where("text <> ''")
    return out.select("document_id", "unit", "locator", "text")


class Refused(ValueError):
    """A file that isn't safe or isn't what its suffix says."""


def _archive(content: bytes, prefix: str) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Refused("no archive") from e
    infos = z.infolist()
    names = {i.filename for i in infos}
    rules = [
        (len(infos) > MAX_ENTRIES, "too many entries"),
        (sum(i.file_size for i in infos) > MAX_INFLATED, "too large inflated"),
        (any(i.filename.startswith(("/", "\\")) or ".." in posixpath.normpath(i.filename).split("/") or ".." in i.filename.split("/") for i in infos), "unsafe path"),
        (any(i.compress_size and i.file_size / i.compress_size > MAX_RATIO for i in infos), "suspicious ratio"),
        ("[Content_Types].xml" not in names or not any(n.startswith(prefix) for n in names), "wrong kind"),
    ]
    for bad, why in rules:
        if bad:
            raise Refused(why)
    return z


def _texts(root: ElementTree.Element) -> str:
    found = [n.text for n in root.iter() if n.tag.endswith("}t") and n.text and n.text.strip()]
    return " ".join(" ".join(found).replace("\0", " ").split())


def _slides(z: zipfile.ZipFile) -> list[str]:
    """Names of slides, as the presentation lists them; by number where it can't be read."""
    names = set(z.namelist())
    try:
        targets = {n.get("Id"): n.get("Target", "") for n in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels")).iter() if n.tag.endswith("}Relationship")}
        wanted = [next((v for k, v in n.attrib.items() if k.endswith("}id")), None) for n in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter() if n.tag.endswith("}sldId")]
    except (KeyError, ElementTree.ParseError):
        targets, wanted = {}, []
    listed = []
    for i in wanted:
        t = (targets.get(i) or "").lstrip("/")
        t = t if t.startswith("ppt/") else posixpath.normpath(posixpath.join("ppt", t)) if t else ""
        if t in names and t.startswith("ppt/slides/"):
            listed.append(t)
    numbered = sorted((int(m[1]), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    return listed or [n for _, n in numbered]


def office_units(content: bytes, suffix: str) -> tuple[list[tuple[str, str]], list[str]]:
    """Units (locator, text) and warnings of an office file's bytes; Refused if it can't be read."""
    if suffix == ".pptx":
        with _archive(content, "ppt/") as z:
            names = _slides(z)
            if not names:
                raise Refused("no slides")
            parts = []
            for n in names:
                try:
                    parts.append(_texts(ElementTree.fromstring(z.read(n))))
                except ElementTree.ParseError:
                    parts.append("")
        return [(f"幻灯片 {i}", t) for i, t in enumerate(parts, 1) if t], [f"幻灯片 {i} 没有可提取文本。" for i, t in enumerate(parts, 1) if not t]
    if suffix == ".docx":
        with _archive(content, "word/") as z:
            try:
                root = ElementTree.fromstring(z.read("word/document.xml"))
            except (KeyError, ElementTree.ParseError) as e:
                raise Refused("no readable body") from e
        units = [(f"段落 {i}", t) for i, p in enumerate((n for n in root.iter() if n.tag.endswith("}p")), 1) if (t := _texts(p))]
        return units, [] if units else ["Word 文件中没有可提取文本。"]
    if suffix == ".pdf":
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise Refused("pypdf is not installed") from e
        try:
            reader = PdfReader(io.BytesIO(content))
            closed = reader.is_encrypted and not reader.decrypt("")
            pages = [] if closed else list(reader.pages)
        except Exception as e:  # whatever a broken file makes the reader raise
            raise Refused("not readable") from e
        if closed or len(pages) > MAX_PAGES:
            raise Refused("encrypted or too long")
        units, warnings = [], []
        for i, page in enumerate(pages, 1):
            try:
                text = " ".join((page.extract_text() or "").split())
            except Exception:  # a broken page is a warning, not the end of the file
                warnings.append(f"第 {i} 页无法提取文本。")
                continue
            units += [(f"第 {i} 页", text)] if text else []
            warnings += [] if text else [f"第 {i} 页没有可提取文本，可能需要 OCR。"]
        return units, warnings
    raise Refused("unknown suffix")


def read_office(files: DataFrame) -> DataFrame:
    """(document_id, unit, locator, text, problem) of office files (document_id, suffix, content); a refused file or a warning is a row with a problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, s, c in zip(b["document_id"], b["suffix"], b["content"], strict=True):
                try:
                    units, warnings = office_units(bytes(c), s)
                    out += [(d, i, where, t, None) for i, (where, t) in enumerate(units, 1)]
                    out += [(d, 0, "", "", w) for w in warnings]
                except Refused as e:
                    out.append((d, 0, "", "", f"refused: {e}"))
            yield pd.DataFrame(out, columns=["document_id", "unit", "locator", "text", "problem"])

    return files.select("document_id", "suffix", "content").mapInPandas(run, "document_id string, unit int, locator string, text string, problem string")


def read_units(files: DataFrame) -> DataFrame:
    """Units of files (document_id, suffix, content) by suffix: text, Markdown, office."""
    plain = lambda s: files.where(F.col("suffix") == s).select("document_id", F.decode("content", "UTF-8").alias("text"))
    office = read_office(files.where(~F.col("suffix").isin(".txt", ".md"))).where("problem IS NULL").drop("problem")
    return text_units(plain(".txt")).unionByName(markdown_units(plain(".md"))).unionByName(office)


def wav_samples(content: bytes) -> tuple[np.ndarray, int, int]:
    """Samples (frames, channels) as floats, rate and bits of a WAV file of 8, 16 or 32 bits; Refused otherwise."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            n, width, rate, channels = w.getnframes(), w.getsampwidth(), w.getframerate(), w.getnchannels()
            raw = w.readframes(n)
    except (wave.Error, EOFError) as e:
        raise Refused(f"no plain WAV: {e}") from e
    if not n or len(raw) != n * width * channels:
        raise Refused("empty or truncated")
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2 ** (8 * width - 1)
    else:
        raise Refused(f"{8 * width} bits")
    return x.reshape(n, channels), rate, 8 * width


def read_wav(files: DataFrame) -> DataFrame:
    """(path, sample_rate, channels, bits, samples: an array for each channel, problem) of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"], strict=True):
                try:
                    x, rate, bits = wav_samples(bytes(c))
                    out.append((p, rate, x.shape[1], bits, [list(map(float, ch)) for ch in x.T], None))
                except Refused as e:
                    out.append((p, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "sample_rate", "channels", "bits", "samples", "problem"])

    return files.select("path", "content").mapInPandas(run, "path string, sample_rate int, channels int, bits int, samples array<array<float>>, problem string")


def tone(spark, seconds: float = 12.0, rate: int = 48_000, seed: int = 7) -> DataFrame:
    """(i, sample): a chirp over seeded noise, made where it is used."""
    t = F.col("id") / rate
    chirp = 0.3 * F.sin(2 * np.pi * (200 * t + 50 * t * t))
    return spark.range(int(seconds * rate)).select(F.col("id").alias("i"), (chirp + 0.05 * F.randn(seed)).alias("sample"))
