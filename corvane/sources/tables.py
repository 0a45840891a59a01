"""Table scans: CSV manifests and ledgers, JSON files, WAV headers, key-value configurations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P

MANIFEST = [
    "sample_id", "dataset_version", "split", "speaker_id", "sentence_id", "reference_text", "reference_normalized", "source_type", "clean_path", "noise_path", "mixed_path", "noise_type", "noise_source",
    "consent_or_license", "snr_db", "mix_seed", "noise_offset_seconds", "mix_alpha", "final_gain", "sample_rate", "channels", "duration_seconds", "recording_device", "recording_distance_cm", "sha256",
    "is_demo_candidate", "is_locked", "notes",
]
LEDGER = [
    "asset_id", "source_type", "source_original_path", "relative_path", "speaker_id", "sentence_id", "noise_type", "recording_device", "recording_location", "recording_date", "recorder", "distance_cm",
    "consent_status", "source_original_sha256", "standardized_sha256", "notes",
]


class SourceError(ValueError):
    """A file that breaks its contract."""


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The names in a file's first line, without a byte-order mark."""
    first = spark.read.text(path, wholetext=False).limit(1).collect()
    if not first:
        raise SourceError(f"{path}: no header")
    row = spark.createDataFrame([(first[0][0].lstrip("\ufeff"),)], "value string")
    wide = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(first[0][0].count(sep) + 1)])
    cells = row.select(F.from_csv("value", wide.simpleString()[7:-1].replace(":", " "), {"sep": sep}).alias("r")).select("r.*").first()
    return [(c or "").strip() for c in cells]


def read_csv(spark: SparkSession, path: str, required: list[str], sep: str = ",", strict: bool = False) -> DataFrame:
    """All cells as text, stripped, null as empty; surplus cells of a row are dropped.

    A missing required column, a header that repeats a name, or an empty file is a SourceError. strict: rows that are too
    long or too short are one too, found by a pass over the file.
    """
    names = header(spark, path, sep)
    if len(set(names)) != len(names):
        raise SourceError(f"{path}: repeated columns")
    if missing := [c for c in required if c not in names]:
        raise SourceError(f"{path}: no columns {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_broken"]])
    rows = spark.read.csv(path, schema=schema, header=True, sep=sep, quote='"', escape='"', multiLine=True, enforceSchema=True, columnNameOfCorruptRecord="_broken", mode="PERMISSIVE", encoding="UTF-8")
    if strict:
        rows.cache()  # broken rows can only be looked for in parsed ones
        whole = rows.where("_broken IS NOT NULL").isEmpty()
        rows.unpersist()
        if not whole:
            raise SourceError(f"{path}: rows of the wrong length")
    return rows.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in names])


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, original_path, enhanced_path) of a pair list; relative paths start in the list's folder, all are in normal form.

    A blank sample_id is a SourceError.
    """
    rows = read_csv(spark, path, ["sample_id", "original_path", "enhanced_path"])
    if not rows.where("sample_id = ''").isEmpty():
        raise SourceError(f"{path}: a sample_id is blank")
    folder = F.lit(path.rpartition("/")[0] or ".")
    return rows.select("sample_id", *[P.resolved(folder, F.col(c)).alias(c) for c in ("original_path", "enhanced_path")])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """(name, ...) of JSON files of one object each, by name."""
    reader = spark.read.option("multiLine", True).option("allowNonNumericNumbers", False)
    rows = reader.schema(schema).json(path) if schema else reader.json(path)
    return rows.withColumn("name", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)).orderBy("name")


def parse_json(text, schema: str):
    """A struct, or null for text that is no JSON or has NaN or Infinity for a number."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', '""')
    return F.when(~bare.rlike(r"\b(?:NaN|-?Infinity)\b"), F.from_json(text, schema, {"allowNonNumericNumbers": "false"}))


def read_config(spark: SparkSession, path: str, required: list[str]) -> dict:
    """A YAML (where its library is installed) or JSON mapping of sections, read on the driver; two-level YAML needs no library."""
    text = "\n".join(r[0] for r in spark.read.text(path).collect())  # a configuration: a few lines
    try:
        import yaml
    except ImportError:
        data = json.loads(text) if text.lstrip().startswith("{") else _two_levels(text)
    else:
        data = yaml.safe_load(text)
    if not isinstance(data, dict) or any(not isinstance(data.get(k), dict) for k in required):
        raise SourceError(f"{path}: sections {required} are required")
    return data


def _two_levels(text: str) -> dict:
    out: dict = {}
    section = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        name, _, value = bare.strip().partition(":")
        value = value.strip().strip("\"'")
        if not bare.startswith(" "):
            section = out.setdefault(name, {}) if not value else None
            if value:
                out[name] = value
        elif section is not None:
            section[name] = value
    return out


def wav_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, channels, sample_rate, bits, data_bytes, duration_seconds, truncated) from each file's chunks, in the JVM.

    Of plain files (a 16-byte format chunk, then data); others have nulls, and read_wav() reads them.
    """
    raw = spark.read.format("binaryFile").load(path).select("path", "length", F.hex(F.substring("content", 1, 44)).alias("h"))

    def little(at: int, n: int):
        return F.conv(F.concat(*[F.substring("h", 2 * (at + n - 1 - i) + 1, 2) for i in range(n)]), 16, 10).cast("long")

    plain = (F.substring("h", 1, 8) == "52494646") & (F.substring("h", 17, 16) == "57415645666D7420") & (little(16, 4) == 16) & (F.substring("h", 73, 8) == "64617461") & (little(20, 2) == 1)
    c, r, b, d = little(22, 2), little(24, 4), little(34, 2), little(40, 4)
    there = F.least(d, F.col("length") - 44)
    out = {"channels": c, "sample_rate": r, "bits": b, "data_bytes": d, "duration_seconds": there / (r * c * b / 8), "truncated": d > F.col("length") - 44}
    return raw.select("path", *[F.when(plain, v).alias(k) for k, v in out.items()])
