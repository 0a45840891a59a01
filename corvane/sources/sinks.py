"""Sinks: tables in one fixed form, and writes that never replace what is there."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .media import png_bytes


def write_csv(rows: DataFrame, path: str, columns: list[str], sep: str = ",") -> None:
    """Columns in this order, with a header; nulls are empty."""
    rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).write.mode("overwrite").option("emptyValue", "").csv(path, header=True, sep=sep, escape='"')


def write_once(rows: DataFrame, path: str, form: str = "json") -> bool:
    """Write unless the path is there: True if it was written. Not atomic between two writers that start together."""
    try:
        rows.write.mode("errorifexists").format(form).save(path)
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" in str(e):
            return False
        raise
    return True


def write_if_absent(rows: DataFrame, path: str, form: str = "csv") -> None:
    """A template: what is there stays."""
    rows.write.mode("ignore").format(form).option("header", True).save(path)


def write_partitioned(rows: DataFrame, path: str, *keys: str) -> None:
    """JSON in a folder for each key; only the partitions that rows have are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(path)


def as_json_array(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """One row: the rows as a JSON array in order, keys sorted. For manifests, which are small."""
    row = F.struct(*[F.col(c) for c in sorted(columns)])
    return rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))), lambda x: x["r"]), {"ignoreNullFields": "false"}).alias("json"))


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A mono 16-bit WAV file of samples within -1 to 1, cut toward zero."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def encode_wav(rows: DataFrame, key: str, samples: str, rate: int = 48_000) -> DataFrame:
    """(key, content): each row's samples as a WAV file's bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "content": [wav_bytes(np.asarray(x, float), rate) for x in b[samples]]})

    return rows.select(key, samples).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, content binary")


def encode_png(rows: DataFrame, key: str, samples: str, width: int) -> DataFrame:
    """(key, content): each row's samples, from -1 to 1, as a grey picture of so many columns; what doesn't fill a line goes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pixels = [((np.clip(np.asarray(x, float), -1, 1) + 1) * 127.5).astype(np.uint8)[: len(x) // width * width].tobytes() for x in b[samples]]
            yield pd.DataFrame({key: b[key], "content": [png_bytes(p, width) for p in pixels]})

    return rows.select(key, samples).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, content binary")


def expired(files: DataFrame, now: str, seconds: int) -> DataFrame:
    """Files (path, modified) older than so many seconds at a time."""
    return files.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("modified") > seconds)


def receipt(spark, path: str, dataset: str, state: str) -> bool:
    """The one-shot marker of a run over a dataset: started may be written once, complete only after it. True if written."""
    if state == "complete":
        try:
            spark.read.json(f"{path}/{dataset}/started").count()
        except AnalysisException:
            return False
    return write_once(spark.createDataFrame([(dataset, state)], "dataset string, state string"), f"{path}/{dataset}/{state}")
