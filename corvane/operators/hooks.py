"""Functions that a caller gives, behind checked contracts: what breaks a contract, or raises, becomes a row with a fault."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The states that a processed sample may end in.
STATUSES = ["success", "partial", "failed"]
EVENT = "label string, score double, start_seconds double, end_seconds double, fault string"


def _number(x: Any) -> float | None:
    """A finite number; null for anything else, booleans and texts too."""
    if isinstance(x, (bool, str, bytes)) or x is None:
        return None
    try:
        y = float(x)
    except (TypeError, ValueError, OverflowError):
        return None
    return y if math.isfinite(y) else None


def checked_event(found: Any) -> tuple:
    """A row of EVENT for what a detector gave: (label, score, start, end); with a fault (shape, label, number, range) if it breaks the contract."""
    try:
        label, *rest = found
    except TypeError:
        return None, None, None, None, "shape"
    if len(rest) != 3:
        return None, None, None, None, "shape"
    if not isinstance(label, str) or not label.strip():
        return None, None, None, None, "label"
    score, start, end = map(_number, rest)
    if score is None or start is None or end is None:
        return label, score, start, end, "number"
    return label, score, start, end, None if 0 <= score <= 1 and 0 <= start <= end else "range"


def detect(windows: DataFrame, samples: str, detector: Callable[..., Iterable], labels: list[str] | None = None, **options: float) -> DataFrame:
    """windows with the events that a detector finds in each: label, score, start_seconds, end_seconds, fault. Windows without any have no row.

    detector(samples, labels=..., **options) gives (label, score, start, end): a text that isn't blank, a score of 0 to 1,
    a start of 0 or more, an end not before it, all finite. What breaks that is a row with a fault, and so is a detector
    that raises ("raised: ..."): the others' events stay. The detector is a table function beside the rows, so it runs
    where they lie.
    """

    class Detect:
        def eval(self, x):
            try:
                found = list(detector(x, labels=labels, **options))
            except Exception as e:  # whatever the caller's function raises is its row's fault
                yield None, None, None, None, f"raised: {type(e).__name__}"
                return
            for event in found:
                yield checked_event(event)

    spark = windows.sparkSession
    name = f"detect_{abs(hash((id(detector), tuple(options.items()))))}"
    spark.udtf.register(name, F.udtf(Detect, returnType=EVENT, useArrow=True))
    return spark.sql(f"SELECT w.*, e.* FROM {{windows}} w, LATERAL {name}(w.`{samples}`) e", windows=windows)


def strict_json(x: Any) -> str:
    """JSON text with sorted keys; TypeError or ValueError for what JSON doesn't have, NaN and infinities too."""
    return json.dumps(x, allow_nan=False, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def process(rows: DataFrame, key: str, columns: list[str], function: Callable[[dict], Mapping]) -> DataFrame:
    """(key, status, result, fault) of function({column: value}) for every row: a mapping with a status of STATUSES, as strict JSON.

    A function that raises, gives no mapping, another status or what JSON doesn't have fails its own row: status failed,
    no result, and the fault (raised, mapping, status, json).
    """

    def one(given: dict) -> tuple[str, str | None, str | None]:
        try:
            got = function(given)
        except Exception as e:  # whatever the caller's function raises is its row's fault
            return "failed", None, f"raised: {type(e).__name__}"
        if not isinstance(got, Mapping):
            return "failed", None, "mapping"
        if got.get("status") not in STATUSES:
            return "failed", None, "status"
        try:
            return got["status"], strict_json(dict(got)), None
        except (TypeError, ValueError):
            return "failed", None, "json"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [one({c: None if not isinstance(v, (list, dict)) and pd.api.types.is_scalar(v) and pd.isna(v) else v for c, v in zip(columns, row, strict=True)}) for row in zip(*(b[c] for c in columns), strict=True)]
            yield pd.DataFrame({key: b[key], "status": [x[0] for x in out], "result": [x[1] for x in out], "fault": [x[2] for x in out]})

    return rows.select(*dict.fromkeys([key, *columns])).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, status string, result string, fault string")
