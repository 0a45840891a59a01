"""Line dedup: overlapping windows of three lines; later occurrences go, by merged positions.

Every three consecutive lines of a document are hashed (128 bits). The earliest place of each window that recurs is a
grouped minimum, combined before the shuffle; the join back to the places is by hash, where adaptive execution splits a
window that holds a large share of the rows. What a document loses is then merged line by line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, materialize


def _strip(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, kept = [], [], []
            for t, gone in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw = t.as_py()
                lines = [] if raw is None else raw.split(b"\n")
                n = len(lines)
                if gone:
                    edge = np.zeros(n + width, np.int64)
                    np.add.at(edge, gone, 1)
                    np.add.at(edge, np.array(gone) + width, -1)
                    lines = [x for x, c in zip(lines, np.cumsum(edge).tolist(), strict=False) if not c]
                total.append(n)
                removed.append(n - len(lines))
                kept.append(b"\n".join(lines))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_lines", "n_removed", "kept"])

    return run


def drop_repeated_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text) of every row of docs.

    Lines are what line feeds separate, unchanged, blank ones too; kept_text joins what stays by line feeds. A line goes
    if it is in a window of so many lines that starts earlier too: in a smaller doc_id, or further up in the same. Texts
    of fewer lines have no windows and stay. A null doc_id counts as the smallest; rows that repeat a doc_id are the same
    document: equal places in them aren't earlier than one another. A null text has no lines, an empty one has one. An
    empty table gives no rows.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.hash("text").alias("mark"), F.col("text"))
    lines = F.split("text", "\n", -1)

    def window(i):
        parts = [F.element_at(F.col("lines"), i + k) for k in range(1, width + 1)]
        return F.struct(i.alias("p"), F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("b"), *parts).alias("b"))

    cut = base.select("id", "mark", lines.alias("lines")).where(F.size("lines") >= width)
    places = cut.select("id", "mark", F.inline(F.transform(F.sequence(F.lit(0), F.size("lines") - width), window)))
    places = materialize(places, "lines")
    firsts = places.groupBy("a", "b").agg(F.min(F.struct("id", "p")).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    late = places.join(firsts, ["a", "b"]).where(F.struct("id", "p") > F.col("first"))
    gone = late.groupBy("id", "mark").agg(F.collect_set("p").alias("gone"))
    rows = base.join(gone, ["id", "mark"], "left").select("id", F.col("text").cast("binary").alias("text"), "gone")
    out = rows.mapInArrow(_strip(width), "id long, n_lines long, n_removed long, kept binary")
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_lines", "n_removed", F.col("kept").cast("string").alias("kept_text"))
