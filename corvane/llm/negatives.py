"""Hard negatives by a vector-approximation file: cells for each dimension, bounds on scores by lookup, exact scores of candidates only.

Components become whole numbers, floor(scale * x). Vectors that are the same in label and numbers are one class, which
keeps its smallest ids, as no others can be ranked. The approximation file holds a byte a dimension: the cell in which a
class's component lies. A cell's ends, looked up by dimension and cell, bound what the component adds to a score, and
their sums bound the score.

Anchors and the file are dealt as pairs of blocks: every anchor meets every class, and a task holds a block of each.

1. Positives: of an anchor's label, a class can be among the best k if its upper bound reaches the k-th largest lower
   bound. Those are scored exactly and ranked.
2. Each positive's score opens a window. A class of another label is a candidate if its bounds meet the window and its
   upper bound reaches the k-th largest lower bound of classes that lie in the window whatever their exact score.
   Candidates are scored exactly, held against the window and ranked.

In a block of classes the k-th largest bound is that of the block; over all blocks it is taken again before scoring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, release

#: Cells of a dimension (a byte at most), classes whose numbers place the cells' ends (the smallest by hash), classes and anchors of a block.
CELLS, SAMPLE, ROWS, ANCHORS = 128, 4096, 8192, 2048
#: Numbers of a matrix that a task holds at once.
HELD = 1 << 20
#: Vectors whose squares add up to this or more take no part: their scores are no longs.
MOST = float(1 << 62)


def numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v: array<long>) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double") * scale).alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    squares = F.aggregate("x", F.lit(0.0), lambda s, x: s + (F.abs(x) + 1) * (F.abs(x) + 1))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(finite).where(squares < MOST)
    return rows.select("vec_id", "label", F.transform("x", lambda x: F.floor(x)).alias("v"))


class Cells:
    """Inner cuts, and lowest and highest number, of each dimension's cells; a dimension is a place in vectors of any length."""

    def __init__(self, sample: list[list[int]], least: list[int], most: list[int], cells: int):
        at: list[list[int]] = [[] for _ in least]
        for v in sample:
            for d, x in enumerate(v):
                at[d].append(x)
        self.cuts = []
        self.low, self.high = np.zeros((len(least), cells), np.int64), np.zeros((len(least), cells), np.int64)
        for d, xs in enumerate(at):
            q = np.sort(np.array(xs, np.int64))
            cuts = np.unique(q[(np.arange(1, cells) * len(q)) // cells]) if len(q) else q
            cuts = cuts[(cuts >= least[d]) & (cuts < most[d])]  # cell c: more than cuts[c - 1], at most cuts[c]
            self.cuts.append(cuts)
            self.low[d, : len(cuts) + 1] = np.concatenate([[least[d]], cuts + 1])
            self.high[d, : len(cuts) + 1] = np.concatenate([cuts, [most[d]]])

    def encode(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.uint8)
        for d in range(x.shape[1]):
            out[:, d] = np.searchsorted(self.cuts[d], x[:, d], side="left")
        return out

    def bounds(self, q: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """(anchors, classes) of lower and of upper bounds, and whether these are exact whole numbers; else they are wide enough."""
        place = np.arange(codes.shape[1])
        low, high = self.low[place, codes].astype(np.float64), self.high[place, codes].astype(np.float64)
        q = q.astype(np.float64)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        lower, upper = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        largest = np.maximum(np.abs(low), np.abs(high))
        size = np.abs(q) @ largest.T
        if size.size and size.max() < 2.0**52:
            return lower, upper, True
        return lower - size * 2.0**-40, upper + size * 2.0**-40, False


def _matrix(col: pa.ChunkedArray, rows: np.ndarray, length: int) -> np.ndarray:
    return np.array([col[int(i)].as_py() for i in rows], np.int64).reshape(len(rows), length)


def _bounded(cells: Cells, k: int, windows: bool):
    """A block of asks (class, label, v, lows, highs) and one of the file (row, label, code) -> ask, w, row, lower, upper, sure.

    Without windows (w 0): rows of the ask's label whose upper bound reaches the block's k-th largest lower one. With
    windows: of other labels, for each window.
    """
    kinds = [("ask", pa.int64()), ("w", pa.int32()), ("row", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64()), ("sure", pa.bool_())]

    def largest(x: np.ndarray) -> np.ndarray:
        """The k-th largest of each line, as a column."""
        n = x.shape[1]
        return np.partition(x, n - k, axis=1)[:, n - k, None] if n >= k else np.full((len(x), 1), -np.inf)

    def run(asks: pa.Table, file: pa.Table) -> pa.Table:
        out: list[tuple] = []
        code = file.column("code").to_pylist()
        lengths, asked = np.array([len(c) for c in code], np.int64), np.array([len(x) for x in asks.column("v").to_pylist()], np.int64)
        row, label = file.column("row").to_numpy(), file.column("label").to_numpy()
        ask, ask_label = asks.column("ask").to_numpy(), asks.column("label").to_numpy()
        lows, highs = asks.column("lows").to_pylist(), asks.column("highs").to_pylist()
        for m in np.unique(lengths):
            here = np.flatnonzero(lengths == m)
            codes = np.frombuffer(b"".join(code[i] for i in here), np.uint8).reshape(len(here), m)
            mine = np.flatnonzero(asked == m)
            step = max(1, HELD // len(here))
            for a in range(0, len(mine), step):
                some = mine[a : a + step]
                lower, upper, exact = cells.bounds(_matrix(asks.column("v"), some, m), codes)
                same = ask_label[some][:, None] == label[here][None, :]
                if not windows:
                    t = largest(np.where(same, lower, -np.inf))
                    i, j = np.nonzero(same & (upper >= t))
                    out.append((ask[some[i]], np.zeros(len(i), np.int32), row[here[j]], lower[i, j], upper[i, j], np.zeros(len(i), bool)))
                    continue
                for w in range(max((len(lows[x]) for x in some), default=0)):
                    lo = np.array([lows[x][w] if w < len(lows[x]) else np.inf for x in some], np.float64)[:, None]
                    hi = np.array([highs[x][w] if w < len(highs[x]) else -np.inf for x in some], np.float64)[:, None]
                    if not exact:  # a window's ends are rounded then
                        lo, hi = lo - np.abs(lo) * 2.0**-40, hi + np.abs(hi) * 2.0**-40
                    may = ~same & (upper >= lo) & (lower <= hi)
                    sure = may & (lower >= lo) & (upper <= hi) if exact else np.zeros_like(may)
                    t = largest(np.where(sure, lower, -np.inf))
                    i, j = np.nonzero(may & (np.minimum(upper, hi) >= t))
                    out.append((ask[some[i]], np.full(len(i), w, np.int32), row[here[j]], lower[i, j], upper[i, j], sure[i, j]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * len(kinds)
        return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds, cols, strict=True)})

    return run


def _candidates(asks: DataFrame, file: DataFrame, cells: Cells, k: int, windows: bool, blocks: int) -> DataFrame:
    """Pairs of blocks through _bounded(); asks: ask, label, v, lows, highs."""
    parts = max(1, -(-asks.count() // ANCHORS))
    both = lambda name, n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    left = asks.withColumn("i", F.pmod(F.xxhash64("ask"), F.lit(parts))).select("*", both("j", blocks))
    right = file.withColumn("j", F.pmod(F.xxhash64("row"), F.lit(blocks))).select("*", both("i", parts))
    run = _bounded(cells, k, windows)
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, "ask long, w int, row long, lower double, upper double, sure boolean")


def _scored(pairs: DataFrame, asks: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (ask, row, ...) with the exact score and the row's ids."""
    rows = pairs.join(classes.select("row", "ids", F.col("v").alias("_v")), "row").join(asks.select("ask", F.col("v").alias("_q")), "ask")
    dot = F.aggregate(F.zip_with("_v", "_q", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.withColumn("score", dot).drop("_v", "_q")


def _ranked(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, best: array<struct<rank, id, score>>): a key's first k ids by score, then id."""
    each = scored.select(*keys, "score", F.explode(F.slice("ids", 1, k)).alias("id"))
    line = W.partitionBy(*keys).orderBy(F.desc("score"), "id")
    best = each.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)
    return best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))


def mine(vectors: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, cells: int = CELLS, block: int = ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, label, embedding).

    A score is the inner product of floor(scale * x) of both vectors. An anchor's positives are its best other rows of the
    same label, a positive's negatives the best rows of other labels whose score is low to high hundredths of the
    positive's; higher scores first, ties by smaller id. is_anchor is a condition on vec_id and label. Rows without id or
    label, without a vector, or with a null or non-finite component take no part, nor do those whose squares add up to
    2^62 or more; vectors of different lengths don't meet, empty ones score 0. A row that repeats another wholly counts
    once; an anchor's own id is never its positive, also where other vectors share it. Anchors without positives and
    positives without negatives have no rows, and an empty table has none.
    """
    base = numbers(vectors, scale)
    keep = max(positives + 1, negatives)
    order = F.dense_rank().over(W.partitionBy("label", "v").orderBy("vec_id"))
    few = base.withColumn("_k", order).where(F.col("_k") <= keep).groupBy("label", "v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    classes = materialize(few.select(F.monotonically_increasing_id().alias("row"), "label", "v", "ids"), "classes")
    anchors = base.where(is_anchor).distinct().join(classes.select("row", "label", "v"), ["label", "v"]).select(F.col("vec_id").alias("anchor_id"), F.col("row").alias("ask"))
    anchors = materialize(anchors, "anchors")
    blocks = max(1, -(-classes.count() // block))
    # a row a dimension, and SAMPLE classes
    ends = classes.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("least"), F.max("x").alias("most")).orderBy("d").collect()
    sample = classes.select("v", F.xxhash64("label", "v").alias("h")).orderBy("h", "v").limit(SAMPLE).collect()
    table = Cells([r["v"] for r in sample], [r["least"] for r in ends], [r["most"] for r in ends], min(cells, 256))

    def encode(batches):
        for b in batches:
            v = b.column(2).to_pylist()
            lengths = np.array([len(x) for x in v], np.int64)
            out: list[bytes] = [b""] * len(v)
            for m in np.unique(lengths):
                here = np.flatnonzero(lengths == m)
                codes = table.encode(np.array([v[i] for i in here], np.int64).reshape(len(here), m))
                for i, c in zip(here, codes, strict=True):
                    out[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["row", "label", "code"])

    file = materialize(classes.select("row", "label", "v").mapInArrow(encode, "row long, label long, code binary"), "cells")
    none = F.array().cast("array<long>")
    asks = classes.join(anchors.select(F.col("ask").alias("row")).distinct(), "row").select(F.col("row").alias("ask"), "label", "v")
    asks = materialize(asks.select("*", none.alias("lows"), none.alias("highs")), "asks")

    found = materialize(_candidates(asks, file, table, positives + 1, False, blocks), "near")
    line = W.partitionBy("ask").orderBy(F.desc("lower"), "row")
    bar = found.withColumn("_k", F.row_number().over(line)).where(F.col("_k") <= positives + 1).groupBy("ask").agg(F.count("*").alias("n"), F.min("lower").alias("t"))
    pairs = found.join(bar, "ask").where((F.col("n") <= positives) | (F.col("upper") >= F.col("t"))).select("ask", "row")
    first = materialize(_ranked(_scored(pairs, asks, classes), ["ask"], positives + 1), "first")

    score = F.array_distinct(F.transform("best", lambda b: b["score"]))
    hundredths = lambda s, x: s.cast("decimal(20,0)") * F.lit(x).cast("decimal(9,0)") / F.lit(100).cast("decimal(3,0)")
    windows = asks.drop("lows", "highs").join(first, "ask").withColumn("s", F.transform(score, lambda s: F.struct(s.alias("s"), F.ceil(hundredths(s, low)).cast("long").alias("lo"), F.floor(hundredths(s, high)).cast("long").alias("hi"))))
    windows = windows.withColumn("s", F.filter("s", lambda w: w["lo"] <= w["hi"])).where(F.size("s") > 0)
    windows = materialize(windows.select("ask", "label", "v", F.col("s.s").alias("scores"), F.col("s.lo").alias("lows"), F.col("s.hi").alias("highs")), "windows")
    met = materialize(_candidates(windows.drop("scores"), file, table, negatives, True, blocks), "met")
    line = W.partitionBy("ask", "w").orderBy(F.desc("lower"), "row")
    bar = met.where("sure").withColumn("_k", F.row_number().over(line)).where(F.col("_k") <= negatives).groupBy("ask", "w").agg(F.count("*").alias("n"), F.min("lower").alias("t"))
    pairs = met.join(bar, ["ask", "w"], "left").where(F.coalesce((F.col("n") < negatives) | (F.col("upper") >= F.col("t")), F.lit(True))).select("ask", "row").distinct()
    scored = _scored(pairs, windows, classes).join(windows.select("ask", F.explode(F.arrays_zip("scores", "lows", "highs")).alias("x")), "ask")
    last = _ranked(scored.where(F.col("score").between(F.col("x.lows"), F.col("x.highs"))).withColumn("ps", F.col("x.scores")), ["ask", "ps"], negatives)

    own = F.slice(F.filter("best", lambda b: b["id"] != F.col("anchor_id")), 1, positives)
    given = anchors.join(first, "ask").select("anchor_id", "ask", F.explode(own).alias("p")).select("anchor_id", "ask", F.col("p.id").alias("positive_id"), F.col("p.score").alias("ps"))
    out = given.join(last, ["ask", "ps"]).select("anchor_id", "positive_id", "ps", F.explode("best").alias("b"))
    out = materialize(out.select("anchor_id", "positive_id", F.col("b.rank").cast("int").alias("rank"), F.col("b.id").alias("negative_id"), F.col("ps").alias("positive_score"), F.col("b.score").alias("negative_score")), "negatives")
    release(classes, anchors, file, asks, found, first, windows, met)
    return out
