import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import negatives
from corvane.llm.negatives import Cells, mine

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("row", T.StringType()), T.StructField("ids", T.IntegerType())])


def brute(rows, anchor, positives=5, negs=10, low=30, high=90):
    kept = {(i, y, tuple(math.floor(256 * x) for x in v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and sum(x * x * 65536 for x in v) < 1e18}
    out = []
    for i, y, v in kept:
        if not anchor(i):
            continue
        score = [(sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in kept if len(w) == len(v)]
        for ps, p, _ in sorted((x for x in score if x[2] == y and x[1] != i), key=lambda x: (-x[0], x[1]))[:positives]:
            inside = sorted((x for x in score if x[2] != y and low * ps <= 100 * x[0] <= high * ps), key=lambda x: (-x[0], x[1]))
            out += [(i, p, k + 1, x[1], ps, x[0]) for k, x in enumerate(inside[:negs])]
    return sorted(out)


def drawn(seed, n, dim, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centres[i % 6] * spread + r.normal(size=dim)
        rows.append((i, int(r.integers(0, 4)), (v / np.linalg.norm(v)).tolist()))
    return rows


def run(spark, rows, anchor, **more):
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], SCHEMA).repartition(7, F.rand(2))
    return sorted(map(tuple, mine(df, anchor, **more).collect()))


@pytest.mark.parametrize(("spread", "block", "cells"), [(2.0, 8192, 128), (0.3, 50, 8), (2.0, 64, 2)])
def test_against_brute_force(spark, monkeypatch, spread, block, cells):
    monkeypatch.setattr(negatives, "ANCHORS", 5)
    monkeypatch.setattr(negatives, "HELD", 500)
    rows = drawn(3, 400, 12, spread)
    got = run(spark, rows, F.col("vec_id") % 20 == 0, block=block, cells=cells)
    assert got == brute(rows, lambda i: i % 20 == 0) and len(got) > 300


def test_copies_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SAMPLE", 16)  # most lies in cells that the sample didn't see
    r = random.Random(1)
    hot, near = [0.5, 0.25, -0.125], [0.3, 0.2, -0.1]
    rows = [(i, 1 if i % 2 else 2, hot) for i in range(0, 300)] + [(i, 3, near) for i in range(300, 400)]  # ties within and over labels
    rows += [(i, r.randint(0, 3), [r.choice([0.0, 0.125, -0.5, 0.75]) for _ in range(3)]) for i in range(400, 600)]
    rows += [(600, None, hot), (700, 1, None), (800, 1, [0.1, None, 0.2]), (900, 1, [0.1, float("nan"), 0.2]), (1000, 1, [float("inf"), 0.0, 0.0]), (None, 1, hot)]
    rows += [(1100, 1, []), (1101, 1, []), (1102, 2, []), (1200, 1, [0.0, 0.0, 0.0]), (1300, 1, [0.5, 0.5]), (1301, 1, [0.5, 0.25]), (1302, 2, [0.25, 0.25]), (1400, 2, [-0.5, -0.25, 0.125])]
    rows += [(1500, 1, [1e300, 0.0, 0.0]), (1, 1, hot), (1300, 1, [0.5, 0.5])]  # too large for a long; whole repeats
    got = run(spark, rows, F.col("vec_id") % 100 == 0)
    assert got == brute(rows, lambda i: i % 100 == 0)
    assert {x[0] for x in got} >= {0, 100, 300, 1100, 1300} and not {x[0] for x in got} & {600, 700, 800, 900, 1000, 1500}


def test_large_numbers(spark):
    r = random.Random(9)
    rows = [(i, i % 3, [r.uniform(-1, 1) * 2.0**20 for _ in range(4)]) for i in range(150)]
    got = run(spark, rows, F.col("vec_id") % 10 == 0, block=40)
    assert got == brute(rows, lambda i: i % 10 == 0) and max(abs(x[4]) for x in got) > 2**53


def test_bounds_hold():
    r = np.random.default_rng(5)
    x = r.integers(-200, 200, (300, 9))
    c = Cells(x[:40].tolist(), x.min(0).tolist(), x.max(0).tolist(), 16)
    q = r.integers(-200, 200, (20, 9))
    lower, upper, exact = c.bounds(q, c.encode(x))
    assert exact and (lower <= q @ x.T).all() and (q @ x.T <= upper).all() and (upper - lower).max() < 0.5 * np.abs(q @ x.T).max() * 9


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mine(empty, F.col("vec_id") % 100 == 0).collect() == []
    few = spark.createDataFrame([(1, 1, [0.5], "", 0), (100, None, [0.5], "", 0)], SCHEMA)
    assert mine(few, F.col("vec_id") % 100 == 0).collect() == []
