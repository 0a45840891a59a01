import numpy as np
import pytest
from pyspark.sql import types as T

from corvane.llm.embeddings import near_duplicates

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("node", T.StringType()), T.StructField("size", T.LongType())])


def rows_of(seed=1):
    r = np.random.default_rng(seed)
    out = []
    for i in range(150):
        v = r.standard_normal(16)
        out.append((i * 2, v, int(r.integers(0, 3))))
        for k in range(int(r.integers(0, 4))):
            out.append((1000 + i * 4 + k, v * r.uniform(0.5, 3) + r.standard_normal(16) * r.choice([0, 0.02, 0.12, 0.2]), out[-1][2] if r.random() < 0.9 else None))
    base = r.standard_normal(16)
    out += [(5000 + i, base + 0.02 * r.standard_normal(16), 1) for i in range(60)]
    rows = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in out]
    rows += [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [1.0, None] * 8, 1), (9005, [float("inf")] + [1.0] * 15, 1), (9006, [1.0] * 5, 1), (9007, [2.0] * 5, 1), (None, [3.0] * 5, 1), (9008, rows[0][1], rows[0][2]), (9008, rows[0][1], rows[0][2]), (9009, rows[0][1], None)]
    return rows


def brute(rows, least=0.98):
    ok = [v is not None and len(v) and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, y in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            (_, a, x), (_, b, y) = rows[i], rows[j]
            if ok[i] and ok[j] and x == y and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= least - 1e-12:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i in range(n):
        if rows[i][0] is not None:
            low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((d, links[i], c := low.get(find(i)), d is not None and d == c) for i, (d, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [2048, 7])
def test_against_brute_force(spark, block):
    rows = rows_of()
    df = spark.createDataFrame([(i, v, y, "clash", 0) for i, v, y in rows], SCHEMA)
    assert sorted(map(tuple, near_duplicates(df, block=block).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
