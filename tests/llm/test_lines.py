import random

from pyspark.sql import types as T

from corvane.llm.lines import drop_repeated_lines

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("p", T.StringType()), T.StructField("lines", T.LongType())])


def brute(rows, width=3):
    docs = [((-(2**63) if d is None else d), i, [] if t is None else t.split("\n")) for i, (d, t) in enumerate(rows)]
    first, out = {}, []
    for d, _, x in docs:
        for p in range(len(x) - width + 1):
            k = tuple(x[p : p + width])
            first[k] = min(first.get(k, (d, p)), (d, p))
    for d, i, x in docs:
        gone = {q for p in range(len(x) - width + 1) if first[tuple(x[p : p + width])] < (d, p) for q in range(p, p + width)}
        out.append((rows[i][0], len(x), len(gone), "\n".join(y for q, y in enumerate(x) if q not in gone)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(6)
    pool = [f"line {i}" for i in range(12)] + ["", "é\r"]
    rows = [(i * 2, "\n".join(r.choice(pool) for _ in range(r.randint(1, 25)))) for i in range(150)]
    rows += [(None, "line 1\nline 2\nline 3"), (901, None), (902, ""), (903, "\n\n\n\n\n"), (904, "one"), (905, "x\n" * 5000), (906, rows[3][1]), (906, rows[3][1])]
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], SCHEMA)
    assert sorted(map(tuple, drop_repeated_lines(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert drop_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0
