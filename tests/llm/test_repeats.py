import hashlib
import random

from pyspark.sql import types as T

from corvane.llm import repeats
from corvane.llm.repeats import remove_repeats

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType()), T.StructField("found", T.LongType())])


def brute(rows, window=20):
    docs = sorted(((-(2**63) if d is None else d), i, (t or "").encode().split()) for i, (d, t) in enumerate(rows))
    first, out = {}, {}
    for d, _, w in docs:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, (d, p)), (d, p))
    for d, i, w in docs:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (d, p):
                gone |= set(range(p, p + window))
        out[i] = (rows[i][0], len(w), len(gone), b" ".join(x for q, x in enumerate(w) if q not in gone).decode())
    return sorted(out.values(), key=str)


def rows_of(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(500)] + ["é", "the", "the"]
    text = lambda n: [r.choice(words) for _ in range(n)]
    shared = [text(n) for n in (20, 21, 35, 60)]
    rows = []
    for i in range(60):
        body = text(r.randint(0, 120))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(body))
            body[at:at] = r.choice(shared)
        rows.append((r.randint(-5, 200) * 7, " \n".join(body)))
    seen = set()
    rows = [x for x in rows if x[0] not in seen and not seen.add(x[0])]
    same = " ".join(["the"] * 70)
    return rows + [(9001, same), (9002, same), (9003, None), (9004, ""), (9005, "\t \x0b"), (9006, "a b c"), (None, " ".join(shared[2])), (9007, rows[3][1]), (9007, rows[3][1])]


def test_against_brute_force(spark):
    rows = rows_of(3)
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], SCHEMA)
    assert sorted(map(tuple, remove_repeats(df).collect()), key=str) == brute(rows)


def test_hot_anchors_and_long_groups(spark, monkeypatch):
    rows = rows_of(4)
    df = spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], SCHEMA)
    monkeypatch.setattr(repeats, "HOT", 2)
    assert sorted(map(tuple, remove_repeats(df).collect()), key=str) == brute(rows)


def test_shard_carries_a_group_over_calls():
    s = repeats.Shard(3)
    assert s.occurrences([5, 5], [1, 2], [0, 0], [b"a b c d", b"x b c d"]) == [(1, 1, 4)]
    assert s.occurrences([5, 6], [3, 4], [7, 0], [b"a b c", b"q r s"]) == [(0, 7, 10)]
    assert s.occurrences([6], [9], [0], [b"q r s"]) == [(0, 0, 3)]


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_digest():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
