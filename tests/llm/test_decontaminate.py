import random

import numpy as np
from pyspark.sql import types as T

from corvane.llm import decontaminate as dec

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("score", T.LongType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.LongType())])


def slow_align(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1))
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (dec.MATCH if item[i - 1] == passage[j - 1] else dec.MISMATCH), h[i - 1, j] + dec.GAP, h[i, j - 1] + dec.GAP)
    return h.max()


def test_alignment_against_the_plain_recurrence():
    r = np.random.default_rng(3)
    for _ in range(60):
        a, b = r.integers(0, 6, r.integers(1, 15)), r.integers(0, 6, r.integers(0, 25))
        score, start, end = dec.align(a, b)
        assert np.isclose(score, slow_align(a, b)) and (score == 0 or np.isclose(score, slow_align(a, b[start:end])))


def test_copies_edits_and_clean_documents(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(15, 50)))) for i in range(25)] + [(90, "zig zag"), (91, "Zog!"), (92, ""), (93, None), (None, "w1 w2 w3 w4")]
    filler = lambda n: [r.choice(words) for _ in range(n)]
    docs, truth = [], set()
    for d in range(150):
        body = filler(r.randint(0, 150))
        if d % 3 == 0:
            i, t = items[d % 25]
            t = t.split()
            if d % 2:
                for k in range(2, len(t), 6):
                    t[k] = "edited"
                del t[4]
            at = r.randint(0, len(body))
            body[at:at] = [x.upper() + "," for x in t]
            truth.add((d, i))
        docs.append((d, "\n".join(body)))
    docs += [(500, "a zig  zag, b"), (501, "zog"), (502, None), (503, ""), (None, items[2][1]), (504, items[3][1]), (504, items[3][1])]
    truth |= {(500, 90), (501, 91), (None, 2), (504, 3)}
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS)
    got = dec.contaminated(df, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == truth and len(got) == len(truth)
    assert all(x["score"] >= 0.5 for x in got)
    kept = dec.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted((x["doc_id"] for x in kept.collect())) == sorted({d for d, _ in docs if d is not None} - {d for d, _ in truth})


def test_every_item_against_every_document(spark):
    """Exhaustive alignment of edited copies, by share of edited words."""
    r = random.Random(11)
    words = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(words) for _ in range(30))) for i in range(12)]
    docs, share = [], {}
    for d in range(144):
        t = items[d % 12][1].split()
        edits = d // 12
        for k in r.sample(range(30), edits):
            t[k] = f"new{k}"
        body = [r.choice(words) for _ in range(40)]
        docs.append((d, " ".join(body[:20] + t + body[20:])))
        share[d] = edits
    docs += [(1000 + k, " ".join(r.choice(words) for _ in range(80))) for k in range(30)]
    number = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in t.split()])
    want = {(d, i) for d, t in docs for i, u in items if slow_align(code(u), code(t)) / 30 >= dec.LEAST}
    got = {(x["doc_id"], x["item_id"]) for x in dec.contaminated(spark.createDataFrame([(d, t, "", 0) for d, t in docs], DOCS), spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)).collect()}
    assert got <= want
    light = {p for p in want if share.get(p[0], 99) <= 6}
    assert len(light) >= 80 and light <= got and len(got) >= 0.95 * len(want)


def test_rows_stay_or_go_by_their_own_text(spark):
    item = "one two three four five six seven"
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("a.b", T.StringType()), T.StructField("m1", T.LongType())])
    rows = [(None, item, "x", 1), (None, "clean words only here", "y", 2), (None, None, "z", 3), (7, item, "x", 4), (7, "another clean text", "x", 5), (7, "another clean text", "x", 5)]
    kept = dec.clean(spark.createDataFrame(rows, schema), spark.createDataFrame([(1, item, 0)], ITEMS))
    assert kept.columns == ["doc_id", "text", "a.b", "m1"]
    assert sorted(tuple(x)[3] for x in kept.collect()) == [2, 3, 5, 5]


def test_full_bitmap_and_empty_tables(spark, monkeypatch):
    from corvane.llm import common

    monkeypatch.setattr(common, "BITS_EACH", 0)
    df = spark.createDataFrame([(1, "a b c d e", "", 0), (2, "f g h", "", 0)], DOCS)
    bench = spark.createDataFrame([(1, "b c d e", 0), (2, "f g h i", 0), (3, "q", 0), (3, "d e", 0)], ITEMS)
    assert {(x[0], x[1]) for x in dec.contaminated(df, bench).collect()} == {(1, 1), (2, 2), (1, 3)}
    assert dec.contaminated(df, bench.limit(0)).count() == 0 and dec.contaminated(df.limit(0), bench).count() == 0
