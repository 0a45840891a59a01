import hashlib
import random
import re

import numpy as np
from pyspark.sql import types as T

from corvane.llm import pii

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("email", T.LongType())])
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum((v * 2 - 9 * (v > 4)) if i % 2 else v for i, v in enumerate(map(int, d[::-1]))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def texts():
    r = random.Random(8)
    bits = ["a@b.co", "x.y+z@mail-1.example.com", "@", ".", "-", " ", "1.2.3.4", "255.256.1.1", "0000.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "+1 (555) 010-2000", "+49 30 901820", "+1", "é", "🎧", "_", "%", "12", "7", "(", ")", "\n", "word", "--", "", "..", "a@b", "@c.d.", "1.1.1.1.1.1.1.1.1"]
    out = ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(600)]
    return out + ["a@b.com_x@c.de", "x@y.z-.w@q.r", "1 " * 30000, "9" * 60000, "a." * 20000 + "@x.y", "a@" + "b." * 20000 + "c", "1." * 20000, "+" + "1 " * 20000, "plain", "", None]


def test_base_spans_against_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "a@b.co"), (3, texts()[3])]
    got = pii.digest(pii.find(spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA))).collect()
    assert len(got) == len(rows)
    by = {(x["doc_id"]): x for x in got}
    for i, t in rows:
        want = brute(t)
        x = by[i]
        assert x["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, t, x["spans"][:200], want[:5])
        assert [x[f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert set(filter(None, want)) <= set(x["spans"].split(","))


def test_trees_add_spans(spark):
    rows = [
        (1, "please call (743) 555-3824 today", "phone:12:26"),
        (2, "mail me: jo.doe [at] example [dot] org thanks", "email:9:38"),
        (3, "the server 10[.]20[.]30[.]40 is down", "ip:11:28"),
        (4, "card: 4111.1111.1111.1111 visa", "card:6:25"),
        (5, "on 2024-05-12 we sold 12 345 678 of 1999 220 3333 things in 10,000,000,000", ""),
        (6, "call +1 (743) 555-3824", "phone:5:22"),
        (7, "le 7536784127813050 4845168114407329 fin", "card:3:19,card:20:36"),
        (8, "Des +1 (826) 555-4081 190.137.223.204 ok", "ip:22:37,phone:4:21"),
        (9, "hash 681c09b8e90e7e8c9575180f595f646 v1.2.3.4.5.6 7536784127813051", "ip:38:45"),
        (10, "write to ann at mail dot example now", "email:9:32"),
    ]
    out = {x["doc_id"]: x["spans"] for x in pii.digest(pii.find(spark.createDataFrame([(i, t, "", 0) for i, t, _ in rows], SCHEMA))).collect()}
    assert out == {i: s for i, _, s in rows}
    red = {x["doc_id"]: x["text"] for x in pii.redact(spark.createDataFrame([(i, t, "", 0) for i, t, _ in rows] + [(99, None, "", 0)], SCHEMA)).collect()}
    assert red[1] == "please call [phone] today" and red[7] == "le [card] [card] fin" and red[5] == rows[4][1] and red[99] is None


def test_driver_and_column_features_agree(spark):
    from pyspark.sql import functions as F

    examples = [("phone", "(743) 555-3824", "please call ", " now"), ("card", "4111.1111.1111.1111", "x", ".1"), ("ip", "10[.]2[.]3[.]4", "v", "é"), ("phone", "2024 333 4444", "on:", ""), ("card", "4111111111111111", "7 ", ". ")]
    for kind, hit, before, after in examples:
        row = spark.range(1).select(*[v.cast("double").alias(k) for k, v in pii.features_of(F.lit(hit), F.lit(before), F.lit(after), kind).items()]).first()
        assert list(row) == pii.plain_features(hit, before, after, kind), (kind, hit)


def test_held_out_examples():
    for k in pii.KINDS:
        prior, trees, threshold = pii.fitted(k)
        x, y = pii.drawn_examples(k, 2000, 77)
        said = prior + sum(pii.walk(t, x) for t in trees) >= threshold
        assert y[said].mean() > 0.97 and said[y == 1].mean() > 0.9, (k, np.mean(y[said]), said[y == 1].mean())


def test_overlapping_proposals_and_many_matches(spark):
    import time

    many = " ".join(f"u{i}@example.org" for i in range(16_000))
    df = spark.createDataFrame([(1, many, "", 0), (2, "4111111111111111 " * 3000, "", 0)], SCHEMA)
    began = time.time()
    got = {x["doc_id"]: x for x in pii.digest(pii.find(df)).collect()}
    assert got[1]["n_email"] == 16_000 and got[1]["spans"].startswith("email:0:14,email:15:29") and got[1]["spans"].endswith(f":{len(many)}")
    assert got[2]["spans"].count("card") == 3000
    assert time.time() - began < 40


def test_empty(spark):
    assert pii.digest(pii.find(spark.createDataFrame([], SCHEMA))).count() == 0


def test_many_proposals_beside_many_base_spans(spark):
    """Proposals are held against base spans in one sweep each way, not against each of them."""
    import time

    text = " ".join(f"u{i}@example.org or {'abcdef'[i % 6]}no [at] example [dot] org," for i in range(6000))
    began = time.time()
    x = pii.digest(pii.find(spark.createDataFrame([(1, text, "", 0)], SCHEMA))).first()
    assert x["n_email"] == 6000 and x["spans"].count("email:") == 12_000
    spans = [tuple(map(int, s.split(":")[1:])) for s in x["spans"].split(",")]
    assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert time.time() - began < 40
