import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import types as T

from corvane.llm import toxicity as tox

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("toxic", T.LongType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def corpus(n=600):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    bad = ["zorg", "vlimp", "quax"]
    docs, labels = [], []
    for i in range(n):
        y = int(r.random() < 0.3)
        w = [r.choice(words) for _ in range(r.randint(5, 80))]
        if y:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", "s", "!"]))
        docs.append((i, " ".join(w), "clash", 1 - y))
        labels.append((i, 0, y))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(None, "zorg", "", 0), (9000, None, "", 0), (9001, "", "", 0), (9002, "?! \n", "", 0), (9003, "x" * 5000 + " é", "", 0), (3, docs[3][1], "", 0)]
    labels += [(None, 0, 1), (5, 0, None), (77777, 0, 1), (6, 1, 7)]
    d, y = spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame(labels, LABELS)
    out = tox.toxicity(d, y)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = out.collect()
    assert len(rows) == len(docs) + len(odd)
    truth = {i: t for i, _, t in labels if i is not None and t in (0, 1)}
    held = [x for x in rows if x["held_out"] and x["doc_id"] in truth]
    assert len(held) > 80 and np.mean([x["predicted"] == truth[x["doc_id"]] for x in held]) > 0.95
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in rows)
    assert [x["held_out"] for x in rows if x["doc_id"] is None] == [None]


def test_no_labels_no_rows(spark):
    docs, _ = corpus(20)
    d, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)
    assert {x["predicted"] for x in tox.toxicity(d, none).collect()} == {0}
    assert tox.toxicity(spark.createDataFrame([], DOCS), none).count() == 0


def test_probabilities_add_up():
    words = [b"abc", b"abd", b"xbc", b"abcde"]
    g, of = tox.grams(words)
    assert len(g) == sum(map(len, words)) + 4 and of.tolist() == [0] * 4 + [1] * 4 + [2] * 4 + [3] * 6
    assert int(g[0]).to_bytes(8, "big") == tox.PAD * 7 + b"a" and int(g[3]).to_bytes(8, "big") == tox.PAD * 4 + b"abc" + tox.END
    u, at = np.unique(g, return_inverse=True)
    c0, c1 = (np.bincount(at, weights=np.array(c, float)[of], minlength=len(u)) for c in ([3, 1, 0, 2], [0, 2, 5, 1]))
    three = np.unique(tox._suffix(u, 3)).astype(np.int64)
    pairs, n = np.unique(three & 0xFFFF, return_counts=True)
    low, share = tox.low_orders(pairs, n.astype(float)), tox.Share(u, c0, c1)
    for context in np.unique(u >> np.uint64(8)).tolist():
        every = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        for p in share.probabilities(every, low):
            assert np.isclose(p.sum(), 1) and (p > 0).all()


def test_curve_without_both_classes():
    assert tox.fit_curve(np.zeros((0, tox.FEATURES)), np.zeros(0))[1:].tolist() == [0.0] * tox.FEATURES


OFF = [0, 1.0, 1.5, 1.75]


def plain_ratios(words):
    """word -> log-ratio, by dicts of every n-gram; words: (word, toxic), once for each document."""
    tops = (Counter(), Counter())
    for w, y in words:
        x = tox.PAD * 7 + w + tox.END
        tops[y].update(x[i - 7 : i + 1] for i in range(7, len(x)))
    cont, total, kinds = Counter(), Counter(), Counter()
    seen = set(tops[0]) | set(tops[1])
    for k in range(7, 0, -1):
        longer, seen = seen, {g[1:] for g in seen}
        cont.update(g[1:] for g in longer)
        kinds.update((k, g[:-1]) for g in seen)
        for g in seen:
            total[k, g[:-1]] += cont[g]
    sums, sorts = (defaultdict(int), defaultdict(int)), (defaultdict(int), defaultdict(int))
    for y in (0, 1):
        for g, c in tops[y].items():
            sums[y][g[:-1]] += c
            sorts[y][g[:-1]] += OFF[min(c, 3)]

    def ratio(w):
        x, out = tox.PAD * 7 + w + tox.END, 0.0
        for i in range(7, len(x)):
            g = x[i - 7 : i + 1]
            p = (cont[g[7:]] + 0.5) / (total[1, b""] + 128)
            for k in range(2, 8):
                s = g[8 - k :]
                if total[k, s[:-1]]:
                    p = (max(cont[s] - 0.75, 0) + 0.75 * kinds[k, s[:-1]] * p) / total[k, s[:-1]]
            for y in (0, 1):
                n = sums[y][g[:-1]]
                out += (2 * y - 1) * np.log((tops[y][g] - OFF[min(tops[y][g], 3)] + sorts[y][g[:-1]] * p) / n if n else p)
        return out

    return ratio


def test_scores_are_those_of_exact_counts(spark):
    # more distinct n-grams of an order than a table of 2^18 rows could keep apart
    r = random.Random(5)
    docs = [(i, " ".join("".join(r.choices("abcdefghijklmnopqrst", k=9)) for _ in range(100)) + (" zorg vlimp" if i % 4 == 0 else ""), "", 0) for i in range(600)]
    labels = [(i, 0, int(i % 4 == 0)) for i in range(600)]
    fold = [zlib.crc32(str(i).encode()) % 5 for i in range(600)]
    ratio = plain_ratios([(w, labels[i][2]) for i, t, *_ in docs if fold[i] in (1, 2, 3) for w in set(t.encode().split())])
    x = {}
    for i in [i for i in range(600) if fold[i] == 4] + [i for i in range(600) if fold[i] == 0][:10]:
        words = Counter(docs[i][1].encode().split())
        x[i] = tox.features(np.array([ratio(w) for w in words]), np.array(list(words.values())))
    fit = [i for i in x if fold[i] == 4]
    curve = tox.fit_curve(np.array([x[i] for i in fit]), np.array([labels[i][2] for i in fit], float))
    got = {row["doc_id"]: row["score"] for row in tox.toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    for i in x:
        z = curve[0] + np.dot(curve[1:], x[i])
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-3, i
