import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from corvane.llm import mixing

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("epoch", T.StringType()), T.StructField("_key", T.LongType()), T.StructField("row", T.LongType())])


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    rows = []
    for i in range(900):
        s = "big" if i % 3 else r.choice(["a", "b", "c", None])
        rows.append((i, " ".join("w" for _ in range(r.randint(1, 60))), s, "x", 1, 2))
    rows += [(5000, None, "a", "", 0, 0), (5001, "", "empty", "", 0, 0), (5002, " \t", "a", "", 0, 0), (None, "q r s", "a", "", 0, 0), (7, rows[7][1], rows[7][2], "", 0, 0)]
    return spark.createDataFrame(rows, DOCS), rows


def plain(rows, budget_share, entropy, repetition):
    tokens = defaultdict(int)
    for _, t, s, *_ in rows:
        tokens[s] += len((t or "").split())
    tokens = {k: v for k, v in tokens.items() if v}
    total = sum(tokens.values())

    def at(a):
        q = {k: (v / total) ** a for k, v in tokens.items()}
        z = sum(q.values())
        w = {k: x / z for k, x in q.items()}
        return w, -sum(x * math.log(x) for x in w.values()), max(budget_share * total * w[k] / tokens[k] for k in w)

    a = 1.0
    if entropy is not None and at(1.0)[1] < entropy * math.log(len(tokens)):
        low, high = 0.0, 1.0
        for _ in range(60):
            m = (low + high) / 2
            low, high = (m, high) if at(m)[1] >= entropy * math.log(len(tokens)) else (low, m)
        a = low
    if repetition is not None and at(a)[2] > repetition:
        low, high = a, 1.0
        for _ in range(60):
            m = (low + high) / 2
            low, high = (m, high) if at(m)[2] > repetition else (low, m)
        a = high
    return at(a)[0], tokens, total


@pytest.mark.parametrize(("share", "entropy", "repetition"), [(1.0, 0.95, None), (1.0, 0.99, 2.0), (0.4, None, None), (2.5, 0.9, 6.0)])
def test_weights_and_budgets(docs, share, entropy, repetition):
    df, rows = docs
    w, tokens, total = plain(rows, share, entropy, repetition)
    got = {x["source"]: x for x in mixing.weights(df, share, entropy, repetition).collect()}
    assert got.keys() == w.keys() and all(abs(got[k]["weight"] - w[k]) < 1e-5 for k in w)
    drawn, largest = defaultdict(int), defaultdict(int)
    epochs = defaultdict(set)
    for x in mixing.schedule(df, 3, share, entropy, repetition).collect():
        drawn[x["source"]] += x["n_tokens"]
        largest[x["source"]] = max(largest[x["source"]], x["n_tokens"])
        epochs[x["source"]].add(x["epoch"])
    for k in w:
        assert got[k]["budget"] <= drawn[k] < got[k]["budget"] + 60, k
        assert epochs[k] == set(range(math.ceil(got[k]["budget"] / tokens[k])))
    if repetition:
        assert all(drawn[k] <= (repetition + 0.01) * tokens[k] + 60 for k in w)


def test_mix_draws_as_the_schedule(docs):
    df, _ = docs
    want, got = defaultdict(int), defaultdict(int)
    for x in mixing.schedule(df, 3, 1.2, 0.97, 3.0).collect():
        want[x["doc_id"]] += 1
    out = mixing.mix(df, 3, 1.2, 0.97, 3.0)
    assert out.columns == df.columns
    for x in out.collect():
        got[x["doc_id"]] += 1
    assert got == want and max(want.values()) > 1


def test_epochs_are_permutations_and_repeatable(docs):
    df, _ = docs
    key = lambda x: (x["block_order"], x["doc_order"], x["doc_id"] or 0)
    rows = [x for x in mixing.schedule(df, 3, 2.0, None, None).collect() if x["source"] == "big"]
    orders = [[x["doc_id"] for x in sorted((x for x in rows if x["epoch"] == e), key=key)] for e in (0, 1)]
    assert sorted(orders[0]) == sorted(orders[1]) and orders[0] != orders[1]
    again = mixing.schedule(df.repartition(5), 3, 2.0, None, None)
    assert sorted(map(str, again.collect())) == sorted(map(str, mixing.schedule(df, 3, 2.0, None, None).collect()))


def test_empty(docs):
    df, _ = docs
    assert mixing.schedule(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    assert mixing.schedule(df.where("text IS NULL")).count() == 0
