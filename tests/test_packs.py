"""Evidence in packed blocks: what is shuffled stays small, and scores are rounded before they are ranked."""

import random

import pytest

from corvane.operators import meeting


@pytest.fixture
def tables(spark):
    r = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    c = spark.createDataFrame([(str(i), f"d{i % 4}", text(150)) for i in range(400)], "chunk_id string, document_id string, text string")
    return spark.createDataFrame([(i, text(40)) for i in range(120)], "k long, query string"), c


def test_terms_are_shuffled_in_packs(spark, tables, monkeypatch):
    monkeypatch.setattr(meeting, "QUERIES_OF_BLOCK", 10)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert meeting.evidence(*tables, "k").count() == 480
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    assert written() - before < 3_000_000  # 60,000 terms go to 12 blocks: 4 bytes each


def test_scores_are_rounded_before_they_are_ranked(tables):
    q, c = tables
    scores = {}
    for x in meeting.evidence(q, c, "k", top_k=1000, per_document=1000).collect():
        scores.setdefault(x["k"], []).append((-round(x["score"] + 1e-12, 1), x["chunk_id"], x["document_id"]))
    want = set()
    for k, rows in scores.items():
        seen = []
        for s, i, d in sorted(rows):
            if seen.count(d) < 3 and len(seen) < 4:
                seen.append(d)
                want.add((k, len(seen), i, -s))
    assert {(x["k"], x["rank"], x["chunk_id"], x["score"]) for x in meeting.evidence(q, c, "k", digits=1).collect()} == want
