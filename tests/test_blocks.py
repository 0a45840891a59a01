"""Evidence scored by blocks of queries and chunks has the rows of the plain join."""

import random

from corvane.operators import meeting


def test_blocks_of_queries_and_chunks(spark, monkeypatch):
    r = random.Random(2)
    words = [f"w{i}" for i in range(40)] + ["é", "Ünder"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    chunks = [(str(i), f"d{i % 5}" if i % 7 else None, text(12)) for i in range(60)]
    chunks += [(str(100 + i), x[1], x[2]) for i, x in enumerate(chunks[:20])] + [("900", "d1", "")]  # ties, and no terms
    c = spark.createDataFrame(chunks, "chunk_id string, document_id string, text string")
    q = spark.createDataFrame([(i, text(6)) for i in range(23)] + [(50, ""), (51, "unknown")], "k long, query string")
    want = sorted(map(str, meeting.evidence(q, c, "k", phrase_bonus=1e-300).collect()))
    monkeypatch.setattr(meeting, "QUERIES_OF_BLOCK", 5)
    monkeypatch.setattr(meeting, "CHUNKS_OF_BLOCK", 9)
    assert len(want) == 23 * 4 and sorted(map(str, meeting.evidence(q, c, "k").collect())) == want
