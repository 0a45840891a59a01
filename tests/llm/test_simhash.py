import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from corvane.llm import simhash
from corvane.llm.simhash import agreement, layout, near_duplicates, nearest_edges, one_of_each, segment_masks, sweep

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("u", T.LongType())])


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("whole", [0, 1, 2])
def test_against_brute_force(spark, monkeypatch, whole):
    monkeypatch.setattr(simhash, "WHOLE_SEGMENTS", [0] * whole + [1 << 60])
    monkeypatch.setattr(simhash, "FOREST", 2 if whole else 16)
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        base = [r.choice(words) for _ in range(r.randint(1, 300))]
        rows.append((i * 3, " ".join(base)))
        if i % 3 == 0:
            for k in range(3):
                base = base[:]
                base[r.randrange(len(base))] = "x"
                rows.append((1000 + i * 3 + k, " ".join(base).upper()))
    rows += [(None, "a b c d e"), (7000, "a b c d e"), (7001, None), (7002, ""), (7003, " \t\n"), (7004, "one"), (7004, "one"), (7005, "é x y")]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    got = sorted((tuple(x) for x in near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_some_segment_differs_in_one_bit_at_most():
    assert [m.bit_count() for m, _ in segment_masks(4)] == [21, 22, 21] and sum(m for m, _ in segment_masks(4)) == 2**64 - 1
    r = random.Random(3)
    for bits in (1, 3, 4):
        for whole in (0, 1, 2, 3):
            masks = segment_masks(bits, whole)
            for _ in range(300):
                d = sum(1 << b for b in r.sample(range(64), r.randint(0, bits)))
                assert any((d & m).bit_count() <= 1 and not d & beside for m, beside in masks)


def test_forests():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 600).astype(np.uint64)
    fps = np.unique(np.concatenate([base, base[:200] ^ np.uint64(0b1111), base[:90] ^ np.uint64(0b11110000)]))

    def groups(u, v):
        root = {int(x): int(x) for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            assert (a ^ b).bit_count() <= 4
            root[find(a)] = find(b)
        return len({find(x) for x in root})

    far = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    i, j = np.nonzero(np.triu(far, 1))
    want = groups(fps[i], fps[j])
    u, v = sweep(fps, 4)
    assert groups(u, v) == want and len(u) <= len(fps) - want
    u, v = nearest_edges(fps[:, None], 4)
    got = set(zip(u.tolist(), v.tolist(), strict=True))
    assert all((a ^ b).bit_count() <= 4 for a, b in got) and len(u) <= 2 * len(fps)
    bits = np.bitwise_count(fps[:, None] ^ fps[None, :]).astype(int) + 99 * np.eye(len(fps), dtype=int)
    for k in np.flatnonzero(bits.min(axis=1) <= 4).tolist():
        assert any((int(fps[k]), int(fps[j])) in got for j in np.flatnonzero(bits[k] == bits[k].min()))
    key = np.zeros(len(fps), np.int64)
    same = simhash._edges(simhash._nearest(key, fps[:, None], 4, len(fps)))

    def closest(u, v):
        out = {}
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            side = (a, b > a)
            out[side] = min(out.get(side, 99), (a ^ b).bit_count())
        return out

    assert closest(u, v) == closest(*same)
    two = np.stack([fps, fps[::-1]], axis=1)  # of two words both count
    u, v = nearest_edges(two, 8)
    assert all(np.bitwise_count(two[np.flatnonzero(fps == a)[0]] ^ two[np.flatnonzero(fps == b)[0]]).sum() <= 8 for a, b in zip(u, v, strict=True))
    assert closest(u, v) == closest(*simhash._edges(simhash._nearest(key, two, 8, len(fps))))


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1])) if any(sets) else 1.0


def test_similar_texts_against_all_pairs(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    docs, pairs = [], []
    for i in range(400):
        base = [r.choice(words) for _ in range(r.randint(40, 300))]
        docs.append((2 * i, " ".join(base)))
        copy = base[:]
        for k in r.sample(range(len(base)), r.randint(0, max(1, len(base) // 40))):
            copy[k] = "edited"
        docs.append((2 * i + 1, " ".join(copy)))
        pairs.append(jaccard(docs[-1][1], docs[-2][1]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("m.1", T.StringType()), T.StructField("id", T.LongType())])
    kept = {x["doc_id"] for x in one_of_each(spark.createDataFrame([(d, t, "", 1) for d, t in docs], schema)).collect()}
    assert {2 * i for i in range(400)} <= kept
    like, unlike = [i for i in range(400) if pairs[i] >= 0.8], [i for i in range(400) if pairs[i] < 0.8]
    assert len(like) > 100 and len(unlike) > 30 and all(2 * i + 1 in kept for i in unlike)
    assert np.mean([2 * i + 1 not in kept for i in like]) > 0.96


def test_rows_of_each_group_and_odd_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("a.b", T.StringType()), T.StructField("node", T.LongType()), T.StructField("id", T.LongType())])
    one, two = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, one, "x", 1, 5), (1, two, "x", 2, 5), (2, one.upper(), "y", 3, 5), (1, one, "z", 4, 5), (None, two, "x", 5, 5), (None, "only here without id", "x", 6, 5), (None, "only here without id", "x", 7, 5), (4, None, "x", 8, 5), (5, "", "x", 9, 5), (6, " \n", "x", 10, 5)]
    got = one_of_each(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "a.b", "node", "id"]
    found = sorted((x["doc_id"], x["text"]) if x["doc_id"] else (0, x["text"]) for x in got.collect())
    assert found == [(0, "only here without id"), (1, one), (1, two), (4, None)]
    assert one_of_each(spark.createDataFrame([], schema)).count() == 0


def test_layout():
    assert 0.84 < agreement(0.8) < 0.86 and agreement(1.0) == 1.0
    for n in (0, 10, 10**4, 10**7, 10**10):
        size, segments = layout(n, 0.8)
        p = agreement(0.8)
        assert 1 - (1 - p**size - size * p ** (size - 1) * (1 - p)) ** segments >= simhash.RECALL and size <= 30


def test_every_pair_that_meets_is_verified(spark):
    """A group of copies edited more and less: each one's closest fingerprints aren't its most similar texts."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    base = [r.choice(words) for _ in range(150)]
    docs = []
    for i in range(700):
        copy = base[:]
        for k in r.sample(range(len(base)), r.randint(1, 9)):
            copy[k] = f"edited{r.randrange(10**6)}"
        docs.append((i, " ".join(copy)))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    size, segments = layout(len(docs), 0.8)
    keyed = rows.selectExpr("doc_id AS id", "0L AS m1", "0L AS m2", "CAST(text AS binary) AS text")
    sets = [(x["id"], np.array(x["fps"], np.int64).view(np.uint64), set(np.frombuffer(x["shingles"], np.uint32).tolist())) for x in simhash._shingled(keyed, 5, 42, 2).collect()]
    root = {i: i for i, _, _ in sets}
    for i, a, x in sets:
        for j, b, y in sets[:i]:
            d = a ^ b
            meet = any((int(d[k // (64 // size)]) >> (k % (64 // size) * size) & ((1 << size) - 1)).bit_count() <= 1 for k in range(segments))
            if root[i] != root[j] and meet and np.bitwise_count(d).sum() <= simhash.farthest(128, 0.8) and len(x & y) >= 0.8 * len(x | y):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if v == old else v for k, v in root.items()}
    assert 2 < len(set(root.values())) < 600
    assert {x["doc_id"] for x in one_of_each(rows).collect()} == set(root.values())
