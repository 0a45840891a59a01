import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from corvane.llm import packing
from corvane.llm.packing import Encoder, best_fit_decreasing

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("row", T.LongType())])
ENCODER = Encoder(open(packing.VOCABULARY, "rb").read())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t ab'sé1.!|界　\x1c\x85🎧")), max_size=40))
def test_ids_are_the_vocabularys_own(text):
    assert np.frombuffer(ENCODER.encode(text), ENCODER.kind).tolist() == ENCODER.encoding.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=60))
def test_best_fit_against_a_plain_scan(lengths):
    rows, left = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in range(len(rows)) if left[r] >= lengths[i]]
        if fits:
            least = min(left[r] for r in fits)
            r = [r for r in fits if left[r] == least][-1]
            rows[r].append(i)
            left[r] -= lengths[i]
        else:
            rows.append([i])
            left.append(37 - lengths[i])
    got = best_fit_decreasing(lengths, 37)
    assert sorted(i for r in got for i in r) == list(range(len(lengths)))
    fill = lambda rs: sorted(sum(lengths[i] for i in r) for r in rs)
    assert fill(got) == fill(rows) and all(x <= 37 for x in fill(got))


@pytest.mark.parametrize("chunk", [1 << 20, 200])
def test_round_trip(spark, monkeypatch, chunk):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["alpha", "the", "naïve", "x\n", "", "12"]) for _ in range(r.randint(1, 400))), "clash", 0) for i in range(80)]
    rows += [(900, None, "", 0), (901, "", "", 0), (902, " \n ", "", 0), (903, "y" * 9000, "", 0), (None, "no id", "", 0)]
    rows += [(904, "twice", "", 0)] * 2
    out = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), length=64).collect()
    m = packing.matrix(out, 64)
    assert m.shape == (len(out), 64) and len({(x["shard"], x["row"]) for x in out}) == len(out)
    back = defaultdict(list)
    for x, ids in zip(out, m, strict=True):
        cu = x["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == x["n_tokens"] and x["position_resets"] == cu[:-1] and (ids[cu[-1] :] == packing.END).all()
        for d, o, a, b in zip(x["doc_ids"], x["doc_offsets"], cu, cu[1:], strict=False):
            back[d].append((o, ids[a:b].tolist()))
    want = {d: ENCODER.encoding.encode_ordinary(t) + [packing.END] for d, t, *_ in rows if t}
    assert back.keys() == want.keys()
    for d, parts in back.items():
        if d == 904:
            assert [p for _, p in parts] == [want[d]] * 2
        else:
            assert [i for _, p in sorted(parts) for i in p] == want[d]
            assert all(len(p) == 64 for _, p in sorted(parts)[:-1])
    if chunk > 200:
        assert m.size < 1.2 * sum(map(len, want.values())) + 3 * 64


def test_write_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", "", 0), (2, "c", "", 0)], DOCS)
    packing.write(packing.pack(df, length=8), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 1
    assert packing.pack(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t\x85　ab'1.\x1c")), max_size=40))
def test_runs_of_white_space_cut_out_beforehand(text):
    short = Encoder(open(packing.VOCABULARY, "rb").read(), long=2) if not hasattr(packing, "_short") else packing._short
    packing._short = short
    assert short.encode(text) == ENCODER.encode(text)


@pytest.mark.parametrize("text", ["a" + " " * 5_000_000 + "b", "\t" * 5_000_000, "x\n" + "\n" * 5_000_000 + " y", "z" * 5_000_000])
def test_very_long_runs(text):
    ids = np.frombuffer(ENCODER.encode(text), ENCODER.kind).tolist()
    assert ENCODER.encoding.decode(ids) == text
