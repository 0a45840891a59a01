import random
import zlib
from collections import Counter

from corvane.llm import spelling
from corvane.llm.spelling import Automaton

SCHEMA = "doc_id long, text string, word string, n long"


def one_apart(a, b):
    """Whether one code point inserted, deleted or replaced parts two words."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least, occurrences, divisor, factor):
    import re

    n = Counter()
    for doc, text in rows:
        for w in re.findall(r"[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % divisor == 0 else w
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= occurrences}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: v if v and n[v] >= factor * n[w] else None for w, v in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def corpus(seed, docs, words):
    r = random.Random(seed)
    some = ["".join(r.choice("abéÿ×ß") for _ in range(r.randint(3, 9))) for _ in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    return [(r.choice([None, i, i, 7]), r.choice([" ", ", ", "\n", "ł", "1"]).join(r.choices([*some, "ABabab", "Éaaaaa"], [*weights, 0.2, 0.2], k=r.randint(0, 120)))) for i in range(docs)] + [(1, None), (2, ""), (3, "aaaaaa " * 3000), (3, "aaaaaa " * 3000)]


def test_automaton_is_minimal_and_numbers_its_words():
    r = random.Random(2)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(600)})
    a = Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words))) and a.count[0] == len(words)
    assert a.number("abcabcab") is None and a.number("") is None
    # states that can be reached are as many as different sets of endings
    ends = {}
    for w in words:
        for i in range(len(w) + 1):
            ends.setdefault(w[:i], set()).add(w[i:])
    reached, todo = {0}, [0]
    while todo:
        for t, _ in a.arcs[todo.pop()].values():
            if t not in reached:
                reached.add(t)
                todo.append(t)
    assert len(reached) == len({frozenset(e) for e in ends.values()})
    for w in words[::7]:
        for half in range(len(w)):
            assert {words[k] for k in a.near(w, half)} == {v for v in words if v[:half] == w[:half] and one_apart(w[half:], v[half:])}
    assert Automaton([]).near("abc", 1) == set() and Automaton(["ab"]).number("ab") == 0


def test_variants_against_brute_force(spark):
    chains = 0
    for seed, least, occurrences, divisor, factor in ((1, 6, 5, 199, 5), (2, 4, 1, 3, 2), (3, 2, 1, 5, 2)):
        rows = corpus(seed, 60, 150)
        df = spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], SCHEMA).repartition(5)
        got = {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in spelling.variants(df, least, occurrences, divisor, factor).collect()}
        want = brute(rows, least, occurrences, divisor, factor)
        assert got == want and len(want) > 40, seed
        chains += sum(v[0] != v[1] for v in want.values() if v[0])
    assert chains > 5


def test_shards_and_slices_find_the_same(spark, monkeypatch):
    r = random.Random(3)
    words = sorted({"pre" + "".join(r.choice("abcd") for _ in range(r.randint(3, 6))) for _ in range(400)} | {"".join(r.choice("abcd") for _ in range(r.randint(3, 6))) + "ing" for _ in range(400)})
    vocabulary = spark.createDataFrame([(w, r.randint(5, 90)) for w in words], "word string, n long").persist()
    whole = sorted(map(tuple, spelling.near(vocabulary).collect()))
    assert whole == sorted(map(tuple, spelling.near(vocabulary, shard=50, most=7).collect())) and len(whole) > 300
    n = {x["word"]: x["n"] for x in vocabulary.collect()}
    for w, n_near, near_n, best in whole:
        near = [v for v in words if one_apart(w, v)]
        assert n_near == len(near) and best == min(near, key=lambda v: (-n[v], v)) and near_n == n[best]
    monkeypatch.setattr(spelling, "HELD", 10)
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=50))) for i in range(20)], "doc_id long, text string")
    assert {x["word"]: x["n"] for x in spelling.words(docs, occurrences=1, divisor=10**9).collect()} == Counter(w for x in docs.collect() for w in x["text"].split())


def test_chains_and_empty_tables(spark):
    links = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(20)] + [("x", "w03"), ("y", "z")], "word string, form string")
    assert {x["word"]: x["root"] for x in spelling.roots(links).collect()} == {f"w{i:02}": "w20" for i in range(20)} | {"x": "w20", "y": "z"}
    for rows in ([], [(1, None, "", 0), (2, "kurz", "", 0)]):
        assert spelling.variants(spark.createDataFrame(rows, SCHEMA)).collect() == []
