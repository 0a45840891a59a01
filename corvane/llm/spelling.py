"""Spelling variants: words one edit apart are found by minimal acyclic automata in both directions.

A word is cut in half. If another word differs from it by one code point, the first half stands in it unchanged (the
error is behind it) or the second half does. So words are dealt by halves: a dictionary word goes to every half by which
a word of its length, one more or one less may ask for it (two in each direction), and asks by its own. In a task the
dictionary words are compiled into a minimal automaton (of reversed words, for second halves) in which a word's number
is its place among them; a query walks its half exactly and completes the rest with one error. What both directions find
counts in the forward one only.

Shards are many halves; a half with more than MOST words is dealt as slices of its dictionary, each asked by all of its
queries. So no task holds more than a shard of about SHARD words and a slice, whatever beginnings or endings are common.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Dictionary words of a shard (about), most words of a half that isn't sliced, and different words that a task counts before it passes them on.
SHARD, MOST, HELD = 20_000, 20_000, 300_000


class Automaton:
    """The minimal acyclic automaton of sorted different words. arcs[state]: code point -> (state, words before those that go this way)."""

    def __init__(self, words: list[str]):
        self.words = words
        self.arcs: list[dict] = [{}]
        self.final, self.count = [False], [0]
        known: dict[tuple, int] = {}
        free: list[int] = []
        path, before = [0], ""

        def settle(depth: int) -> None:
            """The states below depth on the path are done: each is one that is known already, or becomes known."""
            while len(path) > depth + 1:
                s = path.pop()
                total = int(self.final[s])
                arcs = {}
                for c, t in self.arcs[s].items():
                    arcs[c] = (t, total)
                    total += self.count[t]
                key = (self.final[s], tuple(self.arcs[s].items()))
                same = known.setdefault(key, s)
                if same == s:
                    self.arcs[s], self.count[s] = arcs, total
                else:
                    self.arcs[path[-1]][before[len(path) - 1]] = same
                    free.append(s)

        for w in words:
            k = 0
            while k < len(before) and k < len(w) and before[k] == w[k]:
                k += 1
            settle(k)
            for c in w[k:]:
                if free:
                    s = free.pop()
                    self.arcs[s], self.final[s], self.count[s] = {}, False, 0
                else:
                    s = len(self.arcs)
                    self.arcs.append({})
                    self.final.append(False)
                    self.count.append(0)
                self.arcs[path[-1]][c] = s
                path.append(s)
            self.final[path[-1]] = True
            before = w
        settle(0)
        total, arcs = int(self.final[0]), {}
        for c, t in self.arcs[0].items():
            arcs[c] = (t, total)
            total += self.count[t]
        self.arcs[0], self.count[0] = arcs, total

    def number(self, word: str) -> int | None:
        """A word's place among the words."""
        s = n = 0
        for c in word:
            arc = self.arcs[s].get(c)
            if arc is None:
                return None
            s, n = arc[0], n + arc[1]
        return n if self.final[s] else None

    def near(self, word: str, half: int) -> set[int]:
        """Numbers of the words that have word's first half code points and differ from it by one inserted, deleted or replaced code point behind them."""
        arcs, final, size, found = self.arcs, self.final, len(word), set()
        s = n = 0
        for c in word[:half]:
            arc = arcs[s].get(c)
            if arc is None:
                return found
            s, n = arc[0], n + arc[1]

        def rest(t: int, m: int, i: int) -> None:
            while i < size:
                arc = arcs[t].get(word[i])
                if arc is None:
                    return
                t, m = arc[0], m + arc[1]
                i += 1
            if final[t]:
                found.add(m)

        for i in range(half, size + 1):
            at = word[i] if i < size else None
            for c, (t, k) in arcs[s].items():
                rest(t, n + k, i)  # one inserted
                if at is not None and c != at:
                    rest(t, n + k, i + 1)  # one replaced
            if at is None:
                break
            rest(s, n, i + 1)  # one deleted
            arc = arcs[s].get(at)
            if arc is None:
                break
            s, n = arc[0], n + arc[1]
        return found


def _counts(least: int, divisor: int):
    """doc_id, text -> word, n: how often a word occurs, in parts."""
    import re

    run = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def out(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # Latin-1 has all letters that count; whatever else becomes "?", and lower() changes A-Z only
                for w, n in Counter(run.findall(text.encode("latin-1", "replace").lower())).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % divisor == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least:
                            continue
                    held[w] = held.get(w, 0) + n
                if len(held) >= HELD:
                    yield out(held)
                    held = {}
        if held:
            yield out(held)

    return count


def _search(key: tuple, rows: pa.Table) -> pa.Table:
    """word, n, entry, query of a shard in one direction -> (word, n_near, near_n, near) of its queries: how many near words, and the one of most occurrences."""
    back = key[0].as_py() == 1
    turn = (lambda w: w[::-1]) if back else (lambda w: w)
    counts, queries = {}, set()
    for w, n, entry, query in zip(*(rows.column(c).to_pylist() for c in ("word", "n", "entry", "query")), strict=True):
        if entry:
            counts[w] = n
        if query:
            queries.add(w)
    words = sorted(turn(w) for w in counts)
    ns = [counts[turn(w)] for w in words]  # by number
    found = Automaton(words)
    out: list[tuple] = []
    for w in queries:
        half = len(w) // 2
        first = w[:half]
        n_near, best = 0, None
        for k in found.near(turn(w), len(w) - half if back else half):
            v = turn(words[k])
            if back and v.startswith(first):  # found forward
                continue
            n_near += 1
            rank = (-ns[k], v)
            if best is None or rank < best:
                best = rank
        if best is not None:
            out.append((w, n_near, -best[0], best[1]))
    cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
    return pa.table({"word": pa.array(cols[0], pa.string()), "n_near": pa.array(cols[1], pa.int64()), "near_n": pa.array(cols[2], pa.int64()), "near": pa.array(cols[3], pa.string())})


def words(docs: DataFrame, least: int = 6, occurrences: int = 5, divisor: int = 199) -> DataFrame:
    """(word, n) of docs (doc_id, text): runs of letters up to U+00FF, A-Z lower-cased, of at least so many code points and occurrences.

    A run whose crc32 with its document's id is divisible by divisor loses the code point at that number modulo its length.
    Null texts have no words, a null doc_id counts as empty. Repeated rows count each.
    """
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counts(least, divisor), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def near(vocabulary: DataFrame, least: int = 6, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """(word, n_near, near_n, near) of the words of (word, n) that others are near: their number, and the one with most occurrences (ties: the smallest)."""
    n = F.length("word")
    keys = []
    for back in (0, 1):
        for d in (-1, 0, 1):  # the lengths that may ask
            half = F.floor((n + d + back) / 2).cast("int")
            part = F.right("word", half) if back else F.left("word", half)
            keys.append(F.when(n + d >= least, F.struct(F.lit(back).alias("back"), part.alias("half"))))
    own = F.when(F.col("k.back") == 0, F.floor(n / 2)).otherwise(F.ceil(n / 2))
    entries = vocabulary.select("word", "n", F.explode(F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull()))).alias("k"))
    entries = entries.select("word", "n", F.col("k.back").alias("back"), F.col("k.half").alias("half"), (F.length("k.half") == own).alias("query"))
    entries = materialize(entries, "halves")
    shards = max(1, -(-entries.count() // shard))
    wide = entries.groupBy("back", "half").agg(F.count("*").alias("size")).where(F.col("size") > most)
    wide = materialize(wide.select("back", "half", F.ceil(F.col("size") / most).cast("int").alias("slices")), "wide")
    # a row of wide stands for more than MOST entries, so it has a 20,000th of their rows at most; Catalyst chooses the join
    rows = entries.join(wide, ["back", "half"], "left")
    plain = rows.where("slices IS NULL").select("back", F.pmod(F.xxhash64("half"), F.lit(shards)).alias("shard"), F.lit("").alias("of"), F.lit(True).alias("entry"), "query", "word", "n")
    sliced = rows.where("slices IS NOT NULL")
    held = sliced.select("back", F.pmod(F.xxhash64("word"), F.col("slices").cast("long")).alias("shard"), F.col("half").alias("of"), F.lit(True).alias("entry"), F.lit(False).alias("query"), "word", "n")
    asked = sliced.where("query").select("back", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices").cast("long") - 1)).alias("shard"), F.col("half").alias("of"), F.lit(False).alias("entry"), F.lit(True).alias("query"), "word", "n")
    dealt = plain.unionByName(held).unionByName(asked)
    found = dealt.groupBy("back", "shard", "of").applyInArrow(_search, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("near_n"), "b.near")
    out = materialize(found, "near")
    release(entries, wide)
    return out


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form), whose chains end: what the forms of forms lead to. Each round doubles the steps taken."""
    at = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        to = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not at.join(to, "root", "left_semi").limit(1).count():
            return at
        further = at.join(to, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        before, at = at, materialize(further, "roots")
        release(before)


def variants(docs: DataFrame, least: int = 6, occurrences: int = 5, divisor: int = 199, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs (doc_id, text); see words().

    Words are near if one inserted, deleted or replaced code point parts them. A word's form is its near word of most
    occurrences (ties: the smallest in the order of code points) if it has factor times the word's own or more, else null;
    root is where the forms of forms end. Counts cover all rows; an empty table and texts without such words give no rows.
    """
    if least < 2 or factor < 2:
        raise ValueError("halves need words of two code points, chains of forms need factors of two")
    known = materialize(words(docs, least, occurrences, divisor), "words")
    rows = known.join(near(known, least), "word", "left")
    given = F.col("near_n") >= factor * F.col("n")
    rows = materialize(rows.select("word", F.when(given, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(given, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
