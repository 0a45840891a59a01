"""Substring dedup: words of 20-word passages that occurred earlier are removed.

Method (repeated-phrase automata). A window of WINDOW words is named by an anchor: the SEED-word phrase in it whose hash
is least, so equal windows have equal anchors. One pass counts the anchors; those met only once in the corpus can't be in
a repeated window. A second pass deals passages to shards by anchor where a bitmap of the recurring ones lets them pass. A
shard reads its passages in order of (document, position); of those that have a window whose hash recurs (the others can't
hold a repeated one) it confirms the word sequences, compiles them into an Aho-Corasick automaton over word symbols and
streams the passages through it, which locates every occurrence: a window
with another anchor can't be equal to one of the shard's. Occurrences but the earliest mark the words that go.

A shard holds SHARD_ROWS passages at a time. An anchor met more than HOT times is dealt by whole window instead, so a
frequent phrase with ever different surroundings spreads over all tasks. A window met more than HOT times is dealt out in
SLICES by document, each led by the window's first occurrence, a grouped minimum. Nothing is capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, bitmap, materialize, mix64, passing, release

WINDOW, SEED = 20, 5
SHARD_ROWS, HOT, SLICES = 4000, 100_000, 64
#: Most anchors that are dealt by whole window (8 bytes each are sent to all tasks); the threshold rises until no more are left.
MOST_HOT = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)


def phrase_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of every k consecutive words."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        out = out * BASE + h[i : i + n]
    return out


def window_sums(h: np.ndarray, window: int) -> np.ndarray:
    """32 bits of a hash of every window, put together from spans of doubled length."""
    out, have, rest = h, 1, []
    power = int(BASE)
    while True:
        if window & have:
            rest.append((out, have, power))
        if 2 * have > window:
            break
        out = out[:-have] * np.uint64(power) + out[have:] if len(out) > have else out[:0]
        have, power = 2 * have, power * power % 2**64
    n = len(h) - window + 1
    total, at = np.zeros(max(n, 0), np.uint64), 0
    for part, length, factor in rest:
        if n > 0:
            total = total * np.uint64(factor) + part[at : at + n]
        at += length
    return (mix64(total) >> np.uint64(32)).astype("<u4")


def anchors(h: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Of each window, in order: where its anchor starts; and every seed phrase's hash.

    Phrases are ordered by the upper half of their hash, then by place; both are the same in equal windows, up to where
    the window starts. The least of a span is found by spans of doubled length.
    """
    g = mix64(phrase_hashes(h, seed))
    span, have = window - seed + 1, 1
    if len(g) < span:
        return np.zeros(0, np.int64), g
    low = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64), g


def _anchor_counts(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """(anchor, n) of the anchors that recur; docs: text binary. A document's anchors at different places count each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [np.zeros(0, np.int64)]
            for t in b.column(0):
                words = (t.as_py() or b"").split()
                if len(words) >= window:
                    at, g = anchors(word_hashes(words), window, seed)
                    keys.append(g[np.unique(at)].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys))], names=["anchor"])

    return docs.mapInArrow(run, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")


def _passages(rows: DataFrame, window: int, seed: int, bits: np.ndarray, hot: np.ndarray, whole: bool) -> DataFrame:
    """rows: id, mark, text. The passages whose windows have an anchor that the bitmap lets pass, but for hot ones; or (whole) the windows with a hot one, each by itself."""
    sent = rows.sparkSession.sparkContext.broadcast((bits, np.sort(hot)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = sent.value
        for b in batches:
            out: list[tuple] = []
            texts: list[bytes] = []
            sums: list[bytes] = []
            for i, m, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = (t.as_py() or b"").split()
                if len(words) < window:
                    continue
                h = word_hashes(words)
                at, g = anchors(h, window, seed)
                cut = np.flatnonzero(np.diff(at)) + 1
                first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)]))
                key = g[at[first]]
                some = np.flatnonzero(passing(bits, key))
                if not len(some):
                    continue
                a, z, key = first[some], last[some], key[some]
                if len(hot):
                    is_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                    a, z, key = (x[is_hot == whole] for x in (a, z, key))
                    if not len(a):
                        continue
                if whole:
                    a = np.concatenate([np.arange(x, y) for x, y in zip(a.tolist(), z.tolist(), strict=True)])
                    z, key = a + 1, mix64(phrase_hashes(h, window))[a]
                line = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                starts = np.where(a > 0, ends[a - 1], 0).tolist()
                stops = (ends[z + window - 2] - 1).tolist()
                texts += [line[x:y] for x, y in zip(starts, stops, strict=True)]
                line = window_sums(h, window).tobytes()
                sums += [line[x:y] for x, y in zip((4 * a).tolist(), (4 * z).tolist(), strict=True)]
                out.append((key.view(np.int64), np.full(len(a), i, np.int64), np.full(len(a), m, np.int64), a.astype(np.int32)))
                if len(texts) > 20_000:
                    yield _rows(out, texts, sums)
                    out, texts, sums = [], [], []
            if out:
                yield _rows(out, texts, sums)

    def _rows(out: list[tuple], texts: list[bytes], sums: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in zip(*out, strict=True)), pa.array(texts, pa.binary()), pa.array(sums, pa.binary())], names=["shard", "id", "mark", "start", "passage", "sums"])

    return rows.mapInArrow(run, "shard long, id long, mark long, start int, passage binary, sums binary")


def _sliced(alone: DataFrame) -> DataFrame:
    """Windows; those that occur more than HOT times in slices by document, each with the window's first occurrence too."""
    often = alone.groupBy("shard").agg(F.count("*").alias("n"), F.min_by(F.struct("id", "mark", "start", "passage", "sums"), F.struct("id", "start", "mark")).alias("first")).where(F.col("n") > HOT)
    often = materialize(often, "often")
    of_slice = lambda k: F.xxhash64("shard", k)
    firsts = often.select("shard", "first.*", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("k")).select(of_slice(F.col("k")).alias("shard"), "id", "mark", "start", "passage", "sums")
    marked = alone.join(often.select("shard", F.lit(True).alias("much")), "shard", "left")
    slices = marked.withColumn("shard", F.when(F.col("much"), of_slice(F.pmod(F.xxhash64("id", "mark"), F.lit(SLICES)).cast("int"))).otherwise(F.col("shard")))
    return slices.select(*firsts.columns).unionByName(firsts)


class Symbols(dict):
    """Word -> character, in order of appearance; surrogates are left out."""

    def __missing__(self, word: bytes) -> str:
        n = len(self) + 1
        self[word] = c = chr(n if n < 0xD800 else n + 0x800)
        return c


class Shard:
    """Passages in order of (shard key, document, start); automata over their words."""

    def __init__(self, window: int):
        self.window, self.key, self.words, self.first, self.lines = window, None, Symbols(), {}, {}

    def occurrences(self, keys: list, ids: list, starts: list, passages: list) -> list[tuple[int, int, int]]:
        """(row, from, to) of the words in windows that started earlier. The rows' keys follow on from the last call's.

        Of passages that are the same word for word, one is searched; the rest share what was found.
        """
        if keys[0] != self.key:  # else a long group goes on
            self.words, self.first, self.lines = Symbols(), {}, {}
        self.key = keys[-1]
        w, symbol, first, confirmed = self.window, self.words.__getitem__, self.first, {}
        rows, again = [], self.lines  # line -> whether it has been met twice
        for i, s, p in zip(ids, starts, passages, strict=True):
            line = "".join(map(symbol, p.split()))
            rows.append(line)
            if again.get(line):
                continue
            for k in range(len(line) - w + 1):
                phrase = line[k : k + w]
                known = first.get(phrase)
                if known is None:
                    first[phrase] = (i, s + k)
                else:
                    confirmed[phrase] = known
            again[line] = line in again
        if not confirmed and not any(map(again.get, rows)):
            return []
        for line in {x for x in rows if again[x]}:  # of an earlier call, or met twice in this one
            for k in range(len(line) - w + 1):
                phrase = line[k : k + w]
                confirmed[phrase] = first[phrase]
        automaton = ahocorasick.Automaton()
        for phrase, known in confirmed.items():
            automaton.add_word(phrase, known)
        automaton.make_automaton()
        found = {line: self._spans([(end + 1 - w, known) for end, known in automaton.iter(line)]) for line in set(rows)}
        out = []
        for r, line in enumerate(rows):
            hits, latest, spans = found[line]
            if not hits:
                continue
            if not latest < (ids[r], starts[r]):  # some may be this very occurrence, or a later one
                _, _, spans = self._spans([(k, known) for k, known in hits if known < (ids[r], starts[r] + k)])
            out += [(r, starts[r] + a, starts[r] + b) for a, b in spans]
        return out

    def _spans(self, hits: list) -> tuple[list, tuple | None, list[tuple[int, int]]]:
        """The hits (place, first occurrence), the latest of those occurrences, and the merged places."""
        spans: list[tuple[int, int]] = []
        for k, _ in hits:
            if spans and k <= spans[-1][1]:
                spans[-1] = (spans[-1][0], k + self.window)
            else:
                spans.append((k, k + self.window))
        return hits, max((known for _, known in hits), default=None), spans


def _recurring(keys: list, sums: list) -> list[int]:
    """Places of the passages with a window whose hash another window under the same key has: no other can hold a repeated one."""
    lengths = np.fromiter(map(len, sums), np.int64, len(sums)) >> 2
    both = mix64(np.repeat(np.array(keys, np.int64).view(np.uint64), lengths)) + np.frombuffer(b"".join(sums), "<u4")
    order = np.argsort(both, kind="stable")
    same = np.diff(both[order]) == 0
    again = np.zeros(len(both), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return np.flatnonzero(np.bincount(np.repeat(np.arange(len(sums)), lengths), again, len(sums))).tolist()


def _covered(passages: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = Shard(window), [[] for _ in range(6)]

        def ready(last: bool) -> pa.RecordBatch | None:
            """Handle whole groups, or, if one alone is too many, what there is of it."""
            keys = held[0]
            n, whole = len(keys), True
            if not last:
                while n and keys[n - 1] == keys[-1]:
                    n -= 1
                if not n and len(keys) >= SHARD_ROWS:
                    n, whole = len(keys), False
            if not n:
                return None
            part = [x[:n] for x in held]
            for x in held:
                del x[:n]
            m = 0  # rows of a long group that goes on
            while shard.key is not None and m < n and part[0][m] == shard.key:
                m += 1
            some = [m + k for k in _recurring(part[0][m:], part[5][m:])] if whole and m < n else list(range(m, n))
            found = []
            for rows in (list(range(m)), some):
                if rows:
                    found += [(rows[r], a, b) for r, a, b in shard.occurrences(*([part[c][r] for r in rows] for c in (0, 1, 3, 4)))]
            if not found:
                return None
            r, a, b = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([part[1][i] for i in r], pa.int64()), pa.array([part[2][i] for i in r], pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["id", "mark", "a", "b"])

        for whole in batches:
            for i in range(0, whole.num_rows, SHARD_ROWS):
                for x, c in zip(held, whole.slice(i, SHARD_ROWS).columns, strict=True):
                    x += c.to_pylist()
                if len(held[0]) >= SHARD_ROWS and (out := ready(False)) is not None:
                    yield out
        while held[0]:
            if (out := ready(True)) is not None:
                yield out

    parts = passages.repartition("shard").sortWithinPartitions("shard", "id", "start", "mark").select("shard", "id", "mark", "start", "passage", "sums")
    return parts.mapInArrow(run, "id long, mark long, a int, b int")


def _strip(rows: DataFrame) -> DataFrame:
    """rows: id, text, gone (array of (a, b), or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, kept = [], [], []
            for t, gone in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                words = (t.as_py() or b"").split()
                total.append(len(words))
                if gone:
                    mask = np.zeros(len(words) + 1, np.int64)
                    for x in gone:
                        mask[x["a"]] += 1
                        mask[x["b"]] -= 1
                    stay = np.cumsum(mask[:-1]) == 0
                    words = [w for w, ok in zip(words, stay.tolist(), strict=True) if ok]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, "id long, n_words long, n_removed long, kept binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row of docs.

    Words are runs of bytes other than space and tab to carriage return, unchanged; kept_text joins what stays by one
    space. A word goes if it is in a window of so many words that starts earlier too: in a smaller doc_id, or further up
    in the same. A null doc_id counts as the smallest. Rows that repeat a doc_id are the same document: equal places in
    them aren't earlier than one another. Null and empty texts have no words; an empty table gives no rows.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    counted = materialize(_anchor_counts(base.select("text"), window, seed), "anchors")
    n, times = counted.agg(F.count("*"), F.sum("n")).first()
    hot = counted.where(F.col("n") > max(HOT, (times or 0) // MOST_HOT)).select("anchor").toPandas()["anchor"].to_numpy(np.int64)
    bits = bitmap(counted.select("anchor"), n)
    release(counted)
    passages = _passages(base, window, seed, bits, hot.view(np.uint64), False)
    if len(hot):
        alone = materialize(_passages(base, window, seed, bits, hot.view(np.uint64), True), "windows")
        passages = passages.unionByName(_sliced(alone))
    gone = _covered(passages, window).groupBy("id", "mark").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    gone = materialize(gone, "repeats")
    out = _strip(base.join(gone, ["id", "mark"], "left").select("id", "text", "gone"))
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))
