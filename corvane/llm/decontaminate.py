"""Benchmark decontamination: rare n-gram seeds join passages of documents to test items; Smith-Waterman alignment scores them.

One pass over the documents hashes every word n-gram and keeps those that a bitmap of the items' n-grams lets pass; a join
with the items' n-grams drops what passed by chance. How often each n-gram occurs in the corpus is counted over the rest.
An item's seeds are its rare n-grams: those that are not far more frequent than four fifths of the item's own. Rarity is
measured within the item, as all n-grams of an item that has leaked a million times occur a million times. Seeds join
their occurrences to items; only documents with a seed are read again, and around each run of seeds of one item the
passage is aligned with the item word by word. The passes are the same however large the benchmark is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_TEXTS, Cache, bitmap, materialize, passing, release, rolling, small_enough, text_marks

#: Words of a seed. N-grams more than FACTOR times as frequent as this share of the item's own are no seeds.
SEED, SHARE, FACTOR = 3, 0.8, 4
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: Least alignment score against the item's own.
LEAST = 0.5
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


def tokens(text: bytes | None) -> list[bytes]:
    return TOKEN.findall((text or b"").decode("utf-8", "replace").lower().encode())


def word_hashes(text: bytes | None, cache: Cache | None = None) -> np.ndarray:
    """A 64-bit hash of each word; cache (see hashes_of) is by what stands between white space."""
    raw = (text or b"").split() if cache is not None else [text or b""]
    return np.frombuffer(b"".join(map(cache.__getitem__ if cache is not None else hashes_of, raw)), np.uint64)


def hashes_of(raw: bytes) -> bytes:
    return b"".join([xxhash.xxh3_64_digest(w) for w in tokens(raw)])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman with linear gaps: best score, and where the aligned words of the passage begin and end."""
    n = len(passage)
    ramp = GAP * np.arange(n + 1)
    row, begin = np.zeros(n + 1), np.arange(n + 1)
    best = (0.0, 0, 0)
    places = np.arange(n + 1)
    for w in item:
        step = np.zeros(n + 1)
        step[1:] = row[:-1] + np.where(passage == w, MATCH, MISMATCH)
        up = row + GAP
        diagonal = np.concatenate(([0], begin[:-1]))
        here, origin = np.where(step >= up, step, up), np.where(step >= up, diagonal, begin)
        origin = np.where(here > 0, origin, places)
        here = np.maximum(here, 0)
        run = np.maximum.accumulate(here - ramp)  # a gap in the item: the best to the left less its length
        source = np.maximum.accumulate(np.where(here - ramp >= run, places, 0))
        row = run + ramp
        begin = np.where(row > 0, origin[source], places)
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (float(row[top]), int(begin[top]), top)
    return best


def best_alignment(item: np.ndarray, words: np.ndarray, begins: list[int]) -> tuple[float, int, int] | None:
    """(score, first word, end) of the best alignment of an item near the places where seeds say that it begins, the first if equal; None below LEAST."""
    n, own = len(item), np.unique(item)
    begins = sorted(set(begins))
    if n < SEED:  # the seed is the whole item
        return 1.0, begins[0], begins[0] + n
    best, k = None, 0
    while k < len(begins):  # seeds near one another share a passage
        m = k
        while m + 1 < len(begins) and begins[m + 1] - begins[m] <= n:
            m += 1
        low, high = max(0, begins[k] - n // 2 - 2), min(len(words), begins[m] + n + n // 2 + 2)
        part = words[low:high]
        if np.isin(part, own).sum() >= LEAST * n:  # no alignment has more matches
            score, a, b = align(item, part)
            score /= n * MATCH
            if score >= LEAST and (best is None or score > best[0]):
                best = (score, low + a, low + b)
        k = m + 1
    return best


def _item_grams(items: DataFrame) -> DataFrame:
    """(gram, item, place, n_words) of items (item, text binary): n-grams of SEED words, or of all words of a shorter item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = word_hashes(t.as_py())
                g = rolling(h, min(SEED, len(h))) if len(h) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.full(len(g), i, np.int64)), pa.array(np.arange(len(g), dtype=np.int32)), pa.array(np.full(len(g), len(h), np.int32))], names=["gram", "item", "place", "n_words"])

    return items.mapInArrow(run, "gram long, item long, place int, n_words int")


def _occurrences(docs: DataFrame, bitmap: np.ndarray, widths: list[int]) -> DataFrame:
    """(gram, m1, m2, at) of the documents' n-grams that the bitmap lets pass; docs: m1, m2, text binary."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bits = Cache(hashes_of, 400_000), sent.value
        for b in batches:
            found, places, rows = [], [], []
            for r, t in enumerate(b.column(2)):
                h = word_hashes(t.as_py(), cache)
                for n in widths:
                    g = rolling(h, n)
                    here = np.flatnonzero(passing(bits, g))
                    if len(here):
                        found.append(g[here])
                        places.append(here)
                        rows.append(np.full(len(here), r))
            if found:
                at = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(np.concatenate(places).astype(np.int32))], names=["gram", "m1", "m2", "at"])

    return docs.mapInArrow(run, "gram long, m1 long, m2 long, at int")


def _aligned(rows: DataFrame) -> DataFrame:
    """(m1, m2, item, score, first_word, end_word) of rows (m1, m2, text, items: array of (item, begins, item_text)) that reach LEAST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for m1, m2, t, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                words = word_hashes(t.as_py())
                for x in items.as_py():
                    best = best_alignment(word_hashes(x["item_text"]), words, x["begins"])
                    if best:
                        out.append((m1, m2, x["item"], *best))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["m1", "m2", "item", "score", "first_word", "end_word"])

    return rows.mapInArrow(run, "m1 long, m2 long, item long, score double, first_word int, end_word int")


def _found(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(m1, m2, item_id, score, first_word, end_word) of the distinct texts (m1, m2, text) that hold an item."""
    none = texts.sparkSession.createDataFrame([], "m1 long, m2 long, item_id long, score double, first_word int, end_word int")
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    items = materialize(items.withColumn("item", F.xxhash64("item_id", "text")), "items")
    of_items = materialize(_item_grams(items.select("item", "text")), "item-grams")
    size = of_items.agg(F.count("*").alias("n"), F.collect_set(F.least("n_words", F.lit(SEED))).alias("widths")).first()
    if not size["n"]:
        return none
    hits = _occurrences(texts.select("m1", "m2", F.col("text").cast("binary").alias("text")), bitmap(of_items.select("gram"), size["n"]), sorted(size["widths"]))
    hits = materialize(hits.join(of_items.select("gram").distinct(), "gram", "left_semi"), "hits")
    counts = hits.groupBy("gram").agg(F.count("*").alias("n"))
    # an item's own n-grams, as many as it has words, meet in its row
    counted = of_items.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    usual = counted.groupBy("item").agg(F.array_sort(F.collect_list("n")).alias("ns"))
    place = F.least(F.size("ns") - 1, F.floor(F.lit(SHARE) * F.size("ns")).cast("int"))
    usual = usual.select("item", (FACTOR * (1 + F.col("ns")[place])).alias("most"))
    seeds = counted.join(usual, "item").where("n > 0 AND (n <= most OR n_words < %d)" % SEED).select("gram", "item", "place")
    wanted = hits.join(seeds, "gram").select("m1", "m2", "item", (F.col("at") - F.col("place")).alias("begin"))
    wanted = materialize(wanted.groupBy("m1", "m2", "item").agg(F.collect_set("begin").alias("begins")), "candidates")
    release(hits)
    per_text = wanted.join(items.select("item", F.col("text").alias("item_text")), "item").groupBy("m1", "m2").agg(F.collect_list(F.struct("item", "begins", "item_text")).alias("items"))
    marks = wanted.select("m1", "m2").distinct()
    side = F.broadcast(marks) if small_enough(marks, BROADCAST_TEXTS) else marks
    seen = texts.join(side, ["m1", "m2"], "left_semi").groupBy("m1", "m2").agg(F.first(F.col("text").cast("binary")).alias("text"))
    found = _aligned(seen.join(per_text, ["m1", "m2"]).select("m1", "m2", "text", "items"))
    # items that share id and text are one; an id with several texts is held against all of them
    out = found.join(items.select("item", "item_id"), "item").groupBy("m1", "m2", "item_id").agg(F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"))).alias("b"))
    out = materialize(out.select("m1", "m2", "item_id", "b.*"), "found")
    release(items, of_items, wanted)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): documents with a copy of a test item, exact or edited; no order.

    Words are lower-case runs of letters and digits. score is the best local alignment's (match 1, mismatch and gap
    -0.5) over the item's words; 0.5 or more counts. An item is found where three consecutive words of it that are rare
    for it survive; items of fewer than three words must occur whole. Null or empty texts on either side match nothing;
    items without an id are left out; rows that repeat a doc_id answer together, each item once; a null doc_id is
    returned as null. Empty tables give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_marks("text"))
    found = _found(rows, benchmark)
    out = rows.select("doc_id", "m1", "m2").join(found, ["m1", "m2"])
    return out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"))).alias("b")).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a test item, as contaminated() finds it.

    Rows go by their text, not by their id: another row of the same doc_id, null or not, stays if its own text is clean.
    Null texts stay; repeated rows go or stay together; all columns are kept whatever their names.
    """
    found = _found(docs.select("text", *text_marks("text")), benchmark).select("m1", "m2").distinct()
    m1, m2 = text_marks(docs["text"])
    return docs.join(found, (m1 == found["m1"]) & (m2 == found["m2"]), "left_anti")
