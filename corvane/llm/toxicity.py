"""Toxicity by class-conditional Kneser-Ney models over the bytes of words.

Each class has interpolated Kneser-Ney probabilities of a byte after the ORDER - 1 before it in the same word. The highest
order has counts of its own for each class (in how many documents a word occurs), with discounts by count, so that what
one document alone says counts for nothing; all lower orders are continuation counts that both classes share, so a rare
expression is smoothed alike on both sides and only what is known to differ speaks. Counts come from every labelled
training row and are exact: the n-grams are dealt by the two bytes before their last one, so that all counts of order 3
and more that an n-gram needs meet in one group, and the orders below have at most 65,536 counts, which are sent along.

A word's log-ratio (toxic less ordinary) depends on the word alone, so each distinct word of the corpus is scored once.
Documents are read once, in chunks that keep their documents as word numbers; a chunk's words go to the buckets of the
vocabulary, a bucket asks every share of the n-grams for what it holds, and the ratios go back to the chunks. A document's
length-normalised log-ratios, over all its distinct words and over its most telling ones, enter a logistic curve that is
fitted on labelled rows that the models did not see.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_TEXTS, materialize, release, small_enough, text_marks

ORDER = 8
#: Bytes of text in a chunk of documents that are scored together.
CHUNK_BYTES = 16 << 20
#: Buckets of the vocabulary and shares of the n-grams for so many MB of text to the power by which vocabularies grow; most of each.
BUCKETS, SHARES, GROWTH, MOST = 1, 2, 0.7, 1 << 16
#: What is taken off a count: of the shared orders; of the classes' own counts of one, two, and three or more documents.
DISCOUNT, DISCOUNTS = 0.75, (0.0, 1.0, 1.5, 1.75)
#: Longer words are scored on so many characters at a time, each piece a word of its own.
PIECE = 48
#: Most labelled rows that the logistic curve is fitted on, those of the lowest hash.
CURVE_ROWS = 20_000
#: Most label rows that are broadcast to find the training texts (16 bytes each); more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
TOKEN = re.compile(r"[0-9a-z\x80-\U0010ffff']+")
PAD, END = b"\x02", b"\x03"


def tokens(text: bytes | None) -> Counter[str]:
    """How often each word occurs, in lower case without punctuation; long ones in pieces."""
    found = Counter(TOKEN.findall((text or b"").decode("utf-8", "replace").lower()))
    if found and max(map(len, found)) > PIECE:
        whole, found = found, Counter()
        for w, n in whole.items():
            for i in range(0, len(w), PIECE):
                found[w[i : i + PIECE]] += n
    return found


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c0, c1) over rows (toxic, text): how many ordinary and toxic rows hold a word. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            words = list(held[0].keys() | held[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in held)], names=["word", "c0", "c1"])
            for c in held:
                c.clear()
            return out

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held[y].update(tokens(t.as_py()).keys())
                if len(held[0]) + len(held[1]) > 200_000:
                    yield flush()
        yield flush()

    parts = texts.select(F.col("toxic").cast("int"), F.col("text").cast("binary")).mapInArrow(run, "word string, c0 long, c1 long")
    return parts.groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the words (and each word's end): the ORDER bytes that end there, packed in a uint64; and the word's index."""
    raw = np.frombuffer(b"".join([PAD * (ORDER - 1) + w + END for w in words]), np.uint8).astype(np.uint64)
    n = len(raw)
    packed = np.zeros(n, np.uint64)
    for k in range(ORDER):
        packed[k:] |= raw[: n - k] << np.uint64(8 * k)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    of = np.repeat(np.arange(len(words)), lengths)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    keep = np.arange(n) - first[of] >= ORDER - 1
    return packed[keep], of[keep]


def _suffix(g: np.ndarray, k: int) -> np.ndarray:
    return g & np.uint64((1 << (8 * k)) - 1)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value stands in sorted keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _counts_at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of wanted keys; 0 where a key is unknown."""
    if not len(keys):
        return np.zeros(len(wanted))
    at, known = _at(keys, wanted)
    return np.where(known, values[at], 0).astype(float)


def _step(seen: np.ndarray, kinds: np.ndarray, total: np.ndarray, p: np.ndarray) -> np.ndarray:
    """One order's interpolated probabilities over those of the order below; those where the context is unknown."""
    with np.errstate(divide="ignore", invalid="ignore"):
        q = (np.maximum(seen - DISCOUNT, 0) + DISCOUNT * kinds * p) / total
    return np.where(total > 0, q, p)


def low_orders(pairs: np.ndarray, cont: np.ndarray) -> np.ndarray:
    """Probabilities of order 2 by the last two bytes (65,536), from the byte pairs seen and what continues each of them."""
    every = np.arange(1 << 16)
    cont2 = np.bincount(pairs, weights=cont, minlength=1 << 16)
    p = (np.bincount(pairs & 255, minlength=256)[every & 255] + 0.5) / (max(len(pairs), 1) + 128)
    context = pairs >> 8
    return _step(cont2, np.bincount(context, minlength=256)[every >> 8], np.bincount(context, weights=cont, minlength=256)[every >> 8], p)


class Share:
    """Training's n-grams that have the same bytes before the last (of one key or several), with counts of all orders from 3 on."""

    def __init__(self, seen: np.ndarray, c0: np.ndarray, c1: np.ndarray):
        """seen: sorted and distinct."""
        self.orders = []
        for k in range(3, ORDER):
            s, cont = np.unique(_suffix(np.unique(_suffix(seen, k + 1)), k), return_counts=True)
            context, of = np.unique(s >> np.uint64(8), return_inverse=True)
            self.orders.append((k, s, cont, context, np.bincount(of, minlength=len(context)), np.bincount(of, weights=cont, minlength=len(context))))
        context, of = np.unique(seen >> np.uint64(8), return_inverse=True)
        self.sides = []
        for c in (c0, c1):
            off = np.array(DISCOUNTS)[np.minimum(c, len(DISCOUNTS) - 1).astype(np.int64)]
            self.sides.append((seen, c - off, context, np.bincount(of, weights=off, minlength=len(context)), np.bincount(of, weights=c, minlength=len(context))))

    def probabilities(self, asked: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        """Of each asked n-gram's last byte after the others: in ordinary and in toxic text. The same where the context is unknown to both."""
        p = low[_suffix(asked, 2).astype(np.int64)]
        for k, s, cont, context, kinds, total in self.orders:
            x = _suffix(asked, k)
            p = _step(_counts_at(s, cont, x), _counts_at(context, kinds, x >> np.uint64(8)), _counts_at(context, total, x >> np.uint64(8)), p)
        before = asked >> np.uint64(8)
        q = []
        for s, left, context, off, total in self.sides:
            n = _counts_at(context, total, before)
            own = _counts_at(s, left, asked) + _counts_at(context, off, before) * p
            q.append(np.where(n > 0, own / np.maximum(n, 1), p))
        return q

    def ratios(self, asked: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Log-ratio of each asked n-gram, toxic less ordinary."""
        ordinary, toxic = self.probabilities(asked, low)
        return np.log(np.maximum(toxic, 1e-12)) - np.log(np.maximum(ordinary, 1e-12))


def _squeeze(x: np.ndarray) -> bytes:
    """An array as compressed bytes, those of the same place together."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), 3)


def _unsqueeze(x: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(x), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


#: What features() returns; how often a word of a document counts at most among its telling words.
FEATURES, REPEATS = 6, 3


def features(ratios: np.ndarray, times: np.ndarray) -> list[float]:
    """Of one document, from its distinct words' ratios and how often each occurs: the mean over all; the largest; the means of the two and the four largest, and of the four largest with repeats; how many words there are."""
    n = len(ratios)
    if not n:
        return [0.0] * FEATURES
    order = np.argsort(-ratios)[:4]
    top, again = np.zeros(4), np.zeros(4)
    top[: len(order)] = ratios[order]
    repeated = np.repeat(ratios[order], np.minimum(times[order], REPEATS))[:4]
    again[: len(repeated)] = repeated
    return [float(x) for x in (ratios.mean(), top[0], top[:2].mean(), top.mean(), again.mean(), np.log1p(n))]


def _words(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _key(g: np.ndarray, shares: int) -> np.ndarray:
    """The share of n-grams that one belongs to, by the two bytes before its last."""
    return ((_suffix(g, 3) >> np.uint64(8)) * np.uint64(40503) % np.uint64(65521) % np.uint64(shares)).astype(np.int32)


def _seen_grams(counts: DataFrame, shares: int) -> DataFrame:
    """(key, grams, c0, c1: packed) from (word, c0, c1); an n-gram may come in several rows, to be added up."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = _words(b.column(0))
            if not words:
                continue
            g, of = grams(words)
            u, at = np.unique(g, return_inverse=True)
            c = [np.bincount(at, weights=b.column(j).to_numpy()[of], minlength=len(u)).astype(np.int64) for j in (1, 2)]
            key = _key(u, shares)
            order = np.argsort(key, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(key[order])) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(key[[x[0] for x in parts]]), *(pa.array([_squeeze(v[x]) for x in parts], pa.binary()) for v in (u, *c))], names=["key", "grams", "c0", "c1"])

    return counts.mapInArrow(split, "key int, grams binary, c0 binary, c1 binary")


def _low_orders(counts: DataFrame) -> np.ndarray:
    """low_orders() of training; at most 65,536 rows come to the driver."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = _words(b.column(0))
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_suffix(grams(words)[0], 3)).astype(np.int64))], names=["three"])

    pairs = counts.mapInArrow(split, "three long").distinct().groupBy(F.col("three").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.count("*").alias("n"))
    got = pairs.toPandas()
    return low_orders(got["pair"].to_numpy(np.int64), got["n"].to_numpy(float))


def _pack_words(words: list[str]) -> bytes:
    return zstandard.compress("\n".join(words).encode(), 3)


def _unpack_words(packed: bytes) -> list[bytes]:
    return zstandard.decompress(packed).split(b"\n")


def word_ratios(blocks: DataFrame, counts: DataFrame, shares: int) -> DataFrame:
    """(bucket, ratios) of blocks (bucket, words: packed), from the training words in counts: a number for each word, in order.

    Blocks of the vocabulary and shares of the n-grams exchange packed arrays: an array for each block and share that have
    n-grams in common.
    """
    low = _low_orders(counts)

    def parts_of(packed: bytes) -> tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]:
        """How many words a block has; its n-grams' places by word; the distinct n-grams; and where those of each share stand."""
        raw = _unpack_words(packed)
        g, at = [], []
        for i in range(0, len(raw), 20_000):
            x, of = grams(raw[i : i + 20_000])
            g.append(x)
            at.append(of + i)
        u, inverse = np.unique(np.concatenate(g), return_inverse=True)
        key = _key(u, shares)
        order = np.argsort(key, kind="stable")
        return len(raw), np.stack([np.concatenate(at), inverse]), u, np.split(order, np.flatnonzero(np.diff(key[order])) + 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                _, _, u, parts = parts_of(packed.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(_key(u[[x[0] for x in parts]], shares)), pa.array([bucket] * len(parts), pa.int32()), pa.array([_squeeze(u[x]) for x in parts], pa.binary())], names=["key", "bucket", "grams"])

    def answer(seen: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"key": [], "bucket": [], "ratios": []}
        if seen.num_rows and asked.num_rows:
            rows = {c: np.concatenate([_unsqueeze(x.as_py(), kind) for x in seen[c]]) for c, kind in (("grams", np.uint64), ("c0", np.int64), ("c1", np.int64))}
            g, at = np.unique(rows["grams"], return_inverse=True)
            share = Share(g, *(np.bincount(at, weights=rows[c], minlength=len(g)) for c in ("c0", "c1")))
            wanted = [_unsqueeze(x.as_py(), np.uint64) for x in asked["grams"]]
            ends = np.cumsum([len(x) for x in wanted])
            found = np.split(share.ratios(np.concatenate(wanted), low).astype(np.float32), ends[:-1])
            for key, bucket, x in zip(asked["key"].to_pylist(), asked["bucket"].to_pylist(), found, strict=True):
                if x.any():
                    for name, v in zip(out, (key, bucket, _squeeze(x)), strict=True):
                        out[name].append(v)
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), (pa.int32(), pa.int32(), pa.binary()), strict=True)})

    def add_up(block: pa.Table, answers: pa.Table) -> pa.Table:
        found = dict(zip(answers["key"].to_pylist(), answers["ratios"].to_pylist(), strict=True))
        ratios = []
        for packed in block["words"]:
            n, (of, inverse), u, parts = parts_of(packed.as_py())
            known = np.zeros(len(u), np.float32)
            for x, key in zip(parts, _key(u[[x[0] for x in parts]], shares).tolist(), strict=True):
                if key in found:
                    known[x] = _unsqueeze(found[key], np.float32)
            ratios.append(_squeeze(np.bincount(of, weights=known[inverse], minlength=n).astype(np.float32)))
        return pa.table({"bucket": block["bucket"], "ratios": pa.array(ratios, pa.binary())})

    asked = blocks.mapInArrow(ask, "key int, bucket int, grams binary")
    answers = _seen_grams(counts, shares).repartition(shares, "key").groupBy("key").cogroup(asked.groupBy("key")).applyInArrow(answer, "key int, bucket int, ratios binary")
    return blocks.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(add_up, "bucket int, ratios binary")


def _scan(docs: DataFrame, columns: list[str], counts: DataFrame) -> DataFrame:
    """The columns, and each row's features under the models of the training words in counts. Written once."""
    size = (docs.agg(F.sum(F.octet_length(F.col("text").cast("binary")))).first()[0] or 0) / (1 << 20)
    buckets, shares = (min(MOST, int(k * size**GROWTH) + 1) for k in (BUCKETS, SHARES))
    n = len(columns)
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField("features", T.ArrayType(T.DoubleType()))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each chunk and bucket with the chunk's words in it, in order; and one (bucket -1) with its rows and each one's words by number."""
        held: list[pa.RecordBatch] = []
        known: dict[str, int] = {}  # words by order of appearance
        found: list[tuple[np.ndarray, np.ndarray]] = []  # of each row, its words and how often they occur

        def flush() -> pa.RecordBatch:
            lists: list[list[str]] = [[] for _ in range(buckets)]
            for w in known:
                lists[xxhash.xxh3_64_intdigest(w) % buckets].append(w)
            number, n_words = np.zeros(len(known), np.int32), 0
            for x in lists:
                x.sort()
                number[[known[w] for w in x]] = np.arange(n_words, n_words + len(x))
                n_words += len(x)
            lengths, codes, times = np.fromiter((len(x) for x, _ in found), np.int64, len(found)), [], []
            for x, often in found:
                at = number[x]
                order = np.argsort(at)
                codes.append(np.diff(at[order], prepend=np.int32(0)))
                times.append(often[order])
            sink = pa.BufferOutputStream()
            rows = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows)
            rows = sink.getvalue().to_pybytes()
            chunk = xxhash.xxh64_intdigest(uuid.uuid4().bytes) - (1 << 63)
            some = [i for i, x in enumerate(lists) if x]
            sizes = np.fromiter(map(len, lists), np.int64, buckets)
            packed = [None] * len(some) + [[rows, *map(_squeeze, (sizes, lengths, *(np.concatenate(x) if len(x) else np.zeros(0, k) for x, k in ((codes, np.int32), (times, np.uint8)))))]]
            held.clear()
            found.clear()
            known.clear()
            return pa.RecordBatch.from_arrays([pa.array([chunk] * len(packed), pa.int64()), pa.array([*some, -1], pa.int32()), pa.array([*(_pack_words(lists[i]) for i in some), None], pa.binary()), pa.array(packed, pa.list_(pa.binary()))], names=["chunk", "bucket", "words", "rows"])

        total = 0
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                held.append(part.select(list(range(n))))
                for t in part.column(n):
                    words = tokens(raw := t.as_py())
                    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
                    found.append((ids, np.minimum(np.fromiter(words.values(), np.int64, len(words)), REPEATS).astype(np.uint8)))
                    total += len(raw or b"")
                if total >= CHUNK_BYTES:
                    total = 0
                    yield flush()
        if held:
            yield flush()

    def distinct(key: tuple, asked: pa.Table) -> pa.Table:
        words: set[bytes] = set()
        for x in asked["words"]:
            words.update(_unpack_words(x.as_py()))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([zstandard.compress(b"\n".join(sorted(words)), 3)], pa.binary())})

    def answer(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        known = dict(zip(_unpack_words(blocks["words"][0].as_py()), _unsqueeze(blocks["ratios"][0].as_py(), np.float32).tolist(), strict=True))
        found = [_squeeze(np.array([known[w] for w in _unpack_words(x.as_py())], np.float32)) for x in asked["words"]]
        return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "ratios": pa.array(found, pa.binary())})

    def score(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        known = dict(zip(answers["bucket"].to_pylist(), answers["ratios"].to_pylist(), strict=True))
        rows, *arrays = chunks["rows"][0].as_py()
        sizes, lengths, codes, times = (_unsqueeze(x, k) for x, k in zip(arrays, (np.int64, np.int64, np.int32, np.uint8), strict=True))
        ratios = np.concatenate([_unsqueeze(known[i], np.float32) for i in np.flatnonzero(sizes).tolist()] or [np.zeros(0, np.float32)]).astype(float)
        out, at = [], 0
        for k in lengths.tolist():
            out.append(features(ratios[np.cumsum(codes[at : at + k])], times[at : at + k]))
            at += k
        return pa.ipc.open_stream(rows).read_all().append_column("features", pa.array(out, pa.list_(pa.float64())))

    parts = docs.select(*columns, F.col("text").cast("binary").alias("_text")).mapInArrow(deal, "chunk long, bucket int, words binary, rows array<binary>")
    parts = materialize(parts, "chunks")
    asked, chunks = parts.where("bucket >= 0").select("chunk", "bucket", "words"), parts.where("bucket < 0").select("chunk", "rows")
    blocks = materialize(asked.groupBy("bucket").applyInArrow(distinct, "bucket int, words binary"), "blocks")
    ratios = materialize(word_ratios(blocks, counts, shares), "ratios")
    answers = asked.groupBy("bucket").cogroup(blocks.join(ratios, "bucket").groupBy("bucket")).applyInArrow(answer, "chunk long, bucket int, ratios binary")
    out = materialize(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema), "features")
    release(parts, blocks, ratios)
    return out


def fold_of(doc_id):
    """crc32 of the id as text, mod 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Bias and weights of a logistic regression (Newton steps). Without both classes: the prior only."""
    if not len(y) or y.min() == y.max():
        prior = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
        return np.concatenate(([np.log(prior / (1 - prior))], np.zeros(FEATURES)))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return np.concatenate(([w[0] - (w[1:] * mean / scale).sum()], w[1:] / scale))


def train(docs: DataFrame, labels: DataFrame, columns: list[str]) -> tuple[DataFrame, np.ndarray]:
    """The columns of docs with each row's features, and the curve (bias, weights of the features) from labelled rows outside the held-out fold (fold_of(doc_id) = 0).

    Folds 1 to 3 give the counts, fold 4 the curve. Labels other than 0 and 1, null ids and ids without a text are left
    out; of labels that repeat an id the largest counts. Without any toxic row every score is the share of toxic rows.
    """
    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = materialize(marks.where(fold_of(F.col("doc_id")) != 0), "labels")
    side = F.broadcast(marks) if small_enough(marks, BROADCAST_LABELS) else marks
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(side, "doc_id")
    counts = materialize(word_counts(known.where(fold_of(F.col("doc_id")) != 4)), "words")
    scanned = _scan(docs, columns, counts)
    release(counts)
    sample = side.where(fold_of(F.col("doc_id")) == 4).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CURVE_ROWS)
    rows = scanned.select(F.col("doc_id").cast("long").alias("doc_id"), "features").join(F.broadcast(sample), "doc_id")
    got = rows.groupBy("doc_id").agg(F.min("features").alias("features"), F.max("toxic").alias("toxic")).toPandas()  # CURVE_ROWS at most
    release(marks)
    x = np.array(got["features"].tolist(), float).reshape(-1, FEATURES)
    return scanned, fit_curve(x, got["toxic"].to_numpy(float))


def _score(curve: np.ndarray):
    """A column of scores from the features column."""
    z = F.lit(float(curve[0]))
    for i in range(FEATURES):
        z = z + F.lit(float(curve[i + 1])) * F.col("features")[i]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Null and empty texts and texts without words get the score of a text that says nothing. Repeated rows are scored
    each. A null doc_id keeps null held_out. An empty table gives no rows. No column but text enters a score.
    """
    scanned, curve = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, ["doc_id"])
    out = scanned.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), _score(curve).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxic_rows(docs: DataFrame, labels: DataFrame, toxic: bool = True) -> DataFrame:
    """The rows of docs, all columns, whose score is 0.5 or more; or, with toxic=False, the others.

    Rows as in toxicity(). A score depends on the text alone, so rows go or stay by their text: rows of equal texts alike,
    null texts too; ids may be null or repeat, further columns may have any name. An empty table gives no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *text_marks("text"))
    scanned, curve = train(keyed, labels, ["doc_id", "m1", "m2"])
    found = scanned.where(_score(curve) >= 0.5).select("m1", "m2").distinct()
    found = F.broadcast(found) if small_enough(found, BROADCAST_TEXTS) else found
    m1, m2 = text_marks(docs["text"])
    return docs.join(found, (m1 == found["m1"]) & (m2 == found["m2"]), "left_semi" if toxic else "left_anti")
