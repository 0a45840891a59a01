"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a few differing bits; and groups by shingle similarity.

Method (deletion-variant signatures): with k differing bits allowed, the fingerprint is cut into k // 2 + 1 segments, so
that one of them differs in at most one bit. Each distinct fingerprint is indexed under every segment with one bit taken
out; equal keys meet, and the whole fingerprints are compared. Tables of very many fingerprints are cut into k + e
segments instead, of which e are the same in both and one more differs in at most one bit: keys are as many bits longer.

Similar texts (similar()) differ in more bits than segments of one fingerprint can bridge: at a similarity of 0.8 in 15 %
of them. There a document has as many fingerprint words as it takes until RECALL of such pairs have one segment with at
most one differing bit; pairs that meet are verified by their shingles' exact Jaccard similarity. What is close links first,
so that of large groups of copies only pairs that aren't linked yet are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_TEXTS, Cache, connected_components, materialize, mix64, release, rolling, small_enough, text_marks

#: Distinct fingerprints up to which keys hold 0, 1, 2, ... whole segments beside the one with a bit taken out.
WHOLE_SEGMENTS = [1 << 20, 1 << 27, 1 << 34]
#: Buckets of more fingerprints give a spanning forest, smaller ones all pairs.
FOREST = 16
#: Share of the pairs at the least similarity that meet in similar(). How many unrelated texts may share a bucket, as a power of two.
RECALL, CROWD = 0.95, 6
#: Standard deviations above the mean by which similar texts may differ in their bits before their shingles are looked at.
FAR = 3.0
#: Buckets of more fingerprints are compared as blocks of a matrix (so many rows of it at once, for pairs of two labels), smaller ones place by place.
MATRIX, BLOCK = 192, 1024


def shingle_hashes(text: bytes | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of a text's shingles, in order. No words: none; fewer than width words: the whole sequence is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        spans = [line]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-width]))
        spans = [line[a:b] for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(x, seed) for x in spans]), ">u8").astype(np.uint64)


def majority(h: np.ndarray) -> np.ndarray:
    """Of hashes (shingles, words): each word's bits that are set in over half of them."""
    raw = np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(len(h), -1)
    ones = np.zeros(64 * h.shape[1], np.int64)
    for i in range(0, len(h), 255):  # sums that fit in a byte
        ones += np.add.reduce(np.unpackbits(raw[i : i + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8").astype(np.uint64)


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """The SimHash of a text, unsigned. No words (or null): 0; fewer than width words: the whole sequence is one shingle."""
    h = shingle_hashes(text, width, seed)
    return int(majority(h[:, None])[0]) if len(h) else 0


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp: long) of every row; null texts count as empty. One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t.as_py(), width, seed) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segment_masks(bits: int, whole: int = 0) -> list[tuple[int, int]]:
    """(mask of the segment that loses a bit, mask of the whole segments beside it), for a distance of so many bits."""
    parts = bits + whole if whole else bits // 2 + 1
    cuts = [round(64 * i / parts) for i in range(parts + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [(m, sum(others)) for m in masks for others in combinations([x for x in masks if x != m], whole)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints differ; of several words (last axis) in all."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.uint8)


def sweep(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect whatever is linked among distinct fingerprints (uint64): a forest, not all pairs."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    rest = fps
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), x), found))
                todo += list(found)
                rest = rest[~near]
    return _edges(out)


def nearest_edges(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint (a row of words) with the closest before it and the closest behind it, up to so many bits apart; by their first words."""
    out, places = [], np.arange(len(fps))
    for a in range(0, len(fps), 512):
        far = np.zeros((min(512, len(fps) - a), len(fps)), np.uint8)
        for word in fps.T:
            far += np.bitwise_count(word[a : a + 512, None] ^ word[None, :])
        i = np.arange(a, a + len(far))
        for outside in (places[None, :] >= i[:, None], places[None, :] <= i[:, None]):
            at = np.where(outside, np.uint8(255), far)
            best = at.argmin(axis=1)
            near = np.flatnonzero(at[np.arange(len(i)), best] <= bits)
            out.append((fps[i[near], 0], fps[best[near], 0]))
    return _edges(out)


def _edges(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _all_near(key: np.ndarray, fp: np.ndarray, bits: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs at most so many bits apart of buckets (runs of a key) of up to most fingerprints."""
    out = []
    for d in range(1, min(most, len(fp))):  # each with the one d places on in its bucket
        same = np.flatnonzero(key[d:] == key[:-d])
        if not len(same):
            break
        near = same[_far(fp[same], fp[same + d]) <= bits]
        out.append((fp[near, 0], fp[near + d, 0]))
    return out


def _nearest(key: np.ndarray, fp: np.ndarray, bits: int, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """nearest_edges() of all such buckets at once."""
    best, at = np.full((2, len(fp)), bits + 1, np.uint8), np.zeros((2, len(fp)), np.int64)
    for d in range(1, min(most, len(fp))):
        low = np.flatnonzero(key[d:] == key[:-d])
        if not len(low):
            break
        far = _far(fp[low], fp[low + d])
        near = np.flatnonzero(far <= bits)
        low, far = low[near], far[near]
        for side, i, j in ((0, low + d, low), (1, low, low + d)):
            nearer = far < best[side, i]
            best[side, i[nearer]], at[side, i[nearer]] = far[nearer], j[nearer]
    found = [np.flatnonzero(best[side] <= bits) for side in (0, 1)]
    return [(fp[i, 0], fp[at[side, i], 0]) for side, i in enumerate(found)]


def _meet(rows: DataFrame, bits: int, small, large, most: int) -> DataFrame:
    """(u, v) of fingerprints at most so many bits apart that share a key, as small() gives them for buckets of up to most fingerprints and large() for others; rows: key, fp, and further words of it."""

    def pairs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        size = ends - starts
        found = [large(fp[a:b], bits) for a, b in zip(starts[size > most].tolist(), ends[size > most].tolist(), strict=True)]
        few = np.flatnonzero(np.repeat((size > 1) & (size <= most), size))
        found += small(key[few], fp[few], bits, most)
        return _edges([x for x in found if len(x[0])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last bucket, not yet ended

        def emit(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            u, v = pairs(key, fp)
            if len(u):
                low, high = np.minimum(u.view(np.int64), v.view(np.int64)), np.maximum(u.view(np.int64), v.view(np.int64))
                both = np.unique(np.stack([low, high]), axis=1)
                both = both[:, both[0] != both[1]]
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            key, fp = b.column(0).to_numpy(), np.stack([c.to_numpy().view(np.uint64) for c in b.columns[1:]], axis=1)
            last = len(key) - int(np.argmax(key[::-1] != key[-1])) if key[0] != key[-1] else 0
            if held and (last or held[-1][0][-1] != key[0]):
                if held[-1][0][-1] == key[0]:
                    first = int(np.argmax(key != key[0]))
                    held.append((key[:first], fp[:first]))
                    key, fp, last = key[first:], fp[first:], last - first
                yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            if last:
                yield from emit(key[:last], fp[:last])
            held.append((key[last:].copy(), fp[last:].copy()))
        if held:
            yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)))

    parts = rows.repartition("key").sortWithinPartitions("key", "fp")
    return parts.mapInArrow(run, "u long, v long").distinct()


def links(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """(u, v: long) edges between distinct fingerprints (column fp) at most bits apart: enough to connect all that are linked.

    Null fingerprints are left out; repeated ones count once; an empty table gives no rows.
    """
    n = distinct.count()
    whole = sum(n > most for most in WHOLE_SEGMENTS) if bits else 0
    keys = []
    for k, (m, beside) in enumerate(segment_masks(bits, whole)):
        for i in (i for i in range(64) if m >> i & 1):
            value = F.col("fp").bitwiseAND(F.lit(_signed(m & ~(1 << i) | beside)))
            keys.append(F.xxhash64(F.lit(k * 64 + i), value))
    rows = distinct.where("fp IS NOT NULL").select("fp", F.explode(F.array(*keys)).alias("key")).select("key", "fp")
    return _meet(rows, bits, _all_near, lambda fps, most: sweep(fps[:, 0], most), FOREST)


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id: smallest doc_id reachable by links) of every row of docs.

    Null texts, empty texts and texts of white space have fingerprint zero and link like any other. Rows with a null
    doc_id keep it and may link others; component_id ignores nulls and is null where no id is known. Repeated rows stay.
    An empty table gives no rows; further columns are ignored.
    """
    fps = materialize(fingerprints(docs, width, seed), "fps")
    distinct = fps.select("fp").distinct()
    groups = connected_components(links(distinct, bits))
    per_fp = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = per_fp.join(groups, per_fp.fp == groups.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def agreement(similarity: float) -> float:
    """How likely two texts of a Jaccard similarity (and equal size) agree in a bit."""
    return 1 - math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def layout(n: int, similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a segment, so that buckets of n texts stay small; and how many segments it takes."""
    size, p = min(30, max(12, math.ceil(math.log2(n + 1)) - 1 - CROWD)), agreement(similarity)
    meet = p**size + size * p ** (size - 1) * (1 - p)
    return size, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1


def farthest(bits: int, similarity: float) -> int:
    """In how many of so many bits similar texts differ at most, but for about one in 1,000."""
    p = 1 - agreement(similarity)
    return math.ceil(bits * p + FAR * math.sqrt(bits * p * (1 - p)))


def shingle_set(text: bytes | None, width: int, cache: Cache) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles, as in shingle_hashes() but from hashes of words; cache: word to packed hash."""
    words = (text or b"").lower().split()
    h = rolling(np.frombuffer(b"".join(map(cache.__getitem__, words)), np.uint64), min(width, len(words))) if words else np.zeros(0, np.uint64)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def _shingled(docs: DataFrame, width: int, seed: int, words: int) -> DataFrame:
    """(id, m1, m2, node, fps, shingles) of docs (id, m1, m2, text binary): a hash of the set of shingles, its fingerprint words, and the set as packed sorted 32-bit hashes."""
    salts = mix64(np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # the first is 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(lambda w: xxhash.xxh64_digest(w, seed), 400_000)
        for b in batches:
            nodes, fps, sets = [], [], []
            for t in b.column(3):
                h = shingle_set(t.as_py(), width, cache)
                many = h[:, None] ^ salts[None, :]
                many[:, 1:] = mix64(many[:, 1:])
                fps.append((majority(many) if len(h) else np.zeros(words, np.uint64)).view(np.int64))
                nodes.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                short = (h >> np.uint64(32)).astype(np.uint32)
                sets.append((short[np.concatenate(([True], short[1:] != short[:-1]))] if len(h) else short).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(fps, pa.list_(pa.int64())), pa.array(sets, pa.binary())], names=["id", "m1", "m2", "node", "fps", "shingles"])

    return docs.mapInArrow(run, "id long, m1 long, m2 long, node long, fps array<long>, shingles binary")


def _sets_of(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, shingles) of distinct nodes, each once, written; sets: node, shingles."""
    nodes = F.broadcast(nodes) if small_enough(nodes, BROADCAST_TEXTS) else nodes
    return materialize(sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v: nodes) whose shingles' Jaccard similarity is so high; sets: node, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(z.as_py(), np.uint32) for z in (x, y))
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(same >= similarity * (len(both) - same))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    some = _sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), sets)
    rows = pairs.join(some.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u").join(some.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v")
    out = materialize(rows.select("u", "v", "x", "y").mapInArrow(run, "u long, v long"), "similar")
    release(some)
    return out


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches, cut so that all rows of a key (the first column) are in one table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        first = int(np.searchsorted(key, held[-1].column(0)[0].as_py(), "right")) if held else 0
        last = int(np.searchsorted(key, key[-1], "left"))
        if held and first:
            held.append(b.slice(0, first))
        if first < len(key):
            if held:
                yield pa.Table.from_batches(held)
            if first < last:
                yield pa.Table.from_batches([b.slice(first, last - first)])
            held = [b.slice(max(first, last))]
    if held:
        yield pa.Table.from_batches(held)


def _first_key(differ: list[np.ndarray], key: np.ndarray | int, size: int) -> np.ndarray:
    """Whether no earlier key brings two texts together; differ: their two fingerprint words' differences."""
    k, i = key >> 40, key >> 32 & 255
    met = np.zeros(differ[0].shape, bool)
    for s in range(2 * (64 // size)):
        word, low = divmod(s, 64 // size)
        here = differ[word] & np.uint64(((1 << size) - 1) << (low * size))
        met |= (s < k) & (np.bitwise_count(here) <= 1) | (s == k) & (i > 0) & (here == 0)
    return ~met


def _crossing(rows: DataFrame, bits: int, size: int) -> DataFrame:
    """(grp, node, label, side) of the texts that share a key with one of another label, at most so many bits away; rows: key, label, node, fp, more.

    Each group is to be tested all against all, those of side 1 or 3 against those of side 2 or 3. A group is a bucket's
    such texts, or, of a bucket of many, those of two of its blocks. Pairs count in the first bucket they share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_keys(batches):
            key, label, node = (t.column(i).to_numpy() for i in range(3))
            fp = [t.column(i).to_numpy().view(np.uint64) for i in (3, 4)]
            cut = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
            mixed = label[starts] != label[ends - 1]
            few = np.flatnonzero(np.repeat(mixed & (ends - starts <= MATRIX), ends - starts))
            out = []  # group, rows, side
            k, lab, f = key[few], label[few], [x[few] for x in fp]
            found = np.zeros(len(few), bool)
            for d in range(1, min(MATRIX, len(few))):
                low = np.flatnonzero((k[d:] == k[:-d]) & (lab[d:] != lab[:-d]))
                if not len(low) and not (k[d:] == k[:-d]).any():
                    break
                low = low[np.bitwise_count(f[0][low] ^ f[0][low + d]) + np.bitwise_count(f[1][low] ^ f[1][low + d]) <= bits]
                low = low[_first_key([x[low] ^ x[low + d] for x in f], k[low], size)]
                found[low] = found[low + d] = True
            out.append((k[found], few[found], 3))
            for a, b in zip(starts[mixed & (ends - starts > MATRIX)].tolist(), ends[mixed & (ends - starts > MATRIX)].tolist(), strict=True):
                for i in range(a, b, BLOCK):
                    x = np.arange(i, min(i + BLOCK, b))
                    for j in range(i, b, BLOCK):
                        y = np.arange(j, min(j + BLOCK, b))
                        if label[x[0]] == label[y[-1]]:
                            continue
                        differ = [w[x, None] ^ w[None, y] for w in fp]
                        near = (np.bitwise_count(differ[0]) + np.bitwise_count(differ[1]) <= bits) & (label[x, None] != label[None, y])
                        if near.any():
                            near &= _first_key(differ, int(key[a]), size)
                        grp = mix64(np.array([key[a]]).view(np.uint64) + np.uint64((i - a) << 32 | (j - a) + 1)).view(np.int64)
                        for rows, side in ((x[near.any(axis=1)], 3 if i == j else 1), (y[near.any(axis=0)] if i < j else y[:0], 2)):
                            out.append((np.repeat(grp, len(rows)), rows, side))
            at = np.concatenate([x[1] for x in out])
            if len(at):
                side = np.concatenate([np.full(len(x[1]), x[2], np.int32) for x in out])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out])), pa.array(node[at]), pa.array(label[at]), pa.array(side)], names=["grp", "node", "label", "side"])

    return rows.repartition("key").sortWithinPartitions("key", "label").mapInArrow(run, "grp long, node long, label long, side int")


def similar_of(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places (i, j) of texts so similar, i of side 1 or 3, j of side 2 or 3: as many as it takes to connect labels that such pairs connect."""
    right = np.flatnonzero(side & 2)
    if not len(right):
        return []
    sizes = np.array([len(s) for s in sets])
    held, owner = np.concatenate([sets[j] for j in right]), np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    root, out = label.copy(), []
    for i in np.flatnonzero(side & 1):
        if (root[right] == root[i]).all():
            continue
        low, high = np.searchsorted(held, sets[i], "left"), np.searchsorted(held, sets[i], "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        same = np.bincount(owner[at], minlength=len(right))
        for j in right[same >= similarity * (sizes[i] + sizes[right] - same)]:
            if root[i] != root[j]:
                out.append((int(i), int(j)))
                root[root == root[j]] = root[i]
    return out


def _across(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v: nodes) of a similarity so high within the groups of _crossing(), enough to connect the labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_keys(batches):
            grp, node, label, side = (t.column(i).to_numpy() for i in range(4))
            texts = [np.frombuffer(x.as_py(), np.uint32) for x in t.column(4)]
            cut = (np.flatnonzero(np.diff(grp)) + 1).tolist()
            pairs = [(a + i, a + j) for a, b in zip([0, *cut], [*cut, len(grp)], strict=True) for i, j in similar_of(texts[a:b], label[a:b], side[a:b], similarity)]
            if pairs:
                i, j = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["u", "v"])

    some = _sets_of(members.select("node").distinct(), sets)
    rows = members.join(some, "node").select("grp", "node", "label", "side", "shingles")
    out = materialize(rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "u long, v long"), "across")
    release(some)
    return out


def _keys(size: int, segments: int, less: bool) -> Column:
    """An array of the segments' keys: the segment's number, the bit that is taken out (if any), what is left of it."""
    keys = []
    for k in range(segments):
        word, low = divmod(k, 64 // size)
        value = F.shiftrightunsigned(F.col("fps")[word], low * size).bitwiseAND(F.lit((1 << size) - 1))
        keys += [value.bitwiseAND(F.lit(~(1 << i))).bitwiseOR(F.lit(k << 40 | i << 32)) for i in range(size)] if less else [value.bitwiseOR(F.lit(k << 40))]
    return F.array(*keys)


def similar(sets: DataFrame, n: int, similarity: float = 0.8, recall: float = RECALL) -> DataFrame:
    """(u, v) of nodes whose sets of shingles are so similar: enough to connect all that meet and are; sets: _shingled().

    First texts that share a whole segment are held against the closest before and the closest behind by their
    fingerprints, and those whose first words are the same against one of them. What that links has one label. Then of
    all texts that share a key, all pairs of two labels that are near by their fingerprints are verified, where they
    meet first: no pair is left out, and of a group of copies few have another label.
    """
    size, segments = layout(n, similarity, recall)
    one = sets.groupBy(F.col("fps")[0].alias("fp")).agg(F.min(F.struct("node", "fps")).alias("first")).select("fp", "first.node", "first.fps")
    one = materialize(one, "fingerprints")
    rows = one.select("fp", F.col("fps")[1].alias("more"), F.explode(_keys(size, segments, False)).alias("key")).select("key", "fp", "more")
    met = _meet(rows, farthest(128, similarity), _nearest, nearest_edges, MATRIX)
    a, b = (one.select(F.col("fp").alias(x), F.col("node").alias(f"{x}_node")) for x in ("u", "v"))
    pairs = met.join(a, "u").join(b, "v").select(F.col("u_node").alias("a"), F.col("v_node").alias("b"))
    rest = sets.select(F.col("fps")[0].alias("fp"), F.col("node").alias("b")).join(one.select("fp", "node"), "fp").where("b <> node").select(F.col("node").alias("a"), "b")
    pairs = pairs.unionByName(rest).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    pairs = materialize(pairs, "pairs")
    texts = sets.select("node", "shingles")
    close = _verified(pairs, texts, similarity)
    release(one, pairs)
    nodes = sets.groupBy("node").agg(F.first("fps").alias("fps")).join(connected_components(close), "node", "left")
    rows = nodes.select("node", F.coalesce("component", "node").alias("label"), F.col("fps")[0].alias("fp"), F.col("fps")[1].alias("more"), F.explode(_keys(size, segments, True)).alias("key"))
    members = materialize(_crossing(rows.select("key", "label", "node", "fp", "more"), farthest(128, similarity), size), "members")
    across = _across(members, texts, similarity)
    release(members)
    return materialize(close.unionByName(across), "linked")


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """docs with one row for each group of texts that are linked by similar shingles: that of the smallest doc_id.

    Two texts are linked if the Jaccard similarity of their sets of shingles (width lower-case words) is so high; about
    1 - RECALL of the pairs right at it are missed, fewer above. Null texts and texts without words are one group. Texts
    decide, not ids: of rows that share an id but not the group, each group's stays. Of a group's rows with the smallest
    id, or without any id, the first by a hash of the text stays, and one of those that are the same in both. All columns
    are kept, whatever their names; an empty table gives no rows.
    """
    n = docs.count()
    size, segments = layout(n, similarity)
    words = max(2, -(-segments // (64 // size)))
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), *text_marks("text"), F.col("text").cast("binary").alias("text"))
    sets = materialize(_shingled(keyed, width, seed, words), "sets")
    edges = similar(sets, n, similarity)
    groups = connected_components(edges)
    rows = sets.select("id", "m1", "m2", "node").join(groups, "node", "left").withColumn("root", F.coalesce("component", "node"))
    order = F.struct(F.col("id").isNull().alias("no"), "id", "m1", "m2")
    same = rows.groupBy("root", "id", "m1", "m2").agg(F.count("*").alias("n"))
    best = same.groupBy("root").agg(F.min_by(F.struct("id", "m1", "m2", "n"), order).alias("b")).select("b.*")
    best = materialize(best, "kept")
    release(sets, edges)

    def of(rows: DataFrame) -> DataFrame:
        """The rows of docs that have the id and text of one in best."""
        m1, m2 = text_marks(docs["text"])
        return docs.join(rows, docs["doc_id"].cast("long").eqNullSafe(rows["id"]) & (m1 == rows["m1"]) & (m2 == rows["m2"]), "left_semi")

    repeated = of(best.where("n > 1"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    alike = repeated.toDF(*names).withColumn("key", F.struct(F.col(names[docs.columns.index("doc_id")]).cast("long"), *text_marks(names[docs.columns.index("text")])))
    alike = alike.groupBy("key").agg(F.first(F.struct(*names)).alias("row")).select("row.*").toDF(*docs.columns)
    return of(best.where("n = 1")).unionByName(alike)
