"""Token ids and binary output: documents become rows of a packed id matrix.

Documents are tokenized with a byte-pair vocabulary (its path is a parameter) and end with an end id. Documents longer
than a row are split without loss into full rows and a rest; all rests are packed best-fit-decreasing: the longest first,
each into the row with the least room that holds it, found by a segment tree over remaining capacities. This happens
where the documents are read, CHUNK tokens at a time, so nothing is shuffled and memory doesn't grow with the input; a
lost task packs the same documents again.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's makers split text before pairs are merged (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
#: White space as the vocabulary's makers mean it (fixed values). Runs of LONG and more are cut out before the pattern sees them.
SPACE, LONG = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", 1 << 14
#: Tokens that are packed together.
CHUNK = 4 << 20


class Encoder:
    """Text to ids as little-endian bytes of kind, by the vocabulary's own encoder."""

    def __init__(self, vocabulary: bytes, end: int = END, pattern: str = PATTERN, long: int = LONG):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.kind, self.code = ("<u2", "H") if max([end, *ranks.values()]) < 1 << 16 else ("<u4", "I")
        self.end = np.array([end], self.kind).tobytes()
        self.runs = re.compile(f"[{SPACE}]{{{long},}}")

    def encode(self, text: str) -> bytes:
        """The pattern's matcher gives up on a very long run of white space. It makes one piece of it, but for the last
        character, which belongs to what follows, if anything does; that piece is merged here, and the ids are the same."""
        out, at = [], 0
        for m in self.runs.finditer(text):
            last = m.end() - (m.end() < len(text))
            out.append(array(self.code, self.encoding.encode_ordinary(text[at : m.start()])).tobytes())
            out.append(array(self.code, self.encoding._encode_single_piece(text[m.start() : last])).tobytes())
            at = last
        out.append(array(self.code, self.encoding.encode_ordinary(text[at:])).tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes, end: int, pattern: str) -> Encoder:
    return Encoder(vocabulary, end, pattern)


class Room:
    """A segment tree over remaining capacities 0..size: how many open rows have each, and the least that is enough."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least capacity that is at least need, and that capacity; it is no longer open."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until there is something to the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i *= 2
                if not count[i]:
                    i += 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return self.rows[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of indices into lengths (each 1 to size): longest first, each into the fullest row that still holds it."""
    room, rows = Room(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        got = room.take(lengths[i])
        if got is None:
            rows.append([i])
            left = size - lengths[i]
            row = len(rows) - 1
        else:
            row, left = got[0], got[1] - lengths[i]
            rows[row].append(i)
        if left:
            room.add(left, row)
    return rows


SCHEMA = "shard int, row int, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<int>"


def pack(docs: DataFrame, length: int = 2048, vocabulary: str = VOCABULARY, end: int = END, pattern: str = PATTERN) -> DataFrame:
    """Packed rows of docs (doc_id, text), in no order.

    shard and row name a row of the id matrix (shard is the task that packed it). input_ids: length ids as little-endian
    unsigned integers of 2 bytes (4 if an id needs them), filled up with the end id behind n_tokens. cu_seqlens: 0 and
    the running ends of the row's segments. position_resets: where positions start anew from 0, each segment's first
    column. doc_ids, doc_offsets: each segment's document, and how many of its ids came in earlier segments. A document
    is its text's ids and the end id; joined by offset, its segments give them back. Null and empty texts have no ids and
    no segment; a null doc_id stays null; repeated rows are packed each; an empty table gives no rows.
    """
    raw = open(vocabulary, "rb").read()  # on the driver only
    sent = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, n_rows = _encoder(sent.value, end, pattern), TaskContext.get().partitionId(), 0
        wide = int(enc.kind[-1])
        full = length * wide
        held: list[tuple] = []
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal n_rows
            bins = best_fit_decreasing([len(x[2]) // wide for x in held], length)
            for a in range(0, len(bins), 512):
                out: list[list] = [[] for _ in range(8)]
                for one in bins[a : a + 512]:
                    parts = [held[i] for i in one]
                    ids = b"".join([x[2] for x in parts])
                    ends = np.cumsum([0] + [len(x[2]) // wide for x in parts]).tolist()
                    for column, x in zip(out, (shard, n_rows, ends[-1], ids + enc.end * (length - ends[-1]), ends, ends[:-1], [x[0] for x in parts], [x[1] for x in parts]), strict=True):
                        column.append(x)
                    n_rows += 1
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py()
                if not text:
                    continue
                ids = enc.encode(text) + enc.end
                held += [(i, at // wide, ids[at : at + full]) for at in range(0, len(ids), full)]
                size += len(ids) // wide
                if size >= CHUNK:
                    yield from emit()
                    held, size = [], 0
        yield from emit()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet with binary ids, a folder for each shard; readers map input_ids of a shard to a matrix."""
    packed.write.partitionBy("shard").parquet(path)


def matrix(rows: list, length: int = 2048) -> np.ndarray:
    """The id matrix of some packed rows, in their order."""
    raw = b"".join(r["input_ids"] for r in rows)
    wide = len(raw) // max(1, len(rows)) // length
    return np.frombuffer(raw, f"<u{wide or 2}").reshape(len(rows), length)
