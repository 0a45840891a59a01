"""Embedding near-dedup: sign hashes of random hyperplanes in several tables, exact cosines, connected components.

Vectors that are the same in label and bytes are one class. Each class is hashed in several tables of signs; classes
that share a label and a table's signs meet in a bucket, and there the cosines are computed as blocks of a matrix
product. A pair is counted in the first table in which it meets, so the counts of links add up without a list of pairs;
for the components a bucket yields edges that connect what is linked in it, not all pairs. Buckets of more than BLOCK
classes are dealt out as pairs of blocks, so no task holds more than two blocks and every pair of the bucket is still
compared.

A table has as many signs as keep a bucket of unrelated vectors at about one, and there are as many tables as it takes
for RECALL of the pairs right at the least cosine to meet in one. A pair at 0.98 (11.5 degrees) agrees in a sign with
probability 0.936, in a table of 16 with 0.348, and meets in at least one of 24 such tables with 0.99996.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, release

RECALL, BLOCK = 0.9999, 2048


def layout(n: int, least: float, recall: float = RECALL) -> tuple[int, int]:
    """Tables and signs of each for n classes and a least cosine."""
    bits = min(30, max(8, math.ceil(math.log2(n + 1))))
    meet = (1 - math.acos(min(1.0, max(-1.0, least))) / math.pi) ** bits
    return (1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meet))), bits


def planes(dim: int, tables: int, bits: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def signs(unit: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(vectors, tables) of hashes."""
    one = (unit @ planes(unit.shape[1], tables, bits) > 0).reshape(len(unit), tables, bits)
    return (one * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, embedding (array<double>) -> vec_id, label, dim, raw (null if the vector links with nothing)."""
    for b in batches:
        emb = b.column(2)
        raw, dims = [], []
        for v, ok in zip(emb, pc.is_valid(b.column(1)).to_pylist(), strict=True):
            x = None
            if ok and v.is_valid and len(v) and v.values.null_count == 0:
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
                norm = np.linalg.norm(x / (top if (top := np.abs(x).max()) > 0 and np.isfinite(top) else 1.0))
                x = x / top + 0.0 if np.isfinite(norm) and norm > 0 else None  # scaled, so that no square overflows; -0 is 0
            raw.append(None if x is None else x.tobytes())
            dims.append(0 if x is None else len(x))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "label", "dim", "raw"])


def _hash(tables: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for d in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == d)))
                got = signs(units(part.column(3).to_pylist()), tables, bits)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(got), pa.list_(pa.int32()))], names=[*part.schema.names, "sig"])

    return run


def _linker(least: float):
    """Rows sorted by bucket and block pair: node, size, raw, sig, table, side (0: both blocks, else 1 or 2), then the bucket's key."""

    def pairs(rows: dict) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Nodes, how many vectors each links to here, and edges."""
        node, size, sig, side, t = rows["node"], rows["size"], rows["sig"], rows["side"], rows["table"]
        x = units(rows["raw"])
        left, right = (np.arange(len(node)),) * 2 if side.max() == 0 else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
        counts, edges = np.zeros(len(node), np.int64), []
        joined = np.arange(len(node))  # roots, so that only joining edges are given
        for a in range(0, len(left), 512):
            i = left[a : a + 512]
            near = x[i] @ x[right].T >= least - 1e-9
            if side.max() == 0:
                near &= i[:, None] < right[None, :]
            p, q = np.nonzero(near)
            p, q = i[p], right[q]
            if not len(p):
                continue
            cos = np.empty(len(p))
            for k in range(0, len(p), 1 << 15):  # pairs at the threshold: as one dot product each
                cos[k : k + (1 << 15)] = np.einsum("ij,ij->i", x[p[k : k + (1 << 15)]], x[q[k : k + (1 << 15)]])
            keep = cos >= least
            if t:
                for k in range(0, len(p), 1 << 15):
                    keep[k : k + (1 << 15)] &= ~(sig[p[k : k + (1 << 15)], :t] == sig[q[k : k + (1 << 15)], :t]).any(axis=1)
            p, q = p[keep], q[keep]
            np.add.at(counts, p, size[q])
            np.add.at(counts, q, size[p])
            for u in np.unique(p).tolist():
                ends = q[p == u]
                roots = np.unique(joined[ends])
                mine = joined[u]
                roots = roots[roots != mine]
                if len(roots):
                    for r in roots.tolist():
                        edges.append((int(node[u]), int(node[ends[joined[ends] == r][0]])))
                    joined[np.isin(joined, roots)] = mine
        return node, counts, edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "dim", "table", "bucket", "pair"]
        held, key = [], None

        def done() -> pa.RecordBatch | None:
            rows = pa.Table.from_batches(held)
            if rows.num_rows < 2:
                return None
            col = {n: rows.column(n) for n in ("node", "size", "raw", "sig", "side")}
            node, counts, edges = pairs({"node": col["node"].to_numpy(), "size": col["size"].to_numpy(), "raw": col["raw"].to_pylist(), "sig": np.array(col["sig"].to_pylist()), "side": col["side"].to_numpy(), "table": rows.column("table")[0].as_py()})
            some = np.flatnonzero(counts)
            if not len(some):
                return None
            u = [int(n) for n in node[some]] + [e[0] for e in edges]
            v = [None] * len(some) + [e[1] for e in edges]
            n = counts[some].tolist() + [0] * len(edges)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["u", "v", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(n).to_numpy(zero_copy_only=False) for n in names]
            cut = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1 if b.num_rows > 1 else np.zeros(0, int)
            starts, ends = [0, *cut.tolist()], [*cut.tolist(), b.num_rows]
            for s, e in zip(starts, ends, strict=True):
                now = tuple(c[s] for c in cols)
                if now != key and held:
                    if (out := done()) is not None:
                        yield out
                    held = []
                key = now
                held.append(b.slice(s, e - s))
        if held and (out := done()) is not None:
            yield out

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label).

    Vectors link if their labels are equal and not null and their cosine, in double precision, is least or more; found
    pairs are verified, and about one in 10,000 at the threshold is missed. Null vectors, empty and zero ones and those
    with null or non-finite parts link with nothing; neither do vectors of different lengths. component_id is the
    smallest vec_id reachable, kept says that a row is it. Rows that repeat a vec_id count as vectors of their own; a
    null vec_id is never a component_id unless nothing else is reachable, and isn't kept. An empty table gives no rows.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialize(base.mapInArrow(_classes, "vec_id long, label long, dim int, raw binary"), "vectors")
    plain = rows.where("raw IS NOT NULL").groupBy("label", "dim", "raw").agg(F.count("*").alias("size"), F.min("vec_id").alias("first"))
    for seed in range(9):  # classes are told apart by their bytes; their 64-bit numbers are drawn until no two are the same
        node = F.xxhash64(F.lit(seed), "label", "raw")
        classes = materialize(plain.select(node.alias("node"), "size", "first", "label", "dim", "raw"), "classes")
        count = classes.agg(F.count("*").alias("n"), F.count_distinct("node").alias("different")).first()
        if count["n"] == count["different"]:
            break
        release(classes)
    else:
        raise RuntimeError("classes can't be numbered")
    rows = rows.withColumn("node", F.when(F.col("raw").isNotNull(), node))
    hashed = classes.select("node", "label", "dim", "raw", "size").mapInArrow(_hash(*layout(count["n"], least)), "node long, label long, dim int, raw binary, size long, sig array<int>")
    hashed = materialize(hashed, "signs")
    keys = hashed.select("node", "label", "dim", F.posexplode("sig").alias("table", "bucket"))
    sizes = keys.groupBy("label", "dim", "table", "bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    met = keys.join(sizes, ["label", "dim", "table", "bucket"])
    # a class in block i of a bucket takes part in the block pairs (i, j): one task each
    met = met.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    met = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("pair", F.least("i", "j") * F.col("blocks") + F.greatest("i", "j")).withColumn("side", F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).cast("int"))
    met = met.select("node", "label", "dim", "table", "bucket", "pair", "side").join(hashed.select("node", "raw", "sig", "size"), "node")
    order = ["label", "dim", "table", "bucket", "pair"]
    found = met.repartition(*order).sortWithinPartitions(*order).select("node", "size", "raw", "sig", "side", *order).mapInArrow(_linker(least), "u long, v long, n long")
    found = materialize(found, "links")
    counts = found.groupBy("u").agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("v IS NOT NULL").select("u", "v"))
    per = classes.join(counts, classes.node == counts.u, "left").select("node", "size", "first", F.coalesce("n", F.lit(0)).alias("n"))
    per = per.join(groups.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select("node", "first", (F.col("n") + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    least_id = per.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = per.join(least_id, "root").select(F.col("node").alias("class"), "n_links", "component_id")
    out = rows.select("vec_id", "node").join(of_class, F.col("node") == F.col("class"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
