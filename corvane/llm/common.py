"""Helpers shared by the training-data operators: shared-folder tables, hashing, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null id inside an operator, so that null sorts first and joins with itself.
NULL_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master where it is unset, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corvane-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Written tables by their DataFrame, until they are released.
_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs nothing of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corvane-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (out, path)
    return out


def release(*tables: DataFrame) -> None:
    """Delete what materialize() wrote. Nothing that is still to be computed may read it."""
    for t in tables:
        held, path = _WRITTEN.pop(id(t))
        _delete(held.sparkSession, path)


@atexit.register
def _release_all() -> None:
    """What results still read is deleted when the process ends, unless its session has ended before."""
    for held, path in list(_WRITTEN.values()):
        if held.sparkSession.sparkContext._jsc is not None:
            try:
                _delete(held.sparkSession, path)
            except Py4JError:  # the gateway has gone
                return


#: Most texts whose marks (16 bytes each) are broadcast to find them; more are joined by a shuffle.
BROADCAST_TEXTS = 500_000


def text_marks(text: Column | str) -> list[Column]:
    """m1, m2: 128 bits that stand for a text. Null texts have the same ones."""
    return [F.xxhash64(text).alias("m1"), F.xxhash64(F.lit("m2"), text).alias("m2")]


def quoted(names: list[str]) -> list[Column]:
    """Columns by their names, whatever characters these hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether a table has at most max_rows rows; reads no more of it than that."""
    return df.limit(max_rows + 1).count() <= max_rows


class Cache(dict):
    """A dict that computes missing values. It holds at most limit keys, in two generations: when the younger is full it becomes the older."""

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self.make, self.limit, self.older = make, limit // 2, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n consecutive ones, other for each n."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m]
    return mix64(out)


#: Bits of a bitmap for each key, and most bits in all (32 MB); a fuller bitmap lets more pass.
BITS_EACH, MOST_BITS = 64, 1 << 28


def bitmap(keys: DataFrame, count: int) -> np.ndarray:
    """A bit for each of count hashes (the one long column of keys), by their lowest bits. Set bits are gathered where the keys lie; at most MOST_BITS come to the driver."""
    bits = 1 << 16
    while bits < min(BITS_EACH * count, MOST_BITS):
        bits *= 2
    name = keys.columns[0]
    parts = keys.selectExpr(f"shiftright({name} & {bits - 1}L, 6) AS at", f"shiftleft(1L, int({name} & 63)) AS bit").groupBy("at").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(bits >> 6, np.int64)
    for batch in parts.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(np.uint64)


def passing(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bitmap lets each key (uint64) pass: all that are in it, and some others."""
    low = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes in edges (u, v: long); component is the smallest node reachable.

    Alternating large-star and small-star rounds, each written to the shared folder. Every group is reduced by min()
    before it is joined, so a hub's edges are never gathered in one task. Null ends and loops are left out. Empty edges
    give no rows.
    """
    pairs = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = materialize(pairs, "edges")
    mark = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).where("u <> v").distinct()
        before, pairs = pairs, materialize(small, "edges")
        release(before)
        # every node has one edge, to a root: done when nothing changes
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    leaf = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaf.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
