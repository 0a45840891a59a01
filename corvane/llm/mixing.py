"""Mixing sources to target weights by temperature, with DataFrame operations only.

Each source's share of the tokens is raised to an exponent and normalised: 1 keeps the mixture, 0 makes all sources equal.
The largest exponent (least change) is found whose weights reach a target entropy and the smallest whose weights keep
every source within a repetition limit; the limit wins if both can't hold. Weights become token budgets, and a budget is
realised as epochs over the source: each epoch is a permutation of blocks, and of documents in each block, drawn by hash
from a seed, cut where the budget ends.

A source is never gathered in one task: cumulative tokens are sums over blocks (about the square root of the source's
documents, by hash), then within blocks, so a source that holds a third of all rows is spread over its blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, quoted, small_enough

#: Exponents tried in a round of the search, and rounds: the exponent is found to (1 / 16) ** 6.
POINTS, ROUNDS = 16, 6


def words(text: Column) -> Column:
    """Tokens of a text: its words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _scan_exponents(sources: DataFrame, total: int, budget: float, lows: list[float]) -> list[tuple[float, float, float]]:
    """(exponent, entropy, most repetition) for each exponent, over all sources: two sums and a maximum."""
    share = F.col("tokens") / F.lit(float(total))
    rows = sources.select("tokens", share.alias("p"), F.explode(F.array(*[F.lit(float(x)) for x in lows])).alias("a")).withColumn("q", F.pow("p", "a"))
    # entropy of q / Z is log Z - sum(q log q) / Z; repetition of a source is budget q / (Z tokens)
    got = rows.groupBy("a").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("s"), F.max(F.col("q") / F.col("tokens")).alias("m"))
    return sorted((r["a"], math.log(r["z"]) - r["s"] / r["z"], budget * r["m"] / r["z"]) for r in got.collect())


def find_exponent(sources: DataFrame, total: int, budget: float, entropy: float | None = None, repetition: float | None = None) -> float:
    """The exponent in 0 to 1. entropy: a share of the largest there is, log(sources); repetition: most epochs of a source.

    Entropy falls and repetition of the rarest falls as the exponent grows, so each limit is met on one side of a point
    that rounds of POINTS exponents close in on.
    """
    n = sources.count()

    def search(ok) -> tuple[float, float]:
        """The last exponent from 0 that is ok and the first that isn't, for a property that holds up to a point."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / POINTS for i in range(POINTS + 1)]
            good = [ok(e, r) for _, e, r in _scan_exponents(sources, total, budget, grid)]
            k = good.index(False) if False in good else len(good)
            if k == 0:
                return low, low
            if k == len(good):
                return high, high
            low, high = grid[k - 1], grid[k]
        return low, high

    a = 1.0
    if entropy is not None:
        a = search(lambda e, r: e >= entropy * math.log(n) - 1e-12)[0] if n > 1 else 1.0
    if repetition is not None:  # holds from a point on
        a = max(a, search(lambda e, r: r > repetition)[1])
    return a


def weights(docs: DataFrame, budget_share: float = 1.0, entropy: float | None = 0.95, repetition: float | None = 4.0) -> DataFrame:
    """(source, docs, tokens, weight, budget, exponent) of every source with tokens; see schedule()."""
    sized = docs.select(F.col("source"), words(F.col("text")).alias("n_tokens"))
    per = materialize(sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "sources")
    return _weigh(per, budget_share, entropy, repetition)


def _weigh(per: DataFrame, budget_share: float, entropy: float | None, repetition: float | None) -> DataFrame:
    total = per.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return per.select("source", "docs", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"), F.lit(1.0).alias("exponent"))
    budget = budget_share * total
    a = find_exponent(per, total, budget, entropy, repetition)
    q = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))
    z = per.agg(F.sum(q)).first()[0]
    return per.select("source", "docs", "tokens", (q / F.lit(z)).alias("weight"), F.floor(F.lit(budget) * q / F.lit(z) + 0.5).cast("long").alias("budget"), F.lit(a).alias("exponent"))


def _epochs(docs: DataFrame, seed: int, budget_share: float, entropy: float | None, repetition: float | None, columns: list[str]) -> DataFrame:
    """_key and n_tokens of each row, with its source's figures and an entry for each epoch in which it is drawn."""
    key = F.xxhash64(F.lit(seed), *columns)
    sized = docs.select(*columns, key.alias("_key"), words(F.col("text")).alias("n_tokens"))
    slim = materialize(sized.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "_key", "n_tokens"), "sizes")
    per = materialize(slim.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")), "sources")
    plan = materialize(_weigh(per.where("tokens > 0"), budget_share, entropy, repetition), "weights")
    of_source = plan.select(F.col("source").alias("s"), "docs", "tokens", "weight", "budget").withColumn("blocks", F.ceil(F.sqrt("docs")).cast("int"))
    rows = slim.join(of_source, slim.source.eqNullSafe(of_source.s)).drop("s")
    block = F.pmod(F.xxhash64("_key", F.lit(1)), F.col("blocks").cast("long")).cast("int")
    # whole epochs hold every row; one more is cut
    rows = rows.withColumn("block", block).withColumn("whole", F.floor(F.col("budget") / F.col("tokens")).cast("int")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    per_block = rows.where("rest > 0").groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    order = W.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "block", "whole"), "block")
    cut = per_block.withColumn("before", F.sum("in_block").over(order) - F.col("in_block")).where("before < rest")
    cut = cut.select(F.col("source").alias("s"), F.col("block").alias("b"), "before", (F.col("before") + F.col("in_block") > F.col("rest")).alias("partly"))
    last = rows.where("rest > 0").join(cut, rows.source.eqNullSafe(cut.s) & (rows.block == cut.b)).drop("s", "b")
    inside = W.partitionBy("source", "block").orderBy(F.xxhash64("_key", "whole"), "_key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    partly = last.where("partly").withColumn("before", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where("before < rest")
    drawn = last.where("NOT partly").unionByName(partly).select("doc_id", "source", "_key", "n_tokens", "weight", "block", F.col("whole").alias("epoch"))
    full = rows.where("whole > 0").select("doc_id", "source", "_key", "n_tokens", "weight", "block", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"))
    return full.unionByName(drawn)


def schedule(docs: DataFrame, seed: int = 17, budget_share: float = 1.0, entropy: float | None = 0.95, repetition: float | None = 4.0) -> DataFrame:
    """The drawn rows: doc_id, source, n_tokens, weight (the source's), epoch, block, block_order, doc_order.

    A reader takes the sources by weight and of each the rows in order of (epoch, block_order, doc_order). budget_share:
    tokens to draw against those there are; entropy: wanted share of the largest entropy; repetition: most epochs of a
    source. A source's drawn tokens reach its budget and pass it by less than one document. Null sources are a source of
    their own; rows whose source has no tokens, as null and empty texts have, aren't drawn; rows that are the same in
    doc_id, source and text are drawn alike; an empty table gives no rows.
    """
    out = _epochs(docs, seed, budget_share, entropy, repetition, ["doc_id", "source", "text"])
    return out.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", F.xxhash64(F.lit(seed), "block", "epoch").alias("block_order"), F.xxhash64("_key", "epoch").alias("doc_order"))


#: Most keys whose rows are numbered that are broadcast (16 bytes each) to find them; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def mix(docs: DataFrame, seed: int = 17, budget_share: float = 1.0, entropy: float | None = 0.95, repetition: float | None = 4.0) -> DataFrame:
    """docs as schedule() draws it: rows of scarce sources repeat, once an epoch, and rows beyond a source's budget are left out.

    Rows that are equal in doc_id, source and text share their draws evenly; only where these don't come out even, as may
    be at a source's cut, are such rows numbered. Nulls, empty tables and sources without tokens as in schedule(); all
    columns are kept, whatever their names.
    """
    keys = ["doc_id", "source", "text"]
    drawn = _epochs(docs, seed, budget_share, entropy, repetition, keys).groupBy("_key").agg(F.count("*").alias("n"))
    key = F.xxhash64(F.lit(seed), *keys)
    copies = docs.groupBy(key.alias("_key")).agg(F.count("*").alias("of"))
    plan = copies.join(drawn, "_key").select(F.col("_key").alias("k"), F.floor(F.col("n") / F.col("of")).cast("int").alias("times"), (F.col("n") % F.col("of")).cast("int").alias("more"))
    plan = materialize(plan, "draws")
    rows = docs.select(key.alias("_key"), F.struct(*quoted(docs.columns)).alias("row"))
    even = rows.join(plan.where("more = 0"), F.col("_key") == F.col("k")).select("row", "times")
    some = plan.where("more > 0")
    some = F.broadcast(some) if small_enough(some, BROADCAST_KEYS) else some
    odd = rows.join(some, F.col("_key") == F.col("k")).withColumn("i", F.row_number().over(W.partitionBy("k").orderBy("k")))
    odd = odd.select("row", (F.col("times") + (F.col("i") <= F.col("more")).cast("int")).alias("times")).where("times > 0")
    return even.unionByName(odd).withColumn("e", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
