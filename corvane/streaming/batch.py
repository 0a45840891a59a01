"""Stream policies over recorded rows: each is the batch twin of a streaming operator, and what tests hold it against."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..plans.folds import fold
from .queues import Queue

#: Priorities of waiting jobs, and least seconds between unasked advice.
PRIORITIES = {"manual_answer": 100, "question": 95, "manual_next": 90, "next_line": 20}
INTERVALS = {"active": 5.0, "conservative": 15.0}


def priority(trigger: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv]), trigger), F.lit(0))


def drop_repeated_finals(events: DataFrame, order: str, *keys: str) -> DataFrame:
    """Final events but the first of each key; partial ones, and those not known to be final, pass. (order, is_final, keys...)

    Only final events are dealt by key.
    """
    final = F.coalesce("is_final", F.lit(False))
    first = W.partitionBy(*keys).orderBy(order)
    kept = events.where(final).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return events.where(~final).unionByName(kept)


def latest_partial(events: DataFrame, session: str, order: str) -> DataFrame:
    """(session, partial, finals): the text still open, empty after a final one; and the number of finals."""
    last = F.max_by(F.when(F.col("is_final"), F.lit("")).otherwise(F.col("text")), order)
    return events.groupBy(session).agg(last.alias("partial"), F.count_if("is_final").alias("finals"))


def rate_limit(events: DataFrame, key: str, seconds: str, asked: str, interval: float, started: float | None = None) -> DataFrame:
    """(key, seconds, trigger) of the events that fire: a question always does, any other when interval has passed since the last.

    started: when a key's clock starts; None fires at once.
    """
    kinds = dict(events.dtypes)

    def step(last: float, row) -> tuple[float, tuple | None]:
        now = getattr(row, seconds)
        if getattr(row, asked):
            return now, (getattr(row, key), now, "question")
        return (now, (getattr(row, key), now, "next_line")) if now - last >= interval else (last, None)

    first = -np.inf if started is None else started
    return fold(events.select(key, seconds, asked), key, seconds, lambda: first, step, f"{key} {kinds[key]}, {seconds} {kinds[seconds]}, trigger string")


def effective_interval(level: str, suggested: float) -> float | None:
    """Seconds between advice; None if none is given unasked."""
    return None if level == "manual" else max(suggested, INTERVALS["active" if level == "active" else "conservative"])


def priority_slot(jobs: DataFrame, slot: str, order: str, trigger: str = "trigger") -> DataFrame:
    """(slot, order, trigger) of the job left in a slot of one between drains: the highest priority, the newest among equals."""
    best = F.max_by(F.struct(F.col(order), F.col(trigger)), F.struct(priority(F.col(trigger)), F.col(order)))
    return jobs.groupBy(slot).agg(best.alias("j")).select(slot, f"j.{order}", f"j.{trigger}")


def keep_current(results: DataFrame, versions: DataFrame, session: str, version: str, most: int = 0) -> DataFrame:
    """Results whose version is at most so far behind the session's, and not ahead; versions: (session, now)."""
    return results.join(versions.select(session, F.col("now").alias("_now")), session).where((F.col("_now") - F.col(version)).between(0, most)).drop("_now")


def current_at(events: DataFrame, session: str, order: str, version: str = "version", now: str = "now", most: int = 0) -> DataFrame:
    """Of a log of versions (now) and results (version), the results that were current when they came: at most so far behind, and not ahead.

    Before a session's first version nothing is current. A row that has both sets the version first.
    """
    so_far = W.partitionBy(session).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = events.withColumn("_now", F.last(now, ignorenulls=True).over(so_far))
    return rows.where(F.col(version).isNotNull() & (F.col("_now") - F.col(version)).between(0, most)).drop("_now")


def bounded_queue(schedule: DataFrame, key: str, order: str, capacity: int, policy: str, prefill: int = 0, resync_on_drop: bool = False) -> DataFrame:
    """(key, order, item, fate) of a recorded schedule of operations (op: put, take, resync or fail; item); see queues.Queue.

    fate: taken, silence, dropped, drained, or underrun for a take that finds nothing. Items still queued at the end have
    no row.
    """
    kinds = dict(schedule.dtypes)

    def step(queue: Queue, row) -> tuple[Queue, list[tuple]]:
        return queue, [(getattr(row, key), getattr(row, order), item, fate) for item, fate in queue.apply(row.op, row.item)]

    return fold(schedule.select(key, order, "op", "item"), key, order, lambda: Queue(capacity, policy, prefill, resync_on_drop), step, f"{key} {kinds[key]}, {order} {kinds[order]}, item {kinds['item']}, fate string")


def reblock(chunks: DataFrame, key: str, order: str, samples: str, size: int) -> DataFrame:
    """(key, block, samples): blocks of a fixed size cut from a stream of chunks; what is left over isn't a block.

    Places are running sums of the chunks' lengths, so a stream's samples are grouped by block and never all together.
    """
    rows = chunks.select(key, order, samples, F.size(samples).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("before", before).where("n > 0")
    first, last = F.floor(F.col("before") / size), F.floor((F.col("before") + F.col("n") - 1) / size)
    parts = placed.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block") * size - F.col("before"), F.lit(0))
    stop = F.least((F.col("block") + 1) * size - F.col("before"), F.col("n"))
    cut = parts.select(key, "block", F.col("before"), F.slice(samples, (start + 1).cast("int"), (stop - start).cast("int")).alias("part"))
    out = cut.groupBy(key, "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("before", "part"))), lambda x: x["part"])).alias("samples"))
    return out.where(F.size("samples") == size)


def align(raw: DataFrame, enhanced: DataFrame, key: str, block: str) -> DataFrame:
    """The k-th block of one stream with the k-th of another."""
    return raw.join(enhanced, [key, block])


def hopping_counts(events: DataFrame, ts: str, width: str, hop: str, *keys: str, value: str | None = None) -> DataFrame:
    """(start, end, keys..., n, total) over overlapping windows."""
    total = F.sum(value).alias("total") if value else F.lit(None).cast("double").alias("total")
    return events.groupBy(F.window(ts, width, hop).alias("w"), *keys).agg(F.count("*").alias("n"), total).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def utterances(events: DataFrame, ts: str, key: str, gap: str = "600 milliseconds") -> DataFrame:
    """(key, start, end, n): events with no longer pause between them."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def mode_blocks(blocks: DataFrame, modes: DataFrame, key: str, order: str) -> DataFrame:
    """Blocks (raw, enhanced, quiet) as the mode in force says; modes: (key, since, mode). Quiet falls back to raw."""
    m = modes.select(key, F.col("since").alias(order), "mode").withColumn("is_mode", F.lit(True))
    b = blocks.select(key, order, "raw", "enhanced", "quiet").withColumn("is_mode", F.lit(False))
    both = b.unionByName(m, allowMissingColumns=True)
    line = W.partitionBy(key).orderBy(order, F.desc("is_mode")).rowsBetween(W.unboundedPreceding, 0)
    now = F.coalesce(F.last("mode", ignorenulls=True).over(line), F.lit("enhanced"))
    chosen = F.when(F.col("mode") == "raw", F.col("raw")).when(F.col("mode") == "quiet", F.coalesce("quiet", "raw")).otherwise(F.col("enhanced"))
    return both.withColumn("mode", now).where("NOT is_mode").select(key, order, "mode", chosen.alias("samples"))


def isolate(blocks: DataFrame, key: str, order: str, samples: str, failed: str) -> DataFrame:
    """Blocks whose samples are silence from a stream's first failure on: a failed worker never ends the stream."""
    so_far = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    down = F.max(F.coalesce(failed, F.lit(False))).over(so_far)
    return blocks.withColumn("_down", down).withColumn(samples, F.when(F.col("_down"), F.transform(samples, lambda v: v * 0)).otherwise(F.col(samples))).drop("_down")


def resync(blocks: DataFrame, key: str, order: str, samples: str, mark: str, prefill: int = 3) -> DataFrame:
    """(key, order, epoch, place, samples): at a marked block all state begins anew: blocks are numbered from 0, the first few are silence."""
    so_far = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = blocks.withColumn("epoch", F.sum(F.coalesce(F.col(mark), F.lit(False)).cast("int")).over(so_far))
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy(key, "epoch").orderBy(order)) - 1)
    quiet = F.when(F.col("place") < prefill, F.transform(samples, lambda v: v * 0)).otherwise(F.col(samples))
    return rows.select(key, order, "epoch", "place", quiet.alias(samples))


def resample_stream(chunks: DataFrame, key: str, order: str, samples: str, rate_in: int, rate_out: int) -> DataFrame:
    """(key, order, total, samples): chunks at another rate, by straight lines within a chunk; after each chunk a stream has as many samples as its time asks for.

    What a chunk lacks for that comes first, as the differences of rounded running totals (half to even).
    """
    so_far = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = chunks.withColumn("_n", F.size(samples)).withColumn("_in", F.sum("_n").over(so_far))
    due = lambda n: F.bround(n * rate_out / rate_in).cast("int")
    rows = rows.withColumn("total", due(F.col("_in"))).withColumn("_out", F.col("total") - due(F.col("_in") - F.col("_n")))
    step = (F.col("_n") - 1) / F.greatest(F.col("_out") - 1, F.lit(1))

    def at(i: Column) -> Column:
        p = i * step
        low = F.floor(p).cast("int")
        a, b = F.get(samples, low).cast("double"), F.get(samples, F.least(low + 1, F.col("_n") - 1)).cast("double")
        return a + (b - a) * (p - low)

    made = F.when((F.col("_out") > 0) & (F.col("_n") > 0), F.transform(F.sequence(F.lit(0), F.col("_out") - 1), at)).otherwise(F.array().cast("array<double>"))
    return rows.select(key, order, "total", made.alias(samples))


def resample_carried(chunks: DataFrame, key: str, order: str, samples: str, rate_in: int, rate_out: int) -> DataFrame:
    """(key, order, total, samples): a stream at another rate, by straight lines that run on over chunks; however it is cut, the samples are the same.

    After each chunk a stream has round(samples in * rate_out / rate_in) samples (half to even). Sample k lies half a step
    of its own behind place k, and one sample late, so it never needs one that hasn't come: all that a chunk needs of what
    was before is the last sample. Before the first sample the signal is held.
    """
    line = W.partitionBy(key).orderBy(order)
    rows = chunks.withColumn("_n", F.size(samples)).withColumn("_in", F.sum("_n").over(line.rowsBetween(W.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("_n") > 0, F.element_at(samples, -1).cast("double")), ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1))
    due = lambda n: F.bround(n * rate_out / rate_in).cast("long")
    rows = rows.withColumn("_before", last).withColumn("_start", F.col("_in") - F.col("_n")).withColumn("total", due(F.col("_in"))).withColumn("_from", due(F.col("_start")))

    def at(k: Column) -> Column:
        p = (k + 0.5) * rate_in / rate_out - 1
        low = (F.floor(p) - F.col("_start")).cast("int")
        value = lambda i: F.when(i < 0, F.coalesce("_before", F.get(samples, F.lit(0)).cast("double"))).otherwise(F.get(samples, i).cast("double"))
        a = value(low)
        return a + (F.coalesce(value(low + 1), a) - a) * (p - F.floor(p))

    made = F.when(F.col("total") > F.col("_from"), F.transform(F.sequence("_from", F.col("total") - 1), at)).otherwise(F.array().cast("array<double>"))
    return rows.select(key, order, "total", made.alias(samples))
