"""Structured Streaming forms of the stream policies.

What keeps lists or several values for a key uses transformWithStateInPandas, whose state needs the RocksDB provider:
spark.sql.streaming.stateStore.providerClass = STORE. Rows of a key are taken in order within a micro-batch, and in the
order of arrival over micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .queues import COUNTS, Queue

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SERVER_MESSAGE = "header struct<event:string,error_message:string>, payload struct<output:struct<sentence:struct<text:string,sentence_end:boolean,sentence_id:bigint,begin_time:bigint,end_time:bigint,heartbeat:boolean>>>"


def recognized(lines: DataFrame, value: str = "value") -> DataFrame:
    """(text, is_final, sentence_id, begin_ms, end_ms) of a recognizer's JSON messages; heartbeats, empty texts and other events go.

    Works on a stream or a table; further columns of lines are kept first.
    """
    s = F.from_json(F.col(value), SERVER_MESSAGE)
    keep = [c for c in lines.columns if c != value]
    rows = lines.select(*keep, s.alias("_m")).where("_m.header.event = 'result-generated'").select(*keep, F.col("_m.payload.output.sentence").alias("s"))
    rows = rows.where("NOT coalesce(s.heartbeat, false) AND trim(coalesce(s.text, '')) <> ''")
    return rows.select(*keep, F.trim("s.text").alias("text"), F.coalesce("s.sentence_end", F.lit(False)).alias("is_final"), "s.sentence_id", F.col("s.begin_time").alias("begin_ms"), F.col("s.end_time").alias("end_ms"))


def deltas(lines: DataFrame, value: str = "value") -> DataFrame:
    """(..., delta) of server-sent lines "data: {json}"; the end mark, other lines and broken JSON go."""
    body = F.trim(F.substring(F.col(value), 6, 1 << 30))
    keep = [c for c in lines.columns if c != value]
    delta = F.try_element_at(F.from_json(body, "choices array<struct<delta:struct<content:string>>>")["choices"], F.lit(1))["delta"]["content"]
    return lines.where(F.col(value).startswith("data:") & (body != "[DONE]")).select(*keep, delta.alias("delta")).where("delta IS NOT NULL")


def drop_repeated_finals(events: DataFrame, ts: str, bound: str = "10 minutes", keys: tuple[str, ...] = ("sentence_id", "begin_ms", "end_ms", "text")) -> DataFrame:
    """Partial events, and the first of each final one. State is kept for bound; a repeat later than that passes (the price of bounded state)."""
    finals = events.where("is_final").withWatermark(ts, bound).dropDuplicatesWithinWatermark(list(keys))
    return events.where("NOT is_final").unionByName(finals)


def _ordered(batches: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    parts = list(batches)
    return pd.concat(parts).sort_values(order, kind="stable") if parts else pd.DataFrame()


def rate_limit(events: DataFrame, key: str, seconds: str, asked: str, interval: float) -> DataFrame:
    """Streaming batch.rate_limit(): the state of a key is when it last fired."""
    kinds = dict(events.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        out = []
        rows = _ordered(batches, seconds)
        for now, q in zip(rows[seconds], rows[asked], strict=True):
            if q or now - last >= interval:
                out.append((k[0], now, "question" if q else "next_line"))
                last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, seconds, "trigger"])

    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {seconds} {kinds[seconds]}, trigger string", "last double", "append", GroupStateTimeout.NoTimeout)


def reblock(chunks: DataFrame, key: str, order: str, samples: str, size: int) -> DataFrame:
    """Streaming batch.reblock(): the state of a key is its next block's number and the samples left over, fewer than a block."""
    kinds = dict(chunks.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, held = state.get if state.exists else (0, [])
        held, out = list(held), []
        for x in _ordered(batches, order).get(samples, []):
            held += [float(v) for v in x]
            while len(held) >= size:
                out.append((k[0], block, held[:size]))
                block, held = block + 1, held[size:]
        state.update((block, held))
        yield pd.DataFrame(out, columns=[key, "block", "samples"])

    return chunks.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, block long, samples array<double>", "block long, held array<double>", "append", GroupStateTimeout.NoTimeout)


def keep_newest(rows: DataFrame, key: str, order: str, item: str, keep: int) -> DataFrame:
    """After each batch: a key's newest items, oldest first (a queue that drops its oldest), and how many it has dropped."""
    kinds = dict(rows.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, dropped = state.get if state.exists else ([], 0)
        items = [*items, *_ordered(batches, order).get(item, [])]
        dropped += max(0, len(items) - keep)
        items = items[-keep:]
        state.update((items, dropped))
        yield pd.DataFrame({key: [k[0]], "items": [items], "dropped": [dropped]})

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, items array<{kinds[item]}>, dropped long", f"items array<{kinds[item]}>, dropped long", "update", GroupStateTimeout.NoTimeout)


class _Queues(StatefulProcessor):
    """A Queue for each key: its items as list state, its flags and counters as value state."""

    def __init__(self, make, order: str, item_kind: str, rows_of):
        self.make, self.order, self.item_kind, self.rows_of = make, order, item_kind, rows_of

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", f"item {self.item_kind}, silent boolean")
        self.marks = handle.getValueState("marks", ", ".join(["due boolean", "failed boolean", *[f"{c} long" for c in COUNTS]]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        queue = self.make()
        if self.marks.exists():
            queue.due, queue.failed, *counts = self.marks.get()
            queue.counts = dict(zip(COUNTS, counts, strict=True))
            queue.items.extend((x[0], x[1]) for x in self.items.get())
        before = len(queue.items)
        batch = _ordered(rows, self.order)
        ended = [(at, item, fate) for at, op, item in zip(batch[self.order], batch["op"], batch["item"], strict=True) for item, fate in queue.apply(op, None if pd.isna(item) else item)]
        if queue.items:
            self.items.put([(None if x is None else x, silent) for x, silent in queue.items])
        elif before:
            self.items.clear()
        self.marks.update((queue.due, queue.failed, *(queue.counts[c] for c in COUNTS)))
        yield self.rows_of(key[0], ended, queue.counts)

    def close(self) -> None:
        pass


def bounded_queue(schedule: DataFrame, key: str, order: str, capacity: int, policy: str, prefill: int = 0, resync_on_drop: bool = False) -> DataFrame:
    """Streaming batch.bounded_queue(): (key, order, item, fate) as operations (key, order, op, item) come."""
    kinds = dict(schedule.dtypes)

    def fates(k, ended: list[tuple], counts: dict) -> pd.DataFrame:
        out = pd.DataFrame(ended, columns=[order, "item", "fate"])
        out.insert(0, key, k)
        return out.astype({"item": object})

    make = lambda: Queue(capacity, policy, prefill, resync_on_drop)
    rows = schedule.select(key, order, "op", "item")
    return rows.groupBy(key).transformWithStateInPandas(_Queues(make, order, kinds["item"], fates), f"{key} {kinds[key]}, {order} {kinds[order]}, item {kinds['item']}, fate string", "Append", "None")


def queue_counts(schedule: DataFrame, key: str, order: str, capacity: int, policy: str, prefill: int = 0, resync_on_drop: bool = False) -> DataFrame:
    """After each batch the counters of the keys in it (update mode): puts, taken, silent, underruns, dropped, drained, resyncs, and the deepest queue so far."""
    kinds = dict(schedule.dtypes)

    def counters(k, ended: list[tuple], counts: dict) -> pd.DataFrame:
        return pd.DataFrame({key: [k], **{c: [counts[c]] for c in COUNTS}})

    make = lambda: Queue(capacity, policy, prefill, resync_on_drop)
    rows = schedule.select(key, order, "op", "item")
    return rows.groupBy(key).transformWithStateInPandas(_Queues(make, order, kinds["item"], counters), f"{key} {kinds[key]}, " + ", ".join(f"{c} long" for c in COUNTS), "Update", "None")


class _Carried(StatefulProcessor):
    """Rows of a key folded with one value of state: step(state or None, row) -> (state, output rows)."""

    def __init__(self, order: str, columns: list[str], kind: str, step, ttl_ms: int | None = None):
        self.order, self.columns, self.kind, self.step, self.ttl_ms = order, columns, kind, step, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.kind, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for row in _ordered(rows, self.order).itertuples(index=False):
            state, got = self.step(state, row)
            out += got
        if state is not None:
            self.state.update(state)
        yield pd.DataFrame(out, columns=self.columns).astype(object)

    def close(self) -> None:
        pass


def _carry(rows: DataFrame, key: str, order: str, schema: str, kind: str, step, ttl_ms: int | None = None) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return rows.groupBy(key).transformWithStateInPandas(_Carried(order, columns, kind, step, ttl_ms), schema, "Append", mode)


def resync(blocks: DataFrame, key: str, order: str, samples: str, mark: str, failed: str | None = None, prefill: int = 3) -> DataFrame:
    """Streaming batch.resync(), and batch.isolate() of it if failed is given: (key, order, epoch, place, samples).

    A marked block begins everything anew: its epoch's blocks are numbered from 0 and the first few are silence. From a
    key's first failed block on all are silence, and the stream goes on.
    """
    kinds = dict(blocks.dtypes)
    keep = [key, order, samples, mark] + ([failed] if failed else [])

    def step(state, row):
        epoch, place, down = state or (0, 0, False)
        if getattr(row, mark) is True or getattr(row, mark) == 1:
            epoch, place = epoch + 1, 0
        if failed and (getattr(row, failed) is True or getattr(row, failed) == 1):
            down = True
        x = getattr(row, samples)
        given = None if x is None else [0.0 if down or place < prefill else float(v) for v in x]
        return (epoch, place + 1, down), [(getattr(row, key), getattr(row, order), epoch, place, given)]

    return _carry(blocks.select(*keep), key, order, f"{key} {kinds[key]}, {order} {kinds[order]}, epoch long, place long, {samples} array<double>", "epoch long, place long, down boolean", step)


def current_at(events: DataFrame, session: str, order: str, version: str = "version", now: str = "now", most: int = 0, ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Streaming batch.current_at(): (session, order, version) of results that are current when they come.

    Versions and results come in one stream (a union of two). A session's version is forgotten when it wasn't set for
    ttl_ms; until it is set again, nothing is current.
    """
    kinds = dict(events.dtypes)

    def step(state, row):
        at = getattr(row, now)
        if at is not None and not pd.isna(at):
            state = (int(at),)
        v = getattr(row, version)
        good = state is not None and v is not None and not pd.isna(v) and 0 <= state[0] - int(v) <= most
        return state, [(getattr(row, session), getattr(row, order), int(v))] if good else []

    return _carry(events.select(session, order, version, now), session, order, f"{session} {kinds[session]}, {order} {kinds[order]}, {version} long", "now long", step, ttl_ms)


def resample(chunks: DataFrame, key: str, order: str, samples: str, rate_in: int, rate_out: int) -> DataFrame:
    """Streaming batch.resample_carried(): the state of a key is how many samples came, and the last one."""
    kinds = dict(chunks.dtypes)

    def step(state, row):
        came, last = state or (0, None)
        x = np.asarray(getattr(row, samples), float)
        start, came = came, came + len(x)
        total = round(came * rate_out / rate_in)
        k = np.arange(round(start * rate_out / rate_in), total)
        made: list[float] = []
        if len(x):
            p = (k + 0.5) * rate_in / rate_out - 1
            held = np.concatenate([[x[0] if last is None else last], x, x[-1:]])  # place -1 first
            low = np.floor(p).astype(int) - start + 1
            made = (held[low] + (held[low + 1] - held[low]) * (p - np.floor(p))).tolist()
            last = float(x[-1])
        return (came, last), [(getattr(row, key), getattr(row, order), total, made)]

    return _carry(chunks.select(key, order, samples), key, order, f"{key} {kinds[key]}, {order} {kinds[order]}, total long, {samples} array<double>", "came long, last double", step)


def hopping_counts(events: DataFrame, ts: str, width: str, hop: str, late: str, *keys: str) -> DataFrame:
    """(start, end, keys..., n) over overlapping windows of a stream, each emitted when the watermark passes it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, hop).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


class CountingSink:
    """A foreachBatch sink that hands batches to a function and counts its errors instead of failing the query."""

    def __init__(self, write):
        self.write, self.batches, self.errors = write, 0, 0

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        try:
            self.write(df, batch_id)
            self.batches += 1
        except Exception:  # a sink's failure is counted, never fatal
            self.errors += 1
