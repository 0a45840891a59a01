"""What a running query reports, as tables: its progress, the metrics observed in it, and their high-water marks."""

from __future__ import annotations

from collections import deque
from threading import Lock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "query string, run string, batch long, at string, input_rows long, late_rows long, state_rows long, batch_ms long, metrics map<string,double>"


def observed(rows: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """rows, whose aggregates are reported with each batch under their names."""
    return rows.observe(name, *[c.cast("double").alias(k) for k, c in metrics.items()])


def lateness(ts: Column) -> Column:
    """How far, in seconds, a batch's oldest event lies behind its newest: what a watermark has to bridge within a batch."""
    return (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6


class ProgressLog(StreamingQueryListener):
    """The newest reports of all queries of a session; add it with spark.streams.addListener(log).

    Older reports than the newest so many are let go, but count in the high-water marks.
    """

    def __init__(self, most: int = 4096):
        self._rows: deque[tuple] = deque(maxlen=most)
        self._peaks: dict[tuple[str, str], list[float]] = {}
        self._lock = Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        metrics = {k: float(v) for row in p.observedMetrics.values() for k, v in row.asDict().items() if v is not None}
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        held = sum(s.numRowsTotal for s in p.stateOperators)
        ms = dict(p.durationMs).get("triggerExecution", 0)
        name = p.name or str(p.id)
        with self._lock:
            self._rows.append((name, str(p.runId), p.batchId, p.timestamp, p.numInputRows, late, held, ms, metrics))
            for k, v in {"input_rows": p.numInputRows, "late_rows": late, "state_rows": held, "batch_ms": ms, **metrics}.items():
                known = self._peaks.setdefault((name, k), [0.0, float("-inf"), 0.0])
                self._peaks[name, k] = [known[0] + v, max(known[1], v), known[2] + 1]

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each report: query, run, batch, at, input_rows, late_rows, state_rows, batch_ms, metrics."""
        with self._lock:
            rows = list(self._rows)
        return spark.createDataFrame(rows, SCHEMA)

    def peaks(self, spark: SparkSession) -> DataFrame:
        """(query, metric, total, most, reports) over all reports of a query."""
        with self._lock:
            rows = [(q, k, *v) for (q, k), v in self._peaks.items()]
        return spark.createDataFrame([(q, k, float(t), float(m), int(n)) for q, k, t, m, n in rows], "query string, metric string, total double, most double, reports long")
