"""Bounded queues that lose, resynchronise and fail: one rule, which recorded schedules and live streams follow alike."""

from __future__ import annotations

from collections import deque
from typing import Any

#: Operations of a schedule; others are passed over.
OPERATIONS = ["put", "take", "resync", "fail"]
COUNTS = ["puts", "taken", "silent", "underruns", "dropped", "drained", "resyncs", "deepest"]


class Queue:
    """A queue of at most capacity items.

    put: into a full queue, drop_new loses the item and drop_oldest the oldest one. take: the oldest item, or an underrun.
    resync: what waits is drained, and prefill silent items stand in for it. fail: from now on every take is an underrun,
    and the stream goes on. resync_on_drop: after a put that lost its item, the next take resynchronises first.
    """

    def __init__(self, capacity: int, policy: str, prefill: int = 0, resync_on_drop: bool = False):
        if policy not in ("drop_new", "drop_oldest") or capacity < 1 or not 0 <= prefill <= capacity:
            raise ValueError("a queue has a policy, room for an item, and for what it is prefilled with")
        self.capacity, self.policy, self.prefill, self.resync_on_drop = capacity, policy, prefill, resync_on_drop
        self.items: deque[tuple[Any, bool]] = deque()  # item, and whether it is silence
        self.due = self.failed = False
        self.counts = dict.fromkeys(COUNTS, 0)

    def apply(self, op: str | None, item: Any = None) -> list[tuple[Any, str]]:
        """(item, fate) of everything that an operation ends: taken, silence, underrun, dropped, drained."""
        n = self.counts
        if op == "fail":
            self.failed = True
        elif op == "resync":
            return self._resync()
        elif op == "put":
            n["puts"] += 1
            lost = []
            if len(self.items) >= self.capacity:
                n["dropped"] += 1
                if self.policy == "drop_new":
                    self.due = self.resync_on_drop
                    return [(item, "dropped")]
                lost = [(self.items.popleft()[0], "dropped")]
            self.items.append((item, False))
            n["deepest"] = max(n["deepest"], len(self.items))
            return lost
        elif op == "take":
            if self.failed:
                n["underruns"] += 1
                return [(None, "underrun")]
            out = self._resync() if self.due else []
            if not self.items:
                n["underruns"] += 1
                return [*out, (None, "underrun")]
            item, silent = self.items.popleft()
            n["silent" if silent else "taken"] += 1
            return [*out, (item, "silence" if silent else "taken")]
        return []

    def _resync(self) -> list[tuple[Any, str]]:
        out = [(item, "drained") for item, _ in self.items]
        self.counts["drained"] += len(out)
        self.counts["resyncs"] += 1
        self.items = deque([(None, True)] * self.prefill)
        self.counts["deepest"] = max(self.counts["deepest"], self.prefill)
        self.due = False
        return out
