"""Folds over the ordered rows of a key, as a plan: deal by key, sort, stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def fold(rows: DataFrame, key: str, order: str, start: Callable[[], Any], step: Callable[[Any, Any], tuple[Any, tuple | list[tuple] | None]], schema: str) -> DataFrame:
    """What step gives for each row: step(state, row) -> (state, an output, a list of them, or None), rows of a key in order.

    A key's rows lie in one task and are streamed, so memory is a batch and one state, however long a key's history is.
    The recurrence is the caller's; where a window function can express a thing, it is the better plan.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, names = object(), None, [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                k = getattr(row, key)
                if k != at:
                    at, state = k, start()
                state, got = step(state, row)
                if got is not None:
                    out += got if isinstance(got, list) else [got]
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)
