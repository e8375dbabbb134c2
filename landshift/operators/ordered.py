"""Folds that depend on the row before, over logs of any length per key.

All rows of a key meet in one task, sorted; the task walks them batch by batch and keeps one state,
so a log of any length is never held in memory. Sequence numbers may be negative, sparse or null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F

Step = Callable[[dict | None, dict], tuple[dict | None, dict]]


def ordered_fold(
    log: DataFrame, key: str, order: str, step: Step, state: dict[str, str], output: dict[str, str],
) -> DataFrame:
    """``step(state or None, row) -> (state, outputs)`` along ``order`` within each ``key``.

    Returns the log's columns, the outputs and the state after each row (prefixed ``after_``).
    ``state`` and ``output`` map names to DDL types. Rows without a sequence number come first, rows of
    one number are ordered by a hash of the row; rows without a key are one log.
    """
    columns = log.columns
    schema = ", ".join(
        [f"`{c}` {t}" for c, t in log.dtypes] + [f"`{c}` {t}" for c, t in output.items()]
        + [f"`after_{c}` {t}" for c, t in state.items()])
    names, outs = list(state), list(output)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: Any = walk  # no key is equal to it
        held: dict | None = None
        for batch in batches:
            done: list[list] = []
            for row in batch.to_dict("records"):
                if _none(row[key]) != current:
                    current, held = _none(row[key]), None
                held, result = step(held, row)
                after = [None] * len(names) if held is None else [held[n] for n in names]
                done.append([result[o] for o in outs] + after)
            extra = pd.DataFrame(done, columns=[*outs, *[f"after_{n}" for n in names]], dtype="object")
            yield pd.concat([batch.reset_index(drop=True), extra], axis=1)

    tie = F.xxhash64(*columns)
    return log.repartition(key).sortWithinPartitions(key, F.col(order).asc_nulls_first(), tie).mapInPandas(walk, schema)


def _none(value):
    return None if value is None or value is pd.NaT or (isinstance(value, float) and value != value) else value
