"""Runs and slices that go on over micro-batches: a group's last key and counters are its state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_slices(stream: DataFrame, group_by: str, key: str, order_by: str, row_limit: int = 0) -> DataFrame:
    """(group, order, key, run_no, slice_no) of a stream's rows: consecutive rows of a group with equal keys are a run, cut
    into slices of at most row_limit rows.

    Rows of a micro-batch are ordered by order_by; a batch follows those before it, so late rows are numbered when they
    come. State is five values a group. Key and order columns are carried as text.
    """
    rows = stream.select(F.col(group_by).cast("string").alias("grp"), F.col(order_by).alias("ord"), F.col(key).cast("string").alias("key"))
    order_type = rows.schema["ord"].dataType.simpleString()

    def number(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, cut, n, last, begun = state.get if state.exists else (0, 0, 0, None, False)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("ord", kind="stable")
        out = []
        for item in rows["key"].where(rows["key"].notna(), None):
            if begun and item != last:
                run, cut, n = run + 1, 0, 0
            elif 0 < row_limit <= n:
                cut, n = cut + 1, 0
            n, last, begun = n + 1, item, True
            out.append((run, cut))
        state.update((run, cut, n, last, begun))
        yield rows.assign(run_no=[r for r, _ in out], slice_no=[c for _, c in out])[["grp", "ord", "key", "run_no", "slice_no"]]

    result = f"grp string, ord {order_type}, key string, run_no long, slice_no long"
    return rows.groupBy("grp").applyInPandasWithState(number, result, "run long, cut long, n long, last string, begun boolean", "append", GroupStateTimeout.NoTimeout)
