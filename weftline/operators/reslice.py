"""Batches cut and merged to row and size limits, and batches by sorted key.

The generators take one batch at a time and hold at most the batches of one result. They run in mapInArrow tasks, or
on any iterable of Arrow tables, pandas frames or arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import to_size


def _rows(b: Any) -> int:
    return b.num_rows if isinstance(b, (pa.Table, pa.RecordBatch)) else len(b)


def _bytes(b: Any) -> int:
    return int(b.memory_usage(deep=True).sum()) if isinstance(b, pd.DataFrame) else b.nbytes


def _take(b: Any, start: int, length: int) -> Any:
    if isinstance(b, (pa.Table, pa.RecordBatch)):
        return b.slice(start, length)
    return b.iloc[start : start + length] if isinstance(b, pd.DataFrame) else b[start : start + length]


def _together(parts: list[Any]) -> Any:
    if len(parts) == 1:
        return parts[0]
    if isinstance(parts[0], pa.RecordBatch):
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    if isinstance(parts[0], pa.Table):
        return pa.concat_tables(parts)
    return pd.concat(parts, ignore_index=True) if isinstance(parts[0], pd.DataFrame) else np.concatenate(parts)


def reslice(batches: Iterable[Any], row_limit: int = 0, size_limit: Any = 0) -> Iterator[Any]:
    """Batches of exactly row_limit rows but for the last. A size limit (bytes or text such as `1mb`) becomes rows by the
    mean size of a row over all that was read, one row at least. Without limits only empty batches are dropped."""
    size_limit = to_size(size_limit)
    held: list[Any] = []
    held_rows = seen_rows = seen_bytes = 0
    for batch in batches:
        n = _rows(batch)
        if not n:
            continue
        if not row_limit and not size_limit:
            yield batch
            continue
        limit = row_limit or (1 << 62)
        if size_limit:
            seen_rows, seen_bytes = seen_rows + n, seen_bytes + _bytes(batch)
            limit = min(limit, max(1, int(size_limit * seen_rows / max(seen_bytes, 1))))
        if held_rows >= limit:  # the limit has come down below what is held
            yield _together(held)
            held, held_rows = [], 0
        at = 0
        while at < n:
            step = min(limit - held_rows, n - at)
            held.append(_take(batch, at, step))
            held_rows, at = held_rows + step, at + step
            if held_rows == limit:
                yield _together(held)
                held, held_rows = [], 0
    if held:
        yield _together(held)


def _key_rows(batch: Any, keys: list[str]) -> list[tuple]:
    frame = batch if isinstance(batch, pd.DataFrame) else batch.select(keys).to_pandas()
    clean = frame[keys].astype(object).where(frame[keys].notna(), None)
    return list(clean.itertuples(index=False, name=None))


def _pieces(batches: Iterable[Any], keys: list[str]) -> Iterator[tuple[tuple, Any]]:
    """(key, rows) of each run of equal keys in each batch."""
    for batch in batches:
        if _rows(batch):
            start = 0
            for key, own in groupby(_key_rows(batch, keys)):
                n = sum(1 for _ in own)
                yield key, _take(batch, start, n)
                start += n


def reslice_sorted(batches: Iterable[Any], keys: list[str]) -> Iterator[Iterator[Any]]:
    """For each key of batches that are sorted by keys an iterator of its batches; null equals null, NaN is null."""
    for _, own in groupby(_pieces(batches, keys), key=lambda p: p[0]):
        yield (piece for _, piece in own)


def reslice_and_merge(batches: Iterable[Any], keys: list[str]) -> Iterator[Any]:
    """One batch for each key of batches that are sorted by keys."""
    for own in reslice_sorted(batches, keys):
        yield _together(list(own))


class Peekable:
    """An iterator that can tell whether it is empty and what comes next."""

    def __init__(self, items: Iterable[Any]):
        self._items = iter(items)
        self._next: list[Any] = []

    @property
    def empty(self) -> bool:
        if not self._next:
            self._next = [x for _, x in zip(range(1), self._items)]  # noqa: B905  one at most
        return not self._next

    def peek(self) -> Any:
        if self.empty:
            raise StopIteration("nothing is left")
        return self._next[0]

    def __iter__(self) -> Iterator[Any]:
        return self

    def __next__(self) -> Any:
        if self._next:
            return self._next.pop()
        return next(self._items)


def slices(items: Iterable[Any], starts_new: Callable[[int, Any, Any], bool]) -> Iterator[Iterator[Any]]:
    """Consecutive items in slices; an item begins one if starts_new(number of the item in its slice, it, the one before).

    What a consumer leaves of a slice is read before the next one.
    """
    source = Peekable(items)
    while not source.empty:

        def one() -> Iterator[Any]:
            last = next(source)
            yield last
            n = 1
            while not source.empty and not starts_new(n, source.peek(), last):
                last = next(source)
                n += 1
                yield last

        own = one()
        yield own
        for _ in own:
            pass


def size_row_slices(items: Iterable[Any], sizer: Callable[[Any], float] | None = None, row_limit: int = 0, size_limit: Any = 0, starts_new: Callable[[int, Any, Any], bool] | None = None) -> Iterator[Iterator[Any]]:
    """Slices that end at the row limit, before the size limit would be passed, or where starts_new says so."""
    limit = to_size(size_limit)
    assert not limit or sizer is not None, "a size limit needs a sizer"
    total = 0.0

    def boundary(n: int, item: Any, last: Any) -> bool:
        nonlocal total
        size = sizer(item) if limit else 0
        if n == 1:
            total = sizer(last) if limit else 0
        new = starts_new is not None and starts_new(n, item, last)
        new = new or (0 < row_limit <= n) or (limit > 0 and total + size > limit)
        total += size
        return new

    yield from slices(items, boundary)


def pairs_of(data: Any, none_as_empty: bool = True) -> Iterator[tuple[Any, Any]]:
    """Key and value pairs of a dict or of pairs; sets have no order and are a ValueError."""
    if data is None and none_as_empty:
        return iter(())
    if isinstance(data, dict):
        return iter(data.items())
    if isinstance(data, (set, frozenset)) or data is None or isinstance(data, str):
        raise ValueError(f"{type(data).__name__} has no pairs")
    first = Peekable(data)

    def checked() -> Iterator[tuple[Any, Any]]:
        for k, v in first:
            yield k, v

    if not first.empty and (not isinstance(first.peek(), (tuple, list)) or len(first.peek()) != 2):
        raise ValueError(f"{first.peek()!r} is no pair")
    return checked()


def map_batches(df: DataFrame, func: Callable[[pa.RecordBatch], pa.RecordBatch], schema: Any, row_limit: int = 0, size_limit: Any = 0) -> DataFrame:
    """func on each batch of the frame, after reslicing within each task. Upstream batches are bounded by Spark's settings."""
    from weftline.schema import Schema

    return df.mapInArrow(lambda batches: map(func, reslice(batches, row_limit, size_limit)), Schema(schema).spark)


def merge_by_key(df: DataFrame, keys: list[str], func: Callable[[pa.Table], pa.Table], schema: Any) -> DataFrame:
    """func on each key's rows as one table. A key's rows must fit a worker; see batches_by_key for those that do not. NaN keys are null ones."""
    from weftline.operators.verbs import nan_as_null
    from weftline.schema import Schema

    return nan_as_null(df, keys).groupBy(*[F.col(f"`{k}`") for k in keys]).applyInArrow(func, Schema(schema).spark)


def batches_by_key(df: DataFrame, keys: list[str], func: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: Any) -> DataFrame:
    """func on an iterator of each key's batches, which are never together in memory. NaN keys are null ones."""
    from weftline.operators.verbs import nan_as_null
    from weftline.schema import Schema

    ordered = nan_as_null(df, keys).repartition(*[F.col(f"`{k}`") for k in keys]).sortWithinPartitions(*[F.col(f"`{k}`") for k in keys])
    return ordered.mapInArrow(lambda batches: chain.from_iterable(func(own) for own in reslice_sorted(batches, keys)), Schema(schema).spark)
