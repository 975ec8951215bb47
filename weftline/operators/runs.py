"""Ordered operators: consecutive runs of equal keys, and slices of runs by rows or by size.

A DataFrame has no order of its own, so the order columns are given. With partition_by, each group is numbered by a window.
Without it the table is one sequence: it is cut into blocks along the first order column, each block is numbered by
itself, and the blocks' counts, a row a block, are summed and added. No window ever holds the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.types import equality, from_spark

#: Rows of a block of one long sequence, about.
BLOCK_ROWS = 200_000
#: Blocks at most; beyond, blocks hold more rows.
MOST_BLOCKS = 4096
#: Cuts between blocks that are looked at together.
STEP = 64


def comparable(df: DataFrame, key: str) -> Column:
    """A key as it is compared in runs: NaN is null, dates count by day, the null type is always equal."""
    field = df.schema[key]
    kind = equality(from_spark(field.dataType, field.metadata))
    c = F.col(f"`{key}`")
    return {"always": F.lit(0), "float": F.nanvl(c, F.lit(None)), "date": F.to_date(c), "plain": c}[kind]


def _blocks(df: DataFrame, order: str) -> DataFrame:
    """Adds __block, which ascends with the order column; rows of one value are in one block."""
    kind = df.schema[order].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        at = F.unix_micros(F.col(f"`{order}`").cast("timestamp")).cast("double")
    elif isinstance(kind, T.NumericType):
        at = F.col(f"`{order}`").cast("double")
    else:
        raise TypeError(f"{order} is neither a number nor a time: give partition_by")
    n = df.count()
    blocks = min(MOST_BLOCKS, max(1, -(-n // BLOCK_ROWS)))
    if blocks == 1:
        return df.withColumn("__block", F.lit(0))
    cuts = sorted(set(df.agg(F.percentile_approx(at, [i / blocks for i in range(1, blocks)], 100 * blocks)).first()[0]))
    # the cuts below, counted in steps first and then within a step
    coarse = F.size(F.filter(F.lit(cuts[STEP - 1 :: STEP] or [float("inf")]), lambda c: c < at)) * STEP
    fine = F.size(F.filter(F.slice(F.lit(cuts), coarse + 1, F.lit(STEP)), lambda c: c < at))
    return df.withColumn("__block", F.coalesce(F.when(at.isNotNull(), coarse + fine), F.lit(0)))


def run_numbers(df: DataFrame, keys: list[str], order_by: list[str], partition_by: list[str] | None = None, name: str = "run_no") -> DataFrame:
    """Adds the number, from 0, of each row's run: consecutive rows, in order, whose keys are equal (null equals null).

    A key that comes back after another one begins a new run. The order must be total for a defined result. Without partition_by its
    first column must be a number or a time, and one of many values: rows of one value are in one block.
    """
    if not keys:
        return df.withColumn(name, F.lit(0).cast("long"))
    return _numbered(df, keys, order_by, partition_by, name).drop("__at")


def _numbered(df: DataFrame, keys: list[str], order_by: list[str], partition_by: list[str] | None, name: str) -> DataFrame:
    """Adds run numbers and __at, the place of a row in its run, both from 0."""
    same = [comparable(df, k).alias(f"__k{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("__k0")]
    df = df.select("*", F.struct(*same).alias("__keys"))
    order = [F.col(f"`{c}`") for c in order_by]
    if partition_by:
        w = Window.partitionBy(*[F.col(f"`{c}`") for c in partition_by]).orderBy(*order)
        return _placed(_changes(df, w), w).withColumns({name: F.col("__local").cast("long"), "__at": F.col("__row") - F.col("__start")}).drop("__keys", "__new", "__local", "__row", "__start")
    df = _blocks(df, order_by[0])
    w = Window.partitionBy("__block").orderBy(*order)
    df = _placed(_changes(df, w), w)
    place = F.struct(*order)
    sums = {"first": F.min_by("__keys", place), "last": F.max_by("__keys", place), "runs": F.max("__local"), "rows": F.count("*"), "tail": F.max("__start")}
    ends = df.groupBy("__block").agg(*(x.alias(k) for k, x in sums.items()))  # MOST_BLOCKS rows at most
    before = Window.orderBy("__block")
    above = before.rowsBetween(Window.unboundedPreceding, -1)
    begins = F.lag("__block").over(before).isNotNull() & ~_equal(F.lag("last").over(before), F.col("first"), max(1, len(keys)))
    ends = ends.withColumns({"step": F.when(begins, 1).otherwise(0), "above": F.coalesce(F.sum("rows").over(above), F.lit(0))})
    offset = F.sum("step").over(before) + F.coalesce(F.sum("runs").over(above), F.lit(0))
    # where the last run of a block begins, unless it goes on from the block before; so where the first run of a block begins
    tail = F.when((F.col("runs") > 0) | (F.col("step") == 1) | (F.col("above") == 0), F.col("above") + F.col("tail"))
    ends = ends.withColumns({"offset": offset, "tail": tail})
    begun = F.when((F.col("step") == 1) | (F.col("above") == 0), F.col("above")).otherwise(F.last("tail", ignorenulls=True).over(above))
    ends = ends.select("__block", F.col("offset").alias("__offset"), F.col("above").alias("__above"), begun.alias("__begun"))
    df = df.join(F.broadcast(ends), "__block")
    start = F.when(F.col("__local") == 0, F.col("__begun")).otherwise(F.col("__above") + F.col("__start"))
    df = df.withColumns({name: (F.col("__local") + F.col("__offset")).cast("long"), "__at": F.col("__above") + F.col("__row") - start})
    return df.drop("__keys", "__new", "__local", "__row", "__start", "__offset", "__above", "__begun", "__block")


def _placed(df: DataFrame, w: Any) -> DataFrame:
    """Adds, within a window, the number of the run, the row's place and the place at which its run begins, all from 0."""
    rows = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({"__local": F.sum("__new").over(rows), "__row": (F.row_number().over(w) - 1).cast("long")})
    return df.withColumn("__start", F.coalesce(F.max(F.when(F.col("__new") == 1, F.col("__row"))).over(rows), F.lit(0).cast("long")))


def _equal(a: Column, b: Column, n: int) -> Column:
    return reduce(lambda x, y: x & y, (a[f"__k{i}"].eqNullSafe(b[f"__k{i}"]) for i in range(n)))


def _changes(df: DataFrame, w) -> DataFrame:
    n = len(df.schema["__keys"].dataType.fields)
    first = F.row_number().over(w) == 1
    return df.withColumn("__new", F.when(first | _equal(F.lag("__keys").over(w), F.col("__keys"), n), 0).otherwise(1))


def row_slices(df: DataFrame, keys: list[str], order_by: list[str], row_limit: int, partition_by: list[str] | None = None, run_name: str = "run_no", slice_name: str = "slice_no") -> DataFrame:
    """Adds run numbers and, within each run, slices of at most row_limit rows, numbered from 0. 0: a run is one slice.

    Without partition_by a run of any length is cut block by block: no task has a whole run.
    """
    if row_limit <= 0:
        return run_numbers(df, keys, order_by, partition_by, run_name).withColumn(slice_name, F.lit(0).cast("long"))
    df = _numbered(df, keys, order_by, partition_by, run_name)
    return df.withColumn(slice_name, F.floor(F.col("__at") / row_limit).cast("long")).drop("__at")


def greedy_slices(sizes: np.ndarray, size_limit: float, row_limit: int = 0, cut: np.ndarray | None = None) -> np.ndarray:
    """Slice numbers of a sequence: a slice ends before the item that would take it over the size limit, when it has
    row_limit items, or where cut is true. An item over the limit is a slice of its own."""
    out = np.zeros(len(sizes), np.int64)
    number, total, rows = 0, 0.0, 0
    for i, size in enumerate(sizes):
        if i and ((size_limit > 0 and total + size > size_limit) or (0 < row_limit <= rows) or (cut is not None and cut[i])):
            number, total, rows = number + 1, 0.0, 0
        total += size
        rows += 1
        out[i] = number
    return out


def size_slices(df: DataFrame, group_by: list[str], order_by: list[str], size: Column, size_limit: float, row_limit: int = 0, slice_name: str = "slice_no") -> DataFrame:
    """Adds greedy slices by size within each group, in order; null and NaN keys are one group, a null size is 0.

    The walk is sequential, so a group goes through one task, but batch by batch: what is held is three numbers.
    """
    keys = [comparable(df, c) for c in group_by]
    wide = df.withColumns({"__group": F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))), "__size": F.coalesce(size.cast("double"), F.lit(0.0))})
    ordered = wide.repartition("__group").sortWithinPartitions("__group", *[F.col(f"`{c}`") for c in order_by])
    schema = T.StructType([*ordered.schema.fields, T.StructField(slice_name, T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, total, rows = None, 0, 0.0, 0
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            groups, sizes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__group", "__size"))
            for i, (group, own) in enumerate(zip(groups, sizes, strict=True)):
                if group != last:
                    last, number, total, rows = group, 0, 0.0, 0
                elif (size_limit > 0 and total + own > size_limit) or 0 < row_limit <= rows:
                    number, total, rows = number + 1, 0.0, 0
                total, rows = total + own, rows + 1
                out[i] = number
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, slice_name])

    return ordered.mapInArrow(cut, schema).drop("__group", "__size")
