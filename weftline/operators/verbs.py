"""Joins, set operations, distinct and null fill with the library's null rules, as plain Spark plans.

Keys: null never meets null in a join, and NaN counts as null. Set operations: columns go by position, names come from the
left, nulls are equal. Nothing here collects or caches; Catalyst picks the join strategy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.types import from_spark, types_equal

#: Names of join kinds without spaces and underscores.
_KINDS = {
    "inner": "inner", "join": "inner", "cross": "cross",
    "left": "left_outer", "leftouter": "left_outer", "right": "right_outer", "rightouter": "right_outer",
    "outer": "full_outer", "full": "full_outer", "fullouter": "full_outer",
    "semi": "left_semi", "leftsemi": "left_semi", "anti": "left_anti", "leftanti": "left_anti",
}


def parse_join_type(kind: str) -> str:
    try:
        return _KINDS[kind.replace(" ", "").replace("_", "").lower()]
    except KeyError:
        raise NotImplementedError(f"{kind} joins are not supported") from None


def _name(c: str) -> Column:
    return F.col(f"`{c.replace('`', '``')}`")


def nan_as_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The frame with null for NaN in floating columns, all or the given ones."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))} & set(columns or df.columns)
    if not floating:
        return df
    return df.select([F.nanvl(_name(c), F.lit(None)).alias(c) if c in floating else _name(c) for c in df.columns])


def join(left: DataFrame, right: DataFrame, how: str, on: list[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """An equi-join on columns of both sides, or a cross join with none.

    Other columns that both sides have get the suffixes; a suffixed name that is taken already is a ValueError.
    """
    how = parse_join_type(how)
    if (how == "cross") == bool(on):
        raise ValueError(f"{how} join on {on}")
    if missing := [c for c in on if c not in left.columns or c not in right.columns]:
        raise ValueError(f"{missing} are not on both sides")
    left, right = nan_as_null(left, on) if on else left, nan_as_null(right, on) if on else right
    if how in ("left_semi", "left_anti"):
        return left.join(right.select([_name(c) for c in on]), on, how)
    both = [c for c in left.columns if c in right.columns and c not in on]
    sides = []
    for df, suffix in ((left, suffixes[0]), (right, suffixes[1])):
        names = [c + suffix if c in both else c for c in df.columns]
        if len(set(names)) < len(names):
            raise ValueError(f"suffix {suffix} repeats a name of {df.columns}")
        sides.append(df.toDF(*names) if both else df)
    left, right = sides
    if clash := (set(left.columns) & set(right.columns)) - set(on):
        raise ValueError(f"{clash} would be on both sides")
    return left.crossJoin(right) if how == "cross" else left.join(right, on, how)


def _aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """The right side under the left one's names; arity and types must agree."""
    if len(left.columns) != len(right.columns):
        raise ValueError(f"{len(left.columns)} and {len(right.columns)} columns")
    for a, b in zip(left.schema, right.schema, strict=True):
        if not types_equal(from_spark(a.dataType, a.metadata), from_spark(b.dataType, b.metadata)):
            raise ValueError(f"{a.name} is {a.dataType.simpleString()} on the left and {b.dataType.simpleString()} on the right")
    return right.toDF(*left.columns)


def union(left: DataFrame, right: DataFrame, unique: bool) -> DataFrame:
    out = left.union(_aligned(left, right))
    return drop_duplicates(out) if unique else out


def _same_rows(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Left rows that have, or lack, an equal right row; nulls are equal. Repeated left rows are all kept or all go."""
    left, right = nan_as_null(left), nan_as_null(_aligned(left, right))
    right = right.toDF(*(f"__other_{i}" for i in range(len(right.columns))))
    equal = reduce(lambda a, b: a & b, (_name(c).eqNullSafe(F.col(f"__other_{i}")) for i, c in enumerate(left.columns)))
    return left.join(right, equal, how)


def intersect(left: DataFrame, right: DataFrame, unique: bool) -> DataFrame:
    """Rows of both sides; with unique=False each repeated left row that the right side has stays."""
    if unique:
        return nan_as_null(left).intersect(nan_as_null(_aligned(left, right)))
    return _same_rows(left, right, "left_semi")


def except_rows(left: DataFrame, right: DataFrame, unique: bool) -> DataFrame:
    """Left rows that the right side lacks; with unique=False repeated ones all stay."""
    if unique:
        return nan_as_null(left).subtract(nan_as_null(_aligned(left, right)))
    return _same_rows(left, right, "left_anti")


def concat(*frames: DataFrame) -> DataFrame:
    """All rows, columns by name; a column that a frame lacks is null."""
    if not frames:
        raise ValueError("no frames")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def drop_duplicates(df: DataFrame) -> DataFrame:
    return nan_as_null(df).dropDuplicates()


def default_value(kind: T.DataType) -> Column:
    """What stands for null: 2000-01-01, "", false or 0; other types have nothing."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("2000-01-01").cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    raise ValueError(f"{kind.simpleString()} has no default")


def fill_default(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls and NaNs of the columns (default: all) replaced by their type's default."""
    wanted = set(columns if columns is not None else df.columns)
    df = nan_as_null(df, [c for c in df.columns if c in wanted]) if wanted else df
    return df.select([F.coalesce(_name(f.name), default_value(f.dataType)).alias(f.name) if f.name in wanted else _name(f.name) for f in df.schema])


def rename(df: DataFrame, columns: dict[str, str], ignore_missing: bool = False) -> DataFrame:
    """Renames at once, so names can be swapped."""
    from weftline.schema import Schema

    return df.toDF(*Schema(df).rename(columns, ignore_missing).names)


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def with_indicator(df: DataFrame, name: str, value: int = 1) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"{name} is a column already")
    return df.withColumn(name, F.lit(value))
