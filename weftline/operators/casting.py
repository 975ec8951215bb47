"""Casts of columns, frames and JSON text to declared types, as projections under ANSI rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.types import UNSIGNED_MAX, Type, from_spark, replace_type, to_type
from weftline.schema import Schema

#: Texts of truth values in a column, in lower case.
_TRUE, _FALSE = ("true", "1"), ("false", "0")

_INTEGERS = {"byte", "short", "int", "long", *UNSIGNED_MAX}


def _fail(message: str, c: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), F.coalesce(c.cast("string"), F.lit("null"))))


def _wall_clock(c: Column, zone: str) -> Column:
    """A zoned time as the wall clock of its zone."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone), c.cast("timestamp_ntz"))


def _zoned(c: Column, zone: str) -> Column:
    """A wall clock as the instant that it is in a zone."""
    return F.convert_timezone(F.lit(zone), F.current_timezone(), c).cast("timestamp")


def cast_column(c: Column, old: Any, new: Any, number_unit: str | None = None) -> Column:
    """A column cast from one type to another.

    Numbers lose their fraction on the way to integers and fail out of range, also for unsigned types. Text is a truth
    value only as true, false, 1 or 0. A wall clock keeps its reading when it gets a zone, and a zoned time its zone's
    reading when it loses it. A number becomes a time only with number_unit (s, ms or us).
    """
    old, new = to_type(old), to_type(new)
    if old == new:
        return c
    numeric = old.name in _INTEGERS | {"float", "double", "float16", "decimal"}
    if new.name == "bool" and old.name == "str":
        low = F.lower(F.trim(c))
        return F.when(low.isin(*_TRUE), True).when(low.isin(*_FALSE), False).when(c.isNull(), None).otherwise(_fail("no truth value: ", c).cast("boolean"))
    if new.name in ("datetime", "timestamp") and numeric:
        if number_unit not in ("s", "ms", "us"):
            raise ValueError("a number becomes a time only with a unit")
        made = {"s": F.timestamp_seconds(c), "ms": F.timestamp_millis(c.cast("long")), "us": F.timestamp_micros(c.cast("long"))}[number_unit]
        return made if new.name == "timestamp" else _wall_clock(made, "UTC")
    if new.name == "timestamp":
        if old.name == "timestamp":
            return c
        if old.name == "str":
            return c.cast("timestamp")
        return _zoned(c.cast("timestamp_ntz"), new.args[1])
    if old.name == "timestamp" and new.name in ("datetime", "date", "str"):
        return _wall_clock(c, old.args[1]).cast(new.spark)
    if new.name in UNSIGNED_MAX:
        wide = c.cast(new.spark)
        return F.when(c.isNull() | wide.between(F.lit(0), F.lit(str(UNSIGNED_MAX[new.name])).cast("decimal(20,0)")), wide).otherwise(_fail(f"out of {new}: ", c).cast(new.spark))
    return c.cast(new.spark)


def _column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _typed(c: Column, name: str, kind: Type) -> Column:
    field = kind.field(name)
    return c.alias(name, metadata=field.metadata) if field.metadata else c.alias(name)


def cast_frame(df: DataFrame, schema: Any) -> DataFrame:
    """Columns cast by position; names come from the schema."""
    new = Schema(schema)
    old = Schema(df)
    if len(old) != len(new):
        raise ValueError(f"{len(old)} columns and {len(new)} types")
    if old == new:
        return df
    return df.select([_typed(cast_column(_column(a), s, t), b, t) for (a, s), (b, t) in zip(old.items(), new.items(), strict=True)])


#: Bits of whole numbers.
_BITS = {"byte": 8, "short": 16, "int": 32, "long": 64, "ubyte": 8, "ushort": 16, "uint": 32, "ulong": 64}


def wrapped(c: Column, new: Any) -> Column:
    """A whole number cut to another type's bits, as unchecked casts do: 300 is 44 as a byte."""
    kind = to_type(new)
    span = 1 << _BITS[kind.name]
    low = F.pmod(c.cast("decimal(38,0)"), F.lit(span).cast("decimal(38,0)") if span < 1 << 63 else F.lit(str(span)).cast("decimal(38,0)"))
    if kind.name not in UNSIGNED_MAX:
        half = F.lit(str(span // 2)).cast("decimal(38,0)")
        low = F.when(low >= half, low - half - half).otherwise(low)
    return low.cast(kind.spark)


def alter(df: DataFrame, schema: Any, safe: bool = True) -> DataFrame:
    """Columns picked by name, put in order and cast; others go. A name that is missing is a KeyError.

    Unless it is safe, whole numbers that another type of them cannot hold are cut to its bits instead of failing.
    """
    new, old = Schema(schema), Schema(df)
    if missing := [n for n in new.names if n not in old.names]:
        raise KeyError(missing[0])
    if old == new:
        return df
    whole = lambda n, t: not safe and old[n] != t and old[n].name in _BITS and t.name in _BITS
    return df.select([_typed(wrapped(_column(n), t) if whole(n, t) else cast_column(_column(n), old[n], t), n, t) for n, t in new.items()])


def alter_function(old: Any, new: Any, safe: bool = True) -> Callable[[DataFrame], DataFrame]:
    """A function that alters frames of one schema to another; faults are raised here, not when it is used."""
    old, new = Schema(old), Schema(new)
    if missing := [n for n in new.names if n not in old.names]:
        raise KeyError(missing[0])
    return (lambda df: df) if old == new else (lambda df: alter(df, new, safe))


def replace_types(df: DataFrame, pairs: list[tuple[Any, Any]], recursive: bool = True) -> DataFrame:
    """Every (type or test, new type) applied in turn to all columns, and inside nested ones."""
    new = replace_types_in_schema(Schema(df), pairs, recursive)
    return alter(df, new)


def replace_types_in_schema(schema: Any, pairs: list[tuple[Any, Any]], recursive: bool = True) -> Schema:
    out = Schema(schema)
    for old, new in pairs:
        out = Schema([(n, replace_type(t, old, new, recursive)) for n, t in out.items()])
    return out


def parse_json_columns(df: DataFrame, columns: Any) -> DataFrame:
    """Text columns parsed as JSON, in their places: with the types of a schema, or of a list of names with types from the data.

    Null text stays null, and text that is no JSON of the type fails. Fields that the type lacks are left out. Inferring
    takes one aggregation over the columns.
    """
    if isinstance(columns, list) and all(isinstance(c, str) and ":" not in c for c in columns):
        if not columns:
            return df
        _assert_text(df, columns)
        found = df.agg(*[F.schema_of_variant_agg(F.parse_json(_column(c))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        ddl = {c: (found[i] or "VOID").replace("OBJECT<", "STRUCT<") for i, c in enumerate(columns)}
        ddl = {c: "STRING" if d == "VOID" else d for c, d in ddl.items()}
    else:
        types = dict(Schema(columns).items())
        if not types:
            return df
        _assert_text(df, list(types))
        ddl = {c: t.spark for c, t in types.items()}
    parsed = {c: _parsed(_column(c), d) for c, d in ddl.items()}
    return df.select([parsed[c].alias(c) if c in parsed else _column(c) for c in df.columns])


def _parsed(text: Column, kind: Any) -> Column:
    """from_json reads objects and arrays; the text is wrapped so that plain values work as well.

    Text that is more than one value must not get through: what closes the object around it does not close a list, so it
    has to be a list's one item as well.
    """
    simple = kind if isinstance(kind, str) else kind.simpleString()
    whole = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"struct<v: {simple}>", {"mode": "FAILFAST"})
    one = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.when(text.isNull() | F.coalesce(one, F.lit(False)), whole["v"]).otherwise(_fail("MALFORMED JSON value: ", text).cast(simple))


def _assert_text(df: DataFrame, columns: list[str]) -> None:
    kinds = dict(df.dtypes)
    if wrong := [c for c in columns if kinds.get(c) != "string"]:
        raise ValueError(f"{wrong} are no text columns")


def rows_of(df: DataFrame, columns: list[str] | None = None) -> Iterator[list[Any]]:
    """Rows as lists of native values, partition by partition; NaN is None."""
    from weftline.operators.verbs import nan_as_null

    chosen = df.select([_column(c) for c in columns]) if columns else df
    return (list(r) for r in nan_as_null(chosen).toLocalIterator())


def apply_schema(schema: Any, rows: Iterable[list[Any]], copy: bool = True, deep: bool = False, str_as_json: bool = True) -> Iterator[list[Any]]:
    """Python rows with each value as the schema's type, lazily; a value that can't be one is a ValueError.

    Without copy the rows themselves are changed and given back. Nested values are only held to be a list, dict or list of pairs unless
    deep, which converts what is in them and, with str_as_json, reads them from text.
    """
    from weftline.functions.values import converter

    convert = [converter(t, deep, str_as_json) for t in Schema(schema).types]
    for row in rows:
        try:
            made = [f(v) for f, v in zip(convert, row, strict=True)]
            if not copy:
                row[:] = made
            yield made if copy else row
        except NotImplementedError:
            raise
        except Exception as e:
            raise ValueError(f"{row}: {e}") from e


def types_of(df: DataFrame) -> dict[str, Type]:
    return {f.name: from_spark(f.dataType, f.metadata) for f in df.schema}
