"""Types and their expressions: `long`, `decimal(5,2)`, `[str]`, `{a:int,b:[str]}`, `<str,int>`.

A Type knows its canonical text, its Spark type and its Arrow type. Spark has no unsigned integers, no half floats and no
zones: those types are widened, and a field that holds one keeps its expression in the field's metadata.
"""

from __future__ import annotations

import datetime as dt
import decimal
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T

from weftline.functions.names import quote_name, quoted_parts, unquote_name

#: Where a field keeps the expression of a type that Spark widens.
METADATA_KEY = "weftline.type"

#: Name, other names, Spark type, Arrow type, and whether Spark's type is a wider one.
_PLAIN: list[tuple[str, tuple[str, ...], T.DataType, pa.DataType, bool]] = [
    ("null", (), T.NullType(), pa.null(), False),
    ("str", ("string",), T.StringType(), pa.string(), False),
    ("bool", ("boolean",), T.BooleanType(), pa.bool_(), False),
    ("byte", ("int8",), T.ByteType(), pa.int8(), False),
    ("short", ("int16",), T.ShortType(), pa.int16(), False),
    ("int", ("int32",), T.IntegerType(), pa.int32(), False),
    ("long", ("int64",), T.LongType(), pa.int64(), False),
    ("ubyte", ("uint8",), T.ShortType(), pa.uint8(), True),
    ("ushort", ("uint16",), T.IntegerType(), pa.uint16(), True),
    ("uint", ("uint32",), T.LongType(), pa.uint32(), True),
    ("ulong", ("uint64",), T.DecimalType(20, 0), pa.uint64(), True),
    ("float16", (), T.FloatType(), pa.float16(), True),
    ("float", ("float32",), T.FloatType(), pa.float32(), False),
    ("double", ("float64",), T.DoubleType(), pa.float64(), False),
    ("date", (), T.DateType(), pa.date32(), False),
    ("datetime", (), T.TimestampNTZType(), pa.timestamp("us"), False),
    ("bytes", ("binary",), T.BinaryType(), pa.binary(), False),
]
_NAMES = {alias: row[0] for row in _PLAIN for alias in (row[0], *row[1])}
_SPARK = {row[0]: row[2] for row in _PLAIN}
_ARROW = {row[0]: row[3] for row in _PLAIN}
_WIDENED = {row[0] for row in _PLAIN if row[4]}
_PYTHON = {bool: "bool", int: "long", float: "double", str: "str", bytes: "bytes", dt.datetime: "datetime", dt.date: "date", type(None): "null"}
#: Bounds of the integers that Spark's wider types do not enforce.
UNSIGNED_MAX = {"ubyte": 2**8 - 1, "ushort": 2**16 - 1, "uint": 2**32 - 1, "ulong": 2**64 - 1}


@dataclass(frozen=True)
class Type:
    """kind is plain (name, args), list, map (the parts are unnamed) or struct (named parts)."""

    kind: str
    name: str = ""
    args: tuple = ()
    parts: tuple[tuple[str, Type], ...] = ()

    def __str__(self) -> str:
        inner = ",".join((f"{quote_name(n)}:" if self.kind == "struct" else "") + str(t) for n, t in self.parts)
        if self.kind != "plain":
            return {"list": "[{}]", "struct": "{{{}}}", "map": "<{}>"}[self.kind].format(inner)
        return f"{self.name}({','.join(map(str, self.args))})" if self.args else self.name

    @property
    def spark(self) -> T.DataType:
        inner = [t.spark for _, t in self.parts]
        if self.kind == "list":
            return T.ArrayType(*inner)
        if self.kind == "map":
            return T.MapType(*inner)
        if self.kind == "struct":
            return T.StructType([t.field(n) for n, t in self.parts])
        if self.name == "decimal":
            return T.DecimalType(*(*self.args, 0)[:2])
        return T.TimestampType() if self.name == "timestamp" else _SPARK[self.name]

    @property
    def arrow(self) -> pa.DataType:
        inner = [t.arrow for _, t in self.parts]
        if self.kind == "list":
            return pa.list_(inner[0])
        if self.kind == "map":
            return pa.map_(*inner)
        if self.kind == "struct":
            return pa.struct([pa.field(n, t) for (n, _), t in zip(self.parts, inner, strict=True)])
        if self.name == "decimal":
            return pa.decimal128(*(*self.args, 0)[:2])
        return pa.timestamp(*self.args) if self.name == "timestamp" else _ARROW[self.name]

    @property
    def widened(self) -> bool:
        """Spark's type does not tell all of it."""
        return self.name in _WIDENED or self.name == "timestamp" or any(t.widened for _, t in self.parts)

    def field(self, name: str) -> T.StructField:
        return T.StructField(name, self.spark, True, {METADATA_KEY: str(self)} if self.widened else None)


def plain(name: str, *args: Any) -> Type:
    """A type by name, in canonical form."""
    if name == "decimal":
        if not 1 <= len(args) <= 2 or not all(re.fullmatch(r"\d+", str(a)) for a in args):
            raise SyntaxError("decimal takes a precision and, after it, a scale")
        digits = tuple(map(int, args))
        return Type("plain", "decimal", digits[:1] if digits[1:] in ((), (0,)) else digits)
    if name == "timestamp":
        if not 1 <= len(args) <= 2 or args[0] not in ("s", "ms", "us", "ns"):
            raise SyntaxError("timestamp takes a unit and, after it, a zone")
        return Type("plain", "datetime") if len(args) == 1 else Type("plain", "timestamp", tuple(args))
    if args or name not in _NAMES:
        raise SyntaxError(f"{name} is not a type")
    return Type("plain", _NAMES[name])


class _Reader:
    """Reads one expression from left to right."""

    _SIGNS = "[]{}<>:,"

    def __init__(self, text: str):
        self.text, self.tokens = text, []
        for quoted, a, b in quoted_parts(text):
            if quoted:
                self.tokens.append(text[a:b])
            else:
                self.tokens += [t for t in (m.strip() for m in re.findall(r"[^\[\]{}<>:,(]+\([^()]*\)|[\[\]{}<>:,]|[^\[\]{}<>:,]+", text[a:b])) if t]
        self.at = 0

    def take(self, sign: str | None = None) -> str:
        token = self.tokens[self.at] if self.at < len(self.tokens) else ""
        if not token or (sign is not None and token != sign) or (sign is None and token in self._SIGNS):
            raise SyntaxError(f"{self.text}: {sign or 'a name'} expected, not {token or 'the end'}")
        self.at += 1
        return token

    def ahead(self, sign: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at] == sign

    def fields(self) -> list[tuple[str, Type]]:
        out: dict[str, Type] = {}
        while True:
            name = unquote_name(self.take())
            self.take(":")
            if name in out:
                raise SyntaxError(f"{self.text}: {name} comes twice")
            out[name] = self.type()
            if not self.ahead(","):
                return list(out.items())
            self.at += 1

    def type(self) -> Type:
        for opening, closing, kind in ("[", "]", "list"), ("{", "}", "struct"), ("<", ">", "map"):
            if self.ahead(opening):
                self.at += 1
                parts = self.fields() if kind == "struct" else [("", self.type())]
                if kind == "map":
                    self.take(",")
                    parts.append(("", self.type()))
                self.take(closing)
                return Type(kind, parts=tuple(parts))
        name, _, args = self.take().partition("(")
        return plain(name.strip(), *(a.strip() for a in args.rstrip(")").split(",")) if args else ())

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise SyntaxError(f"{self.text}: {self.tokens[self.at]} is too much")


def parse_fields(text: str) -> list[tuple[str, Type]]:
    """Names and types of a schema expression; blank text has none. Every fault is a SyntaxError."""
    if not text.strip():
        return []
    try:
        reader = _Reader(text)
        fields = reader.fields()
        reader.end()
    except ValueError as e:
        raise SyntaxError(str(e)) from e
    return fields


def parse_type(text: str) -> Type:
    reader = _Reader(text)
    out = reader.type()
    reader.end()
    return out


def from_arrow(t: pa.DataType) -> Type:
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return Type("list", parts=(("", from_arrow(t.value_type)),))
    if pa.types.is_struct(t):
        return Type("struct", parts=tuple((f.name, from_arrow(f.type)) for f in t))
    if pa.types.is_map(t):
        return Type("map", parts=(("", from_arrow(t.key_type)), ("", from_arrow(t.item_type))))
    if pa.types.is_decimal128(t):
        return plain("decimal", t.precision, t.scale)
    if pa.types.is_timestamp(t):
        return plain("timestamp", t.unit, *([t.tz] if t.tz else []))
    if pa.types.is_large_string(t):
        return plain("str")
    if pa.types.is_large_binary(t):
        return plain("bytes")
    for name, arrow in _ARROW.items():
        if arrow == t:
            return plain(name)
    raise NotImplementedError(f"{t} is not supported")


def from_spark(t: T.DataType, metadata: dict | None = None) -> Type:
    if metadata and METADATA_KEY in metadata:
        kept = parse_type(metadata[METADATA_KEY])
        if kept.spark == t:
            return kept
    if isinstance(t, T.ArrayType):
        return Type("list", parts=(("", from_spark(t.elementType)),))
    if isinstance(t, T.StructType):
        return Type("struct", parts=tuple((f.name, from_spark(f.dataType, f.metadata)) for f in t))
    if isinstance(t, T.MapType):
        return Type("map", parts=(("", from_spark(t.keyType)), ("", from_spark(t.valueType))))
    if isinstance(t, T.DecimalType):
        return plain("decimal", t.precision, t.scale)
    if isinstance(t, T.TimestampType):
        return plain("timestamp", "us", "UTC")
    if isinstance(t, (T.CharType, T.VarcharType)):
        return plain("str")
    for name, _, spark, _, wide in _PLAIN:
        if not wide and spark == t:
            return plain(name)
    raise NotImplementedError(f"{t} is not supported")


def to_type(obj: Any) -> Type:
    """A Type of a Type, an expression, a Spark, Arrow, numpy or pandas type, or a Python class."""
    if obj is None:
        raise TypeError("None is not a type")
    if isinstance(obj, Type):
        return obj
    if isinstance(obj, str):
        return parse_type(obj)
    if isinstance(obj, T.DataType):
        return from_spark(obj)
    if isinstance(obj, pa.DataType):
        return from_arrow(obj)
    if isinstance(obj, type) and obj in _PYTHON:
        return plain(_PYTHON[obj])
    if obj is decimal.Decimal:
        return plain("decimal", 38, 18)
    import numpy as np
    import pandas as pd

    if isinstance(obj, pd.ArrowDtype):
        return from_arrow(obj.pyarrow_dtype)
    if isinstance(obj, pd.StringDtype):
        return plain("str")
    if isinstance(obj, pd.DatetimeTZDtype):
        return plain("timestamp", "us", str(obj.tz))
    if hasattr(obj, "numpy_dtype"):
        obj = obj.numpy_dtype
    own = np.dtype(obj)
    if own.kind == "M":
        return plain("datetime")
    return plain("str") if own.kind in "OUS" else from_arrow(pa.from_numpy_dtype(own))


def is_supported(obj: Any, throw: bool = False) -> bool:
    """Whether a type, but for the items of nested ones, has an expression."""
    try:
        if isinstance(obj, (pa.ListType, pa.StructType, pa.MapType)):
            return True
        to_type(obj)
        return True
    except (NotImplementedError, SyntaxError, TypeError):
        if throw:
            raise NotImplementedError(f"{obj} is not supported") from None
        return False


def types_equal(a: Any, b: Any, equal_groups: list[list[Callable[[Type], bool]]] | None = None) -> bool:
    """Equality in which types of one group count as equal, at any depth. A group is a list of tests; each side passes one."""
    a, b = to_type(a), to_type(b)
    for group in equal_groups or []:
        if any(test(a) for test in group) and any(test(b) for test in group):
            return True
    if a.kind != b.kind or (a.name, a.args) != (b.name, b.args) or len(a.parts) != len(b.parts):
        return False
    return all(m == n and types_equal(s, t, equal_groups) for (m, s), (n, t) in zip(a.parts, b.parts, strict=True))


def replace_type(t: Type, matches: Callable[[Type], bool] | Any, new: Callable[[Type], Any] | Any, recursive: bool = True) -> Type:
    """The type with what matches replaced. Lists are tested after their items; structs and maps are looked into, not replaced."""
    test = matches if callable(matches) and not isinstance(matches, type) else (lambda x, own=to_type(matches): x == own)
    made = new if callable(new) and not isinstance(new, type) else (lambda _, own=to_type(new): own)
    if t.kind != "plain" and recursive:
        t = Type(t.kind, parts=tuple((n, replace_type(p, test, made)) for n, p in t.parts))
    return to_type(made(t)) if t.kind in ("plain", "list") and test(t) else t


def equality(t: Type) -> str:
    """How values of a type are compared in runs: always (null), float (NaN is null), date (the day alone) or plain."""
    if t.name == "null":
        return "always"
    return "float" if t.name in ("float", "double", "float16") else "date" if t.name == "date" else "plain"
