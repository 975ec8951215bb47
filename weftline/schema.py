"""An ordered schema with an algebra, over the types of weftline.functions.types."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weftline.errors import SchemaError
from weftline.functions.names import quote_name, replace_unquoted, search_unquoted, split_names
from weftline.functions.types import METADATA_KEY, Type, from_arrow, from_spark, parse_fields, to_type, types_equal

Pair = tuple[str, Type]


def _of_frame(df: Any) -> list[Pair]:
    """Of a pandas frame, by Arrow's inference; empty columns of objects are text, times have microseconds."""
    out = []
    for f in pa.Schema.from_pandas(df, preserve_index=False):
        kind = f.type
        if pa.types.is_timestamp(kind):
            kind = pa.timestamp("us", kind.tz)
        out.append((f.name, to_type("str") if not len(df) and pa.types.is_null(kind) else from_arrow(kind)))
    return out


def _pairs(obj: Any) -> list[Pair]:
    """Names and types of anything like a schema."""
    import pandas as pd

    if obj is None:
        return []
    if isinstance(obj, Schema):
        return list(obj._types.items())
    if isinstance(obj, str):
        return parse_fields(obj)
    if isinstance(obj, pa.Schema):
        return [(f.name, from_arrow(f.type)) for f in obj]
    if isinstance(obj, pa.Field):
        return [(obj.name, from_arrow(obj.type))]
    if isinstance(obj, T.StructField):
        return [(obj.name, from_spark(obj.dataType, obj.metadata))]
    if isinstance(obj, T.StructType):
        return [p for f in obj for p in _pairs(f)]
    if isinstance(obj, DataFrame) or hasattr(obj, "sparkSession"):
        return _pairs(obj.schema)
    if isinstance(obj, pd.DataFrame):
        return _of_frame(obj)
    if isinstance(obj, dict):
        return [(k, _pairs(v)[0][1] if isinstance(v, (pa.Field, T.StructField)) else to_type(v)) for k, v in obj.items()]
    if isinstance(obj, tuple) and len(obj) == 2 and isinstance(obj[0], str):
        return [(obj[0], to_type(obj[1]))]
    if isinstance(obj, (list, tuple)):
        return [p for x in obj for p in _pairs(x)]
    raise SchemaError(f"{obj!r} is not like a schema")


class Schema:
    """Names and types in order. Only `schema[name] = type`, for new names, and union_with change one."""

    def __init__(self, *args: Any, **kwargs: Any):
        if args and kwargs:
            raise SchemaError("give a schema by position or by name, not by both")
        self._types: dict[str, Type] = {}
        self.append(list(args) if len(args) != 1 else args[0])
        self.append(kwargs)

    # what it holds
    @property
    def names(self) -> list[str]:
        return list(self._types)

    @property
    def types(self) -> list[Type]:
        return list(self._types.values())

    @property
    def fields(self) -> list[T.StructField]:
        return [t.field(n) for n, t in self._types.items()]

    @property
    def spark(self) -> T.StructType:
        return T.StructType(self.fields)

    @property
    def arrow(self) -> pa.Schema:
        return pa.schema([pa.field(n, t.arrow) for n, t in self._types.items()])

    def pandas_dtypes(self, extension: bool = False, arrow: bool = False) -> dict[str, Any]:
        """Numpy dtypes by name, or pandas' nullable ones, or Arrow ones; nested types are objects but for Arrow."""
        import numpy as np
        import pandas as pd

        nullable = {"str": pd.StringDtype(), "bool": pd.BooleanDtype(), "byte": pd.Int8Dtype(), "short": pd.Int16Dtype(), "int": pd.Int32Dtype(), "long": pd.Int64Dtype(), "ubyte": pd.UInt8Dtype(), "ushort": pd.UInt16Dtype(), "uint": pd.UInt32Dtype(), "ulong": pd.UInt64Dtype(), "float": pd.Float32Dtype(), "double": pd.Float64Dtype()}
        out = {}
        for n, t in self._types.items():
            if arrow:
                out[n] = pd.ArrowDtype(t.arrow)
            elif extension and t.name in nullable:
                out[n] = nullable[t.name]
            elif t.name == "timestamp":
                out[n] = pd.DatetimeTZDtype("ns", t.args[1])
            elif t.name == "datetime":
                out[n] = np.dtype("datetime64[ns]")
            else:
                out[n] = np.dtype(object) if t.kind != "plain" or t.name in ("str", "bytes", "date", "decimal", "null") else np.dtype(t.arrow.to_pandas_dtype())
        return out

    def assert_not_empty(self) -> Schema:
        if not self._types:
            raise SchemaError("the schema is empty")
        return self

    def copy(self) -> Schema:
        return Schema(self)

    def items(self) -> list[Pair]:
        return list(self._types.items())

    def index(self, name: str) -> int:
        return self.names.index(name)

    def __len__(self) -> int:
        return len(self._types)

    def __iter__(self) -> Iterator[str]:
        return iter(self._types)

    def __getitem__(self, key: str | int) -> Type:
        return self.types[key] if isinstance(key, int) else self._types[key]

    def __repr__(self) -> str:
        return ",".join(f"{quote_name(n)}:{t}" for n, t in self._types.items())

    def __hash__(self) -> int:
        return hash(repr(self))

    # comparison
    def __eq__(self, other: Any) -> bool:
        return self.is_like(other)

    def is_like(self, other: Any, equal_groups: list | None = None) -> bool:
        """Whether names and types agree in order; a string without groups must be the canonical expression."""
        if other is None:
            return False
        if isinstance(other, str) and equal_groups is None:
            return repr(self) == other
        try:
            own = Schema(other)
        except (SchemaError, SyntaxError, TypeError, NotImplementedError):
            return False
        return self.names == own.names and all(types_equal(a, b, equal_groups) for a, b in zip(self.types, own.types, strict=True))

    def __contains__(self, key: Any) -> bool:
        if isinstance(key, str) and ":" not in key:
            return key in self._types
        if isinstance(key, list):
            return all(k in self for k in key)
        return all(self._types.get(n) == t for n, t in _pairs(key))

    # growth
    def __setitem__(self, name: str, kind: Any) -> None:
        if name is None or kind is None:
            raise SchemaError("a name and a type are needed")
        if name in self._types:
            raise SchemaError(f"{name} is in {self} already")
        if isinstance(kind, (pa.Field, T.StructField)) and kind.name != name:
            raise SchemaError(f"{kind.name} is not {name}")
        try:
            self._types[name] = _pairs(kind)[0][1] if isinstance(kind, (pa.Field, T.StructField)) else to_type(kind)
        except NotImplementedError as e:
            raise SchemaError(str(e)) from e

    def append(self, obj: Any) -> Schema:
        for name, kind in _pairs(obj):
            self[name] = kind
        return self

    def __add__(self, other: Any) -> Schema:
        return self.copy().append(other)

    def __iadd__(self, other: Any) -> Schema:
        return self.append(other)

    # selection
    def _wanted(self, obj: Any) -> list[tuple[str, Type | None]]:
        if obj is None:
            return []
        if isinstance(obj, str) and ":" not in obj:
            return [(obj, None)]
        if isinstance(obj, (list, set)):
            return [p for x in obj for p in self._wanted(x)]
        return list(_pairs(obj))

    def _matches(self, obj: Any, ignore_key_mismatch: bool, require_type_match: bool, ignore_type_mismatch: bool) -> list[str]:
        """Own names that a selection asks for, in its order."""
        out = []
        for name, kind in self._wanted(obj):
            if name not in self._types:
                if not ignore_key_mismatch:
                    raise SchemaError(f"{quote_name(name)} is not in {self}")
            elif kind is None or not require_type_match or kind == self._types[name]:
                out.append(name)
            elif not ignore_type_mismatch:
                raise SchemaError(f"{quote_name(name)} is {self._types[name]}, not {kind}")
        return out

    def remove(self, obj: Any, ignore_key_mismatch: bool = False, require_type_match: bool = True, ignore_type_mismatch: bool = False) -> Schema:
        gone = self._matches(obj, ignore_key_mismatch, require_type_match, ignore_type_mismatch)
        if len(set(gone)) < len(gone):
            raise SchemaError(f"{gone} has a name twice")
        return Schema([(n, t) for n, t in self.items() if n not in gone])

    def extract(self, obj: Any, ignore_key_mismatch: bool = False, require_type_match: bool = True, ignore_type_mismatch: bool = False) -> Schema:
        if isinstance(obj, set):
            raise SchemaError("a set has no order to extract by")
        return Schema([(n, self._types[n]) for n in self._matches(obj, ignore_key_mismatch, require_type_match, ignore_type_mismatch)])

    def exclude(self, other: Any, require_type_match: bool = True, ignore_type_mismatch: bool = False) -> Schema:
        return self.remove(other, True, require_type_match, ignore_type_mismatch)

    def intersect(self, other: Any, ignore_type_mismatch: bool = True, require_type_match: bool = True, use_other_order: bool = False) -> Schema:
        common = self._matches(other, True, require_type_match, ignore_type_mismatch)
        return Schema([(n, self._types[n]) for n in (common if use_other_order else [n for n in self.names if n in common])])

    def __sub__(self, other: Any) -> Schema:
        return self.remove(other)

    def __isub__(self, other: Any) -> Schema:
        raise SchemaError("a schema does not shrink; use a - b")

    def union(self, other: Any, require_type_match: bool = False) -> Schema:
        return self.copy().union_with(other, require_type_match)

    def union_with(self, other: Any, require_type_match: bool = False) -> Schema:
        """Adds the names that are new, in place."""
        for name, kind in _pairs(other):
            if name not in self._types:
                self[name] = kind
            elif require_type_match and self._types[name] != kind:
                raise SchemaError(f"{quote_name(name)} is {self._types[name]}, not {kind}")
        return self

    def alter(self, changes: Any) -> Schema:
        """Other types for some names, in the same order."""
        new = dict(_pairs(changes))
        if missing := [n for n in new if n not in self._types]:
            raise ValueError(f"{missing} not in {self}")
        return Schema([(n, new.get(n, t)) for n, t in self.items()])

    def rename(self, columns: dict[str, str], ignore_missing: bool = False) -> Schema:
        """All at once, so names can be swapped."""
        if not ignore_missing and (missing := [n for n in columns if n not in self._types]):
            raise SchemaError(f"{missing} not in {self}")
        names = [columns.get(n, n) for n in self.names]
        if len(set(names)) < len(names) or not all(isinstance(n, str) for n in names):
            raise SchemaError(f"{names} are no distinct names")
        return Schema(list(zip(names, self.types, strict=True)))

    def transform(self, *args: Any, **kwargs: Any) -> Schema:
        """A schema from expressions: `*` is this one; then, from left to right, `-a,b` drops, `~a,b` drops what there is,
        `+a:int` overwrites or adds. Functions of this schema and schema-likes are added in turn."""
        try:
            out = Schema()
            for arg in args:
                out.append(arg(self) if callable(arg) else self._applied(arg) if isinstance(arg, str) else arg)
            return out.append(kwargs)
        except SchemaError:
            raise
        except Exception as e:
            raise SchemaError(str(e)) from e

    def _applied(self, text: str) -> Schema:
        depth, steps = 0, []
        for at, sign in search_unquoted(text, "-~+()"):  # signs inside parentheses belong to a type
            depth += (sign == "(") - (sign == ")")
            if sign in "-~+" and not depth:
                steps.append(at)
        steps.append(len(text))
        out = Schema(replace_unquoted(text[: steps[0]], "*", repr(self)))
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            rest = text[a + 1 : b]
            if text[a] == "+":
                new = Schema(rest)
                out = Schema([(n, new._types.get(n, t)) for n, t in out.items()]).union_with(new)
            else:
                names = list(split_names(rest, on_empty="ignore"))
                out = out.exclude(names) if text[a] == "~" else out - names
        return out

    # tables
    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.spark)

    def empty_arrow(self) -> pa.Table:
        return self.arrow.empty_table()

    def empty_pandas(self, extension: bool = False, arrow: bool = False) -> Any:
        import pandas as pd

        return pd.DataFrame({n: pd.Series(dtype=d) for n, d in self.pandas_dtypes(extension, arrow).items()})


def schemas_equal(a: Any, b: Any, check_order: bool = True, check_metadata: bool = True, ignore: list[tuple[Any, Any]] | None = None) -> bool:
    """Equality of two schemas, after the replacements (type or test, new type) of ignore if there are any."""
    from weftline.functions.types import replace_type

    left, right = Schema(a), Schema(b)
    for old, new in ignore or []:
        left, right = (Schema([(n, replace_type(t, old, new)) for n, t in s.items()]) for s in (left, right))
    x, y = left.items(), right.items()
    if check_metadata and isinstance(a, T.StructType) and isinstance(b, T.StructType):
        kept = [{f.name: {k: v for k, v in f.metadata.items() if k != METADATA_KEY} for f in s} for s in (a, b)]
        if kept[0] != kept[1]:
            return False
    return x == y if check_order else dict(x) == dict(y)
