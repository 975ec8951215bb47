"""Python values to a type's native values, for rows that are not in a DataFrame yet."""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Callable
from typing import Any

from weftline.functions.scalars import to_bool, to_datetime
from weftline.functions.types import Type


def _missing(v: Any) -> bool:
    import pandas as pd

    return v is None or v is pd.NaT or v is pd.NA


def _nan(v: Any) -> bool:
    return isinstance(v, float) and math.isnan(v)


def _integer(v: Any) -> int | None:
    return None if _nan(v) else int(v)


def _floating(v: Any) -> float | None:
    return None if math.isnan(out := float(v)) else out


def _truth(v: Any) -> bool | None:
    return None if _nan(v) else to_bool(v)


def _time(v: Any) -> dt.datetime:
    out = to_datetime(v)
    return out.to_pydatetime() if hasattr(out, "to_pydatetime") else out


def _day(v: Any) -> dt.date:
    return v if type(v) is dt.date else _time(v).date()


def _bytes(v: Any) -> bytes:
    if not isinstance(v, (bytes, bytearray)):
        raise TypeError(f"{v!r} is not bytes")
    return bytes(v)


_PLAIN: dict[str, Callable[[Any], Any]] = {"null": lambda v: None, "str": str, "bool": _truth, "float": _floating, "double": _floating, "float16": _floating, "datetime": _time, "timestamp": _time, "date": _day, "bytes": _bytes}


def _loaded(v: Any, kind: type | tuple, text: bool = True) -> Any:
    v = json.loads(v) if text and isinstance(v, str) else v.tolist() if hasattr(v, "tolist") else v
    if not isinstance(v, kind):
        raise TypeError(f"{v!r} is not {kind}")
    return v


def converter(t: Type, deep: bool = True, text: bool = True) -> Callable[[Any], Any]:
    """None, NaT and NA are None; a map is a list of pairs. Unless deep, nested values are only held to be of their kind and stay as they
    are; with text, those that are text are read as JSON."""
    if t.kind != "plain" and not deep:
        kinds = {"list": (list,), "struct": (dict,), "map": (dict, list)}[t.kind]
        return lambda v: None if _missing(v) else _loaded(v, kinds, False)
    if t.kind == "list":
        item = converter(t.parts[0][1], deep, text)
        convert = lambda v: [item(x) for x in _loaded(v, (list, tuple), text)]
    elif t.kind == "struct":
        parts = {n: converter(p, deep, text) for n, p in t.parts}
        convert = lambda v: {n: f(d.get(n)) for d in [_loaded(v, dict, text)] for n, f in parts.items()}
    elif t.kind == "map":
        key, item = (converter(p, deep, text) for _, p in t.parts)

        def convert(v: Any) -> list[tuple]:
            v = _loaded(v, (dict, list, tuple), text)
            return [(key(a), item(b)) for a, b in (v.items() if isinstance(v, dict) else v)]

    elif t.name == "decimal":
        raise NotImplementedError("decimals have no row conversion")
    else:
        convert = _PLAIN.get(t.name, _integer)
    keeps_missing = t.name == "str"
    return lambda v: None if v is None or (not keeps_missing and _missing(v)) else convert(v)
