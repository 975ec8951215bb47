"""Scalar conversions of options, lookups by name and assertions: all on the driver."""

from __future__ import annotations

import datetime as dt
import importlib
import inspect
import math
import re
import typing
from collections.abc import Callable
from typing import Any

from weftline.errors import NoneArgumentError

NAN, INF, NEGATIVE_INF = float("nan"), float("inf"), float("-inf")

#: Fixed values.
_TRUE, _FALSE = {"true", "yes", "1"}, {"false", "no", "0"}
_SIZES = {"": 0, "b": 0, "k": 1, "kb": 1, "m": 2, "mb": 2, "g": 3, "gb": 3, "t": 4, "tb": 4, "p": 5, "pb": 5, "e": 6, "eb": 6}
_SPANS = {"d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}


def assert_or_throw(condition: bool, error: Any = None) -> None:
    """Raises if the condition is false: an exception, one made by a function, or an AssertionError with a text."""
    if condition:
        return
    if callable(error) and not (inspect.isclass(error) and issubclass(error, Exception)):
        error = error()
    if isinstance(error, Exception) or (inspect.isclass(error) and issubclass(error, Exception)):
        raise error
    raise AssertionError(*([] if error is None else [str(error)]))


def assert_not_none(value: Any, name: str = "", message: str = "") -> None:
    if value is None:
        raise NoneArgumentError(message or f"{name} can't be None")


def to_bool(value: Any) -> bool:
    if isinstance(value, bool):
        return value
    text = str(value).lower()
    if value is None or text not in _TRUE | _FALSE:
        raise TypeError(f"{value!r} is no truth value")
    return text in _TRUE


def to_datetime(value: Any) -> dt.datetime:
    """Of ISO text, dates and times; numbers are a TypeError."""
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    if isinstance(value, str):
        try:
            return dt.datetime.fromisoformat(value.strip())
        except ValueError:
            import pandas as pd

            return pd.to_datetime(value).to_pydatetime()
    raise TypeError(f"{value!r} is no time")


def to_timedelta(value: Any) -> dt.timedelta:
    """Of numbers of seconds, times as text (`2d1m`, `01:02:03`), min, max and inf."""
    if isinstance(value, dt.timedelta):
        return value
    if value is None:
        raise TypeError("None is no span")
    if isinstance(value, str):
        text = value.strip().lower()
        if text in ("min", "-inf"):
            return dt.timedelta.min
        if text in ("max", "inf"):
            return dt.timedelta.max
        if re.fullmatch(r"(\d+(\.\d+)?\s*(d|h|ms|us|ns|m|s)\s*)+", text):
            return dt.timedelta(seconds=sum(float(n) * _SPANS[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)\s*(d|h|ms|us|ns|m|s)", text)))
        try:
            value = float(text)
        except ValueError:
            import pandas as pd

            return pd.to_timedelta(text).to_pytimedelta()
    if math.isinf(value):
        return dt.timedelta.max if value > 0 else dt.timedelta.min
    return dt.timedelta(seconds=float(value))


def to_size(value: Any) -> int:
    """Bytes of a number or of text such as `1.1 mb`; steps of 1024."""
    assert_not_none(value, "value")
    m = re.fullmatch(r"\s*(-?[0-9.]+(?:e[+-]?\d+)?)\s*([a-z]*)\s*", str(value).lower())
    if not m or m[2] not in _SIZES:
        raise ValueError(f"{value!r} is no size")
    size = float(m[1]) * 1024 ** _SIZES[m[2]]
    assert_or_throw(size >= 0, lambda: AssertionError(f"{value!r} is negative"))
    return int(size)


def as_type(value: Any, kind: type) -> Any:
    special = {bool: to_bool, dt.datetime: to_datetime, dt.timedelta: to_timedelta}
    if type(value) is kind:
        return value
    return special[kind](value) if kind in special else kind(value)


def caller_variables(start: int = 1) -> tuple[dict[str, Any], dict[str, Any]]:
    """Globals and locals of a calling frame."""
    frame = inspect.currentframe()
    for _ in range(start + 1):
        frame = frame.f_back
    return frame.f_globals, frame.f_locals


def to_object(text: str, variables: dict[str, Any] | None = None) -> Any:
    """What a dotted name stands for: a variable's attribute, a builtin or something in a module. Nothing is evaluated."""
    parts = text.strip().split(".")
    if not all(p.isidentifier() for p in parts):
        raise ValueError(f"{text} is no dotted name")
    scope = {**vars(importlib.import_module("builtins")), **(variables or {})}
    if parts[0] in scope:
        found, rest = scope[parts[0]], parts[1:]
    else:
        for n in range(len(parts) - 1, 0, -1):
            try:
                found, rest = importlib.import_module(".".join(parts[:n])), parts[n:]
                break
            except ImportError:
                continue
        else:
            raise ValueError(f"{text} is unknown")
    for p in rest:
        if not hasattr(found, p):
            raise ValueError(f"{text} is unknown")
        found = getattr(found, p)
    return found


def _below(base: type) -> list[type]:
    return [c for s in base.__subclasses__() for c in (s, *_below(s))]


def to_class(value: Any, base: type | None = None, variables: dict[str, Any] | None = None) -> type:
    """A class of a class or a name, which may be that of a subclass of base; it must extend base."""
    if isinstance(value, str):
        near = [c for c in _below(base) if c.__name__ == value] if base and "." not in value else []
        value = near[0] if near else to_object(value, variables)
    if not inspect.isclass(value) or (base is not None and not issubclass(value, base)):
        raise TypeError(f"{value!r} is no {base or 'class'}")
    return value


def to_instance(value: Any, base: type | None = None, args: tuple = (), kwargs: dict | None = None) -> Any:
    """An instance of a class or name, made with the arguments; an instance is taken as it is, without arguments."""
    if isinstance(value, str) or inspect.isclass(value):
        return to_class(value, base)(*args, **(kwargs or {}))
    if args or kwargs or (base is not None and not isinstance(value, base)):
        raise TypeError(f"{value!r} is an instance")
    return value


def to_function(value: Any, variables: dict[str, Any] | None = None) -> Callable:
    if isinstance(value, str):
        value = to_object(value, variables)
    if inspect.isclass(value) or not callable(value):
        raise AttributeError(f"{value!r} is no function")
    return value


def full_path(value: Any) -> str:
    """Module and name of a class, function or an instance's class; lambdas have none."""
    if value is None:
        raise TypeError("None has no path")
    named = value if hasattr(value, "__qualname__") else type(value)
    if named.__name__ == "<lambda>":
        raise TypeError("a lambda has no path")
    return f"{named.__module__}.{named.__qualname__}"


def same_annotation(a: Any, b: Any, by_origin: bool = True) -> bool:
    """Whether two annotations are equal; by origin, List[int] and list[int] are."""
    if a == b:
        return True
    if not by_origin or typing.get_origin(a) is None or typing.get_origin(b) is None:
        return False
    x, y = typing.get_args(a), typing.get_args(b)
    return typing.get_origin(a) is typing.get_origin(b) and len(x) == len(y) and all(map(same_annotation, x, y))
