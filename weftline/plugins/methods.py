"""Methods attached to classes from outside, for a fluent interface over frames."""

from __future__ import annotations

import inspect
import typing
from collections.abc import Callable
from typing import Any

_open: dict[type, set[str]] = {}


def extensible_class(cls: type) -> type:
    """Lets extension_method attach methods to the class; its own methods are protected."""
    _open.setdefault(cls, set())
    return cls


def extension_method(func: Callable | None = None, class_type: type | None = None, name: str | None = None, on_dup: str = "error") -> Callable:
    """Attaches a function as a method. The class is given or the first parameter's annotation. A method attached before
    is an error, left (ignore) or replaced (overwrite); the class's own are always protected."""

    def attach(f: Callable) -> Callable:
        cls = class_type or _first_type(f)
        method = name or f.__name__
        if cls not in _open:
            raise ValueError(f"{cls} is not extensible")
        if method not in _open[cls] and hasattr(cls, method):
            raise ValueError(f"{method} is {cls.__name__}'s own")
        if method in _open[cls]:
            if on_dup == "ignore":
                return f
            if on_dup != "overwrite":
                raise ValueError(f"{cls.__name__} has {method} already" if on_dup == "error" else f"on_dup can't be {on_dup}")
        _open[cls].add(method)
        setattr(cls, method, f)
        return f

    return attach if func is None else attach(func)


def _first_type(f: Callable) -> Any:
    first = next(iter(inspect.signature(f).parameters), None)
    found = typing.get_type_hints(f).get(first)
    if not inspect.isclass(found):
        raise ValueError(f"{f} names no class first")
    return found
