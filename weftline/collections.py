"""Ordered dictionaries with positional access and a read-only mode, and typed options."""

from __future__ import annotations

import copy
import json
from collections import OrderedDict
from typing import Any

from weftline.errors import InvalidOperationError
from weftline.functions.scalars import as_type
from weftline.operators.reslice import pairs_of


class IndexedDict(OrderedDict):
    """An ordered dict that can be read and written by position, and frozen. Copies are not frozen."""

    _frozen = False

    def _guard(self) -> None:
        if self._frozen:
            raise InvalidOperationError("the dict is read-only")

    @property
    def readonly(self) -> bool:
        return self._frozen

    def set_readonly(self) -> None:
        self._frozen = True

    def index_of_key(self, key: Any) -> int:
        for i, k in enumerate(self):
            if k == key:
                return i
        raise KeyError(key)

    def get_item_by_index(self, index: int) -> tuple[Any, Any]:
        return list(self.items())[index]

    def get_key_by_index(self, index: int) -> Any:
        return self.get_item_by_index(index)[0]

    def get_value_by_index(self, index: int) -> Any:
        return self.get_item_by_index(index)[1]

    def set_value_by_index(self, index: int, value: Any) -> None:
        self[self.get_key_by_index(index)] = value

    def pop_by_index(self, index: int) -> tuple[Any, Any]:
        key, value = self.get_item_by_index(index)
        del self[key]
        return key, value

    def equals(self, other: dict, with_order: bool) -> bool:
        return list(self.items()) == list(other.items()) if with_order else dict(self) == dict(other)

    def __setitem__(self, key: Any, value: Any) -> None:
        self._guard()
        super().__setitem__(key, value)

    def __delitem__(self, key: Any) -> None:
        self._guard()
        super().__delitem__(key)

    def clear(self) -> None:
        self._guard()
        super().clear()

    def pop(self, *args: Any) -> Any:
        self._guard()
        return super().pop(*args)

    def popitem(self, last: bool = True) -> tuple[Any, Any]:
        self._guard()
        return super().popitem(last)

    def move_to_end(self, key: Any, last: bool = True) -> None:
        self._guard()
        super().move_to_end(key, last)

    def __copy__(self) -> IndexedDict:
        new = type(self)()
        for k, v in self.items():
            new[k] = v
        return new

    copy = __copy__

    def __deepcopy__(self, memo: dict) -> IndexedDict:
        new = type(self)()
        for k, v in self.items():
            new[copy.deepcopy(k, memo)] = copy.deepcopy(v, memo)
        return new


class Options(IndexedDict):
    """Options by text keys, read with a type; integers read by position."""

    OVERWRITE, THROW, IGNORE = 0, 1, 2

    def __init__(self, data: Any = None, deep: bool = True):
        super().__init__()
        self.update(data, deep=deep)

    def __setitem__(self, key: str, value: Any) -> None:
        if not isinstance(key, str):
            raise ValueError(f"{key!r} is no text")
        super().__setitem__(key, value)

    def __getitem__(self, key: str | int) -> Any:
        return self.get_value_by_index(key) if isinstance(key, int) else super().__getitem__(key)

    def get(self, key: str | int, default: Any) -> Any:
        """The value as the default's type, or the default."""
        if default is None:
            raise ValueError("a default is needed; see get_or_none")
        return as_type(self[key], type(default)) if key in self or isinstance(key, int) else default

    def get_or_none(self, key: str, kind: type) -> Any:
        return as_type(self[key], kind) if self.__contains__(key) and self[key] is not None else None

    def get_or_throw(self, key: str, kind: type) -> Any:
        if key not in self:
            raise KeyError(key)
        return as_type(self[key], kind)

    def update(self, other: Any, on_dup: int = 0, deep: bool = True) -> Options:
        """Takes pairs; repeated keys are overwritten, refused (THROW) or left (IGNORE)."""
        self._guard()
        if on_dup not in (self.OVERWRITE, self.THROW, self.IGNORE):
            raise ValueError(f"on_dup can't be {on_dup}")
        for k, v in pairs_of(other):
            if k in self and on_dup == self.THROW:
                raise KeyError(f"{k} is there already")
            if k not in self or on_dup == self.OVERWRITE:
                self[k] = copy.deepcopy(v) if deep else v
        return self

    def to_json(self, indent: bool = False) -> str:
        return json.dumps(self, indent=4 if indent else None)


def load_json(text: str) -> Any:
    """JSON in which a repeated key is a KeyError."""

    def unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise KeyError(f"repeated key in {[k for k, _ in pairs]}")
        return out

    return json.loads(text, object_pairs_hook=unique)
