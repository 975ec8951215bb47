"""Deterministic ids of Python values and of columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_ROOT = uuid.uuid5(uuid.NAMESPACE_DNS, "")


def to_uuid(*values: Any) -> str:
    """A chain of name-based ids over the values in order. Type and order count; iterables are taken apart, and objects
    with __uuid__ give their own."""
    out = _ROOT
    for text in _texts(values):
        out = uuid.uuid5(out, text)
    return str(out)


def _texts(value: Any) -> Iterator[str]:
    if value is None:
        yield ""
    elif hasattr(value, "__uuid__"):
        yield value.__uuid__()
    elif isinstance(value, (str, bytes)):
        yield f"{type(value).__name__}:{value!r}"
    elif isinstance(value, dict):
        yield "{"
        for k, v in value.items():
            yield from _texts(k)
            yield from _texts(v)
        yield "}"
    elif isinstance(value, Iterable):
        yield "("
        for v in value:
            yield from _texts(v)
        yield ")"
    else:
        yield f"{type(value).__name__}:{value!r}"


def uuid5_column(namespace: uuid.UUID, text: Column) -> Column:
    """uuid5 of a column's text in a namespace, without leaving the JVM."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), text.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
