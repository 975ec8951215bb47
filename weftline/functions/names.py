"""Identifiers, backtick quoting and name normalisation.

Quoting is Spark SQL's: a backtick inside a quoted name is doubled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import Any

QUOTE = "`"

_PLAIN = re.compile(r"(?!_+\Z)[A-Za-z_][A-Za-z0-9_]*\Z")


def is_plain_name(name: str) -> bool:
    """An ASCII identifier that is more than underscores: a name that needs no quotes."""
    return isinstance(name, str) and _PLAIN.match(name) is not None


def assert_plain_name(name: str) -> str:
    if not is_plain_name(name):
        raise ValueError(f"{name!r} is not a plain name")
    return name


def quote_name(name: str, quote: str = QUOTE) -> str:
    return name if is_plain_name(name) else quote + name.replace(quote, quote * 2) + quote


def unquote_name(name: str, quote: str = QUOTE) -> str:
    """The inner text of a quoted name; other names are trimmed and must not be empty."""
    if len(name) > 1 and name.startswith(quote) and name.endswith(quote):
        return name[1:-1].replace(quote * 2, quote)
    if not (trimmed := name.strip()):
        raise ValueError("an empty name must be quoted")
    return trimmed


@cache
def _quoted_part(quote: str) -> re.Pattern:
    q = re.escape(quote)
    return re.compile(f"{q}(?:[^{q}]|{q}{q})*{q}(?!{q})|[^{q}]+|{q}", re.S)


def quoted_parts(text: str, quote: str = QUOTE) -> Iterator[tuple[bool, int, int]]:
    """(is quoted, start, end) of the parts of a text; an open quote is a SyntaxError."""
    for m in _quoted_part(quote).finditer(text):
        if m[0] == quote:
            raise SyntaxError(f"{text} has an open quote {quote}")
        yield m[0][0] == quote, m.start(), m.end()


def end_of_quoted(text: str, start: int, quote: str = QUOTE) -> int:
    """The position after the quoted part that begins at start."""
    m = _quoted_part(quote).match(text, start)
    if not m or len(m[0]) < 2:
        raise SyntaxError(f"{text} has an open quote {quote}")
    return m.end()


def search_unquoted(text: str, signs: str, quote: str = QUOTE) -> Iterator[tuple[int, str]]:
    """(position, sign) of each of the signs outside quotes."""
    for quoted, start, end in quoted_parts(text, quote):
        if not quoted:
            yield from ((i, text[i]) for i in range(start, end) if text[i] in signs)


def replace_unquoted(text: str, find: str, new: str, quote: str = QUOTE) -> str:
    return "".join(text[a:b] if quoted else text[a:b].replace(find, new) for quoted, a, b in quoted_parts(text, quote))


def split_unquoted(text: str, delimiters: str, max_split: int = -1, quote: str = QUOTE) -> Iterator[str]:
    """Parts of a text between delimiters outside quotes; at most max_split cuts if that is not negative."""
    start = 0
    for n, (at, _) in enumerate(search_unquoted(text, delimiters, quote)):
        if 0 <= max_split <= n:
            break
        yield text[start:at]
        start = at + 1
    yield text[start:]


def split_names(text: str, delimiters: str = ",", max_split: int = -1, on_empty: str = "keep", quote: str = QUOTE) -> Iterator[str]:
    """Unquoted names between delimiters. Empty parts without quotes are kept, ignored or refused (throw)."""
    if on_empty not in ("keep", "ignore", "throw"):
        raise ValueError(f"on_empty can't be {on_empty}")
    for part in split_unquoted(text, delimiters, max_split, quote):
        part = part.strip()
        if part:
            yield unquote_name(part, quote)
        elif on_empty == "throw":
            raise ValueError(f"{text} has an empty part")
        elif on_empty == "keep":
            yield part


def normalize_names(names: list[Any]) -> dict[Any, str]:
    """New names for those that are not plain; the others are not in the result.

    Signs become underscores and a leading digit gets one. Names that would repeat get _1, _2 and so on, and a name of
    which nothing is left is _1 and on.
    """
    if not names:
        raise ValueError("no names")
    if len(set(names)) < len(names):
        raise ValueError(f"repeated names in {names}")
    taken = {n for n in names if is_plain_name(n)}
    uses: dict[str, int] = {"": 1, **dict.fromkeys(taken, 1)}
    out = {}
    for name in names:
        if name in taken:
            continue
        new = "" if name is None else re.sub(r"[^A-Za-z0-9_]", "_", str(name).strip())
        new = f"_{new}" if new[:1].isdigit() else new
        last, new = None, new if is_plain_name(new) else ""
        while uses.get(new):  # a name in use gets the number of its uses
            last, new = new, f"{new}_{uses[new]}"
        if last is not None:
            uses[last] += 1
        uses[new] = 1
        out[name] = new
    return out
