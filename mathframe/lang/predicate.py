"""Conditions: existence tests and comparisons joined by NOT, AND and OR (in any case).

``NOT`` binds tightest, ``OR`` loosest.  A bare name tests existence; the left side of a comparison is a
name, the right one a number or a name (there are no quotes: an unknown name is text).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from .tokens import Cursor


@dataclass(frozen=True)
class Test:
    """Is there a value, or, with a relation, does it hold against a number, name or text?"""

    name: str
    relation: str | None = None
    against: float | str | None = None


@dataclass(frozen=True)
class Every:
    """Holds where all parts hold; without parts everywhere."""

    parts: tuple = ()


@dataclass(frozen=True)
class Some:
    """Holds where any part holds; without parts nowhere."""

    parts: tuple = ()


@dataclass(frozen=True)
class Unless:
    """Holds where its part doesn't."""

    part: Any


# Comparison signs and reserved words.
_COMPARE = ("<=", ">=", "==", "!=", "<", ">")
_WORDS = ("not", "and", "or")


def _word(c: Cursor, word: str) -> bool:
    if c.now.kind == "name" and c.now.text.lower() == word:
        c.step()
        return True
    return False


def _joined(c: Cursor, word: str, part, whole) -> Any:
    parts = [part(c)]
    while _word(c, word):
        parts.append(part(c))
    return parts[0] if len(parts) == 1 else whole(tuple(parts))


def _either(c: Cursor) -> Any:
    return _joined(c, "or", _both, Some)


def _both(c: Cursor) -> Any:
    return _joined(c, "and", _negated, Every)


def _negated(c: Cursor) -> Any:
    return Unless(_negated(c)) if _word(c, "not") else _test(c)


def _test(c: Cursor) -> Any:
    if c.take("("):
        inner = _either(c)
        c.need(")")
        return inner
    token = c.step()
    if token.kind != "name" or token.text.lower() in _WORDS:
        raise SyntaxError(f"expected a name at {token.at}, found {token.text or 'the end'!r}")
    if token.text.lower() in ("true", "false"):
        return Every() if token.text.lower() == "true" else Some()
    if c.now.kind == "sign" and c.now.text in _COMPARE:
        return Test(token.text, c.step().text, _right_side(c))
    return Test(token.text)


def _right_side(c: Cursor) -> float | str:
    negative = c.take("-")
    token = c.step()
    if token.kind in ("integer", "real"):
        number = int(token.text) if token.kind == "integer" else float(token.text)
        return -number if negative else number
    if token.kind == "name" and not negative:
        return token.text
    raise SyntaxError(f"expected a number or name at {token.at}, found {token.text or 'the end'!r}")


@lru_cache(maxsize=4096)
def parse_where(text: str) -> Any:
    """The syntax tree of a condition; the whole text must be one."""
    try:
        c = Cursor(text)
        tree = _either(c)
        if c.now.kind != "end":
            raise SyntaxError(f"unexpected {c.now.text!r} at {c.now.at}")
    except SyntaxError as error:
        raise ValueError(f"Failed to parse where string {text!r}: {error}") from error
    return tree
