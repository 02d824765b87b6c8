"""Helpers that expressions may call.

A helper gets expressions as positional arguments; a keyword argument that is a bare name arrives as
text (the name of a dimension).  It runs once, on the driver, and only composes plans.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from ..operators.linexpr import Expr


def _sum(array: Any, *, over: str) -> Any:
    return array.sum(over) if isinstance(array, Expr) else array


def _roll(array: Any, **shift: Any) -> Any:
    if len(shift) != 1:
        raise TypeError(f"roll() takes exactly one keyword argument (dimension=shift), got {sorted(shift)}")
    if not isinstance(array, Expr) or array.is_number:
        raise TypeError("roll() does not support numbers")
    (dim, by) = next(iter(shift.items()))
    if isinstance(by, Expr):
        if not by.is_number:
            raise ValueError("roll(): the shift must be a number")
        by = by.const.number
    return array.roll(**{dim: int(by)})


_BUILT_IN: dict[str, Callable] = {"sum": _sum, "roll": _roll}
_OWN: dict[str, Callable] = {}


def register(name: str) -> Callable[[Callable], Callable]:
    """Decorator that makes a function callable in expressions; a later one replaces an earlier."""
    if name in _BUILT_IN:
        raise ValueError(f"'{name}' is a built-in helper and can't be registered; built-ins: {sorted(_BUILT_IN)}")

    def keep(function: Callable) -> Callable:
        _OWN[name] = function
        return function

    return keep


def get_helper(name: str) -> Callable:
    found = _BUILT_IN.get(name) or _OWN.get(name)
    if found is None:
        raise NameError(f"Unknown helper function '{name}'; available: {sorted({*_BUILT_IN, *_OWN})}. Register others with @register('{name}').")
    return found
