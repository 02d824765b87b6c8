"""Conditions as plans: which cells of a grid hold.

Missing values are two-valued: a comparison with one is False, ``!=`` is True, and NOT comes after that.
So a condition is evaluated on the dense grid of its dimensions, with the parameters joined from
the left, unless some part of it can only hold where a parameter is stored: then the grid is
enumerated from that parameter's rows and only the other dimensions are multiplied out.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.predicate import Every, Some, Test, Unless, parse_where
from ..sources.coords import Dim, ordinal, value_of
from ..sources.parameters import Param
from .grids import extended, full_grid, ordinals

_OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


@dataclass(frozen=True)
class Mask:
    """The cells, over ``dims``, where a condition holds; each cell has one row."""

    dims: tuple[str, ...]
    rows: DataFrame


class ConditionPlanner:
    def __init__(self, spark: SparkSession, params: Mapping[str, Param], master: Mapping[str, Dim]):
        self.spark, self.params, self.master = spark, params, master

    def plan(self, text: str | None) -> Mask | bool:
        """True (all cells), False (none), or a mask."""
        return True if text is None else self.plan_tree(parse_where(text))

    def plan_tree(self, tree: Any) -> Mask | bool:
        tree = self._folded(tree)
        if tree in (Every(), Some()):
            return tree == Every()
        dims = self._dims(tree)
        predicate = self._column(tree)
        leader = self._leader(tree)
        if leader is None:
            rows, missing = full_grid(self.spark, self.master, dims), ()
        else:
            stored = self.params[leader]
            rows = extended(stored.stored(self.master).withColumnRenamed("value", _value(leader)), self.master, [d for d in dims if d not in stored.dims])
            missing = (leader,)
        for name in self._names(tree):
            if name in self.params and name not in missing and self.params[name].number is None:
                param = self.params[name]
                held = param.table.withColumnRenamed("value", _value(name))
                rows = rows.join(held, ordinals(param.dims), "left") if param.dims else rows.join(F.broadcast(held), F.lit(True), "left")
        for name in self._names(tree):
            if name not in self.params:
                rows = rows.join(self.master[name].spread, ordinal(name))
        return Mask(dims, rows.where(predicate).select(*ordinals(dims)))

    # -- resolving names ---------------------------------------------------------------

    def _folded(self, tree: Any) -> Any:
        """The tree with everything decided that needs no cell."""
        if isinstance(tree, Unless):
            part = self._folded(tree.part)
            return {Every(): Some(), Some(): Every()}.get(part, Unless(part))
        if isinstance(tree, (Every, Some)):
            whole, other = type(tree), Some if isinstance(tree, Every) else Every
            parts = [self._folded(p) for p in tree.parts]
            if other() in parts:
                return other()
            parts = tuple(p for p in parts if p != whole())
            return parts[0] if len(parts) == 1 else whole(parts)
        return tree if tree.name in self.params or tree.name in self.master else Some()

    def _tests(self, tree: Any) -> list[Test]:
        """All tests of a tree, in order."""
        if isinstance(tree, Test):
            return [tree]
        return [t for part in ((tree.part,) if isinstance(tree, Unless) else tree.parts) for t in self._tests(part)]

    def _read(self, test: Test) -> list[str]:
        """Parameters and dimensions whose values a test needs; an existence test of a dimension needs none."""
        if test.relation is None:
            return [test.name] if test.name in self.params else []
        return [test.name, *([test.against] if test.against in self.params else [])]

    def _names(self, tree: Any) -> list[str]:
        return list(dict.fromkeys(n for t in self._tests(tree) for n in self._read(t)))

    def _dims(self, tree: Any) -> tuple[str, ...]:
        found = {d for n in self._names(tree) if n in self.params for d in self.params[n].dims}
        found |= {t.name for t in self._tests(tree) if t.name in self.master and t.name not in self.params}
        return tuple(d for d in self.master if d in found)

    def _leader(self, tree: Any) -> str | None:
        """The parameter with most dimensions without whose value the condition can't hold."""
        parts, needed = [tree], []
        while parts:
            part = parts.pop()
            if isinstance(part, Every):
                parts += reversed(part.parts)
            elif isinstance(part, Test) and part.relation != "!=":
                needed += [n for n in self._read(part) if n in self.params]
        needed = [n for n in needed if self.params[n].number is None]
        return max(needed, key=lambda n: len(self.params[n].dims), default=None)

    # -- columns -----------------------------------------------------------------------

    def _operand(self, name: str) -> tuple[Column, str]:
        if name in self.params:
            param = self.params[name]
            return (F.col(_value(name)) if param.number is None else F.lit(param.number)), param.dtype
        return value_of(name), self.master[name].dtype

    def _column(self, tree: Any) -> Column:
        """A condition that is never null."""
        if isinstance(tree, Unless):
            return ~self._column(tree.part)
        if isinstance(tree, (Every, Some)):
            return reduce(operator.and_ if isinstance(tree, Every) else operator.or_, map(self._column, tree.parts))
        return self._compared(tree) if tree.relation else self._there(tree.name)

    def _there(self, name: str) -> Column:
        if name not in self.params:
            return F.lit(True)
        value, dtype = self._operand(name)
        return F.coalesce(value.isNotNull() & (F.abs(value) < float("inf")), F.lit(False)) if dtype == "float" else value.isNotNull()

    def _compared(self, test: Test) -> Column:
        op = test.relation
        left, left_type = self._operand(test.name)
        if test.against in self.params:
            right, right_type = self._operand(test.against)
        else:
            right, right_type = F.lit(test.against), "str" if isinstance(test.against, str) else "float"
        numbers = ("float", "int", "bool")
        if left_type != right_type and not (left_type in numbers and right_type in numbers):
            if op in ("==", "!="):
                return F.lit(op == "!=")
            raise TypeError(f"'{test.name} {op} {test.against}' compares {left_type} with {right_type}")
        if left_type != right_type and "bool" in (left_type, right_type):
            left, right = left.cast("double"), right.cast("double")
        return F.coalesce(_OPS[op](left, right), F.lit(op == "!="))


def _value(name: str) -> str:
    return f"v_{name}"


def both(a: Mask | bool, b: Mask | bool, master: Mapping[str, Dim]) -> Mask | bool:
    """Cells where both hold, over the dimensions of both."""
    if isinstance(a, bool) or isinstance(b, bool):
        constant, other = (a, b) if isinstance(a, bool) else (b, a)
        return other if constant else False
    dims = tuple(d for d in master if d in a.dims or d in b.dims)
    shared = [d for d in a.dims if d in b.dims]
    rows = a.rows.join(b.rows, ordinals(shared)) if shared else a.rows.crossJoin(b.rows)
    return Mask(dims, rows.select(*ordinals(dims)))


def masked_grid(spark: SparkSession, master: Mapping[str, Dim], dims: tuple[str, ...], mask: Mask | bool) -> DataFrame:
    """The cells of a grid that a mask keeps; dimensions that only the mask has are reduced by "any"."""
    if mask is False:
        return full_grid(spark, master, dims).where(F.lit(False))
    if mask is True:
        return full_grid(spark, master, dims)
    shared = [d for d in mask.dims if d in dims]
    rest = [d for d in dims if d not in shared]
    if not shared:
        some = mask.rows.limit(1).select(F.lit(1).alias("any"))  # one row at most
        return full_grid(spark, master, dims).crossJoin(F.broadcast(some)).select(*ordinals(dims))
    rows = mask.rows.select(*ordinals(shared))
    if len(shared) < len(mask.dims):
        rows = rows.distinct()
    return extended(rows, master, rest).select(*ordinals(dims))
