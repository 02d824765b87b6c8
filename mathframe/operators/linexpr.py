"""Linear expressions as sparse tables.

An expression is a sum of term pieces (ordinals, label, coeff) and at most one constant (ordinals, value).
Pieces keep the dimensions they have; an expression's dimensions are those of all its pieces,
and a piece holds for all values of those it lacks.  Adding expressions puts pieces side by side;
nothing is joined, grouped or multiplied out before a table is asked for.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, replace
from numbers import Real
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.grids import full_grid, ordinals
from ..sources.coords import Dim, ordinal
from ..sources.parameters import Param


class NotLinearError(ValueError):
    """A product or power of variables."""


@dataclass(frozen=True)
class Space:
    """What all expressions of a model share."""

    spark: SparkSession
    master: Mapping[str, Dim]

    def ordered(self, *dims: tuple[str, ...]) -> tuple[str, ...]:
        found = {d for group in dims for d in group}
        return tuple(d for d in self.master if d in found)


@dataclass(frozen=True)
class Terms:
    """Cells of one variable with coefficients.

    A label fixes the ordinals of the ``own`` dimensions.  While ``unique`` holds, no two rows have the same
    ordinals and label, so nothing has to be added up.
    """

    dims: tuple[str, ...]
    table: DataFrame
    source: str
    own: tuple[str, ...]
    unique: bool = True


@dataclass(frozen=True)
class Const:
    """``number`` everywhere, or the cells of ``table``; a cell without a row is missing."""

    dims: tuple[str, ...]
    number: float | None = None
    table: DataFrame | None = None

    def cells(self, space: Space) -> DataFrame:
        return self.table if self.table is not None else full_grid(space.spark, space.master, self.dims).withColumn("value", F.lit(float(self.number)))

    def map(self, change) -> Const:
        return replace(self, table=self.table.withColumn("value", change(F.col("value"))))


def _joined(left: DataFrame, left_dims, right: DataFrame, right_dims) -> DataFrame:
    """Cells aligned by the names of their dimensions."""
    shared = [d for d in left_dims if d in right_dims]
    return left.join(right, ordinals(shared)) if shared else left.crossJoin(right)


def _divide(a: Column, b: Column) -> Column:
    """IEEE division: x / 0 is infinite, 0 / 0 and infinite / infinite are missing."""
    by_zero = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf))
    out = F.when(a.isNull() | b.isNull(), F.lit(None)).when(b != 0, F.try_divide(a, b)).otherwise(by_zero)
    return F.nanvl(out.cast("double"), F.lit(None).cast("double"))


def _power(a: Column, b: Column) -> Column:
    return F.nanvl(F.pow(a, b), F.lit(None).cast("double"))


def _real(value: Column) -> Column:
    """A value, missing where it isn't a number (as inf - inf)."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


_COLUMNS = {"+": lambda a, b: _real(a + b), "-": lambda a, b: _real(a - b), "*": lambda a, b: _real(a * b), "/": _divide, "**": _power}


def _numbers(op: str, a: float, b: float) -> float:
    if op == "/":
        if b == 0:
            raise ZeroDivisionError(f"division of {a} by zero in an expression")
        return a / b
    if op == "**":
        power = float(a) ** b
        if isinstance(power, complex):
            raise ValueError(f"{a} ** {b} isn't a real number")
        return power
    return {"+": a + b, "-": a - b, "*": a * b}[op]


class Expr:
    """A linear expression; helpers get these and may use + - * / ** and ``sum``, ``roll``, ``dims``."""

    def __init__(self, space: Space, terms: tuple[Terms, ...] = (), const: Const | None = None):
        self.space, self.terms, self.const = space, terms, const

    # -- making ------------------------------------------------------------------------

    @staticmethod
    def of_number(space: Space, value: float) -> Expr:
        return Expr(space, const=Const((), number=float(value)))

    @staticmethod
    def of_param(space: Space, param: Param) -> Expr:
        if param.dtype == "str":
            raise TypeError(f"parameter '{param.name}' is text and can't be part of an expression")
        if param.number is not None:
            return Expr(space, const=Const(param.dims, number=float(param.number)))
        return Expr(space, const=Const(param.dims, table=param.table.withColumn("value", F.col("value").cast("double"))))

    @staticmethod
    def of_variable(space: Space, name: str, dims: tuple[str, ...], cells: DataFrame) -> Expr:
        return Expr(space, (Terms(dims, cells.select(*ordinals(dims), "label", F.lit(1.0).alias("coeff")), name, dims),))

    # -- properties --------------------------------------------------------------------

    @property
    def dims(self) -> tuple[str, ...]:
        return self.space.ordered(*(t.dims for t in self.terms), self.const.dims if self.const else ())

    @property
    def is_number(self) -> bool:
        """A plain number: no terms, no cells, no dimensions."""
        return not self.terms and self.const is not None and self.const.number is not None and not self.const.dims

    def _as_expr(self, other: Any) -> Expr:
        if isinstance(other, Expr):
            return other
        if isinstance(other, Real):
            return Expr.of_number(self.space, float(other))
        raise TypeError(f"an expression can't be combined with {type(other).__name__}")

    # -- arithmetic --------------------------------------------------------------------

    def _consts(self, op: str, a: Const, b: Const) -> Const:
        """Elementwise; missing where either side is."""
        dims = self.space.ordered(a.dims, b.dims)
        if op == "**" and b.number == 0:
            return Const(dims, number=1.0)  # whatever the base is, even if it is missing
        if a.number is not None and b.number is not None:
            if not dims:
                return Const((), number=_numbers(op, a.number, b.number))
            if not (op == "/" and b.number == 0) and not (op == "**" and a.number <= 0):
                return Const(dims, number=_numbers(op, a.number, b.number))
        change = _COLUMNS[op]
        if b.number is not None and set(b.dims) <= set(a.dims) and a.table is not None:
            table = a.table.withColumn("value", change(F.col("value"), F.lit(b.number)))
        elif a.number is not None and set(a.dims) <= set(b.dims) and b.table is not None:
            table = b.table.withColumn("value", change(F.lit(a.number), F.col("value")))
        else:
            left = a.cells(self.space).withColumnRenamed("value", "left_value")
            right = b.cells(self.space).withColumnRenamed("value", "right_value")
            table = _joined(left, a.dims, right, b.dims).select(*ordinals(dims), change(F.col("left_value"), F.col("right_value")).alias("value"))
        return Const(dims, table=table.where("value is not null"))

    def _add(self, other: Any, sign: int) -> Expr:
        other = self._as_expr(other)
        other_terms = other.terms if sign > 0 else (-other).terms
        if self.const is None or other.const is None:
            const = self.const if other.const is None else (other.const if sign > 0 else (-other).const)
        else:
            const = self._consts("+" if sign > 0 else "-", self.const, other.const)
        return Expr(self.space, self.terms + other_terms, const)

    def __add__(self, other: Any) -> Expr:
        return self._add(other, 1)

    def __radd__(self, other: Any) -> Expr:
        return self._as_expr(other)._add(self, 1)

    def __sub__(self, other: Any) -> Expr:
        return self._add(other, -1)

    def __rsub__(self, other: Any) -> Expr:
        return self._as_expr(other)._add(self, -1)

    def __pos__(self) -> Expr:
        return self

    def __neg__(self) -> Expr:
        terms = tuple(replace(t, table=t.table.withColumn("coeff", -F.col("coeff"))) for t in self.terms)
        const = self.const
        if const is not None:
            const = replace(const, number=-const.number) if const.number is not None else const.map(lambda v: -v)
        return Expr(self.space, terms, const)

    def _scaled(self, factor: Const, op: str) -> Expr:
        terms = []
        for t in self.terms:
            dims = self.space.ordered(t.dims, factor.dims)
            change = _COLUMNS[op]
            if factor.number is not None:
                table = t.table.withColumn("coeff", change(F.col("coeff"), F.lit(factor.number)))
                if set(factor.dims) - set(t.dims):
                    table = _joined(table, t.dims, full_grid(self.space.spark, self.space.master, factor.dims), factor.dims)
            else:
                table = _joined(t.table, t.dims, factor.table, factor.dims).withColumn("coeff", change(F.col("coeff"), F.col("value")))
            table = table.select(*ordinals(dims), "label", "coeff")
            terms.append(replace(t, dims=dims, table=table.where("coeff is not null") if op == "/" else table))
        return Expr(self.space, tuple(terms), None if self.const is None else self._consts(op, self.const, factor))

    def __mul__(self, other: Any) -> Expr:
        other = self._as_expr(other)
        if self.terms and other.terms:
            raise NotLinearError("a product of two expressions with variables isn't linear")
        if other.terms:
            return other._scaled(self.const, "*")
        return self._scaled(other.const, "*")

    __rmul__ = __mul__

    def __truediv__(self, other: Any) -> Expr:
        other = self._as_expr(other)
        if other.terms:
            raise NotLinearError("a division by an expression with variables isn't linear")
        return self._scaled(other.const, "/")

    def __rtruediv__(self, other: Any) -> Expr:
        return self._as_expr(other) / self

    def __pow__(self, other: Any) -> Expr:
        other = self._as_expr(other)
        if self.terms or other.terms:
            raise NotLinearError("a power of an expression with variables isn't linear")
        return Expr(self.space, const=self._consts("**", self.const, other.const))

    def __rpow__(self, other: Any) -> Expr:
        return self._as_expr(other) ** self

    # -- reductions and shifts ---------------------------------------------------------

    def sum(self, over: str) -> Expr:
        """Sum over a dimension; an expression without it stays as it is."""
        if over not in self.dims:
            return self
        size = self.space.master[over].size
        terms = []
        for t in self.terms:
            if over in t.dims:
                terms.append(replace(t, dims=tuple(d for d in t.dims if d != over), table=t.table.drop(ordinal(over)), unique=t.unique and over in t.own))
            else:  # the piece stands for each value of the dimension
                terms.append(replace(t, table=t.table.withColumn("coeff", F.col("coeff") * float(size))))
        return Expr(self.space, tuple(terms), self._summed(over, size))

    def _summed(self, over: str, size: int) -> Const | None:
        c = self.const
        if c is None:
            return None
        if over not in c.dims:
            return replace(c, number=c.number * size) if c.number is not None else c.map(lambda v: v * float(size))
        rest = tuple(d for d in c.dims if d != over)
        if c.number is not None:
            return Const(rest, number=c.number * size)
        # Missing cells are skipped; where all are missing the sum is 0, so the result is dense.
        if not rest:
            return Const((), table=c.table.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")))
        sums = c.table.groupBy(*ordinals(rest)).agg(F.sum("value").alias("value"))
        grid = full_grid(self.space.spark, self.space.master, rest)
        return Const(rest, table=grid.join(sums, ordinals(rest), "left").withColumn("value", F.coalesce("value", F.lit(0.0))))

    def roll(self, **shift: int) -> Expr:
        """Circular shift along one dimension: out[i] = in[i - n].  Ordinals are renumbered, nothing is sorted."""
        if len(shift) != 1:
            raise TypeError(f"roll() takes one dimension and its shift, got {sorted(shift)}")
        dim, by = next(iter(shift.items()))
        by = int(by)
        if dim not in self.dims:
            raise ValueError(f"roll(): the expression has no dimension '{dim}'")
        o, size = ordinal(dim), self.space.master[dim].size
        turned = lambda table: table.withColumn(o, F.pmod(F.col(o) + F.lit(by % max(1, size)), F.lit(max(1, size))).cast("int"))
        terms = tuple(replace(t, table=turned(t.table)) if dim in t.dims else t for t in self.terms)
        const = self.const
        if const is not None and const.table is not None and dim in const.dims:
            const = replace(const, table=turned(const.table))
        return Expr(self.space, terms, const)
