"""Variables, constraint rows and terms, and the objective, as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..document import Variable as Declared
from ..plans.conditions import Mask, masked_grid
from ..plans.grids import cell_number, full_grid, grid_size, ordinals, with_values
from ..sources.parameters import Param
from .linexpr import Const, Expr, Space, Terms


@dataclass(frozen=True)
class VariableBlock:
    """``cells``: ordinals and label of the cells that exist."""

    name: str
    dims: tuple[str, ...]
    base: int
    size: int
    cells: DataFrame
    table: DataFrame


def build_variable(space: Space, name: str, declared: Declared, params: dict[str, Param], mask: Mask | bool, base: int) -> VariableBlock:
    """A variable's cells with label, lower, upper and vtype.

    Labels are the cells' numbers in the full grid, so they don't depend on the mask and need no sort.
    """
    dims = tuple(declared.foreach)
    labelled = masked_grid(space.spark, space.master, dims, mask).select(*ordinals(dims), cell_number(space.master, dims, base).alias("label"))
    table = labelled
    for side in ("lower", "upper"):
        table = _with_bound(space, table, name, dims, side, 0.0 if side == "lower" else 1.0, declared, params)
    vtype = "binary" if declared.binary else "integer" if declared.integer else "continuous"
    return VariableBlock(name, dims, base, grid_size(space.master, dims), labelled, table.select(*ordinals(dims), "label", "lower", "upper", F.lit(vtype).alias("vtype")))


def _with_bound(space: Space, table: DataFrame, name: str, dims: tuple[str, ...], side: str, binary: float, declared: Declared, params: dict[str, Param]) -> DataFrame:
    given = binary if declared.binary else getattr(declared.bounds, side)
    if not isinstance(given, str):
        return table.withColumn(side, F.lit(float(given)))
    param = params[given]
    if param.number is not None:
        return table.withColumn(side, F.lit(float(param.number)))
    outside = sorted(set(param.dims) - set(dims))
    if outside:
        raise ValueError(f"Variable '{name}': bound '{given}' has dimensions {outside} that the variable lacks.")
    missing = F.raise_error(F.lit(f"Variable '{name}': the {side} bound '{given}' has no value at a cell of the variable.")).cast("double")
    held = param.table.select(*ordinals(param.dims), F.col("value").cast("double").alias(side))
    joined = table.join(held, ordinals(param.dims), "left") if param.dims else table.join(F.broadcast(held), F.lit(True), "left")  # one row
    return joined.withColumn(side, F.coalesce(side, missing))


@dataclass(frozen=True)
class ConstraintBlock:
    """One equation: ``rows`` (ordinals, row_id, sign, rhs) and ``terms`` (row_id, label, coeff)."""

    name: str
    dims: tuple[str, ...]
    rows: DataFrame
    terms: DataFrame


def _rhs(const: Const | None) -> float | None:
    """The right-hand side if it is one number."""
    return 0.0 if const is None else -const.number + 0.0 if const.number is not None else None


def build_constraint(space: Space, name: str, left: Expr, sign: str, right: Expr, mask: Mask | bool, base: int) -> tuple[ConstraintBlock, int]:
    """Variables to the left, constants to the right; also the number of row ids used.

    Rows are the cells of both sides' dimensions where the mask holds and the constant exists.  The rows
    are restricted before terms are spread over them; a row's terms of one variable cell are added up.
    """
    e = left - right
    if not e.terms:
        raise ValueError(f"Constraint '{name}' has no variable.")
    dims = e.dims
    number = _rhs(e.const)
    row_id = cell_number(space.master, dims, base).alias("row_id")
    everywhere = mask is True and number is not None
    if number is not None:
        grid = masked_grid(space.spark, space.master, dims, mask)
        rows = grid.select(*ordinals(dims), row_id, F.lit(sign).alias("sign"), F.lit(number).alias("rhs"))
    else:
        held = e.const.table.withColumnRenamed("value", "held")
        if isinstance(mask, Mask) or mask is False:
            grid = masked_grid(space.spark, space.master, dims, mask)
            grid = grid.join(held, ordinals(e.const.dims)) if e.const.dims else grid.crossJoin(F.broadcast(held))  # one row
        elif set(e.const.dims) == set(dims):
            grid = held
        else:
            from ..plans.grids import extended

            grid = extended(held, space.master, [d for d in dims if d not in e.const.dims])
        rows = grid.select(*ordinals(dims), row_id, F.lit(sign).alias("sign"), (F.lit(0.0) - F.col("held")).alias("rhs"))
    parts = []
    for t in e.terms:
        if everywhere and set(t.dims) == set(dims):
            parts.append(t.table.select(row_id, "label", "coeff"))  # every cell is a row: its number is arithmetic
        elif t.dims:
            parts.append(rows.select(*ordinals(dims), "row_id").join(t.table, ordinals(t.dims)).select("row_id", "label", "coeff"))
        else:
            parts.append(rows.select("row_id").crossJoin(_added_up((t,), [t.table], "label")).select("row_id", "label", "coeff"))
    return ConstraintBlock(name, dims, rows, _added_up(e.terms, parts, "row_id", "label")), grid_size(space.master, dims)


def _added_up(terms: tuple[Terms, ...], parts: list[DataFrame], *keys: str) -> DataFrame:
    """The parts' coefficients by ``keys``; there is nothing to add up if each part is unique and of another variable."""
    stacked = parts[0].select(*keys, "coeff")
    for p in parts[1:]:
        stacked = stacked.unionByName(p.select(*keys, "coeff"))
    if all(t.unique for t in terms) and len({t.source for t in terms}) == len(terms):
        return stacked
    return stacked.groupBy(*keys).agg(F.sum("coeff").alias("coeff"))


@dataclass(frozen=True)
class ObjectiveBlock:
    """``terms`` (label, coeff) and ``offset`` (one row, value)."""

    name: str
    sense: str
    terms: DataFrame
    offset: DataFrame


def build_objective(space: Space, name: str, e: Expr, sense: str) -> ObjectiveBlock:
    """The objective with all remaining dimensions summed out."""
    for d in e.dims:
        e = e.sum(d)
    spark = space.spark
    empty = spark.createDataFrame([], "label bigint, coeff double")
    terms = _added_up(e.terms, [t.table for t in e.terms], "label") if e.terms else empty
    c = e.const
    if c is None or c.number is not None:
        offset = spark.range(1).select(F.lit(0.0 if c is None else c.number).alias("value"))
    else:
        offset = c.table.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
    return ObjectiveBlock(name, {"minimize": "min", "maximize": "max"}[sense], terms, offset)


def coordinates(space: Space, table: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """The table with coordinate values in place of ordinals."""
    return with_values(table, space.master, dims).drop(*ordinals(dims))


def dense(space: Space, e: Expr) -> DataFrame:
    """All cells of an expression without variables; missing ones are null."""
    if e.terms:
        raise ValueError("the expression has variables")
    dims = e.dims
    grid = full_grid(space.spark, space.master, dims)
    held = e.const.cells(space)
    joined = grid.join(held, ordinals(dims), "left") if dims else held
    value: Column = F.col("value")
    return with_values(joined, space.master, dims).select(*dims, value)
