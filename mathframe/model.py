"""Models: documents and data compiled to tables."""

from __future__ import annotations

import operator
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .document import MathSchema, read_document
from .functions.registry import get_helper
from .lang.expression import Program, parse_expression
from .lang.predicate import parse_where
from .operators.assemble import ConstraintBlock, ObjectiveBlock, VariableBlock, build_constraint, build_objective, build_variable, coordinates, dense
from .operators.linexpr import Expr, Space
from .plans.conditions import ConditionPlanner, Mask, both, masked_grid
from .plans.grids import full_grid, ordinals, with_values
from .sources.coords import Dim, build_master_coords
from .sources.parameters import Param, load_parameters

_APPLY = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "**": operator.pow}
# Signs of constraints.
_SIGNS = {"==": "=", "<=": "<=", ">=": ">="}


@dataclass
class _State:
    schema: MathSchema
    master: dict[str, Dim]
    params: dict[str, Param]
    variables: dict[str, VariableBlock] = field(default_factory=dict)
    constraints: dict[str, ConstraintBlock] = field(default_factory=dict)
    objective: ObjectiveBlock | None = None
    labels: int = 0
    row_ids: int = 0


class YamlAccessor:
    """What a model keeps of the document it was built from."""

    def __init__(self, model: Model, schema: MathSchema):
        self._model, self._schema = model, schema

    @property
    def schema(self) -> MathSchema:
        """The document of from_yaml(); extend() doesn't change it."""
        return self._schema

    @property
    def dataset(self) -> dict[str, DataFrame]:
        """Parameters by name, as dense tables of coordinates and value."""
        state = self._model._state
        return {name: p.dense(state.master) if p.dims else p.stored(state.master) for name, p in state.params.items()}

    @property
    def coords(self) -> dict[str, Dim]:
        return dict(self._model._state.master)

    def extend(self, source: str | Path | Mapping, *, data: Mapping[str, Any] | None = None, coords: Mapping[str, Any] | None = None) -> None:
        """Add another document; it may use what is declared already.  If it fails, nothing changes."""
        self._model._extend(source, data, coords)


class Model:
    """An optimisation model.  Plans are made at once, tables are computed when they are used."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark
        self._state: _State | None = None
        self._accessor: YamlAccessor | None = None
        self._check_tables = True

    @classmethod
    def from_yaml(cls, spark: SparkSession, source: str | Path | Mapping, *, data: Mapping[str, Any] | None = None, coords: Mapping[str, Any] | None = None, check_tables: bool = True) -> Model:
        """Build a model from a document, parameter values and coordinates.

        ``check_tables=False`` leaves out the search for strange coordinates in Spark tables, which reads them once;
        rows with such coordinates are then left out.
        """
        model = cls(spark)
        model._check_tables = check_tables
        schema = MathSchema.model_validate(read_document(source))
        _parse_all(schema)
        master = build_master_coords(spark, schema, coords)
        params = load_parameters(spark, schema, data, master, check_tables=check_tables)
        model._state = _Builder(spark, _State(schema, master, params)).add(schema)
        model._accessor = YamlAccessor(model, schema)
        return model

    def _extend(self, source: str | Path | Mapping, data: Mapping[str, Any] | None, coords: Mapping[str, Any] | None) -> None:
        old = self._state
        schema = MathSchema.model_validate(read_document(source), known=old.schema)
        _parse_all(schema)
        master = build_master_coords(self.spark, schema, coords, existing=old.master)
        fresh = MathSchema(schema.dimensions, {n: p for n, p in schema.parameters.items() if n not in old.params}, schema.variables, schema.constraints, schema.objectives)
        given = {n: v for n, v in (data or {}).items() if n not in old.params or n not in schema.parameters}
        params = load_parameters(self.spark, fresh, given, master, check_tables=self._check_tables)
        clash = sorted((set(schema.variables) & set(old.variables)) | (set(schema.constraints) & set(old.schema.constraints)))
        if clash:
            raise ValueError(f"names that the model has already: {clash}")
        state = _State(old.schema.merged(schema), master, params | old.params, dict(old.variables), dict(old.constraints), old.objective, old.labels, old.row_ids)
        self._state = _Builder(self.spark, state).add(schema)

    @property
    def yaml(self) -> YamlAccessor:
        if self._accessor is None:
            raise AttributeError("this model was not built from YAML")
        return self._accessor

    # -- tables ------------------------------------------------------------------------

    @property
    def _space(self) -> Space:
        return Space(self.spark, self._state.master)

    @property
    def variables(self) -> dict[str, VariableBlock]:
        return dict(self._state.variables) if self._state else {}

    @property
    def constraints(self) -> dict[str, ConstraintBlock]:
        return dict(self._state.constraints) if self._state else {}

    @property
    def objective(self) -> ObjectiveBlock | None:
        return self._state.objective if self._state else None

    def dimension(self, name: str) -> DataFrame:
        return self._state.master[name].table

    def parameter(self, name: str) -> DataFrame:
        """A parameter's cells that have a value, by coordinates."""
        param = self._state.params[name]
        return with_values(param.stored(self._state.master), self._state.master, param.dims).select(*param.dims, "value")

    def parameter_dense(self, name: str) -> DataFrame:
        """All cells of a parameter, by coordinates; missing ones are null."""
        return self._state.params[name].dense(self._state.master)

    def variable(self, name: str, *, labels_only: bool = False) -> DataFrame:
        """A variable's cells by coordinates, with label, lower, upper and vtype."""
        block = self._state.variables[name]
        return coordinates(self._space, block.cells if labels_only else block.table, block.dims)

    def constraint_rows(self, name: str, *, counted: bool = False) -> DataFrame:
        """An equation's rows by coordinates: row_id, sign, rhs; ``counted`` adds n_terms (0 if a row has none)."""
        block = self._state.constraints[name]
        rows = block.rows
        if counted:
            counts = block.terms.groupBy("row_id").agg(F.count("*").alias("n_terms"))
            rows = rows.join(counts, "row_id", "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0).cast("bigint")))
        return coordinates(self._space, rows, block.dims)

    def constraint_terms(self, name: str) -> DataFrame:
        return self._state.constraints[name].terms

    def all_rows(self) -> DataFrame:
        """Rows of all equations: name, row_id, sign, rhs."""
        return _stacked(self.spark, [b.rows.select(F.lit(b.name).alias("name"), "row_id", "sign", "rhs") for b in self.constraints.values()], "name string, row_id bigint, sign string, rhs double")

    def all_terms(self) -> DataFrame:
        """The coefficient matrix: row_id, label, coeff."""
        return _stacked(self.spark, [b.terms for b in self.constraints.values()], "row_id bigint, label bigint, coeff double")

    def all_variables(self) -> DataFrame:
        """Cells of all variables: name, label, lower, upper, vtype."""
        return _stacked(self.spark, [b.table.select(F.lit(b.name).alias("name"), "label", "lower", "upper", "vtype") for b in self.variables.values()], "name string, label bigint, lower double, upper double, vtype string")

    def objective_terms(self) -> DataFrame:
        if self.objective is None:
            raise ValueError("the model has no objective")
        return self.objective.terms

    def evaluate(self, expression: str) -> DataFrame:
        """All cells of an expression of parameters, by coordinates; missing ones are null."""
        formula = parse_expression(expression)
        if formula.relation is not None:
            raise TypeError(f"a comparison has no value: {expression!r}")
        return dense(self._space, _Builder(self.spark, self._state).evaluated(formula.sides[0]))

    def mask(self, where: str | None, dims: tuple[str, ...] | None = None) -> DataFrame:
        """Cells of a condition by coordinates, with ``keep``: of its own dimensions, or of ``dims``."""
        planner = ConditionPlanner(self.spark, self._state.params, self._state.master)
        found = planner.plan(where)
        own = found.dims if isinstance(found, Mask) else ()
        dims = own if dims is None else tuple(dims)
        if isinstance(found, bool):
            held = full_grid(self.spark, self._state.master, dims).withColumn("keep", F.lit(found))
        elif not dims:
            held = found.rows.agg((F.count("*") > 0).alias("keep"))
        else:
            kept = masked_grid(self.spark, self._state.master, dims, found).withColumn("keep", F.lit(True))
            grid = full_grid(self.spark, self._state.master, dims)
            held = grid.join(kept, ordinals(dims), "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
        return with_values(held, self._state.master, dims).select(*dims, "keep")

    def masked(self, where: str | None, dims: tuple[str, ...]) -> DataFrame:
        """Only the cells of ``dims`` that a condition keeps, by coordinates."""
        found = ConditionPlanner(self.spark, self._state.params, self._state.master).plan(where)
        return with_values(masked_grid(self.spark, self._state.master, tuple(dims), found), self._state.master, dims).select(*dims)


def _stacked(spark: SparkSession, tables: list[DataFrame], schema: str) -> DataFrame:
    out = tables[0] if tables else spark.createDataFrame([], schema)
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _parse_all(schema: MathSchema) -> None:
    """Parse every expression and condition, so that mistakes show before any data is read."""
    for variable in schema.variables.values():
        if variable.where is not None:
            parse_where(variable.where)
    for name, constraint in schema.constraints.items():
        if constraint.where is not None:
            parse_where(constraint.where)
        for i, equation in enumerate(constraint.equations):
            if parse_expression(equation.expression).relation is None:
                raise ValueError(f"Constraint '{name}' equation {i}: the expression must contain exactly one comparison (<=, >=, ==): {equation.expression!r}")
            if equation.where is not None:
                parse_where(equation.where)
    for name, objective in schema.objectives.items():
        for equation in objective.equations:
            if parse_expression(equation.expression).relation is not None:
                raise ValueError(f"Objective '{name}': the expression must not contain a comparison: {equation.expression!r}")


@contextmanager
def _naming(text: str) -> Iterator[None]:
    """The message of an error holds the text of the expression it comes from."""
    try:
        yield
    except (NameError, TypeError, ValueError, ZeroDivisionError) as error:
        raise type(error)(f"{error} (in the expression {text!r})") from error


class _Builder:
    """Adds a document's variables, constraints and objectives, in this order, to a state."""

    def __init__(self, spark: SparkSession, state: _State):
        self.state, self.space = state, Space(spark, state.master)
        self.conditions = ConditionPlanner(spark, state.params, state.master)

    def add(self, schema: MathSchema) -> _State:
        s = self.state
        for name, declared in schema.variables.items():
            s.variables[name] = build_variable(self.space, name, declared, s.params, self.conditions.plan(declared.where), s.labels)
            s.labels += s.variables[name].size
        for name, declared in schema.constraints.items():
            whole = self.conditions.plan(declared.where)
            for i, equation in enumerate(declared.equations):
                mask = both(whole, self.conditions.plan(equation.where), s.master)
                label = name if len(declared.equations) == 1 else f"{name}_{i}"
                formula = parse_expression(equation.expression)
                with _naming(equation.expression):
                    left, right = map(self.evaluated, formula.sides)
                    block, used = build_constraint(self.space, label, left, _SIGNS[formula.relation], right, mask, s.row_ids)
                s.constraints[label] = block
                s.row_ids += used
        for name, declared in schema.objectives.items():
            text = declared.equations[0].expression
            with _naming(text):
                s.objective = build_objective(self.space, name, self.evaluated(parse_expression(text).sides[0]), declared.sense)
        return s

    def evaluated(self, program: Program) -> Expr:
        stack: list[Any] = []
        for step in program:
            if step.what == "push":
                stack.append(Expr.of_number(self.space, step.of))
            elif step.what == "load":
                stack.append(self._named(step.of))
            elif step.what == "word":
                stack.append(step.of)
            elif step.what == "negate":
                stack.append(-stack.pop())
            elif step.what == "apply":
                right, left = stack.pop(), stack.pop()
                stack.append(_APPLY[step.of](left, right))
            elif step.what == "call":
                values = [stack.pop() for _ in range(step.count)][::-1]
                first = step.count - len(step.keywords)
                stack.append(get_helper(step.of)(*values[:first], **{k: _plain(v) for k, v in zip(step.keywords, values[first:])}))
            else:
                raise TypeError(f"unknown step {step!r}")
        [value] = stack
        if not isinstance(value, Expr):
            raise TypeError(f"a helper returned {type(value).__name__}, not an expression")
        return value

    def _named(self, name: str) -> Expr:
        s = self.state
        if name in s.variables:
            return Expr.of_variable(self.space, name, s.variables[name].dims, s.variables[name].cells)
        if name in s.params:
            return Expr.of_param(self.space, s.params[name])
        raise NameError(f"'{name}' not found. Variables: {sorted(s.variables)}. Parameters: {sorted(s.params)}.")


def _plain(value: Any) -> Any:
    """A number for a plain number."""
    return value.const.number if isinstance(value, Expr) and value.is_number else value
