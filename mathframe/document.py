"""The model document: what a YAML file may declare, checked before anything is planned."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


class ValidationError(ValueError):
    """A document that breaks the rules; names every problem found, one a line."""


@dataclass(frozen=True)
class Dimension:
    dtype: str = "str"
    values: list | None = None


@dataclass(frozen=True)
class Parameter:
    dims: list[str]
    dtype: str = "float"


@dataclass(frozen=True)
class Bounds:
    lower: float | str = 0
    upper: float | str = math.inf


@dataclass(frozen=True)
class Equation:
    expression: str
    where: str | None = None


@dataclass(frozen=True)
class Variable:
    foreach: list[str]
    where: str | None = None
    bounds: Bounds = Bounds()
    binary: bool = False
    integer: bool = False


@dataclass(frozen=True)
class Constraint:
    foreach: list[str]
    equations: list[Equation]
    where: str | None = None


@dataclass(frozen=True)
class Objective:
    equations: list[Equation]
    sense: str = "minimize"


# The names that documents use.
DIMENSION_TYPES = ("float", "int", "str", "datetime")
PARAMETER_TYPES = ("float", "int", "bool", "str")
SENSES = ("minimize", "maximize")


class _Reader:
    """Reads plain values and gathers what is wrong with them."""

    def __init__(self):
        self.problems: list[str] = []

    def fail(self, where: str, text: str) -> None:
        self.problems.append(f"{where}: {text}")

    def section(self, raw: Mapping, name: str, read: Callable[[str, Mapping], Any]) -> dict[str, Any]:
        entries = raw.get(name, {})
        if not isinstance(entries, Mapping):
            self.fail(name, "must be a mapping of names")
            return {}
        out = {}
        for key, entry in entries.items():
            at = f"{name}.{key}"
            if not isinstance(entry, Mapping):
                self.fail(at, "must be a mapping")
                continue
            out[str(key)] = read(at, entry)
        return out

    def names(self, at: str, entry: Mapping, key: str) -> list[str]:
        value = entry.get(key)
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            self.fail(at, f"'{key}' is required and must be a list of names")
            return []
        if len(set(value)) < len(value):
            self.fail(at, f"'{key}' names a dimension twice")
        return list(value)

    def choice(self, at: str, entry: Mapping, key: str, default: str, allowed: tuple[str, ...]) -> str:
        value = entry.get(key, default)
        if value not in allowed:
            self.fail(at, f"{key} must be {'|'.join(allowed)}, not {value!r}")
        return value

    def text(self, at: str, entry: Mapping, key: str) -> str | None:
        value = entry.get(key)
        if value is not None and not isinstance(value, str):
            self.fail(at, f"'{key}' must be text (quote it), not {value!r}")
            return None
        return value

    def flag(self, at: str, entry: Mapping, key: str) -> bool:
        value = entry.get(key, False)
        if not isinstance(value, bool):
            self.fail(at, f"'{key}' must be true or false, not {value!r}")
        return bool(value)

    def bound(self, at: str, entry: Mapping, key: str, default: float) -> float | str:
        value = entry.get(key, default)
        if isinstance(value, str):
            return value
        if isinstance(value, (int, float)):
            return float(value)
        self.fail(at, f"bound '{key}' must be a number or the name of a parameter, not {value!r}")
        return default

    def equations(self, at: str, entry: Mapping) -> list[Equation]:
        listed = entry.get("equations")
        if not isinstance(listed, list) or not listed:
            self.fail(at, "needs at least one equation")
            return []
        out = []
        for i, equation in enumerate(listed):
            here = f"{at}.equations[{i}]"
            if not isinstance(equation, Mapping) or not isinstance(equation.get("expression"), str):
                self.fail(here, "'expression' is required and must be text")
                continue
            out.append(Equation(equation["expression"], self.text(here, equation, "where")))
        return out

    def dimension(self, at: str, entry: Mapping) -> Dimension:
        values = entry.get("values")
        if values is not None and not isinstance(values, list):
            self.fail(at, "'values' must be a list")
            values = None
        return Dimension(self.choice(at, entry, "dtype", "str", DIMENSION_TYPES), values)

    def parameter(self, at: str, entry: Mapping) -> Parameter:
        return Parameter(self.names(at, entry, "dims"), self.choice(at, entry, "dtype", "float", PARAMETER_TYPES))

    def variable(self, at: str, entry: Mapping) -> Variable:
        given = entry.get("bounds", {})
        if not isinstance(given, Mapping):
            self.fail(at, "'bounds' must be a mapping")
            given = {}
        bounds = Bounds(self.bound(at, given, "lower", 0), self.bound(at, given, "upper", math.inf))
        binary, integer = self.flag(at, entry, "binary"), self.flag(at, entry, "integer")
        if binary and integer:
            self.fail(at, "a variable can't be both binary and integer")
        return Variable(self.names(at, entry, "foreach"), self.text(at, entry, "where"), bounds, binary, integer)

    def constraint(self, at: str, entry: Mapping) -> Constraint:
        return Constraint(self.names(at, entry, "foreach"), self.equations(at, entry), self.text(at, entry, "where"))

    def objective(self, at: str, entry: Mapping) -> Objective:
        return Objective(self.equations(at, entry), self.choice(at, entry, "sense", "minimize", SENSES))


@dataclass(frozen=True)
class MathSchema:
    """A checked document.  Unknown keys are ignored; every section may be left out."""

    dimensions: dict[str, Dimension] = field(default_factory=dict)
    parameters: dict[str, Parameter] = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    constraints: dict[str, Constraint] = field(default_factory=dict)
    objectives: dict[str, Objective] = field(default_factory=dict)

    @classmethod
    def model_validate(cls, raw: Any, known: MathSchema | None = None) -> MathSchema:
        """Check plain data.  Names declared in ``known`` may be used without being declared again."""
        if not isinstance(raw, Mapping):
            raise ValidationError("a document must be a mapping of sections")
        read = _Reader()
        document = cls(
            read.section(raw, "dimensions", read.dimension),
            read.section(raw, "parameters", read.parameter),
            read.section(raw, "variables", read.variable),
            read.section(raw, "constraints", read.constraint),
            read.section(raw, "objectives", read.objective),
        )
        read.problems += document._unresolved(known or cls())
        if read.problems:
            raise ValidationError("\n".join(read.problems))
        return document

    def _unresolved(self, known: MathSchema) -> list[str]:
        dims, params = {*known.dimensions, *self.dimensions}, {*known.parameters, *self.parameters}
        uses = [(f"parameters.{n}", p.dims) for n, p in self.parameters.items()]
        uses += [(f"variables.{n}", v.foreach) for n, v in self.variables.items()]
        uses += [(f"constraints.{n}", c.foreach) for n, c in self.constraints.items()]
        problems = [f"{at}: undeclared dimension '{d}'" for at, of in uses for d in of if d not in dims]
        for name, variable in self.variables.items():
            for side in (variable.bounds.lower, variable.bounds.upper):
                if isinstance(side, str) and side not in params:
                    problems.append(f"variables.{name}: bound names undeclared parameter '{side}'")
        return problems

    def merged(self, other: MathSchema) -> MathSchema:
        """Both documents; where both declare a dimension or parameter, this one's stays."""
        return MathSchema(
            other.dimensions | self.dimensions, other.parameters | self.parameters,
            self.variables | other.variables, self.constraints | other.constraints, self.objectives | other.objectives,
        )


def read_document(source: str | Path | Mapping) -> Mapping:
    """Plain data of a document: a path, YAML text (if it holds a line break or colon), or a mapping."""
    if isinstance(source, Mapping):
        return source
    import yaml

    is_text = isinstance(source, str) and ("\n" in source or ": " in source or not source.strip())
    loaded = yaml.safe_load(source if is_text else Path(source).read_text(encoding="utf-8"))
    return {} if loaded is None else loaded
