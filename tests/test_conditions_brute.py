"""Random conditions against a plain evaluation cell by cell."""

import itertools
import operator
import random

import pytest

from mathframe import Model
from mathframe.lang.predicate import Every, Some, Unless
from mathframe.lang.predicate import Test as Check

OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
X, Y = [0, 1, 2], [5, 6]


def make(rng, depth):
    kind = rng.choice(["and", "or", "not", "leaf"]) if depth else "leaf"
    if kind == "not":
        return Unless(make(rng, depth - 1))
    if kind != "leaf":
        return (Every if kind == "and" else Some)(tuple(make(rng, depth - 1) for _ in range(rng.randint(2, 3))))
    name = rng.choice(["p", "q", "r", "s", "x", "y", "none"])
    if rng.random() < 0.3:
        return Check(name)
    return Check(name, rng.choice(list(OPS)), rng.choice([0, 1, 6, "p", "q", "s"]))


def text(tree):
    if isinstance(tree, Unless):
        return f"NOT ({text(tree.part)})"
    if isinstance(tree, (Every, Some)):
        return (" AND " if isinstance(tree, Every) else " OR ").join(f"({text(p)})" for p in tree.parts)
    return f"{tree.name} {tree.relation} {tree.against}" if tree.relation else tree.name


def holds(tree, cell):
    if isinstance(tree, Unless):
        return not holds(tree.part, cell)
    if isinstance(tree, (Every, Some)):
        return (all if isinstance(tree, Every) else any)(holds(p, cell) for p in tree.parts)
    if tree.name == "none":
        return False
    value = cell[tree.name]
    if tree.relation is None:
        return value is not None
    other = cell[tree.against] if isinstance(tree.against, str) else tree.against
    return tree.relation == "!=" if value is None or other is None else OPS[tree.relation](value, other)


@pytest.mark.parametrize("seed", range(12))
def test_random_condition(spark, seed):
    rng = random.Random(seed)
    p = {x: rng.choice([None, 0, 1]) for x in X}
    q = {(x, y): rng.choice([None, 0, 1, 6]) for x in X for y in Y}
    r = {y: rng.choice([None, 0, 6]) for y in Y}
    table = lambda cells, schema: spark.createDataFrame([(*(k if isinstance(k, tuple) else (k,)), float(v)) for k, v in cells.items() if v is not None], schema)
    model = Model.from_yaml(
        spark,
        {"dimensions": {"x": {"values": X}, "y": {"values": Y}}, "parameters": {"p": {"dims": ["x"]}, "q": {"dims": ["x", "y"]}, "r": {"dims": ["y"]}, "s": {"dims": []}}},
        data={"p": table(p, "x long, value double"), "q": table(q, "x long, y long, value double"), "r": table(r, "y long, value double"), "s": 1},
    )
    tree = make(rng, 3)
    want = {(x, y): holds(tree, {"p": p[x], "q": q[x, y], "r": r[y], "s": 1, "x": x, "y": y}) for x, y in itertools.product(X, Y)}
    kept = {(c.x, c.y) for c in model.masked(text(tree), ("x", "y")).collect()}
    assert kept == {c for c, h in want.items() if h}, text(tree)
    assert {c.x for c in model.masked(text(tree), ("x",)).collect()} == {x for (x, _), h in want.items() if h}
