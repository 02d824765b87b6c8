import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from mathframe import MathSchema, Model, register
from mathframe.operators.linexpr import NotLinearError
from mathframe.sources.coords import build_master_coords
from mathframe.sources.parameters import load_parameters

SHIPPING = {
    "dimensions": {"depot": {"values": ["north", "south"]}, "town": {"dtype": "int"}},
    "parameters": {"km": {"dims": ["depot", "town"]}, "stock": {"dims": ["depot"]}, "need": {"dims": ["town"]}},
    "variables": {"ship": {"foreach": ["depot", "town"], "where": "km < 9", "bounds": {"upper": 40}}},
    "constraints": {
        "out": {"foreach": ["depot"], "equations": [{"expression": "sum(ship, over=town) <= stock"}]},
        "into": {"foreach": ["town"], "equations": [{"expression": "sum(ship, over=depot) >= need"}]},
    },
    "objectives": {"way": {"equations": [{"expression": "ship * km / 2"}]}},
}


@pytest.fixture(scope="module")
def shipping(spark):
    km = pd.DataFrame([[4, 7, 9], [8, 3, 5]], index=["north", "south"], columns=[11, 12, 13])
    return Model.from_yaml(spark, SHIPPING, data={"km": km, "stock": {"north": 35, "south": 50}, "need": [10, 20, 30]}, coords={"town": [11, 12, 13]})


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_shipping(shipping):
    """Worked out by hand: six cells, the third of which is too far."""
    cells = rows(shipping.variable("ship"), "label", "depot", "town", "lower", "upper", "vtype")
    assert cells[1] == (1, "north", 12, 0.0, 40.0, "continuous") and [c[0] for c in cells] == [0, 1, 3, 4, 5]
    assert rows(shipping.constraint_rows("out"), "depot", "row_id", "sign", "rhs") == [("north", 0, "<=", 35.0), ("south", 1, "<=", 50.0)]
    assert rows(shipping.constraint_rows("into"), "town", "row_id", "sign", "rhs") == [(11, 2, ">=", 10.0), (12, 3, ">=", 20.0), (13, 4, ">=", 30.0)]
    assert [t[:2] for t in rows(shipping.constraint_terms("out"), "row_id", "label")] == [(0, 0), (0, 1), (1, 3), (1, 4), (1, 5)]
    assert rows(shipping.constraint_terms("into"), "row_id", "label", "coeff") == [(2, 0, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 1.0), (4, 5, 1.0)]
    assert rows(shipping.objective_terms(), "label", "coeff") == [(0, 2.0), (1, 3.5), (3, 4.0), (4, 1.5), (5, 2.5)] and shipping.objective.sense == "min"
    assert shipping.yaml.schema.variables["ship"].foreach == ["depot", "town"]
    assert set(shipping.yaml.dataset) == {"km", "stock", "need"} and set(shipping.yaml.coords) == {"depot", "town"}


def test_not_numbers(spark):
    """inf - inf and 0 * inf are missing, an impossible power and errors name the expression."""
    m = Model.from_yaml(spark, {"dimensions": {"x": {"values": [0, 1]}}, "parameters": {"a": {"dims": ["x"]}}}, data={"a": [math.inf, 2.0]})
    assert rows(m.evaluate("a - a"), "x", "value") == [(0, None), (1, 0.0)] and rows(m.evaluate("0 * a"), "x", "value") == [(0, None), (1, 0.0)]
    assert rows(m.evaluate("sum(a - a, over=x)"), "value") == [(0.0,)]
    with pytest.raises(ValueError, match="real number"):
        m.evaluate("(0 - 8) ** 0.5")
    with pytest.raises(NameError, match=r"in the expression 'b \+ a == 0'"):
        Model.from_yaml(spark, {"constraints": {"c": {"foreach": [], "equations": [{"expression": "b + a == 0"}]}}})


def test_repeated_coordinates(spark):
    table = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 4.0)], "x long, value double")
    document = {"dimensions": {"x": {"values": [1, 2]}}, "parameters": {"a": {"dims": ["x"]}}}
    with pytest.raises(ValueError, match="several values at the same coordinates"):
        Model.from_yaml(spark, document, data={"a": table})


def test_not_from_yaml():
    with pytest.raises(AttributeError, match="not built from YAML"):
        Model().yaml
    assert Model().variables == {} and Model().objective is None


def load(spark, dims, params, data):
    schema = MathSchema.model_validate({"dimensions": dims, "parameters": params})
    master = build_master_coords(spark, schema)
    return load_parameters(spark, schema, data, master), master


AB = {"g": {"values": ["a", "b"]}}


def test_coords(spark):
    schema = MathSchema.model_validate({"dimensions": {"x": {"values": [1, 2]}}})
    assert build_master_coords(spark, schema)["x"].values == [1, 2]
    assert build_master_coords(spark, schema, {"x": [99]})["x"].values == [99]
    with pytest.raises(ValueError, match="Dimension 'x' has no values"):
        build_master_coords(spark, MathSchema.model_validate({"dimensions": {"x": {}}}))
    with pytest.raises(ValueError, match="twice"):
        build_master_coords(spark, MathSchema.model_validate({"dimensions": {"x": {"values": [1, 1]}}}))


def test_coords_from_table(spark, monkeypatch):
    from mathframe.sources import coords

    table = spark.createDataFrame([(7,), (3,), (5,), (3,), (None,)], "x long")
    schema = MathSchema.model_validate({"dimensions": {"x": {"dtype": "int"}}})
    expected = [(0, 3), (1, 5), (2, 7)]
    assert rows(build_master_coords(spark, schema, {"x": table})["x"].table) == expected
    monkeypatch.setattr(coords, "SMALL_DIMENSION", 1)  # numbered in ranges
    assert rows(build_master_coords(spark, schema, {"x": table})["x"].table) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        (5.0, {"a": 5.0, "b": 5.0}),
        (np.float32(2), {"a": 2.0, "b": 2.0}),
        (np.array(3), {"a": 3.0, "b": 3.0}),
        (True, {"a": 1.0, "b": 1.0}),
        ({"a": 100}, {"a": 100.0, "b": None}),
        (pd.Series([1.0, np.nan], index=["a", "b"]), {"a": 1.0, "b": None}),
        (pd.Series([1, 2], index=pd.Index(["b", "a"], name="g")), {"a": 2.0, "b": 1.0}),
        ([10, 20], {"a": 10.0, "b": 20.0}),
        (np.array([1.5, np.inf]), {"a": 1.5, "b": math.inf}),
    ],
)
def test_inputs(spark, value, expected):
    params, master = load(spark, AB, {"p": {"dims": ["g"]}}, {"p": value})
    assert dict(rows(params["p"].dense(master))) == expected


def test_frame_inputs(spark):
    dims = {"x": {"values": [0, 1]}, "y": {"values": ["u", "v"]}}
    frame = pd.DataFrame([[1, np.nan], [3, 4]], index=[0, 1], columns=["u", "v"])
    before = frame.copy()
    params, master = load(spark, dims, {"p": {"dims": ["x", "y"]}}, {"p": frame})
    expected = [(0, "u", 1.0), (1, "u", 3.0), (1, "v", 4.0)]
    assert [r for r in rows(params["p"].dense(master).where("value is not null"))] == expected
    assert frame.columns.name is before.columns.name is None
    turned, master = load(spark, dims, {"p": {"dims": ["x", "y"]}}, {"p": frame.T.rename_axis("y").rename_axis("x", axis=1)})
    assert rows(turned["p"].dense(master).where("value is not null")) == expected
    table = spark.createDataFrame([(0, "u", 1), (1, "u", 3), (1, "v", 4)], "x long, y string, value int")
    same, master = load(spark, dims, {"p": {"dims": ["x", "y"]}}, {"p": table})
    assert rows(same["p"].dense(master).where("value is not null")) == expected


def test_datetime_dimension(spark):
    days = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)]
    params, master = load(spark, {"t": {"dtype": "datetime", "values": days}}, {"p": {"dims": ["t"]}}, {"p": pd.Series([1.0], index=pd.to_datetime(["2024-01-02"]))})
    assert dict(rows(params["p"].dense(master))) == {days[0]: None, days[1]: 1.0}


@pytest.mark.parametrize(
    "params, data, error, message",
    [
        ({"p": {"dims": ["g"]}}, {}, ValueError, "required"),
        ({}, {"extra": 1}, ValueError, "not declared"),
        ({"p": {"dims": ["g"]}}, {"p": pd.Series([1.0], index=pd.Index(["z"], name="g"))}, ValueError, "not in the master coordinate"),
        ({"p": {"dims": ["g"]}}, {"p": pd.Series([1.0], index=pd.Index(["a"], name="h"))}, ValueError, "unexpected dimensions"),
        ({"p": {"dims": ["g"]}}, {"p": [1, 2, 3]}, ValueError, "does not match"),
        ({"p": {"dims": ["g"]}}, {"p": [[1, 2]]}, ValueError, "unsupported type ndarray"),
        ({"p": {"dims": []}}, {"p": {"a": 1}}, ValueError, "1-D"),
        ({"p": {"dims": ["g"]}}, {"p": pd.DataFrame([[1]])}, ValueError, "2-D"),
        ({"p": {"dims": ["g"]}}, {"p": None}, TypeError, "unsupported type"),
        ({"p": {"dims": ["g"]}}, {"p": "a"}, TypeError, "unsupported type"),
        ({"p": {"dims": ["g"]}}, {"p": {"a": "text"}}, ValueError, "can't be read as float"),
        ({"p": {"dims": ["g"], "dtype": "int"}}, {"p": {"a": 1.5}}, ValueError, "can't be read as int"),
    ],
)
def test_bad_inputs(spark, params, data, error, message):
    with pytest.raises(error, match=message):
        load(spark, AB, params, data)


def test_bad_table_inputs(spark):
    with pytest.raises(ValueError, match="not in the master coordinate"):
        load(spark, AB, {"p": {"dims": ["g"]}}, {"p": spark.createDataFrame([("z", 1.0)], "g string, value double")})
    with pytest.raises(ValueError, match="unexpected dimensions"):
        load(spark, AB, {"p": {"dims": ["g"]}}, {"p": spark.createDataFrame([("a", "b", 1.0)], "g string, h string, value double")})
    with pytest.raises(ValueError, match="can't be read"):
        load(spark, AB, {"p": {"dims": ["g"]}}, {"p": spark.createDataFrame([("a", "b")], "g string, value string")})


def small(spark, **document):
    base = {"dimensions": {"x": {"values": [0, 1, 2]}, "y": {"values": ["u", "v"]}}, "parameters": {"a": {"dims": ["x"]}, "b": {"dims": ["y"]}, "k": {"dims": []}}, "variables": {"v": {"foreach": ["x"]}, "w": {"foreach": ["x", "y"]}}}
    return Model.from_yaml(spark, base | document, data={"a": {0: 1, 2: 0}, "b": [2, 3], "k": 4})


@pytest.mark.parametrize(
    "expression, expected",
    [
        ("a / a", [(0, 1.0), (1, None), (2, None)]),
        ("k / a", [(0, 4.0), (1, None), (2, math.inf)]),
        ("a ** 0", [(0, 1.0), (1, 1.0), (2, 1.0)]),
        ("a * k - 2", [(0, 2.0), (1, None), (2, -2.0)]),
        ("k + 1", [(5.0,)]),
        ("2 ** 3 ** 1", [(8.0,)]),
        ("sum(a, over=x)", [(1.0,)]),
        ("sum(b, over=x) ", [("u", 2.0), ("v", 3.0)]),
        ("sum(a * b, over=y)", [(0, 5.0), (1, 0.0), (2, 0.0)]),
        ("roll(a, x=1)", [(0, 0.0), (1, 1.0), (2, None)]),
        ("roll(a, x=-4)", [(0, None), (1, 0.0), (2, 1.0)]),
    ],
)
def test_evaluate(spark, expression, expected):
    assert sorted(map(tuple, small(spark).evaluate(expression).collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize(
    "expression, error",
    [("v * v == 1", NotLinearError), ("v ** 2 == 1", NotLinearError), ("1 / v == 1", NotLinearError), ("nothing == v", NameError), ("f(v) == 1", NameError), ("roll(v) == 1", TypeError), ("roll(3, x=1) == v", TypeError), ("roll(v, x=a) == 1", ValueError), ("sum(v) == 1", TypeError), ("1 / 0 == v", ZeroDivisionError), ("a == 1", ValueError), ("v", ValueError), ("roll(v, y=1) == 0", ValueError)],
)
def test_bad_constraints(spark, expression, error):
    with pytest.raises(error):
        small(spark, constraints={"c": {"foreach": ["x"], "equations": [{"expression": expression}]}})


def test_objective_must_not_compare(spark):
    with pytest.raises(ValueError, match="comparison"):
        small(spark, objectives={"o": {"equations": [{"expression": "v == 1"}]}})


def test_missing_data_policy(spark):
    m = small(spark, constraints={"c": {"foreach": ["x"], "equations": [{"expression": "v + w * a <= a"}]}}, objectives={"o": {"sense": "maximize", "equations": [{"expression": "v / a + k"}]}})
    # Rows need their constant; missing coefficients drop the term.
    assert rows(m.constraint_rows("c"), "x", "y", "rhs") == [(0, "u", 1.0), (0, "v", 1.0), (2, "u", 0.0), (2, "v", 0.0)]
    assert rows(m.constraint_terms("c"), "row_id", "label", "coeff") == [(0, 0, 1.0), (0, 3, 1.0), (1, 0, 1.0), (1, 4, 1.0), (4, 2, 1.0), (4, 7, 0.0), (5, 2, 1.0), (5, 8, 0.0)]
    assert rows(m.objective_terms(), "label", "coeff") == [(0, 1.0), (2, math.inf)] and m.objective.offset.first().value == 12.0


def test_bound_without_value(spark):
    m = small(spark, variables={"v": {"foreach": ["x"], "bounds": {"upper": "a"}}})
    with pytest.raises(Exception, match="upper bound 'a' has no value"):
        m.variable("v").collect()
    with pytest.raises(ValueError, match="dimensions"):
        small(spark, variables={"v": {"foreach": ["x"], "bounds": {"upper": "b"}}})


def test_masks(spark):
    m = small(spark)
    assert rows(m.mask("NOT a > 0")) == [(0, False), (1, True), (2, True)]
    assert rows(m.mask("a")) == [(0, True), (1, False), (2, True)]
    assert rows(m.mask("a != 0")) == [(0, True), (1, True), (2, False)]
    assert rows(m.mask("y == v AND a >= 0"), "x", "y", "keep") == [(0, "u", False), (0, "v", True), (1, "u", False), (1, "v", False), (2, "u", False), (2, "v", True)]
    assert rows(m.mask("nothing")) == [(False,)] and rows(m.mask("v == 1")) == [(False,)] and rows(m.mask(None)) == [(True,)]
    assert rows(m.mask("k > 3")) == [(True,)] and rows(m.mask("x")) == [(0, True), (1, True), (2, True)]
    assert rows(m.masked("a > 0", ("y",))) == [("u",), ("v",)] and rows(m.masked("a > 5", ("y",))) == []
    with pytest.raises(TypeError):
        m.mask("a < y2")


def test_extend(spark, tmp_path):
    m = small(spark)
    path = tmp_path / "more.yaml"
    path.write_text("dimensions: {z: {values: [1, 2]}}\nparameters: {c: {dims: [x]}}\nvariables: {u: {foreach: [z]}}\nconstraints:\n  more:\n    foreach: [x]\n    equations: [{expression: v + a <= c}]\nobjectives: {o: {equations: [{expression: \"sum(u, over=z)\"}]}}\n")
    m.yaml.extend(path, data={"c": 5})
    assert rows(m.constraint_rows("more"), "x", "rhs") == [(0, 4.0), (2, 5.0)]
    assert rows(m.variable("u"), "label") == [(9,), (10,)] and set(m.yaml.dataset) == {"a", "b", "k", "c"}
    assert "more" not in m.yaml.schema.constraints
    with pytest.raises(ValueError):
        m.yaml.extend({"variables": {"t": {"foreach": ["x"]}}, "constraints": {"bad": {"foreach": ["x"], "equations": [{"expression": "a == 1"}]}}})
    assert "t" not in m.variables
    with pytest.raises(ValueError, match="already"):
        m.yaml.extend({"variables": {"u": {"foreach": ["x"]}}})


def test_helpers(spark):
    with pytest.raises(ValueError, match="built-in"):
        register("sum")

    @register("doubled")
    def doubled(e, *, plus=0):
        return 2 * e + plus

    assert rows(small(spark).evaluate("doubled(b, plus=1)")) == [("u", 5.0), ("v", 7.0)]

    @register("doubled")
    def again(e):
        return (1 - e) / 2 + +e - 3

    assert rows(small(spark).evaluate("doubled(b)")) == [("u", -1.5), ("v", -1.0)]


def test_no_dimensions(spark):
    m = Model.from_yaml(spark, {"variables": {"z": {"foreach": [], "binary": True, "bounds": {"upper": 9}}}, "constraints": {"c": {"foreach": [], "equations": [{"expression": "z * 2 >= 1"}]}}})
    assert rows(m.variable("z")) == [(0, 0.0, 1.0, "binary")] and rows(m.constraint_rows("c", counted=True)) == [(0, ">=", 1.0, 1)]
    assert rows(m.all_rows()) == [("c", 0, ">=", 1.0)] and rows(m.all_terms()) == [(0, 0, 2.0)] and rows(m.all_variables()) == [("z", 0, 0.0, 1.0, "binary")]


def test_nothing_is_added_up_without_need(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    c = lambda text: {"c": {"foreach": ["x"], "equations": [{"expression": text}]}}
    single = small(spark, constraints=c("sum(w * b, over=y) <= 1"))
    assert "HashAggregate" not in plan(single.constraint_terms("c"))
    assert rows(single.constraint_terms("c")) == [(x, 3 + 2 * x + y, 2.0 + y) for x in range(3) for y in range(2)]
    twice = small(spark, constraints=c("sum(v * b, over=y) + v <= 1"))
    assert rows(twice.constraint_terms("c")) == [(x, x, 6.0) for x in range(3)]
    broadcast = small(spark, constraints=c("sum(v * b, over=y) <= 1"))
    assert rows(broadcast.constraint_terms("c")) == [(x, x, 5.0) for x in range(3)]
    rolled = small(spark, constraints=c("sum(roll(w, y=1), over=x) <= b"))
    assert rows(rolled.constraint_terms("c")) == [(y, 3 + 2 * x + (y + 1) % 2, 1.0) for y in range(2) for x in range(3)]
