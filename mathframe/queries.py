"""Queries over the driver's tables: each builds a model and returns one of its tables; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.registry import register
from .model import Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def keep(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return keep


class _Tables:
    """Dimensions and parameters taken from the tables; a model takes those that its document declares."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")

    def supplier(self):
        return self.read("supplier").select(F.col("s_suppkey").alias("supplier"))

    def part(self):
        return self.read("part").select(F.col("p_partkey").alias("part"))

    def nation(self):
        return self.read("nation").select(F.col("n_nationkey").cast("bigint").alias("nation"))

    def region(self):
        return self.read("region").select(F.col("r_regionkey").cast("bigint").alias("region"))

    def segment(self):
        return self.read("customer").select(F.col("c_mktsegment").alias("segment"))

    def month(self):
        return self.read("orders").select(self._month().alias("month"))

    def event_type(self):
        return self.read("events").select("event_type")

    def hour(self):
        return [*range(24)]

    @staticmethod
    def _month():
        return (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint")

    def cap(self):
        """Positive balances of suppliers."""
        return self.read("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("supplier"), F.col("s_acctbal").alias("value"))

    def cost(self):
        return self.read("supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").cast("double").alias("value"))

    def weight(self):
        return self.read("nation").select(F.col("n_nationkey").cast("bigint").alias("nation"), (F.col("n_regionkey") + 1).cast("double").alias("value"))

    def home(self):
        """1 where a supplier is of a nation."""
        return self.read("supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").cast("bigint").alias("nation"), F.lit(1.0).alias("value"))

    def demand(self):
        return self.read("orders").groupBy(self._month().alias("month")).agg(F.count("*").cast("double").alias("value"))

    def qty(self):
        """Quantity that each supplier sold of each part; pairs never sold are missing."""
        sold = self.read("lineitem").groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part"))
        return sold.agg(F.sum("l_quantity").alias("value"))

    def size(self):
        return self.read("part").select(F.col("p_partkey").alias("part"), F.col("p_size").cast("double").alias("value"))

    def debtors(self):
        """Customers who owe more than 900, by nation and segment."""
        of = self.read("customer").where("c_acctbal < -900")
        return of.groupBy(F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").cast("double").alias("value"))

    def brand(self):
        return self.read("part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("value"))

    def load(self):
        """Events by hour of the day and type."""
        return self.read("events").groupBy(F.hour("ts").cast("bigint").alias("hour"), "event_type").agg(F.count("*").cast("double").alias("value"))


def _model(spark: SparkSession, folder: str, document: dict, **given) -> Model:
    """A model of a document whose dimensions and parameters come from the tables or ``given``."""
    tables = _Tables(spark, folder)
    document = {"dimensions": {}, "parameters": {}, **document}
    dims = {d: ({"dtype": "str"} if d in ("segment", "event_type") else {"dtype": "int"}) for d in document["dimensions"]}
    params = {n: spec if isinstance(spec, dict) else {"dims": spec} for n, spec in document["parameters"].items()}
    coords = {d: given[d] if d in given else getattr(tables, d)() for d in dims}
    data = {n: given[n] if n in given else getattr(tables, n)() for n in params}
    # Coordinates come from the same tables, so there is none to search for strange ones.
    return Model.from_yaml(spark, {**document, "dimensions": dims, "parameters": params}, data=data, coords=coords, check_tables=False)


def _equation(expression: str, where: str | None = None) -> list[dict]:
    return [{"expression": expression} | ({"where": where} if where else {})]


# Tables that the SQL shares.
_S = "s AS (SELECT s_suppkey AS supplier, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS o, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS cap, CAST(s_nationkey AS DOUBLE) AS cost FROM supplier)"
_N = "n AS (SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS o, CAST(n_regionkey + 1 AS DOUBLE) AS weight FROM nation)"
_R = "r AS (SELECT CAST(r_regionkey AS BIGINT) AS region, CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS BIGINT) AS o FROM region)"
_M = "m AS (SELECT *, CAST(row_number() OVER (ORDER BY month) - 1 AS BIGINT) AS o, count(*) OVER () AS size FROM (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS month, CAST(count(*) AS DOUBLE) AS demand FROM orders GROUP BY 1))"
_P = "p AS (SELECT p_partkey AS part, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS o, CAST(p_size AS DOUBLE) AS size, p_brand AS brand FROM part)"
_Q = "q AS (SELECT l_suppkey AS supplier, l_partkey AS part, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2)"
_G = "g AS (SELECT DISTINCT c_mktsegment AS segment FROM customer)"
_D = "d AS (SELECT CAST(c_nationkey AS BIGINT) AS nation, c_mktsegment AS segment, CAST(count(*) AS DOUBLE) AS debtors FROM customer WHERE c_acctbal < -900 GROUP BY 1, 2)"
_E = "e AS (SELECT *, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS o FROM (SELECT DISTINCT event_type FROM events))"
_L = "l AS (SELECT CAST(hour(ts) AS BIGINT) AS hour, event_type, CAST(count(*) AS DOUBLE) AS load FROM events GROUP BY 1, 2)"
_H = "h AS (SELECT CAST(range AS BIGINT) AS hour FROM range(24))"


def _sql(*tables: str) -> str:
    return "WITH " + ", ".join(tables) + " "


# -- dimensions and parameters ---------------------------------------------------------


@_query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS o_supplier, s_suppkey AS supplier FROM supplier")
def dim_from_table(spark, folder):
    return _model(spark, folder, {"dimensions": ["supplier"]}).dimension("supplier")


@_query("SELECT CAST(r_regionkey AS BIGINT) AS region, CAST(2.5 AS DOUBLE) AS value FROM region")
def param_scalar(spark, folder):
    return _model(spark, folder, {"dimensions": ["region"], "parameters": {"a": ["region"]}}, a=2.5).parameter_dense("a")


@_query("SELECT CAST(r_regionkey AS BIGINT) AS region, CAST(CASE r_regionkey WHEN 0 THEN 10 WHEN 3 THEN 7.5 END AS DOUBLE) AS value FROM region")
def param_dict(spark, folder):
    return _model(spark, folder, {"dimensions": ["region"], "parameters": {"a": ["region"]}}, a={0: 10, 3: 7.5}).parameter_dense("a")


@_query("SELECT CAST(r_regionkey AS BIGINT) AS region, CAST(CASE r_regionkey WHEN 1 THEN 4 WHEN 2 THEN 0.25 END AS DOUBLE) AS value FROM region")
def param_series(spark, folder):
    series = pd.Series([4, 0.25, np.nan], index=pd.Index([1, 2, 4], name="region"))
    return _model(spark, folder, {"dimensions": ["region"], "parameters": {"a": ["region"]}}, a=series).parameter_dense("a")


@_query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'BUILDING', CAST(1 AS DOUBLE)), (0, 'MACHINERY', 2), (2, 'MACHINERY', 4)) AS t(region, segment, value)")
def param_frame_2d(spark, folder):
    frame = pd.DataFrame({"BUILDING": [1.0, np.nan], "MACHINERY": [2.0, 4.0]}, index=[0, 2])
    document = {"dimensions": ["region", "segment"], "parameters": {"a": ["region", "segment"]}}
    return _model(spark, folder, document, a=frame, segment=["BUILDING", "MACHINERY", "OTHER"]).parameter("a")


@_query("SELECT CAST(r_regionkey AS BIGINT) AS region, CAST(10 * (row_number() OVER (ORDER BY r_regionkey)) AS DOUBLE) AS value FROM region")
def param_list_positional(spark, folder):
    return _model(spark, folder, {"dimensions": ["region"], "parameters": {"a": ["region"]}}, a=[10, 20, 30, 40, 50]).parameter_dense("a")


@_query(_sql(_N, _G, _D) + "SELECT nation, segment, debtors AS value FROM n CROSS JOIN g LEFT JOIN d USING (nation, segment)")
def param_sparse_dense_view(spark, folder):
    return _model(spark, folder, {"dimensions": ["nation", "segment"], "parameters": {"debtors": ["nation", "segment"]}}).parameter_dense("debtors")


@_query(_sql(_N, _G) + "SELECT nation, segment, weight AS value FROM n, g")
def param_lower_dims_broadcast(spark, folder):
    model = _model(spark, folder, {"dimensions": ["nation", "segment"], "parameters": {"weight": ["nation", "segment"]}})
    return model.evaluate("weight").join(model.dimension("segment").select("segment"), how="cross").select("nation", "segment", "value")


# -- conditions ------------------------------------------------------------------------


def _where(name: str, where: str, sql: str, document: dict | None = None, dims: tuple[str, ...] | None = None) -> None:
    document = document or {"dimensions": ["supplier"], "parameters": {"cap": ["supplier"], "cost": ["supplier"]}}

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _model(spark, folder, document).mask(where, dims)

    run.__name__, run.__doc__ = name, f"Cells where: {where}"
    _query(sql)(run)


def _suppliers_where(condition: str) -> str:
    return _sql(_S) + f"SELECT supplier, {condition} AS keep FROM s"


_where("where_exists", "cap", _suppliers_where("cap IS NOT NULL"))
for _name, _op, _sign in (("lt", "<", "<"), ("le", "<=", "<="), ("gt", ">", ">"), ("ge", ">=", ">="), ("eq", "==", "=")):
    _where(f"where_cmp_{_name}", f"cost {_op} 7", _suppliers_where(f"coalesce(cost {_sign} 7, false)"))
_where("where_cmp_ne", "cost != 7", _suppliers_where("coalesce(cost <> 7, true)"))
_where("where_dim_cmp", "supplier >= 9", _suppliers_where("supplier >= 9"))
_where("where_string_cmp", "segment == BUILDING", _sql(_G) + "SELECT segment, segment = 'BUILDING' AS keep FROM g", {"dimensions": ["segment"]})
_where("where_string_param", "brand != nothing AND size > 25", _sql(_P) + "SELECT part, coalesce(brand <> 'nothing', true) AND size > 25 AS keep FROM p", {"dimensions": ["part"], "parameters": {"brand": {"dims": ["part"], "dtype": "str"}, "size": ["part"]}})
_where("where_param_vs_param", "cap > cost", _suppliers_where("coalesce(cap > cost, false)"))
_where("where_param_vs_param_broadcast", "cost > weight", _sql(_S, _N) + "SELECT supplier, nation, cost > weight AS keep FROM s, n", {"dimensions": ["supplier", "nation"], "parameters": {"cost": ["supplier"], "weight": ["nation"]}})
_where("where_and_or_precedence", "cap > 9000 OR cost > 10 AND supplier < 50", _suppliers_where("coalesce(cap > 9000, false) OR (cost > 10 AND supplier < 50)"))
_where("where_parentheses", "(cap > 9000 OR cost > 10) AND supplier < 50", _suppliers_where("(coalesce(cap > 9000, false) OR cost > 10) AND supplier < 50"))
_where("where_not_missing", "NOT cap > 5000", _suppliers_where("NOT coalesce(cap > 5000, false)"))
_where("where_ne_missing", "cap != 5", _suppliers_where("coalesce(cap <> 5, true)"))
_where("where_unknown_false", "nothing OR cap", _suppliers_where("cap IS NOT NULL"))
_where("where_constant", "True AND NOT False", "SELECT true AS keep")
_where("where_any_reduce", "qty > 140", _sql(_P, _Q) + "SELECT part, part IN (SELECT part FROM q WHERE qty > 140) AS keep FROM p", {"dimensions": ["supplier", "part"], "parameters": {"qty": ["supplier", "part"]}}, ("part",))
_where("where_not_any_reduce", "NOT debtors", _sql(_N, _G, _D) + "SELECT nation, bool_or(debtors IS NULL) AS keep FROM n CROSS JOIN g LEFT JOIN d USING (nation, segment) GROUP BY nation", {"dimensions": ["nation", "segment"], "parameters": {"debtors": ["nation", "segment"]}}, ("nation",))


# -- variables -------------------------------------------------------------------------


def _ship(**variable) -> dict:
    return {"dimensions": ["month", "supplier"], "parameters": {"cap": ["supplier"]}, "variables": {"ship": {"foreach": ["month", "supplier"], **variable}}}


@_query(_sql(_R, _N) + "SELECT region, nation, r.o * (SELECT count(*) FROM n) + n.o AS label, CAST(0 AS DOUBLE) AS lower, CAST('inf' AS DOUBLE) AS upper, 'continuous' AS vtype FROM r, n")
def var_grid(spark, folder):
    return _model(spark, folder, {"dimensions": ["region", "nation"], "variables": {"x": {"foreach": ["region", "nation"]}}}).variable("x")


@_query(_sql(_M, _S) + "SELECT month, supplier, m.o * (SELECT count(*) FROM s) + s.o AS label FROM m, s WHERE cap > 500")
def var_masked(spark, folder):
    return _model(spark, folder, _ship(where="cap > 500")).variable("ship", labels_only=True)


@_query(_sql(_M, _S) + "SELECT month, supplier, m.o * (SELECT count(*) FROM s) + s.o AS label, CAST(-1 AS DOUBLE) AS lower, cap AS upper, 'continuous' AS vtype FROM m, s WHERE cap > 0")
def var_param_bounds(spark, folder):
    return _model(spark, folder, _ship(where="cap > 0", bounds={"lower": -1, "upper": "cap"})).variable("ship")


@_query(_sql(_S) + "SELECT supplier, o AS label, CAST(0 AS DOUBLE) AS lower, CAST(9 AS DOUBLE) AS upper, 'integer' AS vtype FROM s")
def var_integer(spark, folder):
    return _model(spark, folder, {"dimensions": ["supplier"], "variables": {"x": {"foreach": ["supplier"], "integer": True, "bounds": {"upper": 9}}}}).variable("x")


@_query(_sql(_S) + "SELECT supplier, o AS label, CAST(0 AS DOUBLE) AS lower, CAST(1 AS DOUBLE) AS upper, 'binary' AS vtype FROM s")
def var_binary(spark, folder):
    return _model(spark, folder, {"dimensions": ["supplier"], "variables": {"x": {"foreach": ["supplier"], "binary": True}}}).variable("x")


@_query(_sql(_S) + "SELECT 'a' AS name, o AS label FROM s UNION ALL SELECT 'total', (SELECT count(*) FROM s)")
def var_labels_of_model(spark, folder):
    document = {"dimensions": ["supplier"], "variables": {"a": {"foreach": ["supplier"]}, "total": {"foreach": []}}}
    return _model(spark, folder, document).all_variables().select("name", "label")


@_query(_sql(_S) + "SELECT supplier, o AS label FROM s WHERE false")
def var_where_false(spark, folder):
    return _model(spark, folder, {"dimensions": ["supplier"], "variables": {"x": {"foreach": ["supplier"], "where": "False"}}}).variable("x", labels_only=True)


# -- expressions of parameters ---------------------------------------------------------


def _value(name: str, expression: str, sql: str, document: dict | None = None, **given) -> None:
    document = document or {"dimensions": ["supplier"], "parameters": {"cap": ["supplier"], "cost": ["supplier"]}}

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _model(spark, folder, document, **given).evaluate(expression)

    run.__name__, run.__doc__ = name, f"Cells of: {expression}"
    _query(sql)(run)


def _suppliers_value(expression: str) -> str:
    return _sql(_S) + f"SELECT supplier, CAST({expression} AS DOUBLE) AS value FROM s"


_BOTH = {"dimensions": ["supplier", "nation"], "parameters": {"cap": ["supplier"], "weight": ["nation"], "home": ["supplier", "nation"]}}
_MONTH = {"dimensions": ["month"], "parameters": {"demand": ["month"]}}
_PAIRS = {"dimensions": ["supplier", "part"], "parameters": {"qty": ["supplier", "part"], "size": ["part"], "cap": ["supplier"]}}
_value("expr_add", "cap + cost", _suppliers_value("cap + cost"))
_value("expr_sub", "cost - cap - 1", _suppliers_value("cost - cap - 1"))
_value("expr_mul_broadcast", "home * cap", _sql(_S, _N) + "SELECT supplier, nation, CASE WHEN cost = nation THEN cap END AS value FROM s, n", _BOTH)
_value("expr_name_broadcast_outer", "cap * weight", _sql(_S, _N) + "SELECT supplier, nation, cap * weight AS value FROM s, n", _BOTH)
_value("expr_div_by_zero", "(cost - 5) / (cost - 7)", _suppliers_value("CASE WHEN cost = 7 THEN CAST('inf' AS DOUBLE) ELSE (cost - 5) / (cost - 7) END"))
_value("expr_div_missing", "cost / cap", _suppliers_value("CASE WHEN cap IS NULL THEN NULL ELSE cost / cap END"))
_value("expr_pow_right_assoc", "cost ** 2 ** 2", _suppliers_value("cost ** 4"))
_value("expr_pow_zero", "cap ** 0", _suppliers_value("1"))
_value("expr_unary", "-cost ** 2 + +cost", _suppliers_value("cost * cost + cost"))
_value("expr_constant_folding", "cost * (2 + 3 * 4 - 1) / 2", _suppliers_value("cost * 13 / 2"))

# -- sums and rolls of parameters ------------------------------------------------------

_value("sum_over_param", "sum(qty, over=part)", _sql(_S, _Q) + "SELECT supplier, coalesce(sum(qty), 0) AS value FROM s LEFT JOIN q USING (supplier) GROUP BY supplier", _PAIRS)
_value("sum_over_all_missing", "sum(debtors, over=segment)", _sql(_N, _D) + "SELECT nation, coalesce(sum(debtors), 0) AS value FROM n LEFT JOIN d USING (nation) GROUP BY nation", {"dimensions": ["nation", "segment"], "parameters": {"debtors": ["nation", "segment"]}})
_value("sum_over_absent_dim", "sum(cap, over=part)", _suppliers_value("cap"), _PAIRS)
_value("sum_nested", "sum(sum(qty, over=part), over=supplier)", _sql(_Q) + "SELECT sum(qty) AS value FROM q", _PAIRS)
_value("sum_of_scalar", "sum(a, over=nation)", "SELECT CAST(count(*) * 3 AS DOUBLE) AS value FROM nation", {"dimensions": ["nation"], "parameters": {"a": ["nation"]}}, a=3)


def _rolled(by: int) -> str:
    return _sql(_M) + f"SELECT a.month, b.demand AS value FROM m a JOIN m b ON b.o = ((a.o - ({by})) % a.size + a.size) % a.size"


_value("roll_forward", "roll(demand, month=3)", _rolled(3), _MONTH)
_value("roll_backward", "roll(demand, month=-1)", _rolled(-1), _MONTH)
_value("roll_difference", "demand - roll(demand, month=1)", _sql(_M) + "SELECT a.month, a.demand - b.demand AS value FROM m a JOIN m b ON b.o = (a.o - 1 + a.size) % a.size", _MONTH)
_HOURS = {"dimensions": ["hour", "event_type"], "parameters": {"load": ["hour", "event_type"]}}
_value("roll_2d", "roll(roll(load, hour=2), event_type=1)", _sql(_H, _E, _L) + ", n AS (SELECT count(*) AS size FROM e) SELECT h.hour, a.event_type, l.load AS value FROM h CROSS JOIN e a CROSS JOIN n JOIN e b ON b.o = (a.o - 1 + n.size) % n.size LEFT JOIN l ON l.hour = (h.hour - 2 + 24) % 24 AND l.event_type = b.event_type", _HOURS)


# -- constraints -----------------------------------------------------------------------


def _fulfilment(**more) -> dict:
    document = {
        "dimensions": ["month", "supplier"],
        "parameters": {"cap": ["supplier"], "cost": ["supplier"], "demand": ["month"]},
        "variables": {"ship": {"foreach": ["month", "supplier"], "where": "cap > 0", "bounds": {"upper": "cap"}}},
        "constraints": {"balance": {"foreach": ["month"], "equations": _equation("sum(ship, over=supplier) == demand")}},
        "objectives": {"spend": {"equations": _equation("sum(ship * cost, over=supplier)")}},
    }
    return {**document, **more}


_LABEL = "m.o * (SELECT count(*) FROM s) + s.o"


@_query(_sql(_M) + "SELECT month, o AS row_id, '=' AS sign, demand AS rhs FROM m")
def con_balance_rows(spark, folder):
    return _model(spark, folder, _fulfilment()).constraint_rows("balance")


@_query(_sql(_M, _S) + f"SELECT m.o AS row_id, {_LABEL} AS label, CAST(1 AS DOUBLE) AS coeff FROM m, s WHERE cap > 0")
def con_balance_terms(spark, folder):
    return _model(spark, folder, _fulfilment()).constraint_terms("balance")


@_query(_sql(_M, _S) + f"SELECT {_LABEL} AS row_id, {_LABEL} AS label, 1 + cost AS coeff, '<=' AS sign, demand - cap AS rhs FROM m, s WHERE cap > 0")
def con_both_sides(spark, folder):
    model = _model(spark, folder, _fulfilment(constraints={"limit": {"foreach": ["month", "supplier"], "equations": _equation("ship + cap <= demand - ship * cost")}}))
    return model.constraint_terms("limit").join(model.constraint_rows("limit").select("row_id", "sign", "rhs"), "row_id")


@_query(_sql(_M) + "SELECT 'early_0' AS name, o AS row_id, '>=' AS sign, CAST(1 AS DOUBLE) AS rhs FROM m WHERE month < 199400 UNION ALL SELECT 'early_1', o + (SELECT count(*) FROM m), '<=', demand * 2 FROM m WHERE month >= 199400 AND demand > 10")
def con_multi_equation(spark, folder):
    equations = _equation("sum(ship, over=supplier) >= 1", "month < 199400") + _equation("sum(ship, over=supplier) <= demand * 2", "month >= 199400 AND demand > 10")
    return _model(spark, folder, _fulfilment(constraints={"early": {"foreach": ["month"], "equations": equations}})).all_rows()


@_query(_sql(_M, _S) + f"SELECT {_LABEL} AS row_id, {_LABEL} AS label, CAST(1 AS DOUBLE) AS coeff FROM m, s WHERE cap > 0 AND m.o > 0 UNION ALL SELECT {_LABEL}, (m.o - 1) * (SELECT count(*) FROM s) + s.o, CAST(-1 AS DOUBLE) FROM m, s WHERE cap > 0 AND m.o > 0")
def con_ramp_terms(spark, folder):
    """A ramp limit that leaves out the first month, where the shift wraps around."""
    first = _Tables(spark, folder).month().agg(F.min("month")).first()[0]
    return _model(spark, folder, _fulfilment(constraints={"ramp": {"foreach": ["month", "supplier"], "where": f"month > {first}", "equations": _equation("ship - roll(ship, month=1) <= 10")}})).constraint_terms("ramp")


@_query(_sql(_M, _S) + f"SELECT {_LABEL} AS row_id, {_LABEL} AS label, CAST(1 AS DOUBLE) AS coeff FROM m, s WHERE cap > 0 UNION ALL SELECT {_LABEL}, ((m.o - 1 + m.size) % m.size) * (SELECT count(*) FROM s) + s.o, CAST(-1 AS DOUBLE) FROM m, s WHERE cap > 0")
def roll_variable_wraps(spark, folder):
    return _model(spark, folder, _fulfilment(constraints={"ramp": {"foreach": ["month", "supplier"], "equations": _equation("ship - roll(ship, month=1) == 0")}})).constraint_terms("ramp")


@_query(_sql(_M, _S) + "SELECT month, supplier, m.o * (SELECT count(*) FROM s) + s.o AS row_id, '<=' AS sign, cap AS rhs FROM m, s WHERE cap > 1000 AND demand < 200")
def con_masked(spark, folder):
    return _model(spark, folder, _fulfilment(constraints={"use": {"foreach": ["month", "supplier"], "where": "cap > 1000", "equations": _equation("ship <= cap", "demand < 200")}})).constraint_rows("use")


@_query(_sql(_M, _S) + ", t AS (SELECT m.o, month, count(*) FILTER (cap > 9500) AS n FROM m, s GROUP BY ALL) SELECT month, o AS row_id, '>=' AS sign, CAST(0 AS DOUBLE) AS rhs, n AS n_terms FROM t")
def con_rows_counted(spark, folder):
    """Rows without any term are reported with a count of 0."""
    document = _fulfilment(variables={"ship": {"foreach": ["month", "supplier"], "where": "cap > 9500"}}, constraints={"some": {"foreach": ["month"], "equations": _equation("sum(ship, over=supplier) >= 0")}}, objectives={})
    return _model(spark, folder, document).constraint_rows("some", counted=True)


@_query(_sql(_M, _S) + f"SELECT CAST(0 AS BIGINT) AS row_id, {_LABEL} AS label, CAST(1 AS DOUBLE) AS coeff FROM m, s WHERE cap > 0 UNION ALL SELECT 0, (SELECT count(*) FROM s) * (SELECT count(*) FROM m) + m.o, CAST((SELECT count(*) FROM s) AS DOUBLE) FROM m")
def sum_mixed_dims_multiplicity(spark, folder):
    """A piece without the summed dimension counts once for each of its values."""
    document = _fulfilment(constraints={"all": {"foreach": [], "equations": _equation("sum(sum(ship + spare, over=supplier), over=month) == 5")}}, objectives={})
    document["variables"]["spare"] = {"foreach": ["month"]}
    return _model(spark, folder, document).constraint_terms("all")


# -- objectives ------------------------------------------------------------------------


@_query(_sql(_M, _S) + f"SELECT {_LABEL} AS label, cost AS coeff FROM m, s WHERE cap > 0")
def obj_terms(spark, folder):
    return _model(spark, folder, _fulfilment()).objective_terms()


@_query(_sql(_M, _S) + f"SELECT {_LABEL} AS label, CAST(2 AS DOUBLE) AS coeff, 'max' AS sense FROM m, s WHERE cap > 0")
def obj_last_wins(spark, folder):
    objectives = {"first": {"equations": _equation("sum(ship, over=supplier)")}, "second": {"sense": "maximize", "equations": _equation("ship * 2")}}
    model = _model(spark, folder, _fulfilment(objectives=objectives))
    return model.objective_terms().withColumn("sense", F.lit(model.objective.sense))


@_query(_sql(_M, _S) + f"SELECT {_LABEL} AS label, CAST(-1 AS DOUBLE) AS coeff, (SELECT sum(demand) FROM m) AS offset_value FROM m, s WHERE cap > 0")
def obj_first_equation_only(spark, folder):
    objectives = {"gap": {"equations": _equation("demand - sum(ship, over=supplier)", "False") + _equation("ship")}}
    model = _model(spark, folder, _fulfilment(objectives=objectives))
    return model.objective_terms().crossJoin(F.broadcast(model.objective.offset.select(F.col("value").alias("offset_value"))))  # one row


# -- extension and helpers -------------------------------------------------------------


@_query(_sql(_M, _S) + f"SELECT (SELECT count(*) FROM m) + s.o AS row_id, {_LABEL} AS label, CAST(1 AS DOUBLE) AS coeff FROM m, s WHERE cap > 0")
def extend_adds_constraint(spark, folder):
    model = _model(spark, folder, _fulfilment())
    model.yaml.extend({"parameters": {"most": {"dims": ["supplier"]}}, "constraints": {"yearly": {"foreach": ["supplier"], "equations": _equation("sum(ship, over=month) <= most")}}}, data={"most": 1000})
    return model.constraint_terms("yearly")


@register("weighted_sum")
def _weighted_sum(array, weights, *, over):
    return (array * weights).sum(over)


@_query(_sql(_S, _Q, _P) + "SELECT supplier, coalesce(sum(qty * size), 0) AS value FROM s LEFT JOIN (q JOIN p USING (part)) USING (supplier) GROUP BY supplier")
def custom_helper_weighted_sum(spark, folder):
    return _model(spark, folder, _PAIRS).evaluate("weighted_sum(qty, size, over=part)")


# -- whole models ----------------------------------------------------------------------


@_query(_sql(_S, _P, _Q) + ", d AS (SELECT count(*) AS np FROM p) SELECT p.o AS row_id, s.o * np + p.o AS label, qty AS coeff FROM q JOIN s USING (supplier) JOIN p USING (part) CROSS JOIN d")
def sparse_supply_model(spark, folder):
    """Flows exist only where something was sold; one row for each part."""
    document = {
        "dimensions": ["supplier", "part"], "parameters": {"qty": ["supplier", "part"], "size": ["part"]},
        "variables": {"flow": {"foreach": ["supplier", "part"], "where": "qty > 0", "bounds": {"upper": "qty"}}},
        "constraints": {"supply": {"foreach": ["part"], "equations": _equation("sum(flow * qty, over=supplier) >= size")}},
    }
    return _model(spark, folder, document).constraint_terms("supply")


@_query(_sql(_S, _P, _Q) + ", d AS (SELECT count(*) AS np FROM p) SELECT supplier, part, s.o * np + p.o AS label, CAST(0 AS DOUBLE) AS lower, qty AS upper, 'continuous' AS vtype FROM q JOIN s USING (supplier) JOIN p USING (part) CROSS JOIN d WHERE qty > 20 AND size <= 30")
def sparse_supply_variables(spark, folder):
    document = {"dimensions": ["supplier", "part"], "parameters": {"qty": ["supplier", "part"], "size": ["part"]}, "variables": {"flow": {"foreach": ["supplier", "part"], "where": "qty > 20 AND size <= 30", "bounds": {"upper": "qty"}}}}
    return _model(spark, folder, document).variable("flow")


_STORAGE = {
    "dimensions": ["hour", "event_type"], "parameters": {"load": ["hour", "event_type"]},
    "variables": {"level": {"foreach": ["hour", "event_type"]}, "inflow": {"foreach": ["hour", "event_type"], "where": "load > 0"}},
    "constraints": {"storage": {"foreach": ["hour", "event_type"], "equations": [*_equation("level == roll(level, hour=1) * 0.5 + inflow - load", "hour > 0"), *_equation("level == 0", "hour == 0")]}},
}


@_query(_sql(_H, _E, _L) + "SELECT 'storage_0' AS name, h.hour * (SELECT count(*) FROM e) + e.o AS row_id, '=' AS sign, -load AS rhs FROM h CROSS JOIN e JOIN l ON l.hour = h.hour AND l.event_type = e.event_type WHERE h.hour > 0 UNION ALL SELECT 'storage_1', 24 * (SELECT count(*) FROM e) + o, '=', CAST(0 AS DOUBLE) FROM e")
def storage_rows(spark, folder):
    return _model(spark, folder, _STORAGE).all_rows()


@_query(
    _sql(_H, _E, _L)
    + """, n AS (SELECT count(*) AS k FROM e), c AS (
  SELECT h.hour, e.o, k FROM h CROSS JOIN e CROSS JOIN n JOIN l ON l.hour = h.hour AND l.event_type = e.event_type WHERE h.hour > 0)
SELECT hour * k + o AS row_id, hour * k + o AS label, CAST(1 AS DOUBLE) AS coeff FROM c
UNION ALL SELECT hour * k + o, (hour - 1) * k + o, CAST(-0.5 AS DOUBLE) FROM c
UNION ALL SELECT hour * k + o, 24 * k + hour * k + o, CAST(-1 AS DOUBLE) FROM c
UNION ALL SELECT 24 * k + o, o, CAST(1 AS DOUBLE) FROM e CROSS JOIN n"""
)
def storage_terms(spark, folder):
    return _model(spark, folder, _STORAGE).all_terms()


# -- accessors, checks of tables, export -----------------------------------------------

_value("expr_infinity", "cost + inf - cap * 0", _suppliers_value("CASE WHEN cap IS NOT NULL THEN CAST('inf' AS DOUBLE) END"))
_value("expr_infinity_missing", "inf - inf * cost", _suppliers_value("NULL"))
_where("where_dimension_exists", "supplier AND cap", _suppliers_where("cap IS NOT NULL"))


@_query(_sql(_M, _S) + f"SELECT {_LABEL} AS row_id, {_LABEL} AS label, 1 / cap AS coeff FROM m, s WHERE cap > 0")
def con_variable_over_param(spark, folder):
    """A variable divided by a parameter is scaled by its reciprocal."""
    return _model(spark, folder, _fulfilment(constraints={"share": {"foreach": ["month", "supplier"], "equations": _equation("ship / cap <= 1")}})).constraint_terms("share")


@_query(_sql(_M, _S) + "SELECT 'cap' AS name, supplier AS at, cap AS value FROM s UNION ALL SELECT 'cost', supplier, cost FROM s UNION ALL SELECT 'demand', month, demand FROM m")
def accessor_dataset(spark, folder):
    """All parameters of a model as dense tables."""
    found = _model(spark, folder, _fulfilment()).yaml.dataset
    tables = [found[n].select(F.lit(n).alias("name"), F.col(d).alias("at"), "value") for n, d in (("cap", "supplier"), ("cost", "supplier"), ("demand", "month"))]
    return tables[0].union(tables[1]).union(tables[2])


@_query(_sql(_M) + "SELECT month FROM m")
def accessor_coords(spark, folder):
    """The coordinates of a model; what is taken out of the returned dict stays in the model."""
    model = _model(spark, folder, _fulfilment())
    model.yaml.coords.clear()
    return model.yaml.coords["month"].table.select("month")


@_query("SELECT * FROM (VALUES ('balance', 'constraint'), ('ship', 'variable')) AS t(name, kind)")
def accessor_schema(spark, folder):
    """The document that a model was built from; an extension doesn't change it."""
    model = _model(spark, folder, _fulfilment())
    model.yaml.extend({"constraints": {"least": {"foreach": ["month"], "equations": _equation("sum(ship, over=supplier) >= 0")}}})
    schema = model.yaml.schema
    rows = [(n, "variable") for n in schema.variables] + [(n, "constraint") for n in schema.constraints]
    return spark.createDataFrame(rows, "name string, kind string")


@_query("SELECT CAST(n_nationkey AS BIGINT) AS nation, CAST(count(c_custkey) AS DOUBLE) AS value FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def param_checked_table(spark, folder):
    """A table whose coordinates are held against the dimension's and found to be distinct and known."""
    tables = _Tables(spark, folder)
    counted = tables.read("customer").groupBy(F.col("c_nationkey").cast("bigint").alias("nation")).agg(F.count("*").cast("double").alias("value"))
    document = {"dimensions": {"nation": {"dtype": "int"}}, "parameters": {"customers": {"dims": ["nation"]}}}
    return Model.from_yaml(spark, document, data={"customers": counted}, coords={"nation": tables.nation()}).parameter("customers")


@_query(_sql(_M, _S) + ", n AS (SELECT count(*) AS n FROM m, s WHERE cap > 0) SELECT 0 AS section, n FROM n UNION ALL SELECT 2, count(*) FROM m UNION ALL SELECT 4, n FROM n")
def export_lp(spark, folder):
    """Lines of the LP text: objective, rows and bounds."""
    from .export import lp_lines

    lines = lp_lines(_model(spark, folder, _fulfilment())).where("place >= 0 and section in (0, 2, 4)")
    return lines.groupBy("section").agg(F.count("*").alias("n"))


# -- mistakes --------------------------------------------------------------------------


def _mistake(name: str, error: str, says: str, make: Callable[[SparkSession, str], object]) -> None:
    """A query of one row: the error that ``make`` raises, and whether its message holds ``says``."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        try:
            make(spark, folder)
        except Exception as found:  # noqa: BLE001 - which one it is, is the result
            return spark.createDataFrame([(type(found).__name__, says in str(found))], "error string, said boolean")
        return spark.createDataFrame([("none", False)], "error string, said boolean")

    run.__name__, run.__doc__ = name, f"{error}: ... {says} ..."
    _query(f"SELECT '{error}' AS error, true AS said")(run)


def _constrained(expression: str) -> Callable[[SparkSession, str], Model]:
    return lambda spark, folder: _model(spark, folder, _fulfilment(constraints={"wrong": {"foreach": ["month", "supplier"], "equations": _equation(expression)}}))


def _evaluated(expression: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: _model(spark, folder, _MONTH).evaluate(expression)


def _checked(table: Callable[[_Tables], DataFrame]) -> Callable[[SparkSession, str], Model]:
    def make(spark: SparkSession, folder: str) -> Model:
        tables = _Tables(spark, folder)
        document = {"dimensions": {"region": {"dtype": "int"}}, "parameters": {"a": {"dims": ["region"]}}}
        return Model.from_yaml(spark, document, data={"a": table(tables)}, coords={"region": tables.region()})

    return make


_mistake("error_not_parsed", "ValueError", "Failed to parse", _evaluated("demand +* 2"))
_mistake("error_unknown_name", "NameError", "nothing", _evaluated("demand + nothing"))
_mistake("error_unknown_helper", "NameError", "Unknown helper", _evaluated("strange(demand)"))
_mistake("error_sum_without_over", "TypeError", "over", _evaluated("sum(demand)"))
_mistake("error_roll_two_shifts", "TypeError", "exactly one", _evaluated("roll(demand, month=1, hour=2)"))
_mistake("error_roll_number", "TypeError", "numbers", _evaluated("roll(3, month=1)"))
_mistake("error_not_linear", "NotLinearError", "ship * ship <= 1", _constrained("ship * ship <= 1"))
_mistake("error_no_comparison", "ValueError", "exactly one comparison", _constrained("ship + 1"))
_mistake("error_no_variable", "ValueError", "cap <= cost", _constrained("cap <= cost"))
_mistake("error_keyword_as_name", "ValueError", "AND", lambda spark, folder: _model(spark, folder, _MONTH).mask("AND"))
_mistake("error_strange_dimension", "ValueError", "nation", _checked(lambda t: t.read("nation").select(F.col("n_nationkey").alias("nation"), F.lit(1.0).alias("value"))))
_mistake("error_strange_coordinate", "ValueError", "not in the master coordinate", _checked(lambda t: t.read("nation").select(F.col("n_nationkey").cast("bigint").alias("region"), F.lit(1.0).alias("value"))))
_mistake("error_repeated_coordinate", "ValueError", "several values", _checked(lambda t: t.read("nation").select(F.col("n_regionkey").cast("bigint").alias("region"), F.lit(1.0).alias("value"))))
_mistake("error_not_from_yaml", "AttributeError", "not built from YAML", lambda spark, folder: Model(spark).yaml)
