"""Models as LP text: one line of text per row, written by the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import Model


def _number(c: Column) -> Column:
    infinite = F.when(c == float("inf"), F.lit("+inf")).when(c == float("-inf"), F.lit("-inf"))
    return infinite.otherwise(F.format_string("%.17g", c))


def _term() -> Column:
    return F.concat(F.when(F.col("coeff") < 0, F.lit("- ")).otherwise(F.lit("+ ")), _number(F.abs("coeff")), F.lit(" x"), F.col("label").cast("string"))


def _sums(terms: DataFrame, *keys: str) -> DataFrame:
    """Each group's terms in the order of their labels, as text."""
    parts = terms.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("label", _term().alias("text")))).alias("parts"))
    return parts.select(*keys, F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))


def lp_lines(model: Model) -> DataFrame:
    """(section, place, text): the lines of an LP file; sorted by the first two columns they make one.

    A row's terms are gathered in its line, so a row must fit in memory; the objective has a line for each term.
    """
    rows = model.all_rows()
    sums = _sums(model.all_terms(), "row_id")
    text = F.coalesce("text", F.lit("0 x0"))  # a row without terms still says something
    named = rows.join(sums, "row_id", "left").select(F.lit(2).alias("section"), F.col("row_id").alias("place"), F.concat(F.lit(" c"), F.col("row_id").cast("string"), F.lit(": "), text, F.lit(" "), "sign", F.lit(" "), _number(F.col("rhs"))).alias("text"))
    cells = model.all_variables()
    bounds = cells.select(F.lit(4).alias("section"), F.col("label").alias("place"), F.concat(F.lit(" "), _number(F.col("lower")), F.lit(" <= x"), F.col("label").cast("string"), F.lit(" <= "), _number(F.col("upper"))).alias("text"))
    kinds = [cells.where(F.col("vtype") == kind).select(F.lit(section).alias("section"), F.col("label").alias("place"), F.concat(F.lit(" x"), F.col("label").cast("string")).alias("text")) for kind, section in (("integer", 6), ("binary", 8))]
    heads = [(1, "Subject To"), (3, "Bounds"), (5, "General"), (7, "Binary"), (9, "End")]
    sense = "Minimize" if model.objective is None or model.objective.sense == "min" else "Maximize"
    fixed = model.spark.createDataFrame([(-1, -1, sense), *((s, -1, t) for s, t in heads)], "section int, place long, text string")
    out = fixed.unionByName(named).unionByName(bounds)
    for kind in kinds:
        out = out.unionByName(kind)
    if model.objective is not None:
        out = out.unionByName(model.objective_terms().select(F.lit(0).alias("section"), F.col("label").alias("place"), F.concat(F.lit(" "), _term()).alias("text")))
        constant = model.objective.offset.where("value <> 0").select(F.concat(F.when(F.col("value") < 0, F.lit(" - ")).otherwise(F.lit(" + ")), _number(F.abs("value"))).alias("text"))
        out = out.unionByName(constant.select(F.lit(0).alias("section"), F.lit((1 << 63) - 1).alias("place"), "text"))
    return out


def write_lp(model: Model, path: str) -> None:
    """Write LP text as sorted part files in a folder."""
    lp_lines(model).repartitionByRange("section", "place").sortWithinPartitions("section", "place").select("text").write.text(path)
