"""Grids of ordinals, and numbers for their cells."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.coords import SMALL_DIMENSION, Dim, ordinal


def full_grid(spark: SparkSession, master: Mapping[str, Dim], dims: Iterable[str]) -> DataFrame:
    """All combinations of the dimensions' ordinals.

    The cells are one range whose numbers are split into ordinals: there is no join, and Spark deals
    the range evenly, whatever the sizes of the dimensions.
    """
    dims = list(dims)
    size = grid_size(master, dims)
    cells = spark.range(size)
    out, stride = [], 1
    for d in reversed(dims):
        out.insert(0, F.pmod(F.floor(F.col("id") / stride) if stride > 1 else F.col("id"), F.lit(max(1, master[d].size))).cast("int").alias(ordinal(d)))
        stride *= max(1, master[d].size)
    return cells.select(*out)


def grid_size(master: Mapping[str, Dim], dims: Iterable[str]) -> int:
    size = 1
    for d in dims:
        size *= master[d].size
    return size


def extended(rows: DataFrame, master: Mapping[str, Dim], dims: Iterable[str]) -> DataFrame:
    """The rows with every combination of further dimensions."""
    for d in dims:
        size = master[d].size
        if size <= SMALL_DIMENSION:
            each = F.explode(F.sequence(F.lit(0), F.lit(size - 1))) if size else F.explode(F.array().cast("array<int>"))
            rows = rows.select("*", each.alias(ordinal(d)))
        else:
            rows = rows.crossJoin(master[d].ordinals())
    return rows


def cell_number(master: Mapping[str, Dim], dims: Iterable[str], base: int = 0) -> Column:
    """Mixed-radix number of a cell, the last dimension counting fastest."""
    number, stride = F.lit(base).cast("bigint"), 1
    for d in reversed(list(dims)):
        number = number + F.col(ordinal(d)).cast("bigint") * F.lit(stride).cast("bigint")
        stride *= max(1, master[d].size)
    return number


def with_values(rows: DataFrame, master: Mapping[str, Dim], dims: Iterable[str]) -> DataFrame:
    """Add the coordinate values of the ordinals."""
    for d in dims:
        rows = rows.join(master[d].spread, ordinal(d))
    return rows


def ordinals(dims: Iterable[str]) -> list[str]:
    return [ordinal(d) for d in dims]
