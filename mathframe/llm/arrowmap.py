"""Columns appended to a DataFrame by a function of one Arrow column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shipping import ship_package


def quoted(name: str) -> Column:
    """The column of this very name, whatever signs it holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df``, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def append_columns(df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """Append ``fields`` computed from ``column``; columns of these names are replaced.

    ``make`` runs once in each task and returns the function of a batch's column.
    """
    ship_package(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    if column.lower() in new:
        raise ValueError(f"column '{column}' is an input and can't also be an output")
    at = [f.name for f in kept].index(column)
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *function(batch.column(at))], names=[*names, *(f.name for f in fields)])

    # Python's mapInArrow looks columns up by name, which fails for names with dots.
    return df.select(*(quoted(n).alias(f"c{i}") for i, n in enumerate(names))).mapInArrow(run, schema)
