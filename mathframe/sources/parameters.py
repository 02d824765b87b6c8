"""Parameters: numbers, dicts, pandas objects, arrays and Spark tables become sparse tables.

A parameter is a table of ordinals and values; a cell without a row is missing.  A single
number for a parameter with dimensions stays a number until something needs its cells.
"""

from __future__ import annotations

import numbers
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..document import MathSchema
from ..document import Parameter as Declared
from .coords import SPARK_TYPES, Dim, coerce, ordinal, plain


@dataclass(frozen=True)
class Param:
    """``table`` has the ordinals of ``dims`` and value (never missing); or ``number`` holds everywhere."""

    name: str
    dims: tuple[str, ...]
    dtype: str
    table: DataFrame | None = None
    number: Any = None

    def stored(self, master: Mapping[str, Dim]) -> DataFrame:
        """The cells that have a value."""
        if self.table is not None:
            return self.table
        spark = next(iter(master.values())).table.sparkSession
        from ..plans.grids import full_grid

        return full_grid(spark, master, self.dims).withColumn("value", F.lit(self.number))

    def dense(self, master: Mapping[str, Dim]) -> DataFrame:
        """All cells in coordinate values; missing ones are null."""
        from ..plans.grids import full_grid, with_values

        spark = next(iter(master.values())).table.sparkSession
        grid = full_grid(spark, master, self.dims)
        held = grid.join(self.stored(master), [ordinal(d) for d in self.dims], "left") if self.dims else self.stored(master)
        return with_values(held, master, self.dims).select(*self.dims, "value")


def load_parameters(spark: SparkSession, schema: MathSchema, data: Mapping[str, Any] | None, master: Mapping[str, Dim], *, check_tables: bool = True) -> dict[str, Param]:
    """All declared parameters; presence and unknown keys are checked before any value is read."""
    given = dict(data or {})
    for name in schema.parameters:
        if name not in given:
            raise ValueError(f"Parameter '{name}' is required but data= doesn't hold it.")
    unknown = sorted(set(given) - set(schema.parameters))
    if unknown:
        raise ValueError(f"Keys of data= that are not declared as parameters: {unknown}.")
    return {name: _load(spark, name, declared, given[name], master, check_tables) for name, declared in schema.parameters.items()}


def _load(spark: SparkSession, name: str, declared: Declared, raw: Any, master: Mapping[str, Dim], check_tables: bool) -> Param:
    dims, what = tuple(declared.dims), f"Parameter '{name}'"
    if isinstance(raw, np.ndarray) and raw.ndim == 0:
        raw = raw.item()
    if isinstance(raw, (numbers.Number, np.number)) and not isinstance(raw, np.bool_):
        value = coerce(raw, declared.dtype, what)
        if value is None:
            return Param(name, dims, declared.dtype, _table(spark, dims, declared.dtype, []))
        return Param(name, dims, declared.dtype, number=value)
    if isinstance(raw, DataFrame):
        return _from_table(name, declared, raw, master, check_tables)
    if isinstance(raw, Mapping):
        _need_dims(what, "dict", dims, 1)
        raw = pd.Series(list(raw.values()), index=pd.Index(list(raw.keys()), name=dims[0], tupleize_cols=False), dtype=object)
    if isinstance(raw, pd.Series):
        _need_dims(what, "Series", dims, 1)
        index = raw.index.name or dims[0]
        return _from_cells(spark, name, declared, (index,), [((k,), v) for k, v in zip(raw.index, raw.to_numpy(dtype=object))], master)
    if isinstance(raw, pd.DataFrame):
        _need_dims(what, "DataFrame", dims, 2)
        found = (raw.index.name or dims[0], raw.columns.name or dims[1])
        values = raw.to_numpy(dtype=object)
        cells = [((r, c), values[i, j]) for i, r in enumerate(raw.index) for j, c in enumerate(raw.columns)]
        return _from_cells(spark, name, declared, found, cells, master)
    if isinstance(raw, (list, np.ndarray)):
        listed = np.asarray(raw, dtype=object)
        if listed.ndim != 1 or len(dims) != 1:
            raise ValueError(f"{what}: unsupported type ndarray of {listed.ndim} dimensions for dims {list(dims)}; use a table with named columns.")
        dim = master[dims[0]]
        if len(listed) != dim.size:
            raise ValueError(f"{what}: array length {len(listed)} does not match the {dim.size} values of dimension '{dim.name}'.")
        rows = [(i, coerce(v, declared.dtype, what)) for i, v in enumerate(listed)]
        return Param(name, dims, declared.dtype, _table(spark, dims, declared.dtype, rows))
    raise TypeError(f"{what}: unsupported type '{type(raw).__name__}'.")


def _need_dims(what: str, kind: str, dims: tuple[str, ...], count: int) -> None:
    if len(dims) != count:
        raise ValueError(f"{what}: {kind} input is for {count}-D parameters; declared dims are {list(dims)}.")


def _unexpected(what: str, found, dims: tuple[str, ...]) -> None:
    extra = sorted(set(found) - set(dims))
    if extra:
        raise ValueError(f"{what} has unexpected dimensions {extra}; declared dims are {list(dims)}.")


def _table(spark: SparkSession, dims: tuple[str, ...], dtype: str, rows: list) -> DataFrame:
    fields = [T.StructField(ordinal(d), T.IntegerType(), False) for d in dims]
    schema = T.StructType([*fields, T.StructField("value", SPARK_TYPES[dtype])])
    return spark.createDataFrame([r for r in rows if r[-1] is not None], schema)


def _from_cells(spark: SparkSession, name: str, declared: Declared, found: tuple[str, ...], cells: list, master: Mapping[str, Dim]) -> Param:
    """A parameter from local cells ((value of each dim), value)."""
    what, dims = f"Parameter '{name}'", tuple(declared.dims)
    _unexpected(what, found, dims)
    places = []
    for k, dim_name in enumerate(found):
        dim = master[dim_name]
        if dim.values is None:
            dim_rows = dim.table.where(F.col(f"`{dim_name}`").isin([plain(key[k]) for key, _ in cells])).collect()
            place = {r[dim_name]: r[ordinal(dim_name)] for r in dim_rows}
        else:
            place = {v: i for i, v in enumerate(dim.values)}
        keys = {key[k]: _same_type(key[k], dim.dtype) for key, _ in cells}
        strange = sorted({str(plain(raw)) for raw, as_dim in keys.items() if as_dim not in place})
        if strange:
            raise ValueError(f"{what} has values in dimension '{dim_name}' that are not in the master coordinate: {strange}.")
        places.append({raw: place[as_dim] for raw, as_dim in keys.items()})
    rows = [(*(places[k][key[k]] for k in range(len(found))), coerce(v, declared.dtype, what)) for key, v in cells]
    if len({r[:-1] for r in rows}) < len(rows):
        raise ValueError(f"{what} has two values at one coordinate.")
    order = [found.index(d) for d in dims]
    rows = [(*(r[k] for k in order), r[-1]) for r in rows]
    return Param(name, dims, declared.dtype, _table(spark, dims, declared.dtype, rows))


def _same_type(value: Any, dtype: str) -> Any:
    """A key as the dimension's type, or as it is if that can't be."""
    try:
        return coerce(value, dtype, "key")
    except ValueError:
        return plain(value)


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _from_table(name: str, declared: Declared, raw: DataFrame, master: Mapping[str, Dim], check_tables: bool) -> Param:
    """A parameter from a Spark table with a column for each dimension and one other, the value.

    Dimensions that the table lacks hold for all their values.  Coordinates must be distinct.
    """
    what, declared_dims = f"Parameter '{name}'", tuple(declared.dims)
    value_column = "value" if "value" in raw.columns else name
    if value_column not in raw.columns:
        others = [c for c in raw.columns if c not in declared_dims]
        if len(others) != 1:
            raise ValueError(f"{what}: the table needs a column 'value' or '{name}'.")
        value_column = others[0]
    _unexpected(what, [c for c in raw.columns if c != value_column], declared_dims)
    dims = tuple(d for d in declared_dims if d in raw.columns)
    of = raw.schema[value_column].dataType
    fits = {"float": _NUMERIC, "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "bool": (T.BooleanType,), "str": (T.StringType,)}[declared.dtype]
    if not isinstance(of, fits):
        raise ValueError(f"{what}: a column of type {of.simpleString()} can't be read as {declared.dtype}.")
    value = F.col(f"`{value_column}`").cast(SPARK_TYPES[declared.dtype])
    if declared.dtype == "float":
        value = F.nanvl(value, F.lit(None).cast("double"))
    table = raw.select(*(F.col(f"`{d}`").alias(d) for d in dims), value.alias("value")).where("value is not null")
    if check_tables:
        twice = table.groupBy(*(F.col(f"`{d}`") for d in dims)).count().where("count > 1").limit(10).collect()
        if twice:
            raise ValueError(f"{what} has several values at the same coordinates: {[tuple(r)[:-1] for r in twice]}.")
    for d in dims:
        dim = master[d]
        if check_tables:
            strange = table.join(dim.spread, d, "left_anti").select(d).distinct().limit(10).collect()
            if strange:
                raise ValueError(f"{what} has values in dimension '{d}' that are not in the master coordinate: {sorted(str(r[0]) for r in strange)}.")
        table = table.join(dim.spread, d)
    return Param(name, dims, declared.dtype, table.select(*(ordinal(d) for d in dims), "value"))
