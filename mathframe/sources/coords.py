"""Master coordinates: the ordered index of each dimension.

A dimension is a table of its ordinals and values.  Lists keep their order; values from a
Spark table are made distinct and sorted, and numbered without gathering them.
"""

from __future__ import annotations

import datetime as dt
import itertools
import tempfile
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..document import MathSchema

# Column types of declared types.
SPARK_TYPES = {"float": T.DoubleType(), "int": T.LongType(), "str": T.StringType(), "datetime": T.TimestampNTZType(), "bool": T.BooleanType()}
#: Dimensions up to this size may be broadcast and numbered in one window.
SMALL_DIMENSION = 100_000


def ordinal(dim: str) -> str:
    """Name of a dimension's ordinal column."""
    return f"o_{dim}"


@dataclass(frozen=True)
class Dim:
    """``table`` has the columns o_<name> (int, from 0) and <name>; ``values`` are kept if local."""

    name: str
    dtype: str
    size: int
    table: DataFrame
    values: list | None = None

    @property
    def spread(self) -> DataFrame:
        """The table, marked for broadcast if it is small."""
        return F.broadcast(self.table) if self.size <= SMALL_DIMENSION else self.table

    def ordinals(self) -> DataFrame:
        """The ordinals alone: no value is read."""
        return self.table.sparkSession.range(self.size).select(F.col("id").cast("int").alias(ordinal(self.name)))


def plain(value: Any) -> Any:
    """A Python value for a numpy or pandas scalar; missing ones are None."""
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    if hasattr(value, "item") and not isinstance(value, (str, bytes)):
        value = value.item()
    if value is None or value is pd.NaT or isinstance(value, float) and value != value:
        return None
    return value


def coerce(value: Any, dtype: str, what: str) -> Any:
    """The value as the declared type, if nothing is lost by it."""
    value = plain(value)
    if value is None:
        return None
    if dtype == "float" and isinstance(value, (int, float)):
        return float(value)
    if dtype == "int" and isinstance(value, (int, float)) and float(value).is_integer():
        return int(value)
    if dtype == "bool" and isinstance(value, (bool, int, float)) and value in (0, 1):
        return bool(value)
    if dtype == "str" and not isinstance(value, (list, dict)):
        return value if isinstance(value, str) else str(value)
    if dtype == "datetime" and isinstance(value, (dt.datetime, dt.date, str)):
        return pd.Timestamp(value).to_pydatetime()
    raise ValueError(f"{what}: {value!r} can't be read as {dtype}")


def natural_type(values: list, declared: str) -> str:
    """The declared type, or for undeclared text the type that the values have."""
    if declared == "str" and values and all(isinstance(plain(v), int) and not isinstance(plain(v), bool) for v in values):
        return "int"
    if declared == "str" and values and all(isinstance(plain(v), float) for v in values):
        return "float"
    if declared == "str" and values and all(isinstance(plain(v), (dt.datetime, dt.date)) for v in values):
        return "datetime"
    return declared


def local_dim(spark: SparkSession, name: str, dtype: str, values: list) -> Dim:
    dtype = natural_type(values, dtype)
    listed = [coerce(v, dtype, f"Dimension '{name}'") for v in values]
    if None in listed:
        raise ValueError(f"Dimension '{name}' has a missing value")
    if len(set(listed)) < len(listed):
        raise ValueError(f"Dimension '{name}' has a value twice")
    schema = T.StructType([T.StructField(ordinal(name), T.IntegerType(), False), T.StructField(name, SPARK_TYPES[dtype], False)])
    return Dim(name, dtype, len(listed), spark.createDataFrame(list(enumerate(listed)), schema), listed)


def numbered(values: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct sorted values with ordinals: numbered within ranges, which start where the last ended."""
    spark = values.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="mathframe-")
    path = f"{folder.rstrip('/')}/mathframe-dim-{uuid.uuid4().hex}"
    ranges = values.repartitionByRange(F.col(column)).select(F.spark_partition_id().alias("part"), F.col(column).alias("value"))
    ranges.write.parquet(path)  # the ranges must not be drawn anew
    ranges = spark.read.schema(ranges.schema).parquet(path)
    counts = {r.part: r["count"] for r in ranges.groupBy("part").count().collect()}
    starts = dict(zip(sorted(counts), itertools.accumulate([0, *(counts[p] for p in sorted(counts))])))
    table = spark.createDataFrame(list(starts.items()), "part int, start long")
    within = ranges.withColumn("at", F.row_number().over(W.partitionBy("part").orderBy("value")) - 1)
    return within.join(F.broadcast(table), "part").select((F.col("start") + F.col("at")).cast("int").alias(ordinal(name)), F.col("value").alias(name))


def table_dim(name: str, dtype: str, source: DataFrame) -> Dim:
    """A dimension from the column of its name in a table (or the only column)."""
    column = name if name in source.columns else source.columns[0]
    if column != name and len(source.columns) > 1:
        raise ValueError(f"Dimension '{name}': the table has no column of this name")
    found = {v: k for k, v in SPARK_TYPES.items()}.get(source.schema[column].dataType)
    if found is None:
        found = "int" if isinstance(source.schema[column].dataType, (T.IntegerType, T.ShortType, T.ByteType)) else dtype
    values = source.select(F.col(f"`{column}`").cast(SPARK_TYPES[found]).alias("v")).where("v is not null").distinct()
    size = values.count()
    if size > SMALL_DIMENSION:
        table = numbered(values, "v", name)
    else:
        table = values.select((F.row_number().over(W.orderBy("v")) - 1).cast("int").alias(ordinal(name)), F.col("v").alias(name))
    return Dim(name, found, size, table)


def build_master_coords(spark: SparkSession, schema: MathSchema, coords: Mapping[str, Any] | None = None, existing: Mapping[str, Dim] | None = None) -> dict[str, Dim]:
    """The dimensions of a document: ``coords`` come before values of the document; existing ones stay."""
    given, master = dict(coords or {}), dict(existing or {})
    for name, declared in schema.dimensions.items():
        if name in master:
            continue
        source = given.get(name, declared.values)
        if source is None:
            raise ValueError(f"Dimension '{name}' has no values. Give them in the document (dimensions.{name}.values) or as coords={{'{name}': [...]}}.")
        if isinstance(source, Dim):
            master[name] = source
        elif isinstance(source, DataFrame):
            master[name] = table_dim(name, declared.dtype, source)
        else:
            master[name] = local_dim(spark, name, declared.dtype, list(source))
    return master


def value_of(dim: str) -> Column:
    return F.col(f"`{dim}`")
