"""Bounded samples of rows, chosen by a hash of their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as empty)."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds


def sample_labelled(rows: DataFrame, id_column: str, most: int) -> DataFrame:
    """At most ``most`` distinct ids, those with the least hashes; a bounded table."""
    ids = rows.where(F.col(id_column).isNotNull()).select(id_column).distinct()
    taken = ids.orderBy(F.xxhash64(F.lit(11), F.col(id_column)), id_column).limit(most).collect()
    return rows.sparkSession.createDataFrame(taken, ids.schema)


def sample_rows(docs: DataFrame, ids: DataFrame, id_column: str, most: int) -> DataFrame:
    """The rows of ``docs`` with these ids, one for each id and ``most`` in all.

    ``ids`` comes from ``sample_labelled``, so it may be broadcast whatever the input's size.
    """
    return docs.join(F.broadcast(ids), id_column).dropDuplicates([id_column]).limit(most)
