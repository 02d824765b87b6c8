"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a new folder is set, which only one machine can do."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="mathframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Scratch:
    """Names tables of one run, and removes those that later steps replaced.

    With ``release`` the shuffle files of a table go as soon as it is written, not at some later collection of garbage.
    """

    def __init__(self, spark: SparkSession, release: bool = False):
        self.spark, self.release = spark, release
        self.folder = f"{shared_folder(spark)}/mathframe-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again: lost executors cost no more than the reading."""
        path = f"{self.folder}/{name}"
        before = self.spark.conf.get(_CLEANUP, None)
        try:
            if self.release:
                self.spark.conf.set(_CLEANUP, "true")
            df.write.mode("overwrite").parquet(path)
        finally:
            if self.release:
                self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        for name in names:
            self._remove(name)

    def _remove(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
