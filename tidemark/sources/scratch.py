"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``; where it is unset a temporary one, for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Stored:
    """A table written once to the shared folder, which cuts the lineage as a checkpoint does but computes its rows once."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark, self.path = df.sparkSession, new_folder(df.sparkSession, name)
        df.write.parquet(self.path)
        self.table = self.spark.read.schema(df.schema).parquet(self.path)

    def delete(self) -> None:
        """Take it off the folder, when no later plan reads it."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
