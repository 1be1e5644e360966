"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column that :func:`with_row_key` adds.
ROW = "_tidemark_row"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a temporary folder serves a local master; a cluster needs the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def write_table(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet below the shared folder and return its path.

    A written table cuts the lineage: a lost executor costs only the tasks that
    ran on it, and later readers scan just the columns they need.
    """
    path = f"{shared_dir(df.sparkSession)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = write_table(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tidemark_path = path
    return out


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with the long ``ROW``: another one for every row, in the order of doc_id, nulls first.

    Where every row has a doc_id of its own that is the key. Else the rows are written once,
    sorted by doc_id and a hash of the text, and numbered as they are written.
    """
    key = F.col("doc_id").cast("long")
    if not docs.groupBy(key.alias("key")).agg(F.count("*").alias("n")).filter("n > 1 OR key IS NULL").head(1):
        return docs.withColumn(ROW, key)
    ordered = docs.orderBy(key.asc_nulls_first(), F.xxhash64("text"))
    return stored(ordered.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote and that no later plan reads."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(table.tidemark_path)
        target.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    for _ in range(2):  # what the first run finds unreachable may hold more
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
