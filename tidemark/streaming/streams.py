"""Streams of quotes and events: deduplication, windows, late rows, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_folder


def work_dir(spark: SparkSession, name: str) -> str:
    return new_folder(spark, f"stream-{name}")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored events as a stream; ts becomes a timestamp, on which watermarks can be set."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a single file is a stream of its folder with a name filter; a folder is one already
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    rows = reader.parquet(path) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def deduplicated(events: DataFrame, key: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark's delay; overlapping reads of a source do no harm."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """n and total of each kind in each window of event time."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.groupBy(window, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """n of each user's sessions, which end after a gap."""
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def _stored(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the parts that stand whole in a folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(target):
        return []
    whole = [f.getPath() for f in store.listStatus(target) if store.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("part-")) for p in whole)


def _run(stream: DataFrame, mode: str, base: str, write: Callable[[DataFrame, int], None]) -> None:
    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()


def run_to_table(stream: DataFrame, name: str, mode: str, base: str | None = None) -> DataFrame:
    """Run the stream over all that is there and return its result, which is stored and never sent to the driver.

    Each batch is a part of its own, written anew if it is repeated; in complete mode the last one is the result.
    A later call with the same ``base`` goes on from the checkpoint there.
    """
    spark = stream.sparkSession
    base = base or work_dir(spark, name)
    _run(stream, mode, base, lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/out/part-{number}"))
    parts = _stored(spark, f"{base}/out")
    paths = [f"{base}/out/part-{n}" for n in (parts[-1:] if mode == "complete" else parts)]
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


def run_upserts(stream: DataFrame, name: str, key: str, base: str | None = None) -> DataFrame:
    """The last row of each key: every batch merges with the newest stored version before it.

    The version is found in the store, so a restart with the same ``base`` goes on from the table so far,
    and a repeated batch merges with the same version again.
    """
    spark = stream.sparkSession
    base = base or work_dir(spark, name)
    last = lambda rows: rows.groupBy(key).agg(F.max_by(F.struct(*stream.columns), F.struct("ts", "event_id")).alias("r")).select("r.*")

    def merge(batch: DataFrame, number: int) -> None:
        before = [n for n in _stored(spark, f"{base}/out") if n < number]
        rows = last(batch)
        if before:
            rows = last(batch.sparkSession.read.schema(stream.schema).parquet(f"{base}/out/part-{before[-1]}").unionByName(rows))
        rows.write.mode("overwrite").parquet(f"{base}/out/part-{number}")

    _run(stream, "append", base, merge)
    parts = _stored(spark, f"{base}/out")
    return spark.read.schema(stream.schema).parquet(f"{base}/out/part-{parts[-1]}") if parts else spark.createDataFrame([], stream.schema)


def late_rows(events: DataFrame, watermark: Column) -> DataFrame:
    """Rows older than a watermark, marked rather than lost."""
    return events.withColumn("late", F.col("ts") < watermark)
