"""Streams, run over the stored events; results equal those of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import streams as op
from ._base import Family

FAMILY = Family()
query = FAMILY.query


@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-5: counters of tumbling windows, in complete mode so that the last window is there too."""
    rows = op.run_to_table(op.tumbling(op.event_stream(spark, sf_dir), "1 hour"), "tumbling", "complete")
    return rows.select(F.unix_micros("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-1, R-2: rows that come twice are dropped within the watermark."""
    events = op.event_stream(spark, sf_dir)
    rows = op.run_to_table(op.deduplicated(events.unionByName(events), "event_id", "40 days"), "deduplicated", "append")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-7, S-11: the last row of each key, merged batch by batch."""
    return op.run_upserts(op.event_stream(spark, sf_dir), "latest", "user_id").select("user_id", "event_type", "value", "event_id")


@query("""
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, g, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
  SELECT *, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR)::INT AS new FROM events)) GROUP BY user_id, g) GROUP BY user_id
""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-14, an extension: session windows."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = op.sessions(events, "6 hours")
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT ts < TIMESTAMP '2024-01-10' AS late, count(*) AS n FROM events GROUP BY late")
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-3: late rows are marked and counted."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return op.late_rows(events, F.lit("2024-01-10 00:00:00").cast("timestamp")).groupBy("late").agg(F.count("*").alias("n"))
