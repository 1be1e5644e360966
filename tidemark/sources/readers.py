"""Readers of landed API records and files, and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a market record that the engine reads.
MARKET = "id bigint, resolved boolean, closed boolean, volume string, outcomePrices string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line, with a stated schema."""
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def markdown_blocks(spark: SparkSession, path: str, pattern: str, group: int = 1) -> DataFrame:
    """(path, place, block): every match of the pattern in whole text files."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return files.select("path", F.posexplode(F.regexp_extract_all("value", F.lit(pattern), group)).alias("place", "block"))


def market_records(records: DataFrame, body: str = "body") -> DataFrame:
    """Typed rows of JSON market records: market_id, status, volume, yes. What cannot be read is null."""
    r = F.from_json(body, MARKET)
    rows = records.select(r.alias("r"))
    prices = F.from_json(F.col("r.outcomePrices"), "array<string>")
    status = F.when(F.col("r.resolved"), "resolved").when(F.col("r.closed"), "closed").otherwise("active")
    yes = F.try_element_at(prices, F.lit(1)).try_cast("double")
    return rows.select(F.col("r.id").alias("market_id"), status.alias("status"), F.col("r.volume").try_cast("double").alias("volume"), yes.alias("yes"))


def start_time(text: Column) -> Column:
    """A timestamp in one of the forms that records use; null if none fits."""
    repaired = F.regexp_replace(F.regexp_replace(text, r"\+00$", "+00:00"), " ", "T")
    return F.coalesce(text.try_cast("timestamp"), repaired.try_cast("timestamp"))


def align(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The known columns of ``columns`` only: unknown ones are dropped, as a store without them would refuse them."""
    return df.select(*[c for c in columns if c in df.columns])


def append(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Append as Parquet, partitioned by the given columns."""
    df.write.mode("append").partitionBy(*partition).parquet(path)
