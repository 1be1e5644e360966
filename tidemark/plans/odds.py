"""Bookmaker odds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import odds as op
from ..sources.tables import micros, read
from ._base import Family

FAMILY = Family()
query = FAMILY.query

NOW = 1_706_140_800_000_000
_ENTRIES = "WITH e AS (SELECT user_id AS market, event_type AS book, epoch_us(ts) AS created, event_id AS seq, (props->>'k')::INT % 3 <> 0 AS active, round(1 + value / 100, 4) AS price FROM events)"


def entries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("market"), F.col("event_type").alias("book"), micros("ts").alias("created"), F.col("event_id").alias("seq"),
        (F.get_json_object("props", "$.k").cast("int") % 3 != 0).alias("active"), F.round(1 + F.col("value") / 100, 4).alias("price"),
    )


_LINES = f""", l AS (SELECT market, book, arg_max(price, (created, seq)) AS last_price, arg_max(active, (created, seq)) AS last_active, arg_max(price, (created, seq)) FILTER (active) AS price, max(created) FILTER (active) AS created FROM e WHERE created <= {NOW} GROUP BY market, book),
s AS (SELECT *, ({NOW} - created) / 1000000.0 AS stale FROM l)"""


@query(_ENTRIES + _LINES + """, f AS (SELECT *, CASE WHEN price > 1 THEN 1 / price END AS implied FROM s)
SELECT market, book, last_price, last_active, price, stale, round(implied / sum(implied) OVER (PARTITION BY market), 6) AS fair, round(sum(implied) OVER (PARTITION BY market), 6) AS overround FROM f""")
def odds_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-42: the line at an instant and its fair probability."""
    rows = op.fair(op.line_at(entries_of(spark, sf_dir), ["market", "book"], NOW), ["market"])
    return rows.select("market", "book", "last_price", "last_active", "price", "stale", F.round("fair", 6).alias("fair"), F.round("overround", 6).alias("overround"))


@query(_ENTRIES + _LINES + "\nSELECT market, round(median(price) FILTER (stale <= 86400), 6) AS consensus, count(*) FILTER (stale <= 86400) AS used, count(*) AS books FROM s GROUP BY market")
def odds_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-42."""
    rows = op.consensus(op.line_at(entries_of(spark, sf_dir), ["market", "book"], NOW), ["market"], 86_400)
    return rows.withColumn("consensus", F.round("consensus", 6))


_BLOCKS = """, w AS (SELECT *, NOT active AS off, lag(price) OVER k AS before, lead(price) OVER k AS after, lag(NOT active) OVER k AS p FROM e WINDOW k AS (PARTITION BY market, book ORDER BY created, seq)),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR off <> p THEN 1 ELSE 0 END) OVER (PARTITION BY market, book ORDER BY created, seq) AS island FROM w),
b AS (SELECT market, book, min(created) AS "start", max(created) AS "end", count(*) AS n, first(before ORDER BY created, seq) AS before, first(after ORDER BY created DESC, seq DESC) AS after FROM i WHERE off GROUP BY market, book, island)"""


@query(_ENTRIES + _BLOCKS + '\nSELECT *, before IS NOT NULL AND after IS NOT NULL AS enclosed FROM b')
def suspension_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-43, W-6."""
    return op.suspensions(entries_of(spark, sf_dir), ["market", "book"])


@query(_ENTRIES + _BLOCKS + """
SELECT a.market, a.book AS a_book, a."start" AS a_start, a."end" AS a_end, array_to_string(list_sort(list(DISTINCT b2.book)), ',') AS books FROM b a JOIN b b2 ON a.market = b2.market AND a.book <> b2.book AND a."start" - 3600000000 <= b2."end" AND b2."start" - 3600000000 <= a."end" GROUP BY ALL""")
def coincident_suspensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-24."""
    rows = op.coincident(op.suspensions(entries_of(spark, sf_dir), ["market", "book"]), "market", "book", 3_600_000_000)
    return rows.withColumn("books", F.array_join("books", ","))
