"""Adapters that give the stored tables the shapes the operators work on.

Each adapter has a DuckDB twin in ``CTE``, the same arithmetic as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CTE: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (session zone UTC)."""
    return F.unix_micros(F.col(column).cast("timestamp"))


CTE["quotes"] = """quotes AS (
  SELECT user_id::VARCHAR AS event_id, event_type AS outcome, epoch_us(ts) AS tick,
    CASE WHEN k % 10 <> 0 THEN round(value / 500 - 0.01, 4) END AS bid,
    CASE WHEN k % 10 <> 1 THEN round(value / 500 + 0.01, 4) END AS ask,
    CASE WHEN k % 10 NOT IN (0, 1) THEN round(value / 500, 4) END AS mid,
    round(value * 100, 2) AS volume_24h, k * 1000.0::DOUBLE AS liquidity, event_id AS seq
  FROM (SELECT *, (props->>'k')::INT AS k FROM events)
)"""


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided quotes: event_id, outcome, tick (microseconds), bid, ask, mid, volume_24h, liquidity, seq."""
    rows = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    base = F.col("value") / 500
    return rows.select(
        F.col("user_id").cast("string").alias("event_id"), F.col("event_type").alias("outcome"), micros("ts").alias("tick"),
        F.when(k % 10 != 0, F.round(base - 0.01, 4)).alias("bid"), F.when(k % 10 != 1, F.round(base + 0.01, 4)).alias("ask"),
        F.when(~(k % 10).isin(0, 1), F.round(base, 4)).alias("mid"), F.round(F.col("value") * 100, 2).alias("volume_24h"),
        (k * F.lit(1000.0)).alias("liquidity"), F.col("event_id").alias("seq"),
    )


CTE["points"] = """points AS (
  SELECT l_orderkey AS match_id, l_linenumber AS checkpoint, epoch_us(l_shipdate::TIMESTAMP) AS as_of, l_linestatus AS version,
    round(abs(l_discount) * 100) / 10.0 AS p, CASE WHEN l_linenumber % 7 <> 0 THEN round(abs(l_tax) * 100) / 10.0 END AS market,
    (l_returnflag = 'R')::INT AS y, l_extendedprice::DOUBLE AS liquidity,
    CASE WHEN l_linenumber % 5 <> 0 THEN round(abs(l_tax) / 2, 4) END AS spread
  FROM lineitem
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast points: match_id, checkpoint, as_of, version, p, market, y, liquidity, spread."""
    rows = read(spark, sf_dir, "lineitem")
    line = F.col("l_linenumber")
    return rows.select(
        F.col("l_orderkey").alias("match_id"), line.alias("checkpoint"), micros("l_shipdate").alias("as_of"), F.col("l_linestatus").alias("version"),
        (F.round(F.abs("l_discount") * 100) / 10.0).alias("p"), F.when(line % 7 != 0, F.round(F.abs("l_tax") * 100) / 10.0).alias("market"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_extendedprice").cast("double").alias("liquidity"),
        F.when(line % 5 != 0, F.round(F.abs("l_tax") / 2, 4)).alias("spread"),
    )


CTE["legs"] = """legs AS (
  SELECT l_orderkey AS bet_id, l_suppkey % 150 AS event_number, l_linenumber AS leg,
    CASE l_partkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'error' END AS outcome,
    l_extendedprice::DOUBLE AS stake, round(0.05 + abs(l_discount) * 5, 4) AS entry, l_linestatus = 'F' AS closed,
    CASE l_returnflag WHEN 'R' THEN 'win' WHEN 'A' THEN 'loss' ELSE 'void' END AS result,
    CASE WHEN l_linenumber % 3 = 0 THEN round(l_extendedprice / 2, 4) END AS shares
  FROM lineitem
)"""


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bet legs: bet_id, event_number, leg, outcome, stake, entry, closed, result, shares (null: stake / entry)."""
    rows = read(spark, sf_dir, "lineitem")
    kind = F.col("l_partkey") % 5
    name = F.when(kind == 0, "click").when(kind == 1, "view").when(kind == 2, "purchase").when(kind == 3, "signup").otherwise("error")
    result = F.when(F.col("l_returnflag") == "R", "win").when(F.col("l_returnflag") == "A", "loss").otherwise("void")
    return rows.select(
        F.col("l_orderkey").alias("bet_id"), (F.col("l_suppkey") % 150).alias("event_number"), F.col("l_linenumber").alias("leg"), name.alias("outcome"),
        F.col("l_extendedprice").cast("double").alias("stake"), F.round(0.05 + F.abs("l_discount") * 5, 4).alias("entry"),
        (F.col("l_linestatus") == "F").alias("closed"), result.alias("result"),
        F.when(F.col("l_linenumber") % 3 == 0, F.round(F.col("l_extendedprice") / 2, 4)).alias("shares"),
    )


CTE["markets"] = """markets AS (
  SELECT o_orderkey AS market_id, o_custkey AS group_id, o_orderstatus AS status, o_totalprice::DOUBLE AS volume,
    epoch_us(o_orderdate::TIMESTAMP) AS end_at, o_orderpriority AS theme,
    round(least(0.99, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) * (0.9 + 0.1 * (o_custkey % 3))), 6) AS yes
  FROM orders
)"""


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets of groups: market_id, group_id, status, volume, end_at, theme, yes (price)."""
    from pyspark.sql import Window

    price = F.col("o_totalprice").cast("double")
    share = price / F.sum(price).over(Window.partitionBy("o_custkey")) * (0.9 + 0.1 * (F.col("o_custkey") % 3))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("market_id"), F.col("o_custkey").alias("group_id"), F.col("o_orderstatus").alias("status"), price.alias("volume"),
        micros("o_orderdate").alias("end_at"), F.col("o_orderpriority").alias("theme"), F.round(F.least(F.lit(0.99), share), 6).alias("yes"),
    )


def with_ctes(*names: str, body: str) -> str:
    """SQL text: the named table expressions, then ``body``, which may begin with a comma and more of them."""
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n" + body
