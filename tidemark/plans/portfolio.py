"""Positions, bankroll, settlement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import portfolio as op
from ..operators import quotes as quote_op
from ..sources.tables import legs, micros, quotes, read, with_ctes
from ._base import Family
from .quotes import _latest_sql

FAMILY = Family()
query = FAMILY.query

_LEGS = """, l AS (SELECT event_number::VARCHAR AS event_id, * FROM legs),
m AS (SELECT l.*, coalesce(l.shares, round(stake / entry, 4)) AS held, coalesce(q.bid, q.mid) AS price, q.tick FROM l LEFT JOIN latest q USING (event_id, outcome)),
v AS (SELECT *, round(held * price, 6) AS value, CASE WHEN tick IS NULL THEN 'no quote' WHEN price IS NULL THEN 'no price' END AS reason FROM m)"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legs(spark, sf_dir).withColumn("event_id", F.col("event_number").cast("string"))
    return op.mark(rows, quote_op.latest_quotes(quotes(spark, sf_dir)).select("event_id", "outcome", "tick", "bid", "mid", "ask"))


@query(
    with_ctes("quotes", "legs", body=", " + _latest_sql("tick, bid, ask, mid") + _LEGS + """
SELECT outcome, reason, count(*) AS n, round(sum(stake), 2) AS stake, round(sum(value), 2) AS value, round(sum(round(value - stake, 6)), 2) AS unrealized FROM v WHERE NOT closed GROUP BY outcome, reason""")
)
def positions_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-11, J-10."""
    return _marked(spark, sf_dir).filter("NOT closed").groupBy("outcome", "reason").agg(
        F.count("*").alias("n"), F.round(F.sum("stake"), 2).alias("stake"), F.round(F.sum("value"), 2).alias("value"), F.round(F.sum("unrealized"), 2).alias("unrealized")
    )


@query(
    with_ctes("quotes", "legs", body=", " + _latest_sql("tick, bid, ask, mid") + _LEGS + """
SELECT event_id, count(*) AS n, round(sum(stake), 2) AS staked, count(*) FILTER (value IS NULL) AS unmarked, round(CASE WHEN count(*) FILTER (value IS NULL) = 0 THEN sum(value) END, 2) AS marked,
  count(*) FILTER (reason = 'no quote') AS no_quote, count(*) FILTER (reason = 'no price') AS no_price FROM v WHERE NOT closed GROUP BY event_id""")
)
def bankroll_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-10."""
    rows = op.bankroll(_marked(spark, sf_dir), ["event_id"])
    return rows.withColumn("staked", F.round("staked", 2)).withColumn("marked", F.round("marked", 2))


@query(
    with_ctes("legs", body=""", s AS (SELECT *, CASE WHEN closed THEN CASE result WHEN 'win' THEN round((1 - entry) * coalesce(shares, round(stake / entry, 4)), 6) WHEN 'void' THEN 0 ELSE -stake END END AS pnl FROM legs)
SELECT bet_id, count(*) AS n_legs, count(*) FILTER (NOT closed) AS n_open, round(sum(stake::DECIMAL(18, 6)), 2)::DOUBLE AS stake, bool_and(closed) AS closed, round(CASE WHEN bool_and(closed) THEN sum(pnl::DECIMAL(18, 6)) END, 2)::DOUBLE AS pnl FROM s GROUP BY bet_id""")
)
def bet_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-12."""
    rows = op.bets_of(op.settle(legs(spark, sf_dir)))
    return rows.withColumn("stake", F.round("stake", 2)).withColumn("pnl", F.round("pnl", 2))


@query(
    with_ctes("legs", body=""", s AS (SELECT *, bet_id * 1000 AS tick, CASE WHEN closed THEN CASE result WHEN 'win' THEN round((1 - entry) * coalesce(shares, round(stake / entry, 4)), 6) WHEN 'void' THEN 0 ELSE -stake END END AS pnl FROM legs),
w AS (SELECT * FROM (VALUES ('short', 8000000), ('long', 5000000), ('all', NULL)) AS t(span, since))
SELECT span, count(*) FILTER (result = 'win') AS wins, count(*) FILTER (result <> 'void') AS decisive, round(count(*) FILTER (result = 'win') / count(*) FILTER (result <> 'void'), 6) AS win_rate, round(sum(pnl), 2) AS pnl
FROM s JOIN w ON since IS NULL OR tick >= since WHERE closed GROUP BY span""")
)
def performance_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-17, A-2."""
    rows = op.settle(legs(spark, sf_dir)).withColumn("tick", F.col("bet_id") * 1000)
    out = op.performance(rows, "tick", 10_000_000, {"short": 2_000_000, "long": 5_000_000, "all": None})
    return out.select("span", "wins", "decisive", F.round("win_rate", 6).alias("win_rate"), F.round("pnl", 2).alias("pnl"))


@query(
    with_ctes("quotes", body=""", x AS (SELECT event_id, CASE WHEN outcome IN ('click', 'view') THEN 'a' ELSE 'b' END AS outcome, tick,
  CASE WHEN outcome IN ('click', 'view') THEN CASE WHEN bid IS NOT NULL THEN 0.995 - (event_id::INT % 3) * 0.01 END END AS bid, CASE WHEN outcome NOT IN ('click', 'view') THEN 0.005 + (event_id::INT % 2) * 0.01 END AS ask FROM quotes),
p AS (SELECT event_id, outcome, count(*) AS n, bool_and(coalesce(bid >= 0.99, false)) AS high, bool_and(coalesce(ask <= 0.01, false)) AS low FROM x WHERE tick BETWEEN 1705276800000000 AND 1705708800000000 GROUP BY event_id, outcome),
e AS (SELECT event_id, sum(n) AS n, count(*) AS sides, min(n) AS fewest, count(*) FILTER (high) AS highs, count(*) FILTER (low) AS lows, max(CASE WHEN high THEN outcome END) AS winner, max(CASE WHEN low THEN outcome END) AS loser FROM p GROUP BY event_id)
SELECT event_id, CASE WHEN sides = 2 AND n >= 6 AND fewest >= 3 AND highs = 1 AND lows = 1 AND winner <> loser THEN winner END AS winner FROM e""")
)
def sustained_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-13."""
    first = F.col("outcome").isin("click", "view")
    number = F.col("event_id").cast("int")
    rows = quotes(spark, sf_dir).select(
        "event_id", "tick", F.when(first, "a").otherwise("b").alias("outcome"), F.when(first & F.col("bid").isNotNull(), 0.995 - (number % 3) * 0.01).alias("bid"),
        F.when(~first, 0.005 + (number % 2) * 0.01).alias("ask"),
    )
    return op.sustained_winner(rows, 1_705_708_800_000_000, 432_000_000_000, 6, 3)


@query("""
SELECT decision, count(*) AS n FROM (
  SELECT CASE WHEN o_orderstatus <> 'O' AND o_custkey % 4 <> 0 AND len(p) = 2 THEN CASE WHEN p[1] = '0.5' AND p[2] = '0.5' THEN 'void' WHEN list_position(p, '1') > 0 THEN (list_position(p, '1') - 1)::VARCHAR END END AS decision
  FROM (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN ['0.5', '0.5'] WHEN 1 THEN ['1', '0'] WHEN 2 THEN ['0', '1'] WHEN 3 THEN ['0.4', '0.6'] ELSE ['1', '0', '0'] END AS p FROM orders)) GROUP BY decision
""")
def resolution_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-14."""
    k = F.col("o_orderkey") % 5
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    prices = F.when(k == 0, a("0.5", "0.5")).when(k == 1, a("1", "0")).when(k == 2, a("0", "1")).when(k == 3, a("0.4", "0.6")).otherwise(a("1", "0", "0"))
    rows = read(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", prices.alias("p"))
    return rows.groupBy(op.resolution(F.col("p"), F.col("o_orderstatus") != "O", F.col("o_custkey") % 4 != 0).alias("decision")).agg(F.count("*").alias("n"))


@query(
    with_ctes("legs", body=""", u AS (SELECT DISTINCT event_number AS event_id, 0 AS i, 'roster' AS source, false AS p FROM legs WHERE event_number % 2 = 0 UNION ALL SELECT DISTINCT event_number, 1, 'any leg', false FROM legs
  UNION ALL SELECT DISTINCT event_number, 2, 'open leg', true FROM legs WHERE NOT closed AND leg = 7)
SELECT event_id, bool_or(p) AS priority, arg_max(source, i) AS source, count(DISTINCT source) AS n_sources FROM u GROUP BY event_id""")
)
def candidate_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-15, S-24, O-2."""
    rows = legs(spark, sf_dir).withColumn("event_id", F.col("event_number"))
    pick = lambda c: rows.filter(c).select("event_id").distinct()
    sources = {"roster": pick("event_id % 2 = 0"), "any leg": pick("true"), "open leg": pick("NOT closed AND leg = 7")}
    return op.tracks(sources, {"roster": False, "any leg": False, "open leg": True})


@query(
    with_ctes("quotes", body=""", s AS (SELECT event_id, outcome AS label, bid, ask, mid, liquidity AS depth, CASE WHEN seq % 3 = 0 THEN ['click', 'view', 'error'] ELSE ['click', 'view'] END AS labels FROM quotes)
SELECT provenance, count(*) AS n, round(sum(own_bid), 3) AS bids, round(sum(own_ask), 3) AS asks, round(sum(own_depth), 0) AS depth FROM (
  SELECT CASE WHEN label = 'click' THEN 'own' WHEN two THEN 'complement' ELSE 'none' END AS provenance, CASE WHEN label = 'click' THEN bid WHEN two THEN round(1 - ask, 4) END AS own_bid,
    CASE WHEN label = 'click' THEN ask WHEN two THEN round(1 - bid, 4) END AS own_ask, CASE WHEN label = 'click' THEN depth END AS own_depth
  FROM (SELECT *, len(labels) = 2 AND list_contains(labels, label) AND list_contains(labels, 'click') AS two FROM s)) GROUP BY provenance""")
)
def opposite_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-14, F-11, F-13."""
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    rows = quotes(spark, sf_dir).withColumns({"label": F.col("outcome"), "depth": F.col("liquidity"), "labels": F.when(F.col("seq") % 3 == 0, a("click", "view", "error")).otherwise(a("click", "view"))})
    out = op.opposite_quotes(rows.select("event_id", "label", "bid", "ask", "mid", "depth", "labels"), F.col("labels"), F.lit("click"))
    return out.groupBy("provenance").agg(
        F.count("*").alias("n"), F.round(F.sum("own_bid"), 3).alias("bids"), F.round(F.sum("own_ask"), 3).alias("asks"), F.round(F.sum("own_depth"), 0).alias("depth")
    )


@query("""
SELECT o_custkey AS event_id, probability FROM (
  SELECT o_custkey, round(o_totalprice / 600000, 4) AS probability, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS placed, o_orderkey FROM orders WHERE o_orderstatus <> 'O')
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY placed DESC NULLS FIRST, o_orderkey DESC) = 1
""")
def newest_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-13: nulls first in descending order of time."""
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("event_id"), F.when(F.col("o_orderstatus") != "O", F.round(F.col("o_totalprice") / 600000, 4)).alias("probability"),
        F.when(F.col("o_orderkey") % 11 != 0, micros("o_orderdate")).alias("placed"), F.col("o_orderkey").alias("seq"),
    )
    return op.newest_probability(rows, "event_id", F.col("placed")).select("event_id", "probability")


@query(
    with_ctes("legs", body=""", b AS (SELECT o_custkey AS bettor, o_orderkey AS bet_id FROM orders)
SELECT bettor, coalesce(any_value(n), 0) AS n_open, any_value(stake) AS open_stake FROM (SELECT bettor, bet_id FROM b) LEFT JOIN
  (SELECT b.bettor, count(*) AS n, round(sum(stake), 2) AS stake FROM legs JOIN b USING (bet_id) WHERE NOT closed GROUP BY b.bettor) USING (bettor) GROUP BY bettor""")
)
def open_legs_by_bettor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-12, A-3: without open legs the count is zero and the sum null."""
    bets = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bettor"), F.col("o_orderkey").alias("bet_id"))
    sums = legs(spark, sf_dir).filter("NOT closed").join(bets, "bet_id").groupBy("bettor").agg(F.count("*").alias("n"), F.round(F.sum("stake"), 2).alias("open_stake"))
    return bets.select("bettor").distinct().join(sums, "bettor", "left").select("bettor", F.coalesce("n", F.lit(0)).alias("n_open"), "open_stake")
