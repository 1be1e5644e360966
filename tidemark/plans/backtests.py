"""Backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest as op
from ..operators import evaluation
from ..sources.tables import points, with_ctes
from ._base import Family
from .evaluation import _rounded

FAMILY = Family()
query = FAMILY.query

THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9)
_EXEC = """, f AS (SELECT match_id, checkpoint, as_of, liquidity, spread, round(CASE WHEN p < 0.5 THEN 1 - p ELSE p END, 6) AS mid, CASE WHEN p < 0.5 THEN 1 - y ELSE y END AS won FROM points WHERE p <> 0.5 AND spread IS NOT NULL),
e AS (SELECT *, round(mid + spread, 6) AS ask FROM f)"""
_BETS = _EXEC + """, bets AS (SELECT e.*, t AS threshold, CASE WHEN won = 1 THEN 1 - ask ELSE -ask END AS pnl, ask AS stake FROM e, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS t) WHERE mid >= t AND ask < 1)"""
_SUMMARY = """count(*) AS bets, count(DISTINCT match_id) AS matches, round(CASE WHEN sum(stake) <> 0 THEN sum(pnl) / sum(stake) END, 6) AS ev, round(avg(won), 6) AS hit_rate, round(avg(mid), 6) AS mean_mid,
  round(avg(ask), 6) AS mean_ask, round(avg(ask - mid), 6) AS slippage"""


def execution_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-17: the favourite's mid and ask, where there is a spread."""
    rows = evaluation.favourites(points(spark, sf_dir)).filter("NOT tie AND spread IS NOT NULL")
    return rows.select("match_id", "checkpoint", "as_of", "liquidity", F.col("price").alias("mid"), "won", F.round(F.col("price") + F.col("spread"), 6).alias("ask"))


@query(with_ctes("points", body=_BETS + f"\nSELECT threshold, {_SUMMARY} FROM bets GROUP BY threshold"))
def backtest_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-17, E-24, E-25, E-28."""
    return _rounded(op.summary(op.fixed_bets(execution_points(spark, sf_dir), THRESHOLDS), ["threshold"]))


@query(
    with_ctes("points", body=_BETS + """, run AS (SELECT *, sum(pnl) OVER w AS equity, row_number() OVER w AS rn FROM bets WINDOW w AS (PARTITION BY threshold ORDER BY as_of, match_id, checkpoint, liquidity, mid, ask, won ROWS UNBOUNDED PRECEDING)),
peaks AS (SELECT *, greatest(0.0, max(equity) OVER (PARTITION BY threshold ORDER BY rn ROWS UNBOUNDED PRECEDING)) AS peak FROM run)
SELECT threshold, round(max(peak - equity), 4) AS max_drawdown, round(arg_max(equity, rn), 4) AS final FROM peaks GROUP BY threshold""")
)
def backtest_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-27, W-3."""
    bets = op.fixed_bets(execution_points(spark, sf_dir), THRESHOLDS)
    out = op.max_drawdown(bets, ["threshold"], ["as_of", "match_id", "checkpoint", "liquidity", "mid", "ask", "won"])
    return out.select("threshold", F.round("max_drawdown", 4).alias("max_drawdown"), F.round("final", 4).alias("final"))


@query(
    with_ctes("points", body=_EXEC + """, firsts AS (SELECT match_id, min(as_of) AS t FROM e GROUP BY match_id),
halves AS (SELECT match_id, row_number() OVER (ORDER BY t, match_id) <= (SELECT count(*) FROM firsts) // 2 AS train FROM firsts),
x AS (SELECT * FROM e JOIN halves USING (match_id) WHERE mid >= 0.7 AND ask < 1), r AS (SELECT avg(won) AS rate FROM x WHERE train),
k AS (SELECT x.*, CASE WHEN rate * ((1 - ask) / ask + 1) - 1 <= 0 THEN 0 ELSE least((rate * ((1 - ask) / ask + 1) - 1) / ((1 - ask) / ask) * 0.25, 0.05) END AS stake FROM x, r WHERE NOT train),
b AS (SELECT *, (CASE WHEN won = 1 THEN 1 - ask ELSE -ask END) * stake / ask AS pnl FROM k WHERE stake > 0)
SELECT """ + _SUMMARY + " FROM b")
)
def backtest_kelly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-26, D-21, E-20."""
    rows = execution_points(spark, sf_dir)
    rows = rows.join(evaluation.entity_halves(rows), "match_id")
    return _rounded(op.summary(op.kelly_bets(rows.filter("half = 'train'"), rows.filter("half = 'test'"), 0.7, 0.25, 0.05)))
