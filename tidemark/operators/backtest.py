"""Backtests of buying the favourite at the ask."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contract_pnl(ask: Column, won: Column, fee: float = 0.0) -> Column:
    """Profit of one contract bought at ``ask``: 1 - ask - fee if it won, else -ask - fee."""
    return F.when(won == 1, 1 - ask - fee).otherwise(-ask - fee)


def kelly_stake(p: Column, ask: Column, fraction: float, cap: float) -> Column:
    """Share of the bankroll: fraction of edge over odds, 0 without an edge, at most ``cap``."""
    odds = (1 - ask) / ask
    edge = p * (odds + 1) - 1
    return F.when(edge <= 0, 0.0).otherwise(F.least(edge / odds * fraction, F.lit(cap)))


def fixed_bets(points: DataFrame, thresholds: Sequence[float], fee: float = 0.0) -> DataFrame:
    """One contract for each point whose mid reaches the threshold and whose ask is below 1, for each threshold."""
    rows = points.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    rows = rows.filter((F.col("mid") >= F.col("threshold")) & (F.col("ask") < 1))
    return rows.withColumn("pnl", contract_pnl(F.col("ask"), F.col("won"), fee)).withColumn("stake", F.col("ask"))


def kelly_bets(train: DataFrame, test: DataFrame, threshold: float, fraction: float, cap: float) -> DataFrame:
    """Bets on the test points sized by the hit rate of the train points at the threshold."""
    rate = train.filter((F.col("mid") >= threshold) & (F.col("ask") < 1)).agg(F.avg("won").alias("rate"))
    rows = test.filter((F.col("mid") >= threshold) & (F.col("ask") < 1)).crossJoin(F.broadcast(rate))
    rows = rows.withColumn("stake", kelly_stake(F.col("rate"), F.col("ask"), fraction, cap)).filter("stake > 0")
    return rows.withColumn("pnl", contract_pnl(F.col("ask"), F.col("won")) * F.col("stake") / F.col("ask"))


def summary(bets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """bets, matches, ev (sum of pnl over sum of stake), hit rate, mean price, mean ask, slippage."""
    return bets.groupBy(*by).agg(
        F.count("*").alias("bets"), F.countDistinct("match_id").alias("matches"), F.try_divide(F.sum("pnl"), F.sum("stake")).alias("ev"), F.avg("won").alias("hit_rate"),
        F.avg("mid").alias("mean_mid"), F.avg("ask").alias("mean_ask"), F.avg(F.col("ask") - F.col("mid")).alias("slippage"),
    )


def max_drawdown(bets: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The largest fall of the running profit below its peak, which starts at 0.

    A series is one account, so its order is inherent; ``by`` keeps accounts apart.
    """
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = bets.withColumn("equity", F.sum("pnl").over(run))
    rows = rows.withColumn("peak", F.greatest(F.lit(0.0), F.max("equity").over(run)))
    return rows.groupBy(*by).agg(F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"), F.max_by("equity", F.struct(*order)).alias("final"))
