"""Scores of probability forecasts.

Points have match_id, checkpoint, as_of, version, p, market, y (0 or 1), liquidity and spread.
A forecaster is a column; rows where it is null take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW, HIGH = 0.01, 0.99
BUCKETS = 1 << 16


def clamp(p: Column) -> Column:
    """Within 1% and 99%; null stays null."""
    return F.when(p.isNotNull(), F.greatest(F.lit(LOW), F.least(F.lit(HIGH), p)))


def forecasters(offset: float | Column = 0.0) -> dict[str, Column]:
    """agent, market, coin, and the agent less an offset, clamped."""
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    return {"agent": F.col("p"), "market": F.col("market"), "coin": F.lit(0.5), "debiased": clamp(F.col("p") - offset)}


def brier(p: Column, y: str = "y") -> Column:
    """Mean squared error, null over no rows."""
    return F.avg(F.pow(p - F.col(y), F.lit(2)))


def skill(score: Column, reference: Column) -> Column:
    """1 - score / reference; null where the reference is null or zero."""
    return F.when(reference != 0, 1 - score / reference)


def bias(p: Column, y: str = "y") -> Column:
    """Mean forecast less mean outcome over the rows that have a forecast."""
    return F.avg(p) - F.avg(F.when(p.isNotNull(), F.col(y)))


def clamped(p: Column) -> Column:
    return F.count_if((p < LOW) | (p > HIGH))


def scores(points: DataFrame, by: list[str], offset: float = 0.0) -> DataFrame:
    """n and Brier scores, skill against the market and bias, on the sample that has a market price."""
    f = forecasters(offset)
    rows = points.filter(F.col("market").isNotNull())
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"), *[brier(f[name]).alias(name) for name in ("agent", "market", "coin", "debiased")], bias(f["agent"]).alias("bias"), clamped(f["agent"]).alias("clamped"),
    )
    return out.withColumn("skill", skill(F.col("agent"), F.col("market")))


def reliability(points: DataFrame, p: Column, start: float, width: float, count: int, by: list[str] | None = None) -> DataFrame:
    """Buckets of equal width from ``start``; the last takes all above; below the first, rows are dropped.

    bucket, n, matches, mean_p, rate. Empty buckets are absent.
    """
    index = F.least(F.floor((p - F.lit(start)) / F.lit(width)).cast("int"), F.lit(count - 1))
    rows = points.withColumn("_p", p).filter(F.col("_p") >= start).withColumn("bucket", index)
    return rows.groupBy(*(by or []), "bucket").agg(
        F.count("*").alias("n"), F.countDistinct("match_id").alias("matches"), F.avg("_p").alias("mean_p"), F.avg("y").alias("rate"), F.median("spread").alias("typical_spread"),
    )


def verdicts(buckets: DataFrame, least: int = 20) -> DataFrame:
    """gap, bar (half the typical spread) and a verdict for each reliability bucket."""
    gap, bar = F.col("rate") - F.col("mean_p"), F.col("typical_spread") / 2
    verdict = F.when(F.col("matches") < least, "inconclusive").when(bar.isNull(), "no spread").when(F.abs(gap) > bar, "beyond spread").otherwise("within spread")
    return buckets.withColumn("gap", gap).withColumn("bar", bar).withColumn("verdict", verdict)


def calibration_error(buckets: DataFrame) -> DataFrame:
    """The mean distance of rate and forecast, weighted by n."""
    return buckets.agg((F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean_p"))) / F.sum("n")).alias("ece"))


def murphy(buckets: DataFrame) -> DataFrame:
    """Reliability, resolution and uncertainty from buckets; their sums need one pass only."""
    n, p, r = F.col("n"), F.col("mean_p"), F.col("rate")
    sums = buckets.agg(F.sum("n").alias("n"), F.sum(n * r).alias("hits"), F.sum(n * F.pow(p - r, F.lit(2))).alias("rel"), F.sum(n * r * r).alias("sq"))
    base = F.col("hits") / F.col("n")
    return sums.select(
        (F.col("rel") / F.col("n")).alias("reliability"), (F.col("sq") / F.col("n") - base * base).alias("resolution"), (base * (1 - base)).alias("uncertainty"),
    )


def entity_halves(points: DataFrame, entity: str = "match_id", time: str = "as_of", last_seen: bool = False) -> DataFrame:
    """(entity, half): entities by their first (or last) time, the first floor(n / 2) are train, the rest test.

    No task sorts all entities: their times fall into ``BUCKETS`` equal spans, the counts of the
    spans find the one that holds the cut, and only its entities are ranked, by time and name.
    """
    agg = F.max if last_seen else F.min
    firsts = points.groupBy(entity).agg(agg(time).alias("_t"))
    bounds = firsts.agg(F.min("_t").alias("_low"), F.max("_t").alias("_high"))
    span = (F.col("_high") - F.col("_low") + 1) / F.lit(float(BUCKETS))
    firsts = firsts.crossJoin(F.broadcast(bounds)).select(entity, "_t", F.floor((F.col("_t") - F.col("_low")) / span).alias("_b"))
    sizes = firsts.groupBy("_b").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_end", F.sum("_n").over(Window.orderBy("_b"))).withColumn("_begin", F.col("_end") - F.col("_n"))
    placed = sizes.crossJoin(F.broadcast(firsts.agg(F.floor(F.count("*") / 2).alias("_half"))))
    side = F.when(F.col("_end") <= F.col("_half"), "train").when(F.col("_begin") >= F.col("_half"), "test")
    placed = firsts.join(F.broadcast(placed.select("_b", "_begin", "_half", side.alias("_side"))), "_b")
    tied = placed.filter("_side IS NULL").withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_t", entity)))
    tied = tied.select(entity, F.when(F.col("_begin") + F.col("_r") <= F.col("_half"), "train").otherwise("test").alias("half"))
    return placed.filter("_side IS NOT NULL").select(entity, F.col("_side").alias("half")).unionByName(tied)


def debias(points: DataFrame) -> DataFrame:
    """The offset learned on the older half of matches, and scores with it on either half.

    half, offset, n, matches, agent, debiased, straddling (matches with points on both sides of
    the first test time), versions and unseen_versions of the half.
    """
    halves = entity_halves(points)
    rows = points.join(halves, "match_id").filter(F.col("market").isNotNull())
    offset = rows.filter("half = 'train'").agg(bias(F.col("p")).alias("offset"))
    border = rows.filter("half = 'test'").agg(F.min("as_of").alias("border"))
    rows = rows.crossJoin(F.broadcast(offset)).crossJoin(F.broadcast(border))
    train_versions = rows.filter("half = 'train'").select("version", F.lit(1).alias("_known")).distinct()
    rows = rows.join(F.broadcast(train_versions), "version", "left")
    late = F.when((F.col("half") == "train") & (F.col("as_of") >= F.col("border")), F.col("match_id"))
    f = forecasters(F.col("offset"))
    return rows.groupBy("half", "offset").agg(
        F.count("*").alias("n"), F.countDistinct("match_id").alias("matches"), brier(f["agent"]).alias("agent"), brier(f["debiased"]).alias("debiased"),
        F.countDistinct(late).alias("straddling"), F.countDistinct("version").alias("versions"),
        F.countDistinct(F.when(F.col("_known").isNull(), F.col("version"))).alias("unseen_versions"),
    )


def favourites(points: DataFrame) -> DataFrame:
    """Points seen from the favourite's side: price and outcome are turned where p < 0.5; ties are marked."""
    turn = F.col("p") < 0.5
    return points.withColumn("tie", F.col("p") == 0.5).withColumn("price", F.round(F.when(turn, 1 - F.col("p")).otherwise(F.col("p")), 6)).withColumn(
        "won", F.when(turn, 1 - F.col("y")).otherwise(F.col("y"))
    )


def one_row_per_match(points: DataFrame, payload: list[str]) -> DataFrame:
    """The row of the smallest checkpoint of each match, ties by the payload."""
    return points.groupBy("match_id").agg(F.min_by(F.struct("checkpoint", *payload), F.struct("checkpoint", *payload)).alias("r")).select("match_id", "r.*")
