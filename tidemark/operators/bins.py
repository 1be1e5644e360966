"""Markets on counts: bins, implied moments, dispersion, bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 1.0)


def edge_bucket(p: Column, edges: Sequence[float] = EDGES) -> Column:
    """The place of p among irregular edges, the last interval closed; null outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        below = p <= edges[i + 1] if i == len(edges) - 2 else p < edges[i + 1]
        out = F.when((p >= edges[i]) & below, i).otherwise(out)
    return out


def implied_moments(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    """total, missing, mean and sd of the count that bin prices imply.

    ``bins``: by, low, high (null: open), price, dead. A dead bin weighs nothing, a bin without
    price is counted as missing. A bin stands for its middle; an open one has the previous bin's
    width, or 20. Prices are scaled to add up to 1.
    """
    order = Window.partitionBy(*by).orderBy("low")
    width = F.coalesce(F.col("high") - F.col("low"), F.lag(F.col("high") - F.col("low")).over(order), F.lit(20))
    weight = F.when(F.col("dead"), 0.0).otherwise(F.col("price"))
    rows = bins.withColumn("mid", F.col("low") + width / 2).withColumn("w", weight)
    sums = rows.groupBy(*by).agg(
        F.sum("w").alias("total"), F.count_if(F.col("w").isNull()).alias("missing"), F.sum(F.col("w") * F.col("mid")).alias("s1"), F.sum(F.col("w") * F.col("mid") * F.col("mid")).alias("s2")
    )
    mean = F.try_divide("s1", "total")
    return sums.select(*by, "total", "missing", mean.alias("mean"), F.when(mean.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.try_divide("s2", "total") - mean * mean))).alias("sd"))


def contiguity(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    """Holes and overlaps between neighbouring bins."""
    following = F.lead("low").over(Window.partitionBy(*by).orderBy("low"))
    rows = bins.withColumn("step", following - F.col("high") - 1)
    return rows.groupBy(*by).agg(F.count_if(F.col("step") > 0).alias("holes"), F.count_if(F.col("step") < 0).alias("overlaps"))


def summarize_z(rows: DataFrame, by: Sequence[str], z: str = "z") -> DataFrame:
    """n, mean, sd and the interval of 1.96 standard errors; null below two rows."""
    out = rows.groupBy(*by).agg(F.count(z).alias("n"), F.avg(z).alias("mean"), F.stddev_samp(z).alias("sd"), F.median("total").alias("median_total"))
    half = F.when(F.col("n") >= 2, 1.96 * F.col("sd") / F.sqrt("n"))
    return out.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def strongest(summary: DataFrame, by: Sequence[str], least: int = 20) -> DataFrame:
    """The row of the largest mean (in absolute value) whose interval leaves out zero, per key."""
    sure = summary.filter((F.col("n") >= least) & ((F.col("low") > 0) | (F.col("high") < 0)))
    order = F.struct(F.abs("mean"), *[c for c in summary.columns if c in ("n",)])
    return sure.groupBy(*by).agg(F.max_by(F.struct("offset", "n", "mean"), order).alias("r")).select(*by, "r.*")


def dispersion(counts: DataFrame, by: Sequence[str], order: str, size: int) -> DataFrame:
    """Variance over mean of counts, and of sums over blocks of ``size`` that do not overlap; a last short block is left out."""
    spot = Window.partitionBy(*by).orderBy(order)
    rows = counts.withColumn("_b", F.floor((F.row_number().over(spot) - 1) / size))
    one = rows.groupBy(*by).agg(F.try_divide(F.var_samp("n"), F.avg("n")).alias("ratio"), F.count("*").alias("days"))
    blocks = rows.groupBy(*by, "_b").agg(F.sum("n").alias("s"), F.count("*").alias("c")).filter(F.col("c") == size)
    many = blocks.groupBy(*by).agg(F.try_divide(F.var_samp("s"), F.avg("s")).alias("block_ratio"), F.count("*").alias("blocks"))
    return one.join(many, list(by), "left")


def trailing_residual(counts: DataFrame, by: Sequence[str], order: str, back: int) -> DataFrame:
    """Counts less the mean of the ``back`` rows before; null until there are so many."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(-back, -1)
    rows = counts.withColumn("_n", F.count("n").over(before)).withColumn("_m", F.avg("n").over(before))
    return rows.withColumn("residual", F.when(F.col("_n") == back, F.col("n") - F.col("_m"))).drop("_n", "_m")


def pooled_variance(counts: DataFrame, group: str) -> DataFrame:
    """Variance within groups, pooled by degrees of freedom."""
    per = counts.groupBy(group).agg(F.count("*").alias("c"), F.var_samp("n").alias("v"), F.avg("n").alias("m"))
    return per.filter("c > 1").agg((F.sum((F.col("c") - 1) * F.col("v")) / F.sum(F.col("c") - 1)).alias("pooled"), (F.sum(F.col("c") * F.col("m")) / F.sum("c")).alias("mean"))


def cluster_bootstrap(sums: DataFrame, by: Sequence[str], draws: int = 2000, seed: int = 20260801) -> DataFrame:
    """2.5% and 97.5% points of the mean over clusters drawn with replacement: by, mean, low, high.

    ``sums`` has by, cluster, s (sum) and n: one small row a cluster. Draws are numbered and dealt
    over tasks; each is the sum over clusters of Poisson(1) weights that a hash of draw and cluster
    inverts, so a draw needs no list of clusters, and every run gives the same interval.
    """
    steps = [0.0]
    p, total = 0.36787944117144233, 0.0
    for k in range(1, 13):
        total += p
        steps.append(total)
        p /= k
    numbered = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("cluster").cast("string"))), 1, 13), 16, 10).cast("double") / float(16**13)
    weight = F.lit(0)
    for k in range(1, len(steps)):
        weight = F.when(u >= steps[k], k).otherwise(weight)
    drawn = numbered.withColumn("w", weight).groupBy(*by, "draw").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("m"))
    points = drawn.groupBy(*by).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    whole = sums.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("mean"))
    return whole.join(points, list(by)).select(*by, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def seeded_bootstrap(rows: DataFrame, by: Sequence[str], draws: int = 2000, seed: int = 42) -> DataFrame:
    """As :func:`cluster_bootstrap`, by the classic draw with replacement in numpy, for groups of few clusters."""
    import numpy as np

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cluster", kind="stable")
        rng = np.random.default_rng(seed)
        s, n = frame["s"].to_numpy(), frame["n"].to_numpy()
        means = np.empty(draws)
        for i in range(draws):
            pick = rng.integers(0, len(s), len(s))
            means[i] = s[pick].sum() / n[pick].sum()
        means.sort()
        out = frame[list(by)].head(1).copy()
        out["mean"], out["low"], out["high"] = s.sum() / n.sum(), means[int(0.025 * draws)], means[int(0.975 * draws)]
        return out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in by)
    return rows.groupBy(*by).applyInPandas(draw, f"{schema}, mean double, low double, high double")


def coherent_instants(prices: DataFrame, by: Sequence[str], low: float = 0.9, high: float = 1.2) -> DataFrame:
    """Rows of instants whose prices add up to between ``low`` and ``high``."""
    sums = prices.groupBy(*by).agg(F.round(F.sum("price"), 6).alias("_s")).filter(F.col("_s").between(low, high)).select(*by)
    return prices.join(sums, list(by), "left_semi")
