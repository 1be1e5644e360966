"""Operators on series of two-sided quotes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quotes as q
from . import asof

PRICES = ("mid", "ask", "bid")


def paired_sides(quotes: DataFrame, labels: tuple[str, str] = ("Yes", "No")) -> DataFrame:
    """Two rows for each quote: the side itself, and its complement with bid and ask exchanged."""
    own = F.struct(F.lit(labels[0]).alias("side"), "bid", "ask", "mid")
    other = F.struct(F.lit(labels[1]).alias("side"), q.complement(F.col("ask")).alias("bid"), q.complement(F.col("bid")).alias("ask"), q.complement(F.col("mid")).alias("mid"))
    rest = [c for c in quotes.columns if c not in PRICES]
    return quotes.select(*rest, F.inline(F.array(own, other)))


def snapshots(quotes: DataFrame) -> DataFrame:
    """Quotes with at least one side; mid and spread only where both stand."""
    both = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    rows = quotes.filter(F.col("bid").isNotNull() | F.col("ask").isNotNull())
    return rows.withColumn("mid", F.when(both, F.round((F.col("bid") + F.col("ask")) / 2, 4))).withColumn("spread", F.when(both, F.round(F.col("ask") - F.col("bid"), 4)))


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """The last quote of each series (event_id, outcome); equal times go by seq."""
    return asof.latest(quotes, ["event_id", "outcome"], ["tick", "seq"], ["tick", "bid", "ask", "mid", "volume_24h", "liquidity"])


def changes(quotes: DataFrame, windows: Mapping[str, tuple[int, int]]) -> DataFrame:
    """The last quote of each series and, for each window (distance, tolerance in seconds), its change.

    The anchor is the series' own last time less the distance; the nearest quote within the
    tolerance on either side is compared, the earlier one at equal distance. All windows are taken
    in one aggregation over the series, combined before the shuffle.
    """
    keys = ["event_id", "outcome"]
    last = latest_quotes(quotes)
    ends = last.select(*keys, F.col("tick").alias("_end"))
    rows = quotes.join(ends, keys)
    picks = []
    for name, (distance, tolerance) in windows.items():
        gap = F.col("tick") - (F.col("_end") - distance * asof.SECOND)
        order = F.struct(F.abs(gap).alias("d"), F.col("tick").alias("t"), F.col("seq").alias("s"))
        near = F.abs(gap) <= tolerance * asof.SECOND
        picks.append(F.min_by(F.when(near, F.struct("tick", "mid", "ask", "bid")), F.when(near, order)).alias(f"_{name}"))
    found = last.join(rows.groupBy(*keys).agg(*picks), keys)
    now = {c: F.col(c) for c in PRICES}
    for name in windows:
        then = F.col(f"_{name}")
        found = found.withColumn(f"_c{name}", q.change_with_base(now, {c: then[c] for c in PRICES}))
    columns = []
    for name in windows:
        c = F.col(f"_c{name}")
        columns += [F.col(f"_{name}")["tick"].alias(f"at_{name}"), c["base"].alias(f"base_{name}"), c["change"].alias(f"change_{name}"), c["reference"].alias(f"reference_{name}")]
    return found.select(*last.columns, *columns)


def gaps(quotes: DataFrame) -> DataFrame:
    """Seconds since the previous quote of the event; null for the first."""
    before = F.lag("tick").over(Window.partitionBy("event_id").orderBy("tick", "seq"))
    return quotes.withColumn("gap", (F.col("tick") - before) / asof.SECOND)


def watch_band(start: Column, as_of: int, soon_minutes: int, live_minutes: int) -> Column:
    """far, soon or live by minutes to the start; far again once it has run too long; no start is far."""
    minutes = (start - F.lit(as_of)) / (60 * asof.SECOND)
    return F.when((minutes <= 0) & (minutes > -live_minutes), "live").when((minutes > 0) & (minutes <= soon_minutes), "soon").otherwise("far")


def moves(quotes: DataFrame, lookback: int, horizon: int, tolerance: int) -> DataFrame:
    """For each quoted mid, the move since ``lookback`` seconds ago and the move over the next ``horizon`` seconds.

    Each end is the nearest mid within the tolerance, the later one at equal distance.
    """
    series = quotes.filter(F.col("mid").isNotNull()).select("event_id", "outcome", "seq", "tick", "mid")
    keys = ["event_id", "outcome"]
    here = series.withColumn("before_at", F.col("tick") - lookback * asof.SECOND).withColumn("after_at", F.col("tick") + horizon * asof.SECOND)
    price = series.select(*keys, "tick", F.col("mid").alias("other"), "seq")
    before = asof.nearest(here, price, keys, [*keys, "seq"], "before_at", tolerance * asof.SECOND, ["other"], tie="later").withColumnRenamed("other", "before")
    after = asof.nearest(here, price, keys, [*keys, "seq"], "after_at", tolerance * asof.SECOND, ["other"], tie="later").withColumnRenamed("other", "after")
    joined = here.join(before.drop("before_at"), [*keys, "seq"]).join(after.drop("after_at"), [*keys, "seq"])
    return joined.select(*keys, "seq", "tick", "mid", F.round(F.col("mid") - F.col("before"), 6).alias("move"), F.round(F.col("after") - F.col("mid"), 6).alias("forward"))
