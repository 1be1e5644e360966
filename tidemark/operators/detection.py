"""Detectors of signals in markets and quotes, and the life of a signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import basket_edge
from .asof import SECOND


def baskets(markets: DataFrame, least_members: int, least_price: float, least_volume: float, least_coverage: float, least_edge: float, live: Column) -> DataFrame:
    """Groups of exclusive markets whose prices do not add up to 1, or why a group is no signal.

    ``markets``: group_id, market_id, status, yes, volume, end_at. Members are the live active
    markets priced at ``least_price`` or more; coverage is their share of all active ones. One
    aggregation with partial sums; no group is gathered except its bounded member summary.
    """
    active = F.col("status") == "O"
    member = active & live & (F.col("yes") >= least_price)
    groups = markets.groupBy("group_id").agg(
        F.count_if(member).alias("members"), F.count_if(active).alias("active"), F.sum(F.when(member, F.col("yes"))).alias("total"),
        F.sum(F.when(member, F.col("volume"))).alias("volume"), F.bool_and(F.when(active, live)).alias("all_live"), F.min(F.when(member, F.col("end_at"))).alias("expires_at"),
        F.max_by(F.when(member, F.col("market_id")), F.when(member, F.struct("volume", "market_id"))).alias("lead"),
    )
    edge = F.round(basket_edge(F.col("total"), F.col("members")), 4)
    groups = groups.withColumn("coverage", F.try_divide("members", "active")).withColumn("edge", edge).withColumn("side", F.when(F.col("total") > 1, "over").otherwise("under"))
    reason = (
        F.when(F.col("members") < least_members, "few members").when(~F.col("all_live"), "not live").when(F.col("volume") < least_volume, "low volume")
        .when(F.col("coverage") < least_coverage, "low coverage").when((F.col("side") == "under") & (F.col("total") < 0.7), "incomplete").when(F.col("edge") < least_edge, "low edge")
    )
    groups = groups.withColumn("reason", reason)
    return groups.withColumn("confidence", F.when(F.col("reason").isNull(), F.least(F.lit(1.0), F.col("edge") / 10)).otherwise(0.0))


def intra_market(markets: DataFrame, prices: str, threshold: float) -> DataFrame:
    """Markets whose own outcome prices (array of text) do not add up to 1; malformed prices are a reason."""
    numbers = F.transform(prices, lambda x: x.try_cast("double"))
    bad = F.exists(numbers, lambda x: x.isNull())
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    rows = markets.withColumn("total", F.when(~bad, F.round(total, 6)))
    off = F.round(F.abs(F.col("total") - 1), 6)
    reason = F.when(bad, "malformed").when(off < threshold, "below threshold")
    edge = F.round(basket_edge(F.col("total"), F.size(prices)), 4)
    return rows.withColumn("reason", reason).withColumn("deviation", off).withColumn("edge", F.when(~bad, edge)).withColumn("confidence", F.when(reason.isNull(), F.least(F.lit(1.0), off / 0.15)))


def calm_series(quotes: DataFrame, as_of: int, back: int, least: int, most_sd: float) -> DataFrame:
    """Series whose mids hardly move: n, sd (population), last mid and confidence, for those that pass."""
    rows = quotes.filter(F.col("mid").isNotNull() & F.col("tick").between(as_of - back, as_of))
    out = rows.groupBy("event_id", "outcome").agg(F.count("*").alias("n"), F.stddev_pop("mid").alias("sd"), F.max_by("mid", F.struct("tick", "seq")).alias("last_mid"))
    out = out.filter((F.col("n") >= least) & (F.col("sd") < most_sd) & (F.col("last_mid") > 0.05) & (F.col("last_mid") < 0.95))
    return out.withColumn("confidence", F.least(F.lit(1.0), (most_sd - F.col("sd")) / most_sd + 0.5))


def momentum(pairs: DataFrame, as_of: int, most_age: int) -> DataFrame:
    """kind and confidence for rows of the last quote (at, mid, volume_24h) and an earlier one (past_mid, past_volume).

    momentum: at least 10% and 0.03 away from the past price, which may be zero; volume: five
    times the usual hourly volume while the price moves less than 3%. Both make the strongest.
    """
    step = F.abs(F.col("mid") - F.col("past_mid"))
    share = F.when(F.col("past_mid") == 0, F.lit(float("inf"))).otherwise(step / F.when(F.col("past_mid") != 0, F.col("past_mid")))
    hour = F.greatest(F.lit(0.0), F.col("volume_24h") - F.col("past_volume"))
    usual = F.greatest(F.lit(0.001), (F.col("volume_24h") - hour) / 23)
    rows = pairs.filter(F.col("mid").between(0.15, 0.85) & (F.lit(as_of) - F.col("tick") <= most_age) & F.col("past_mid").isNotNull())
    rows = rows.withColumn("share", F.round(share, 6)).withColumn("ratio", F.round(hour / usual, 6)).withColumn("step", F.round(step, 6))
    moving, loud = (F.col("share") >= 0.10) & (F.col("step") >= 0.03), (F.col("ratio") >= 5) & (F.col("share") < 0.03)
    kind = F.when(moving & (F.col("ratio") >= 5), "momentum with volume").when(moving, "momentum").when(loud, "volume")
    confidence = F.when(moving & (F.col("ratio") >= 5), 0.8).when(moving, 0.65).when(loud, 0.6)
    return rows.withColumn("kind", kind).withColumn("confidence", confidence)


def early_markets(quotes: DataFrame, as_of: int, most_age: int) -> DataFrame:
    """First and last quote of each event, and why a market is no early signal. Equal times go by outcome."""
    order = F.struct("tick", "outcome", "seq")
    quote = F.struct("tick", "outcome", "mid", "bid", "ask", "liquidity")
    rows = quotes.groupBy("event_id").agg(F.max_by(quote, order).alias("last"), F.min_by("mid", order).alias("first_mid"))
    last = F.col("last")
    reason = (
        F.when(last["mid"].isNull(), "no price").when(F.lit(as_of) - last["tick"] > most_age, "stale").when(F.abs(last["mid"] - 0.5) < 0.10, "near even")
        .when(~last["mid"].between(0.05, 0.95), "extreme").when(last["ask"] - last["bid"] >= 0.05, "wide").when(last["liquidity"] < 5000, "thin")
    )
    moved = F.round(F.try_divide((last["mid"] - F.col("first_mid")) * 100, F.col("first_mid")), 4)
    return rows.select("event_id", last["outcome"].alias("outcome"), last["mid"].alias("mid"), reason.alias("reason"), moved.alias("movement"))


def signal_actions(candidates: DataFrame, signals: DataFrame, as_of: int, cooldown: int) -> DataFrame:
    """What to do with each candidate (event_id, kind): insert, update (with the next count) or skip for cooldown.

    ``signals``: event_id, kind, seen_at, dismissed_at, count. The newest active signal is
    updated; a recent dismissal holds new ones back.
    """
    per = signals.groupBy("event_id", "kind").agg(
        F.max_by(F.when(F.col("dismissed_at").isNull(), F.col("count")), F.when(F.col("dismissed_at").isNull(), F.struct("seen_at", "count"))).alias("active"),
        F.max("dismissed_at").alias("dismissed"),
        F.count_if(F.col("dismissed_at").isNull()).alias("n_active"),
    )
    rows = candidates.join(per, ["event_id", "kind"], "left")
    action = F.when(F.col("active").isNotNull(), "update").when(F.col("dismissed") > as_of - cooldown, "skip").otherwise("insert")
    return rows.select("event_id", "kind", action.alias("action"), (F.coalesce("active", F.lit(0)) + 1).alias("count"), F.greatest(F.coalesce("n_active", F.lit(0)) - 1, F.lit(0)).alias("older_duplicates"))


def stale_signals(signals: DataFrame, quotes: DataFrame, as_of: int, back: int) -> DataFrame:
    """Signals with members (array) of which any has no quote in the lookback, and how many."""
    live = quotes.filter(F.col("tick").between(as_of - back, as_of)).select(F.col("event_id").alias("member")).distinct().withColumn("live", F.lit(True))
    rows = signals.select("signal_id", F.explode("members").alias("member")).join(live, "member", "left")
    return rows.groupBy("signal_id").agg(F.count("*").alias("members"), F.count_if(F.col("live").isNull()).alias("dead")).withColumn("stale", F.col("dead") > 0)


def visible_signals(signals: DataFrame, open_events: DataFrame, as_of: int, minutes: int, least_edge: float, exempt: list[str]) -> DataFrame:
    """Undismissed fresh signals with enough edge (or an exempt kind), none of whose members has an open leg."""
    rows = signals.filter(F.col("dismissed_at").isNull() & (F.lit(as_of) - F.col("seen_at") <= minutes * 60 * SECOND))
    rows = rows.filter((F.col("edge") >= least_edge) | F.col("kind").isin(exempt))
    taken = rows.select("signal_id", F.explode(F.array_union(F.array("event_id"), F.col("members"))).alias("event")).join(open_events.select(F.col("event_id").alias("event")).distinct(), "event", "left_semi")
    return rows.join(taken.select("signal_id").distinct(), "signal_id", "left_anti")


def scenarios(prices: Column, stake: float) -> Column:
    """For each member of a basket: its chance p / total, and the profit if it comes true, buying all sides under or all others over."""
    total = F.aggregate(prices, F.lit(0.0), lambda a, p: a + p)
    others = F.aggregate(prices, F.lit(0.0), lambda a, p: a + stake / (1 - p))
    n = F.size(prices)
    return F.transform(
        prices,
        lambda p: F.struct(
            F.round(p / total, 6).alias("chance"),
            F.round(F.when(total > 1, others - stake / (1 - p) - stake * n).otherwise(stake / p - stake * n), 4).alias("profit"),
        ),
    )


def reject_reason(price: Column, liquidity: Column, volume: Column, sides: Column, spread: Column, days: Column) -> Column:
    """The first rule that a roster candidate breaks, or null."""
    return (
        F.when(sides == 0, "empty book").when(price.isNull(), "no price").when(days.isNull(), "no end").when(days <= 0, "ended").when(days > 90, "far")
        .when(liquidity < 5000, "low liquidity").when(volume < 2500, "low volume").when(sides == 1, "one-sided").when(spread > 0.015, "wide")
    )


def roster(candidates: DataFrame, per_theme: int, most: int) -> DataFrame:
    """The most liquid candidates of each theme, at most ``most`` in all; ``cut`` is why others are left out.

    Ties go by market_id. A theme's ranking needs its first ``per_theme + 1`` rows only, which
    Spark limits within each task before it shuffles.
    """
    from pyspark.sql import Window

    spot = Window.partitionBy("theme").orderBy(F.col("liquidity").desc(), "market_id")
    ranked = candidates.withColumn("rank", F.row_number().over(spot)).filter(F.col("rank") <= per_theme)
    chosen = ranked.orderBy(F.col("liquidity").desc(), "market_id").limit(most)
    return chosen.select("market_id", "theme", "liquidity", "rank")


def mirror_markets(markets: DataFrame, low: float, high: float) -> DataFrame:
    """Pairs (a, b) of one group, a < b, whose prices add up to between ``low`` and ``high``.

    The join is on group and price cell: the partner's price lies in a known interval, so each
    row meets two cells of its width and not its whole group.
    """
    width = high - low
    cell = lambda x: F.floor(F.round(x / F.lit(width), 9)).cast("long")
    a = markets.select("group_id", F.col("market_id").alias("a"), F.col("yes").alias("pa"))
    a = a.withColumn("cell", F.explode(F.array_distinct(F.array(cell(low - F.col("pa")), cell(high - F.col("pa"))))))
    b = markets.select("group_id", F.col("market_id").alias("b"), F.col("yes").alias("pb")).withColumn("cell", cell(F.col("pb")))
    return a.join(b, ["group_id", "cell"]).filter((F.col("a") < F.col("b")) & F.round(F.col("pa") + F.col("pb"), 6).between(low, high)).select("group_id", "a", "b")
