"""Bankroll, positions and settlement of bet legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quotes import complement


def opposite_quotes(sides: DataFrame, labels: Column, wanted: Column) -> DataFrame:
    """The quote of the wanted label: as it stands, or from the other of exactly two labels, else null.

    ``sides`` has label, bid, ask, mid, depth. Complements exchange bid and ask, and have no
    depth. ``provenance`` is own, complement or none.
    """
    own = F.col("label") == wanted
    two = (F.size(labels) == 2) & F.array_contains(labels, F.col("label")) & F.array_contains(labels, wanted)
    pick = lambda same, other: F.when(own, same).when(two, other)
    return sides.select(
        *sides.columns, pick(F.col("bid"), complement(F.col("ask"))).alias("own_bid"), pick(F.col("ask"), complement(F.col("bid"))).alias("own_ask"),
        pick(F.col("mid"), complement(F.col("mid"))).alias("own_mid"), F.when(own, F.col("depth")).alias("own_depth"),
        F.when(own, "own").when(two, "complement").otherwise("none").alias("provenance"),
    )


def shares_of(stake: Column, entry: Column, shares: Column) -> Column:
    return F.coalesce(shares, F.round(stake / entry, 4))


def mark(legs: DataFrame, latest: DataFrame) -> DataFrame:
    """Legs with the value at the latest price: marked_at, value, unrealized and why there is none.

    ``latest`` has event_id, outcome, tick, bid, mid, ask; a leg is worth its shares at the bid, or
    at the mid where there is no bid. Legs whose series is unknown keep a row.
    """
    priced = legs.join(latest, ["event_id", "outcome"], "left")
    price = F.coalesce("bid", "mid")
    held = shares_of(F.col("stake"), F.col("entry"), F.col("shares"))
    value = F.round(held * price, 6)
    reason = F.when(F.col("tick").isNull(), "no quote").when(price.isNull(), "no price")
    return priced.withColumn("held", held).withColumn("value", value).withColumn("unrealized", F.round(value - F.col("stake"), 6)).withColumn("reason", reason)


def bankroll(marked: DataFrame, by: list[str]) -> DataFrame:
    """Sums over open legs; one leg without a value makes the whole marked value null, never zero."""
    rows = marked.filter("NOT closed").groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("stake").alias("staked"), F.count_if(F.col("value").isNull()).alias("unmarked"), F.sum("value").alias("_value"),
        F.count_if(F.col("reason") == "no quote").alias("no_quote"), F.count_if(F.col("reason") == "no price").alias("no_price"),
    )
    return rows.select(*by, "n", "staked", "unmarked", F.when(F.col("unmarked") == 0, F.col("_value")).alias("marked"), "no_quote", "no_price")


def settle(legs: DataFrame) -> DataFrame:
    """payout and pnl of closed legs: a win pays a share each, a loss nothing, a void returns the stake."""
    held = shares_of(F.col("stake"), F.col("entry"), F.col("shares"))
    win, void = F.col("result") == "win", F.col("result") == "void"
    pnl = F.when(win, F.round((1 - F.col("entry")) * held, 6)).when(void, 0.0).otherwise(-F.col("stake"))
    payout = F.when(win, held).when(void, F.col("stake")).otherwise(0.0)
    return legs.withColumn("pnl", F.when(F.col("closed"), pnl)).withColumn("payout", F.when(F.col("closed"), payout))


def bets_of(settled: DataFrame) -> DataFrame:
    """One row per bet: closed once no leg is open; pnl only then. Money is added up as decimals, so that no border is missed."""
    money = lambda name: F.sum(F.col(name).cast("decimal(18,6)")).cast("double")
    rows = settled.groupBy("bet_id").agg(F.count("*").alias("n_legs"), F.count_if(~F.col("closed")).alias("n_open"), money("stake").alias("stake"), money("pnl").alias("_pnl"))
    return rows.select("bet_id", "n_legs", "n_open", "stake", (F.col("n_open") == 0).alias("closed"), F.when(F.col("n_open") == 0, F.col("_pnl")).alias("pnl"))


def performance(settled: DataFrame, at: str, as_of: int, windows: dict[str, int | None]) -> DataFrame:
    """wins, decisive legs, win rate and pnl for each window back from ``as_of``, in one pass over the legs."""
    known = [F.struct(F.lit(name).alias("span"), F.lit(as_of - back if back is not None else None).cast("long").alias("since")) for name, back in windows.items()]
    rows = settled.filter("closed").select("*", F.inline(F.array(*known))).filter(F.col("since").isNull() | (F.col(at) >= F.col("since")))
    win, decisive = F.col("result") == "win", F.col("result") != "void"
    return rows.groupBy("span").agg(
        F.count_if(win).alias("wins"), F.count_if(decisive).alias("decisive"), F.try_divide(F.count_if(win), F.count_if(decisive)).alias("win_rate"), F.sum("pnl").alias("pnl")
    )


def sustained_winner(quotes: DataFrame, as_of: int, back: int, least: int, each: int) -> DataFrame:
    """(event_id, winner): two outcomes, enough quotes of each, one always bid at .99 or more, the other always asked at .01 or less.

    A missing bid or ask fails the test.
    """
    recent = quotes.filter(F.col("tick").between(as_of - back, as_of))
    per = recent.groupBy("event_id", "outcome").agg(
        F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("bid") >= 0.99, F.lit(False))).alias("high"), F.bool_and(F.coalesce(F.col("ask") <= 0.01, F.lit(False))).alias("low"),
    )
    events = per.groupBy("event_id").agg(
        F.sum("n").alias("n"), F.count("*").alias("sides"), F.min("n").alias("fewest"), F.count_if("high").alias("highs"), F.count_if("low").alias("lows"),
        F.max(F.when(F.col("high"), F.col("outcome"))).alias("winner"), F.max(F.when(F.col("low"), F.col("outcome"))).alias("loser"),
    )
    sure = (F.col("sides") == 2) & (F.col("n") >= least) & (F.col("fewest") >= each) & (F.col("highs") == 1) & (F.col("lows") == 1) & (F.col("winner") != F.col("loser"))
    return events.select("event_id", F.when(sure, F.col("winner")).alias("winner"))


def resolution(prices: Column, closed: Column, resolved: Column) -> Column:
    """void, the place of the winner from 0 as text, or null: only closed and resolved markets of two outcomes decide."""
    void = (F.element_at(prices, 1) == "0.5") & (F.element_at(prices, 2) == "0.5")
    first = F.array_position(prices, "1")
    return F.when(closed & resolved & (F.size(prices) == 2), F.when(void, "void").when(first > 0, (first - 1).cast("string")))


def tracks(sources: dict[str, DataFrame], priorities: dict[str, bool]) -> DataFrame:
    """(event_id, priority, source): candidates of all sources; the last source to name an event decides, priority sticks."""
    parts = [df.select("event_id", F.lit(i).alias("_i"), F.lit(name).alias("source"), F.lit(priorities[name]).alias("_p")) for i, (name, df) in enumerate(sources.items())]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("event_id").agg(F.bool_or("_p").alias("priority"), F.max_by("source", "_i").alias("source"), F.count_distinct("source").alias("n_sources"))


def newest_probability(rows: DataFrame, by: str, order: Column) -> DataFrame:
    """The last probability that is not null; a null time counts as the newest."""
    spot = Window.partitionBy(by).orderBy(order.desc_nulls_first(), F.col("seq").desc())
    return rows.filter(F.col("probability").isNotNull()).withColumn("_r", F.row_number().over(spot)).filter("_r = 1").drop("_r")
