"""Column functions on prices and two-sided books."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def change_with_base(now: dict[str, Column], then: dict[str, Column]) -> Column:
    """struct(base, change, reference): over the first of mid, ask, bid that both ends have; bases are never mixed."""
    out = F.struct(F.lit(None).cast("string").alias("base"), F.lit(None).cast("double").alias("change"), F.lit(None).cast("double").alias("reference"))
    for name in ("bid", "ask", "mid"):
        both = now[name].isNotNull() & then[name].isNotNull()
        value = F.struct(F.lit(name).alias("base"), F.round(now[name] - then[name], 6).alias("change"), then[name].alias("reference"))
        out = F.when(both, value).otherwise(out)
    return out


def valid_bid(bid: Column) -> Column:
    return F.when(bid > 0, bid)


def valid_ask(ask: Column) -> Column:
    return F.when((ask > 0) & (ask < 1), ask)


def sides(bid: Column, ask: Column) -> Column:
    """How many sides of the book are valid: 0, 1 or 2."""
    return valid_bid(bid).isNotNull().cast("int") + valid_ask(ask).isNotNull().cast("int")


def first_price(listed: Column, last_trade: Column) -> Column:
    """The first of the two that lies strictly between 0 and 1."""
    inside = lambda x: F.when((x > 0) & (x < 1), x)
    return F.coalesce(inside(listed), inside(last_trade))


def complement(price: Column, places: int = 4) -> Column:
    return F.round(1 - price, places)


def best_level(levels: Column) -> Column:
    """struct(price, depth) of the last level of an array of struct(price string, size string); bad numbers are null."""
    last = F.try_element_at(levels, F.lit(-1))
    price, size = last["price"].try_cast("double"), last["size"].try_cast("double")
    return F.struct(price.alias("price"), F.round(price * size, 6).alias("depth"))


def band(value: Column, edges: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first edge that the value reaches (>=), edges from high to low; null stays null."""
    out = F.when(value.isNotNull(), F.lit(rest))
    for low, label in sorted(edges):
        out = F.when(value >= low, label).otherwise(out)
    return out


def under(value: Column, edges: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first edge that the value stays below (<), edges from low to high; null stays null."""
    out = F.when(value.isNotNull(), F.lit(rest))
    for high, label in sorted(edges, reverse=True):
        out = F.when(value < high, label).otherwise(out)
    return out
