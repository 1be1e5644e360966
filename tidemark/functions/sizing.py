"""Edges, fees, stakes and other scalar rules of trading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled_round(value: Column, places: int) -> Column:
    """``value`` times a power of ten, rounded half away from zero and divided again.

    So SQL engines round doubles. ``F.round`` rounds the shortest decimal text instead, which differs where that ends in a 5 and the product is not a half.
    """
    return F.round(value * F.lit(float(10**places)), 0) / F.lit(float(10**places))


def basket_edge(total: Column, members: Column, fee: Column | None = None) -> Column:
    """Percent edge of a basket whose prices add up to ``total``.

    Above 1 the other sides are bought: (total - 1) / (members - total); else the sides
    themselves: (1 - total) / total. A pool of zero or less has no edge.
    """
    fee = F.lit(0.0) if fee is None else fee
    over, under = members - total, total
    edge = F.when(total > 1, F.when(over > 0, (total - 1) / over)).otherwise(F.when(under > 0, (1 - total) / under))
    return F.when(edge.isNull(), 0.0).otherwise((edge - fee) * 100)


def basket_fee(prices: Column, rate: float, over: Column) -> Column:
    """Mean fee of the legs: rate * p for each p below 1 when the basket is over, else rate * (1 - p) for 0 < p < 1."""
    no = F.filter(prices, lambda p: p < 1)
    yes = F.filter(prices, lambda p: (p > 0) & (p < 1))
    mean = lambda xs, f: F.coalesce(F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, p: a + f(p)), F.size(xs)), F.lit(0.0))
    return F.when(over, mean(no, lambda p: p * rate)).otherwise(mean(yes, lambda p: (1 - p) * rate))


def kelly(p: Column, odds: Column, fraction: float, cap: float) -> Column:
    edge = p * (odds + 1) - 1
    return F.when(edge <= 0, 0.0).otherwise(F.least(F.try_divide(edge, odds) * fraction, F.lit(cap)))


def stake(bankroll: Column, edge: Column, cap: float) -> Column:
    """Half a unit at least; else the bankroll's share edge / 200, at most ``cap``, to two places."""
    return F.greatest(F.lit(0.5), scaled_round(bankroll * F.least(F.lit(cap), edge / 200), 2))


def least_bankroll(legs: Column, cap: float, factor: float) -> Column:
    return F.ceil(legs / F.lit(cap * factor)).cast("long")


def parse_probability(text: Column) -> Column:
    """struct(value, error): a percentage such as ``62,5 %`` as 0.625."""
    digits = F.replace(F.trim(F.replace(F.trim(text), F.lit("%"), F.lit(""))), F.lit(","), F.lit("."))
    number = F.when(F.rlike(digits, F.lit(r"^\d+(\.\d+)?$")), digits.try_cast("double"))
    error = F.when(text.isNull() | (F.trim(text) == ""), "empty").when(number.isNull(), "not a number").when(number > 100, "out of range")
    return F.struct(F.when(error.isNull(), F.round(number / 100, 5)).alias("value"), error.alias("error"))


def wilson(hits: Column, n: Column, z: float = 1.959964) -> Column:
    """struct(low, high) of the Wilson interval; without trials 0 to 1."""
    p = hits / n
    mid, half, whole = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    none = n == 0
    return F.struct(F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), (mid - half) / whole)).alias("low"), F.when(none, 1.0).otherwise(F.least(F.lit(1.0), (mid + half) / whole)).alias("high"))


def series_probability(p: Column, need: int) -> Column:
    """The probability of winning ``need`` games before the other side does, games being independent with ``p`` each."""
    terms = [F.lit(1.0)]
    for lost in range(1, need):
        terms.append(terms[-1] * (need - 1 + lost) / lost)
    out = F.lit(0.0)
    for lost, ways in enumerate(terms):
        out = out + ways * F.pow(1 - p, F.lit(lost))
    return out * F.pow(p, F.lit(need))


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price of a model call at prices per million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000
