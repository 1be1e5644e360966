"""Bookmaker odds: fair prices, lines at an instant, consensus, suspensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fair(prices: DataFrame, by: list[str]) -> DataFrame:
    """Implied probability of decimal odds, the market's overround, and the probability without it."""
    implied = F.when(F.col("price") > 1, 1 / F.col("price"))
    rows = prices.withColumn("implied", implied)
    totals = rows.groupBy(*by).agg(F.sum("implied").alias("overround"))
    return rows.join(totals, by).withColumn("fair", F.try_divide("implied", "overround"))


def line_at(entries: DataFrame, by: list[str], as_of: int) -> DataFrame:
    """The last entry and the last active one of each line up to the instant, and how stale the active one is.

    At equal times the last of the input (by seq) counts.
    """
    rows = entries.filter(F.col("created") <= as_of)
    active = F.col("active")
    order = F.struct("created", "seq")
    out = rows.groupBy(*by).agg(
        F.max_by("price", order).alias("last_price"), F.max_by("active", order).alias("last_active"), F.max_by(F.when(active, F.col("price")), F.when(active, order)).alias("price"),
        F.max(F.when(active, F.col("created"))).alias("created"),
    )
    return out.withColumn("stale", (F.lit(as_of) - F.col("created")) / 1_000_000)


def consensus(lines: DataFrame, by: list[str], most_stale: float) -> DataFrame:
    """Median price over bookmakers whose line is fresh, and how many took part of how many."""
    fresh = F.col("stale") <= most_stale
    return lines.groupBy(*by).agg(F.median(F.when(fresh, F.col("price"))).alias("consensus"), F.count_if(fresh).alias("used"), F.count("*").alias("books"))


def suspensions(entries: DataFrame, by: list[str]) -> DataFrame:
    """Maximal runs of inactive entries: start, end, n, the price before and after, and whether both exist."""
    spot = Window.partitionBy(*by).orderBy("created", "seq")
    rows = entries.withColumn("off", ~F.col("active"))
    rows = rows.withColumn("change", F.when(F.col("off") != F.coalesce(F.lag("off").over(spot), ~F.col("off")), 1).otherwise(0))
    rows = rows.withColumn("before", F.lag("price").over(spot)).withColumn("after", F.lead("price").over(spot))
    rows = rows.withColumn("island", F.sum("change").over(spot.rowsBetween(Window.unboundedPreceding, 0))).filter("off")
    order = F.struct("created", "seq")
    out = rows.groupBy(*by, "island").agg(
        F.min("created").alias("start"), F.max("created").alias("end"), F.count("*").alias("n"), F.min_by("before", order).alias("before"), F.max_by("after", order).alias("after")
    )
    return out.withColumn("enclosed", F.col("before").isNotNull() & F.col("after").isNotNull()).drop("island")


def coincident(blocks: DataFrame, market: str, book: str, tolerance: int) -> DataFrame:
    """Blocks of one market that overlap, within the tolerance, with a block of another bookmaker: their books.

    Blocks are dealt into spans of time that they touch; an overlapping pair shares one.
    """
    width = max(4 * tolerance, 1)
    rows = blocks.withColumn("cell", F.explode(F.sequence(F.floor((F.col("start") - tolerance) / width), F.floor((F.col("end") + tolerance) / width))))
    a = rows.select(market, "cell", F.col(book).alias("a_book"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = rows.select(market, "cell", F.col(book).alias("b_book"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    near = (F.col("a_start") - tolerance <= F.col("b_end")) & (F.col("b_start") - tolerance <= F.col("a_end")) & (F.col("a_book") != F.col("b_book"))
    pairs = a.join(b, [market, "cell"]).filter(near)
    return pairs.groupBy(market, "a_book", "a_start", "a_end").agg(F.sort_array(F.collect_set("b_book")).alias("books"))
