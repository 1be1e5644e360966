"""Evaluation data sets: prices of matches at checkpoints, with a reason for every point that is left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import nearest

MINUTE = 60_000_000
#: From this price on a side is the favourite, and up to this one the underdog.
FAVOURITE, UNDERDOG = 0.55, 0.45


def checkpoints(matches: DataFrame, minutes: Sequence[int]) -> DataFrame:
    """``matches`` once for each checkpoint, with ``target``: that many minutes before ``scheduled_at``."""
    rows = matches.withColumn("checkpoint", F.explode(F.array(*[F.lit(m) for m in minutes])))
    return rows.withColumn("target", F.col("scheduled_at") - F.col("checkpoint").cast("long") * F.lit(MINUTE))


def checkpoint_prices(matches: DataFrame, quotes: DataFrame, minutes: Sequence[int], tolerance: int) -> DataFrame:
    """(match_id, checkpoint, target, mid, captured_at, reason): the nearest quote of the match's own side.

    ``matches``: match_id, event_id, team, scheduled_at; ``quotes``: event_id, outcome, tick, mid, seq.
    The reason is no_snapshot (none within the tolerance), no_mid, or null for a point.
    """
    points = checkpoints(matches, minutes).withColumnRenamed("team", "outcome")
    rows = quotes.withColumn("captured_at", F.col("tick"))
    found = nearest(points, rows, ["event_id", "outcome"], ["match_id", "checkpoint"], "target", tolerance, ["mid", "captured_at"], seq="seq")
    return found.withColumn("reason", F.when(F.col("captured_at").isNull(), "no_snapshot").when(F.col("mid").isNull(), "no_mid"))


def execution_prices(matches: DataFrame, quotes: DataFrame, minutes: Sequence[int], tolerance: int) -> DataFrame:
    """(match_id, checkpoint, label, own, mid, ask, reason): the favourite's side of each match and checkpoint.

    The own side above one half is the favourite. Below, it is the other label of the event that
    has quotes within the tolerance, if there is just one. A favourite needs an ask; its mid falls
    back to one less the own mid. Reasons, first that holds: no_snapshot, no_mid, tie, no_favourite_side, no_ask.
    """
    points = checkpoints(matches, minutes)
    sides = points.join(quotes.select("event_id", "outcome").distinct(), "event_id")
    rows = quotes.withColumn("captured_at", F.col("tick"))
    near = nearest(sides, rows, ["event_id", "outcome"], ["match_id", "checkpoint", "outcome"], "target", tolerance, ["mid", "ask", "captured_at"], seq="seq")
    near = near.filter("captured_at IS NOT NULL").join(points.select("match_id", "checkpoint", "team"), ["match_id", "checkpoint"])
    side, mine = F.struct("outcome", "mid", "ask"), F.col("outcome") == F.col("team")
    both = near.groupBy("match_id", "checkpoint").agg(F.max(F.when(mine, side)).alias("a"), F.max(F.when(~mine, side)).alias("b"), F.count_if(~mine).alias("others"))
    both = points.select("match_id", "checkpoint").join(both, ["match_id", "checkpoint"], "left")
    own = F.col("a.mid") > 0.5
    label, ask = (F.when(own, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")) for c in ("outcome", "ask"))
    mid = F.when(own, F.col("a.mid")).otherwise(F.coalesce("b.mid", 1 - F.col("a.mid")))
    reason = (
        F.when(F.col("a").isNull(), "no_snapshot").when(F.col("a.mid").isNull(), "no_mid").when(F.col("a.mid") == 0.5, "tie")
        .when(~own & (F.col("others") != 1), "no_favourite_side").when(ask.isNull(), "no_ask")
    )
    kept = lambda c: F.when(F.col("reason").isNull(), c)
    return both.withColumn("reason", reason).select("match_id", "checkpoint", kept(label).alias("label"), kept(own).alias("own"), kept(F.round(mid, 6)).alias("mid"), kept(ask).alias("ask"), "reason")


def series_coverage(matches: DataFrame, quotes: DataFrame, minutes: Sequence[int], tolerance: int) -> DataFrame:
    """(match_id, series, last_at): anchored where a checkpoint has a quote of the own side, else anchorless, other_sides_only or no_series."""
    own = quotes.groupBy("event_id", F.col("outcome").alias("team")).agg(F.max("tick").alias("last_at"))
    known = quotes.select("event_id", F.lit(True).alias("any")).distinct()
    priced = checkpoint_prices(matches, quotes, minutes, tolerance).groupBy("match_id").agg(F.count("captured_at").alias("anchors"))
    rows = matches.join(own, ["event_id", "team"], "left").join(known, "event_id", "left").join(priced, "match_id", "left")
    series = F.when(F.col("anchors") > 0, "anchored").when(F.col("last_at").isNotNull(), "anchorless").when(F.col("any"), "other_sides_only").otherwise("no_series")
    return rows.select("match_id", series.alias("series"), "last_at")


def outcomes(analyses: DataFrame, matches: DataFrame, included: Column) -> DataFrame:
    """``analyses`` (match_id, side, p) with ``outcome`` or the ``reason`` that excludes them.

    The outcome is that of the side that the analysis recorded, whichever side it is on in the
    match today. ``matches``: match_id, team_a, team_b, winner, resolved_at, and what ``included`` reads. Reasons,
    first that holds: match_absent, filtered, no_probability, no_side, void, undecided, incoherent_side.
    """
    rows = analyses.join(matches.withColumn("_found", F.lit(True)).withColumn("_in", included), "match_id", "left")
    side = F.col("side")
    reason = (
        F.when(F.col("_found").isNull(), "match_absent").when(~F.coalesce("_in", F.lit(False)), "filtered").when(F.col("p").isNull(), "no_probability").when(side.isNull(), "no_side")
        .when(F.col("winner").isNull(), F.when(F.col("resolved_at").isNull(), "undecided").otherwise("void"))
        .when(~(side.eqNullSafe(F.col("team_a")) | side.eqNullSafe(F.col("team_b"))), "incoherent_side")
    )
    rows = rows.withColumn("reason", reason).withColumn("outcome", F.when(F.col("reason").isNull(), (side == F.col("winner")).cast("int")))
    return rows.select(*analyses.columns, "outcome", "reason")


def priced_observations(observations: Sequence[DataFrame], quotes: DataFrame, tolerance: int) -> DataFrame:
    """(match_id, team, result, price, band): each distinct pair of a past match and a team with its closing price.

    The lists overlap (form and direct meetings), so pairs are made distinct. The price is the last
    one at or before the start within the tolerance. Columns: match_id, team, event_id, scheduled_at, result.
    """
    rows = observations[0]
    for more in observations[1:]:
        rows = rows.unionByName(more)
    rows = rows.dropDuplicates(["match_id", "team"]).withColumnRenamed("team", "outcome")
    priced = nearest(rows, quotes.filter("mid IS NOT NULL"), ["event_id", "outcome"], ["match_id", "outcome"], "scheduled_at", tolerance, ["mid"], direction="backward", tie="later", seq="seq")
    price = F.col("mid")
    band = F.when(price >= FAVOURITE, "favourite").when(price <= UNDERDOG, "underdog").when(price.isNotNull(), "pickem")
    out = rows.select("match_id", "outcome", "result").join(priced.drop("scheduled_at"), ["match_id", "outcome"])
    return out.select("match_id", F.col("outcome").alias("team"), "result", price.alias("price"), band.alias("band"))


def band_calibration(priced: DataFrame, least: int = 4) -> DataFrame:
    """(band, n, wins, avg_price, brier, enough) of decided observations with a price; void and unpriced ones are counted as bands of their own."""
    kind = F.when(~F.col("result").isin("win", "loss"), "void").when(F.col("price").isNull(), "no_price").otherwise(F.col("band"))
    counted = ~kind.isin("void", "no_price")
    won = (F.col("result") == "win").cast("int")
    return priced.groupBy(kind.alias("band")).agg(
        F.count("*").alias("n"), F.count_if(counted & (F.col("result") == "win")).alias("wins"), F.avg(F.when(counted, F.col("price"))).alias("avg_price"),
        F.avg(F.when(counted, F.pow(F.col("price") - won, F.lit(2)))).alias("brier"), (F.count_if(counted) >= least).alias("enough"),
    )


def select_due(candidates: DataFrame, attempts: DataFrame, key: str, order: Sequence[str], now: int, interval: int, batch: int) -> DataFrame:
    """The first ``batch`` candidates without an attempt (``at``) within the interval, with skipped_recent and truncated; the limit is the feature."""
    last = attempts.groupBy(key).agg(F.max("at").alias("_last"))
    rows = candidates.join(last, key, "left").withColumn("_recent", F.coalesce(F.lit(now) - F.col("_last") < interval, F.lit(False)))
    n = max(batch, 1)
    counts = rows.agg(F.count_if("_recent").alias("skipped_recent"), (F.count_if(~F.col("_recent")) > n).alias("truncated"))
    return rows.filter(~F.col("_recent")).orderBy(*order).limit(n).select(*candidates.columns).crossJoin(F.broadcast(counts))


def decide_once(stored: DataFrame, patches: DataFrame) -> DataFrame:
    """``stored`` (match_id, winner, resolved_at, needs_review) after patches of the same columns by match_id.

    An outcome is written only where neither winner nor resolved_at is set, a review flag only where there is
    none; ``written`` and ``flagged`` say what changed. Patches of unknown matches change nothing.
    """
    p = patches.select("match_id", *[F.col(c).alias(f"_{c}") for c in ("winner", "resolved_at", "needs_review")])
    rows = stored.join(p, "match_id", "left")
    written = F.col("winner").isNull() & F.col("resolved_at").isNull() & (F.col("_winner").isNotNull() | F.col("_resolved_at").isNotNull())
    flagged = ~F.col("needs_review") & F.coalesce("_needs_review", F.lit(False))
    rows = rows.withColumn("written", written).withColumn("flagged", flagged)
    new = lambda c: F.when(F.col("written"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("match_id", new("winner"), new("resolved_at"), (F.col("needs_review") | F.col("flagged")).alias("needs_review"), "written", "flagged")
