"""Retention, upserts, health and cadence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, changes: DataFrame, key: Sequence[str], seq: str, ignore: bool = False) -> DataFrame:
    """``base`` with ``changes`` by key: the last change wins, or with ``ignore`` what exists stays.

    Both have the same columns and ``seq``; one aggregation, no merge.
    """
    columns = [c for c in base.columns if c not in key]
    tagged = base.withColumn("_c", F.lit(0)).unionByName(changes.withColumn("_c", F.lit(1)))
    # among changes the last wins even where existing rows are kept: only rank 0 beats them
    order = F.struct((1 - F.col("_c")).alias("old"), F.col(seq)) if ignore else F.struct("_c", F.col(seq))
    return tagged.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*key, "r.*")


def last_of_each(rows: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The row of the largest ``seq`` of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(*key, "r.*")


def split_first_seen(found: DataFrame, known: DataFrame, key: Sequence[str], stamp: str) -> tuple[DataFrame, DataFrame]:
    """(new, known) rows of ``found``; only new ones carry the provenance stamp."""
    names = known.select(*key).distinct()
    return found.join(names, list(key), "left_anti").withColumn("provenance", F.lit(stamp)), found.join(names, list(key), "left_semi")


def protected(slug: Column, patterns: Sequence[str], fallback: Sequence[str]) -> Column:
    """Whether a slug matches one of the patterns (LIKE); without patterns the fallback list protects. A null slug is unknown."""
    out = F.lit(False)
    for p in patterns or fallback:
        out = out | slug.like(p)
    return F.when(slug.isNotNull(), out)


def deletable(snapshots: DataFrame, events: DataFrame, as_of: int, most_age: int, final_age: int, patterns: Sequence[str], fallback: Sequence[str]) -> DataFrame:
    """Snapshots to delete with the branch that does: old (by age, null slugs too) or finalized (known slugs only).

    Events with open legs (``held``) and protected slugs keep their snapshots.
    """
    rows = snapshots.join(events, "event_id", "left")
    safe = protected(F.col("slug"), patterns, fallback)
    free = ~F.coalesce(F.col("held"), F.lit(False))
    old = free & ~F.coalesce(safe, F.lit(False)) & (F.col("tick") < as_of - most_age)
    done = free & F.col("slug").isNotNull() & ~safe & (F.col("status") == "final") & (F.col("tick") < as_of - final_age)
    return rows.withColumn("branch", F.when(old, "old").when(done, "finalized"))


def partitions_to_manage(rows: DataFrame, day: str, today: int, ahead: int, keep: int) -> DataFrame:
    """(day, n, action) over all days from the first to ``today + ahead``: create, drop (older than ``keep``, 30 at least) or keep."""
    have = rows.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n"))
    span = have.agg(F.min("day").alias("first")).select(F.explode(F.sequence("first", F.lit(today + ahead))).alias("day"))
    action = F.when(F.col("day") < today - max(keep, 30), F.when(F.col("n").isNotNull(), "drop")).when(F.col("n").isNull(), "create").otherwise("keep")
    return span.join(have, "day", "left").withColumn("action", action).filter("action IS NOT NULL").withColumn("n", F.coalesce("n", F.lit(0)))


def health(beats: DataFrame, alerts: DataFrame, as_of: int, limit: int, remind: int) -> DataFrame:
    """What to say about each component: none, alert, remind, recovered or never_beat.

    ``beats``: component, last_at (null: never), status; ``alerts``: component, state, notified_at.
    """
    rows = beats.join(alerts, "component", "left")
    down = (F.lit(as_of) - F.col("last_at") > limit) | (F.col("status") == "error")
    alerted = F.coalesce(F.col("state") == "down", F.lit(False))
    say = (
        F.when(F.col("last_at").isNull(), "never_beat").when(down & ~alerted, "alert").when(down & (F.lit(as_of) - F.col("notified_at") >= remind), "remind")
        .when(~down & alerted, "recovered").otherwise("none")
    )
    return rows.withColumn("say", say)


def due(buckets: DataFrame, as_of: int, intervals: dict[str, int], derived_factor: int, tolerance: int) -> DataFrame:
    """Buckets (band, derived, last_run) whose cadence has passed, within the tick tolerance."""
    wait = F.lit(None).cast("long")
    for name, seconds in intervals.items():
        wait = F.when(F.col("band") == name, seconds * 1_000_000).otherwise(wait)
    wait = wait * F.when(F.col("derived"), derived_factor).otherwise(1)
    return buckets.withColumn("due", F.col("last_run").isNull() | (F.lit(as_of) - F.col("last_run") >= wait - tolerance))


def changed(rows: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows with whether the value differs from the one before; the first always does."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("changed", ~F.equal_null(F.col(value), before) | before.isNull())


def known_streak(rows: DataFrame, by: Sequence[str], order: str, known: str, stop: int) -> DataFrame:
    """Rows up to where ``stop`` known ones have come in a row; the rest is not read."""
    spot = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("_reset", F.sum(F.when(F.col(known), 0).otherwise(1)).over(spot.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("streak", F.sum(F.col(known).cast("int")).over(Window.partitionBy(*by, "_reset").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    ended = F.max((F.col("streak") >= stop).cast("int")).over(spot.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("read", F.coalesce(ended, F.lit(0)) == 0).drop("_reset")


def orphans_by_prefix(events: DataFrame, linked: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """(prefix, n): unlinked events by slug prefix, zero included. Prefixes must be plain names, at most 20."""
    names = [p for p in prefixes if p.isascii() and p.replace("-", "").isalnum()]
    if len(names) != len(prefixes) or len(names) > 20:
        raise ValueError("prefixes must be up to 20 names of letters, digits and hyphens")
    spark = events.sparkSession
    table = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in names])).alias("prefix"))
    free = events.join(linked.select("event_id").distinct(), "event_id", "left_anti")
    hits = free.select(F.explode(F.filter(F.array(*[F.lit(p) for p in names]), lambda p: F.startswith(F.col("slug"), F.concat(p, F.lit("-"))))).alias("prefix"))
    counts = hits.groupBy("prefix").agg(F.count("*").alias("n"))
    return table.join(counts, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("n"))


def retention_batch(rows: DataFrame, order: Sequence[str], size: int = 5000) -> DataFrame:
    """The oldest ``size`` rows that :func:`deletable` gave a branch; one run deletes no more, and the next goes on from there."""
    return rows.filter(F.col("branch").isNotNull()).orderBy(*order).limit(max(size, 1))


def retention_counts(rows: DataFrame, events: DataFrame, patterns: Sequence[str], fallback: Sequence[str]) -> DataFrame:
    """One row: snapshots that the whole run deletes by branch, and the events that are protected (held, or by slug)."""
    safe = F.coalesce(F.col("held"), F.lit(False)) | F.coalesce(protected(F.col("slug"), patterns, fallback), F.lit(False))
    kept = events.agg(F.count_if(safe).alias("protected"))
    return rows.agg(F.count_if(F.col("branch") == "old").alias("old"), F.count_if(F.col("branch") == "finalized").alias("finalized")).crossJoin(F.broadcast(kept))


def expired_fragments(fragments: DataFrame, as_of: int, days: int | None, size: int = 5000) -> DataFrame:
    """The oldest ``size`` fragments by ``observed_at`` (when they came in, not what they speak of) beyond ``days``: 30 at least, 365 where unset."""
    keep = 365 if days is None else max(days, 30)
    return fragments.filter(F.col("observed_at") < as_of - keep * 86_400_000_000).orderBy("observed_at", "fragment_id").limit(max(size, 1))


def with_any(items: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[str], cap: int) -> DataFrame:
    """The first ``cap`` items that have any row, with ``capped``: whether there are more."""
    found = items.join(rows.select(*key).distinct(), list(key), "left_semi")
    first = found.orderBy(*order).limit(cap + 1)
    n = first.agg((F.count("*") > cap).alias("capped"))
    return first.orderBy(*order).limit(cap).crossJoin(F.broadcast(n))
