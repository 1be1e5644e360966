"""As-of joins: the row of the right side that is nearest in time to each row of the left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


def _order(distance: Column, at: Column, seq: Column, tie: str) -> Column:
    second = {"earlier": at, "later": -at, "first": seq, "last": -seq}[tie]
    return F.struct(distance.alias("d"), second.alias("t"), seq.alias("s"))


def nearest(
    left: DataFrame, right: DataFrame, by: Sequence[str], key: Sequence[str], target: str, tolerance: int, payload: Sequence[str],
    direction: str = "both", tie: str = "earlier", seq: str | None = None,
) -> DataFrame:
    """``key``, ``target`` and the payload of the nearest right row with equal ``by``, nulls where there is none.

    ``key`` identifies rows of ``left``; ``target`` is its column of microseconds, and the right
    side's time is ``tick``. ``direction`` is both, backward (tick <= target) or forward; the tolerance
    is inclusive. At equal distance ``tie`` decides: earlier, later, first or last (by ``seq``).

    Times fall into buckets of the tolerance's width, so the join is on equality of ``by`` and
    bucket: a left row meets the at most three buckets that its tolerance reaches.
    """
    width = max(tolerance, 1)
    spread = {"both": (-1, 0, 1), "backward": (-1, 0), "forward": (0, 1)}[direction]
    wanted = left.select(*by, *[k for k in key if k not in by], F.col(target).alias("_target"))
    wanted = wanted.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col("_target") / F.lit(width)).cast("long") + s for s in spread])))
    order = F.col(seq) if seq else F.col("tick")
    rows = right.select(*by, F.col("tick").alias("_at"), order.alias("_seq"), F.struct(*payload).alias("_payload"), F.floor(F.col("tick") / F.lit(width)).cast("long").alias("_bucket"))
    gap = F.col("_target") - F.col("_at")
    low, high = {"both": (-tolerance, tolerance), "backward": (0, tolerance), "forward": (-tolerance, 0)}[direction]
    pairs = wanted.join(rows, [*by, "_bucket"]).filter(gap.between(low, high))
    found = pairs.groupBy(*key).agg(F.min_by("_payload", _order(F.abs(gap), F.col("_at"), F.col("_seq"), tie)).alias("_found"))
    out = left.select(*key, target).join(found, list(key), "left")
    return out.select(*key, target, *[F.col("_found")[c].alias(c) for c in payload])


def latest_before(left: DataFrame, right: DataFrame, by: Sequence[str], target: str, payload: Sequence[str]) -> DataFrame:
    """``left`` with the payload of the last right row at or before ``target``, without tolerance.

    Both sides are merged in time order and the last payload is carried forward, so each
    series is read once whatever the distances are.
    """
    extra = [c for c in left.columns if c not in by]
    merged = left.select(*by, F.col(target).alias("_t"), F.lit(1).alias("_kind"), F.struct(*extra).alias("_left")).unionByName(
        right.select(*by, F.col("tick").alias("_t"), F.lit(0).alias("_kind"), F.struct(*payload).alias("_right")), allowMissingColumns=True
    )
    before = Window.partitionBy(*by).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = merged.withColumn("_last", F.last("_right", ignorenulls=True).over(before)).filter("_kind = 1")
    return carried.select(*by, *[F.col("_left")[c].alias(c) for c in extra], *[F.col("_last")[c].alias(c) for c in payload])


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The payload of the last row of each key, by the order columns. Aggregated before the shuffle."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("_last")).select(*by, "_last.*")


def interval_of(points: DataFrame, intervals: DataFrame, by: Sequence[str], key: Sequence[str], target: str, tolerance: int, default: int) -> DataFrame:
    """Each point with the interval whose ``end_at`` is nearest within the tolerance, else a default window.

    Columns: key, target, start_at, end_at, matched. The default window of ``default``
    microseconds ends at the target.
    """
    ends = intervals.select(*by, F.col("end_at").alias("tick"), "start_at", "end_at")
    found = nearest(points, ends, by, key, target, tolerance, ["start_at", "end_at"])
    return found.select(
        *key, target, F.coalesce("start_at", F.col(target) - default).alias("start_at"), F.coalesce("end_at", F.col(target)).alias("end_at"),
        F.col("end_at").isNotNull().alias("matched"),
    )


def count_between(intervals: DataFrame, rows: DataFrame, by: Sequence[str], key: Sequence[str], low: str, high: str) -> DataFrame:
    """``key`` and the number of rows with equal ``by`` and low <= at <= high.

    Two running counts over the merged series replace the range join: rows up to ``high`` less rows before ``low``.
    """
    ids = [k for k in key if k not in by]
    marks = intervals.select(*by, *ids, F.col(low).alias("_t"), F.lit(0).alias("_kind"), F.lit(-1).alias("_sign")).unionByName(
        intervals.select(*by, *ids, F.col(high).alias("_t"), F.lit(2).alias("_kind"), F.lit(1).alias("_sign"))
    )
    merged = marks.unionByName(rows.select(*by, F.col("tick").alias("_t"), F.lit(1).alias("_kind")), allowMissingColumns=True)
    running = Window.partitionBy(*by).orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = merged.withColumn("_n", F.sum(F.when(F.col("_kind") == 1, 1).otherwise(0)).over(running)).filter("_kind <> 1")
    return counted.groupBy(*key).agg(F.sum(F.col("_sign") * F.col("_n")).cast("long").alias("n"))
