"""A registry of enrichers: named functions from matches to fragments, replayed at an instant."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Enricher:
    """``fetch(matches, as_of)`` returns match_id, kind, as_of, payload. Sources that only know the present are no use in a replay."""

    name: str
    point_in_time: bool
    fetch: Callable[[DataFrame, int], DataFrame]


def admit(enricher: Enricher, as_of: int, now: int, most_age: int = 300_000_000) -> str | None:
    """Why an enricher may not run for the instant, or None."""
    if as_of > now:
        return "future"
    if not enricher.point_in_time and now - as_of > most_age:
        return "not point in time"
    return None


def enrich(matches: DataFrame, enrichers: list[Enricher], as_of: int, now: int) -> DataFrame:
    """Fragments of all admitted enrichers, with name and confidence range checked; none speaks of what came later."""
    parts = [e.fetch(matches, as_of).withColumn("enricher", F.lit(e.name)) for e in enrichers if admit(e, as_of, now) is None]
    if not parts:
        return matches.limit(0).select("match_id", F.lit("").alias("kind"), F.lit(0).cast("long").alias("as_of"), F.lit("").alias("payload"), F.lit("").alias("enricher"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter((F.col("as_of") <= as_of) & F.col("payload").isNotNull())


def score(points: DataFrame, forecasters: dict[str, Column], outcome: Column) -> DataFrame:
    """Brier score of any forecaster columns in one pass: (forecaster, n, brier)."""
    sums = points.agg(*[x for name, p in forecasters.items() for x in (F.count(p).alias(f"{name}_n"), F.avg(F.pow(p - outcome, F.lit(2))).alias(f"{name}_b"))])
    rows = F.array(*[F.struct(F.lit(name).alias("forecaster"), F.col(f"{name}_n").alias("n"), F.col(f"{name}_b").alias("brier")) for name in forecasters])
    return sums.select(F.inline(rows))


def stamped(rows: DataFrame, at: Column) -> DataFrame:
    """Rows with the instant of writing, for append-only tables; an ``updated_at`` that comes with them is replaced."""
    return rows.withColumn("updated_at", at)
