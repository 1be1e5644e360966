"""Findings that readings of rule texts produce, spread to all markets with the same text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_form, pair_key, search_form


def digest_hashes(texts: DataFrame) -> DataFrame:
    """(event_id, sha, liquidity, text_of) with the SHA-256 of each event's text."""
    return texts.select("event_id", F.sha2("text", 256).alias("sha"), "liquidity")


def contradictions(findings: DataFrame, events: DataFrame) -> DataFrame:
    """One row per defect, the unordered pair of normalized passages, over all events that share an accused text.

    ``findings``: event_id, sha, kind, passage, conflict, reading; ``events``: event_id, sha,
    liquidity. An event is accused where one of its own readings says so, else it inherits.
    Copies of a text meet their findings by its hash; per-event rows are made distinct before
    they are gathered, and a defect's market list is as long as its text is spread.
    """
    pairs = findings.filter("kind = 'contradiction'").withColumn("defect", pair_key(normal_form(F.col("passage")), normal_form(F.col("conflict"))))
    defects = pairs.groupBy("sha", "defect").agg(
        F.count("*").alias("times"), F.countDistinct("reading").alias("readings"), F.max_by("passage", F.struct("event_id", "reading")).alias("passage"),
        F.max_by("conflict", F.struct("event_id", "reading")).alias("conflict"),
    )
    own = pairs.select("event_id", "defect", F.lit(True).alias("own")).distinct()
    spread = events.join(defects, "sha").join(own, ["event_id", "defect"], "left")
    spread = spread.withColumn("origin", F.when(F.col("own").isNull(), "inherited").otherwise("accused"))
    return spread.groupBy("defect").agg(
        F.countDistinct("event_id").alias("markets"), F.count_if(F.col("origin") == "accused").alias("accused"), F.max("times").alias("times"),
        F.sum("liquidity").alias("liquidity"), F.sum(F.when(F.col("origin") == "accused", F.col("liquidity"))).alias("accused_liquidity"),
        F.min_by("passage", "sha").alias("passage"),
    )


def keyed(findings: DataFrame) -> DataFrame:
    """Findings with their id: the class's letter, and a hash of the normalized passage or pair of passages."""
    passage = normal_form(F.col("passage"))
    prefix = F.when(F.col("kind") == "trap", "t").when(F.col("kind") == "contradiction", "c").otherwise("a")
    body = F.when(F.col("kind") == "contradiction", pair_key(passage, normal_form(F.col("conflict")))).otherwise(F.md5(passage))
    return findings.withColumn("finding", F.concat(prefix, F.lit("-"), body))


def findings_by_event(findings: DataFrame, events: DataFrame) -> DataFrame:
    """One row per event and finding: class-prefixed id, how often its text's readings found it, readings of the text, origin."""
    named = keyed(findings)
    readings = findings.groupBy("sha").agg(F.countDistinct("event_id", "reading").alias("readings"))
    per_text = named.groupBy("sha", "finding", "kind").agg(F.countDistinct("event_id", "reading").alias("found"), F.max("severity").alias("severity"))
    own = named.select("event_id", "finding", F.lit(True).alias("own")).distinct()
    rows = events.join(per_text, "sha").join(readings, "sha").join(own, ["event_id", "finding"], "left")
    return rows.select("event_id", "finding", "kind", "severity", "found", "readings", F.when(F.col("own").isNull(), "inherited").otherwise("accused").alias("origin"))


def market_summary(by_event: DataFrame, events: DataFrame) -> DataFrame:
    """Per event: findings, contradictions, worst severity, best confirmation; null (not zero) without a digest."""
    sums = by_event.groupBy("event_id").agg(
        F.count("*").alias("findings"), F.count_if(F.col("kind") == "contradiction").alias("contradictions"), F.max("severity").alias("worst"),
        F.max(F.col("found") / F.col("readings")).alias("confirmation"),
    )
    return events.select("event_id", "liquidity").join(sums, "event_id", "left")


def consistency(digests: DataFrame, least: int) -> DataFrame:
    """Texts with several readings: how many say what. ``digests``: sha, reading, source, clauses array<string>."""
    signature = F.concat_ws("|", F.sort_array(F.transform("clauses", normal_form)))
    rows = digests.groupBy("sha").agg(
        F.count("*").alias("readings"), F.countDistinct(F.size("clauses")).alias("sizes"), F.countDistinct(signature).alias("signatures"), F.countDistinct("source").alias("sources"),
    )
    return rows.filter(F.col("readings") >= least).withColumn("diverges", F.col("signatures") > 1)


def presence(passage: Column, text: Column) -> Column:
    """literal, spacing (also other case, quotes or dashes) or absent: how a passage stands in its text."""
    return F.when(F.contains(text, passage), "literal").when(F.contains(search_form(text), search_form(passage)), "spacing").otherwise("absent")


def levelling_plan(texts: DataFrame, readings: DataFrame, least: int) -> DataFrame:
    """Missing readings: (sha, reading, event_id): texts below ``least`` readings, their events in turn."""
    n = readings.groupBy("sha").agg(F.count("*").alias("have"))
    spot = Window.partitionBy("sha").orderBy("event_id")
    members = texts.select("sha", "event_id").distinct().withColumn("i", F.row_number().over(spot) - 1).filter(F.col("i") < least)
    sizes = texts.groupBy("sha").agg(F.countDistinct("event_id").alias("events"))
    gaps = sizes.join(n, "sha", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter(F.col("have") < least)
    plan = gaps.select("sha", "events", F.explode(F.sequence(F.col("have") + 1, F.lit(least).cast("long"))).alias("reading"))
    return plan.withColumn("i", (F.col("reading") - 1) % F.col("events")).join(members, ["sha", "i"]).select("sha", "reading", "event_id")


def recall_growth(keys: DataFrame) -> DataFrame:
    """Per text, the distinct findings of its first reading and of all, and a verdict on reading again."""
    rows = keys.groupBy("sha").agg(F.countDistinct(F.when(F.col("reading") == 1, F.col("finding"))).alias("first"), F.countDistinct("finding").alias("all"))
    growth = F.try_divide(F.col("all") - F.col("first"), F.col("all"))
    return rows.withColumn("verdict", F.when(growth >= 0.3, "read again").when(growth < 0.1, "enough").otherwise("unclear"))


def confirmation_seal(found: Column, readings: Column) -> Column:
    """k/n from three readings on; fewer say nothing."""
    return F.when(readings >= 3, F.concat(found.cast("string"), F.lit("/"), readings.cast("string")))


def finding_problems(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """All problems of each finding row, and its severity after demotion: a trap without a scenario is a detail."""
    bad_sha = ~F.rlike("sha", F.lit("^[0-9a-f]{64}$"))
    problems = F.filter(
        F.array(
            F.when(~F.col("kind").isin(kinds), "unknown kind"), F.when(bad_sha, "bad hash"), F.when(F.length(F.trim("passage")) < 10, "short passage"),
            F.when((F.col("kind") == "contradiction") != F.col("conflict").isNotNull(), "conflict mismatch"),
        ),
        lambda p: p.isNotNull(),
    )
    demoted = F.when((F.col("severity") == "grave") & F.col("scenario").isNull(), "detail").otherwise(F.col("severity"))
    return rows.withColumn("problems", problems).withColumn("severity", demoted)
