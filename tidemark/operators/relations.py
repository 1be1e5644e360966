"""Logical relations between markets, checked against outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many markets each type of relation takes, at least and at most.
ARITY = {"implies": (2, 2), "excludes": (2, 2), "partitions": (2, 99), "equals": (2, 2), "conjunction": (3, 99), "none": (2, 99)}


def problems(kind: Column, labels: Column, known: Column, confidence: Column) -> Column:
    """All problems of a relation: unknown type, unknown or repeated labels, arity, confidence out of 0..1."""
    low, high = F.lit(None).cast("int"), F.lit(None).cast("int")
    for name, (a, b) in ARITY.items():
        low, high = F.when(kind == name, a).otherwise(low), F.when(kind == name, b).otherwise(high)
    return F.filter(
        F.array(
            F.when(low.isNull(), "unknown type"), F.when(F.size(F.array_except(labels, known)) > 0, "unknown label"), F.when(F.size(F.array_distinct(labels)) < F.size(labels), "repeated label"),
            F.when(~F.size(labels).between(low, high), "arity"), F.when(~confidence.between(0, 1), "confidence"),
        ),
        lambda x: x.isNotNull(),
    )


def verdict(kind: Column, outcomes: Column) -> Column:
    """confirmed, refuted or untestable: what the outcomes (booleans in the relation's order) say; a null is untestable.

    So is a conjunction of one market, which has no parts to be compared with.
    """
    yes = F.size(F.filter(outcomes, lambda x: x))
    first, last = F.element_at(outcomes, 1), F.element_at(outcomes, -1)
    rest = F.when(F.size(outcomes) > 1, F.forall(F.slice(outcomes, F.lit(2), F.size(outcomes)), lambda x: x))
    holds = (
        F.when(kind == "implies", ~first | last).when(kind == "excludes", yes <= 1).when(kind == "partitions", yes == 1).when(kind == "equals", first == last)
        .when(kind == "conjunction", first == rest)
    )
    return F.when(F.exists(outcomes, lambda x: x.isNull()) | holds.isNull(), "untestable").when(holds, "confirmed").otherwise("refuted")


def with_outcomes(relations: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(relation_id, kind, outcomes) of relations (relation_id, kind, labels): their labels' outcomes in order; a label without one is null.

    A relation without an id is one too, and so is a null label a label.
    """
    rows = relations.select("relation_id", "kind", F.posexplode("labels").alias("i", "label")).join(outcomes, "label", "left")
    gathered = rows.groupBy("relation_id", "kind").agg(F.sort_array(F.collect_list(F.struct("i", "outcome"))).alias("o"))
    return gathered.select("relation_id", "kind", F.col("o.outcome").alias("outcomes"))
