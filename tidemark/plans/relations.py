"""Relations between markets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizing import scaled_round, wilson
from ..operators import relations as op
from ..sources.tables import read
from ._base import Family

FAMILY = Family()
query = FAMILY.query

_RELATIONS = """WITH r AS (SELECT o_custkey AS relation_id, list(o_orderkey ORDER BY o_orderkey)[1:3] AS l, CASE o_custkey % 6 WHEN 0 THEN 'implies' WHEN 1 THEN 'excludes' WHEN 2 THEN 'partitions' WHEN 3 THEN 'equals' WHEN 4 THEN 'conjunction' ELSE 'other' END AS kind FROM orders GROUP BY o_custkey),
rel AS (SELECT relation_id, kind, CASE WHEN kind IN ('implies', 'excludes', 'equals') AND relation_id % 7 <> 0 THEN l[1:2] ELSE l END AS labels, relation_id % 13 / 10.0 AS confidence FROM r)"""


def relations_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    orders = read(spark, sf_dir, "orders")
    kind = F.when(c % 6 == 0, "implies").when(c % 6 == 1, "excludes").when(c % 6 == 2, "partitions").when(c % 6 == 3, "equals").when(c % 6 == 4, "conjunction").otherwise("other")
    # collect_list leaves nulls out, which SQL lists last
    keys = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").isNull().alias("none"), F.col("o_orderkey").alias("key"))))
    rows = orders.groupBy("o_custkey").agg(F.slice(keys["key"], 1, 3).alias("l")).select(c.alias("relation_id"), kind.alias("kind"), "l")
    two = F.col("kind").isin("implies", "excludes", "equals") & (F.col("relation_id") % 7 != 0)
    return rows.select("relation_id", "kind", F.when(two, F.slice("l", 1, 2)).otherwise(F.col("l")).alias("labels"), (F.col("relation_id") % 13 / F.lit(10.0)).alias("confidence"))


_VERDICTS = _RELATIONS + """, o AS (SELECT o_orderkey AS label, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS outcome FROM orders),
x AS (SELECT relation_id, kind, list(outcome ORDER BY i) AS o FROM (SELECT relation_id, kind, unnest(labels) AS label, generate_subscripts(labels, 1) AS i FROM rel) LEFT JOIN o USING (label) GROUP BY ALL),
h AS (SELECT relation_id, kind, o, CASE kind WHEN 'implies' THEN NOT o[1] OR o[-1] WHEN 'excludes' THEN len(list_filter(o, lambda v: v)) <= 1 WHEN 'partitions' THEN len(list_filter(o, lambda v: v)) = 1 WHEN 'equals' THEN o[1] = o[-1] WHEN 'conjunction' THEN o[1] = list_bool_and(o[2:]) END AS holds FROM x),
v AS (SELECT relation_id, kind, CASE WHEN len(list_filter(o, lambda v: v IS NULL)) > 0 OR holds IS NULL THEN 'untestable' WHEN holds THEN 'confirmed' ELSE 'refuted' END AS verdict FROM h)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    outcomes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("label"), F.when(status == "F", True).when(status == "O", False).alias("outcome"))
    rows = op.with_outcomes(relations_of(spark, sf_dir), outcomes)
    return rows.withColumn("verdict", op.verdict(F.col("kind"), F.col("outcomes")))


@query(_VERDICTS + " SELECT relation_id, kind, verdict FROM v")
def relation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-45, J-35, S-31."""
    return _judged(spark, sf_dir).select("relation_id", "kind", "verdict")


@query(_VERDICTS + """, c AS (SELECT kind, count(*) FILTER (verdict <> 'untestable') AS n, count(*) FILTER (verdict = 'refuted') AS refuted FROM v GROUP BY kind)
SELECT kind, n, refuted, round(CASE WHEN n = 0 THEN 0 ELSE greatest(0, (refuted / n + 1.959964 ** 2 / (2 * n) - 1.959964 * sqrt(refuted / n * (1 - refuted / n) / n + 1.959964 ** 2 / (4 * n * n))) / (1 + 1.959964 ** 2 / n)) END, 5) AS low FROM c""")
def refutation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-46: with a Wilson interval; without tests from 0."""
    rows = _judged(spark, sf_dir).groupBy("kind").agg(F.count_if(F.col("verdict") != "untestable").alias("n"), F.count_if(F.col("verdict") == "refuted").alias("refuted"))
    safe = wilson(F.col("refuted"), F.when(F.col("n") > 0, F.col("n")))
    return rows.select("kind", "n", "refuted", scaled_round(F.coalesce(safe["low"], F.lit(0.0)), 5).alias("low"))


@query(_RELATIONS + """, p AS (SELECT list_filter([CASE WHEN kind = 'other' THEN 'unknown type' END, CASE WHEN len(list_filter(labels, lambda x: x % 20 = 0)) > 0 THEN 'unknown label' END, CASE WHEN len(list_distinct(labels)) < len(labels) THEN 'repeated label' END,
  CASE WHEN kind IN ('implies', 'excludes', 'equals') AND len(labels) <> 2 OR kind = 'partitions' AND len(labels) < 2 OR kind = 'conjunction' AND len(labels) < 3 THEN 'arity' END, CASE WHEN confidence > 1 THEN 'confidence' END], lambda x: x IS NOT NULL) AS p FROM rel)
SELECT array_to_string(p, ', ') AS problems, count(*) AS n FROM p GROUP BY 1""")
def relation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-24."""
    rows = relations_of(spark, sf_dir)
    known = F.filter("labels", lambda x: x % 20 != 0)
    found = op.problems(F.col("kind"), F.col("labels"), known, F.col("confidence"))
    return rows.groupBy(F.array_join(found, ", ").alias("problems")).agg(F.count("*").alias("n"))
