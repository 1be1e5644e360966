"""Count markets and dispersion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bins as op
from ..sources.tables import markets, points, read, with_ctes
from ._base import Family
from .evaluation import _rounded

FAMILY = Family()
query = FAMILY.query

_BINS = """WITH bins AS (SELECT l_orderkey AS market, (l_linenumber - 1) * 20 AS low, CASE WHEN l_linenumber < 7 THEN l_linenumber * 20 - 1 - (l_suppkey % 11 = 0)::INT END AS high,
  CASE WHEN l_partkey % 9 <> 0 THEN round(l_quantity / 120, 4) END AS price, l_partkey % 8 = 0 AS dead FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1)"""


def bins_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of markets; lineitem's key repeats, so the first row of each is taken."""
    line = F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    return rows.select(
        F.col("l_orderkey").alias("market"), ((line - 1) * 20).alias("low"), F.when(line < 7, line * 20 - 1 - (F.col("l_suppkey") % 11 == 0).cast("int")).alias("high"),
        F.when(F.col("l_partkey") % 9 != 0, F.round(F.col("l_quantity") / 120, 4)).alias("price"), (F.col("l_partkey") % 8 == 0).alias("dead"),
    )


_MOMENTS = """, x AS (SELECT *, low + coalesce(high - low, lag(high - low) OVER (PARTITION BY market ORDER BY low), 20) / 2 AS mid, CASE WHEN dead THEN 0 ELSE price END AS w FROM bins),
s AS (SELECT market, sum(w) AS total, count(*) FILTER (w IS NULL) AS missing, sum(w * mid) AS s1, sum(w * mid * mid) AS s2 FROM x GROUP BY market),
m AS (SELECT market, total, missing, CASE WHEN total <> 0 THEN s1 / total END AS mean, CASE WHEN total <> 0 THEN sqrt(greatest(0, s2 / total - (s1 / total) ** 2)) END AS sd FROM s)"""


@query(_BINS + _MOMENTS + "\nSELECT market, round(total, 5) AS total, missing, round(mean, 5) AS mean, round(sd, 4) AS sd FROM m")
def implied_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-31, W-7."""
    rows = op.implied_moments(bins_of(spark, sf_dir), ["market"])
    return rows.select("market", F.round("total", 5).alias("total"), "missing", F.round("mean", 5).alias("mean"), F.round("sd", 4).alias("sd"))


@query(_BINS + "\nSELECT market, count(*) FILTER (step > 0) AS holes, count(*) FILTER (step < 0) AS overlaps FROM (SELECT market, lead(low) OVER (PARTITION BY market ORDER BY low) - high - 1 AS step FROM bins) GROUP BY market")
def bin_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-7."""
    return op.contiguity(bins_of(spark, sf_dir), ["market"])


_Z = ", z AS (SELECT m.*, o_orderpriority AS series, (market % 4)::INT AS \"offset\", CASE WHEN sd > 1 THEN (o_totalprice / 5000 - mean) / sd END AS z FROM m JOIN orders ON o_orderkey = market)"
_SUMMARY = ', y AS (SELECT series, "offset", count(z) AS n, avg(z) AS mean, stddev_samp(z) AS sd, median(total) AS median_total, avg(z) - 1.96 * stddev_samp(z) / sqrt(count(z)) AS low, avg(z) + 1.96 * stddev_samp(z) / sqrt(count(z)) AS high FROM z GROUP BY ALL)'


def _z_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("market"), F.col("o_orderpriority").alias("series"), "o_totalprice")
    rows = op.implied_moments(bins_of(spark, sf_dir), ["market"]).join(orders, "market").withColumn("offset", (F.col("market") % 4).cast("int"))
    rows = rows.withColumn("z", F.when(F.col("sd") > 1, (F.col("o_totalprice") / 5000 - F.col("mean")) / F.col("sd")))
    return op.summarize_z(rows, ["series", "offset"])


@query(_BINS + _MOMENTS + _Z + _SUMMARY + '\nSELECT series, "offset", n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(median_total, 5) AS median_total, round(low, 4) AS low, round(high, 4) AS high FROM y')
def z_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-32, E-33, E-34."""
    rows = _z_summary(spark, sf_dir)
    return rows.select("series", "offset", "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "low", "high")], F.round("median_total", 5).alias("median_total"))


@query(_BINS + _MOMENTS + _Z + _SUMMARY + '\nSELECT series, "offset", n, round(mean, 4) AS mean FROM y WHERE n >= 20 AND (low > 0 OR high < 0) QUALIFY row_number() OVER (PARTITION BY series ORDER BY abs(mean) DESC, n DESC) = 1')
def strongest_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-34."""
    return op.strongest(_z_summary(spark, sf_dir), ["series"]).select("series", "offset", "n", F.round("mean", 4).alias("mean"))


@query(
    with_ctes("points", body="""
SELECT bucket, count(*) AS n, round(avg(x), 6) AS mean_p, round(avg(y), 6) AS rate FROM (SELECT y, x, CASE WHEN x < 0.02 THEN 0 WHEN x < 0.05 THEN 1 WHEN x < 0.1 THEN 2 WHEN x < 0.2 THEN 3 WHEN x < 0.4 THEN 4 WHEN x < 0.6 THEN 5 WHEN x <= 1 THEN 6 END::INT AS bucket FROM (SELECT y, round(p * p, 6) AS x FROM points)) GROUP BY bucket""")
)
def irregular_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-29."""
    rows = points(spark, sf_dir).withColumn("x", F.round(F.col("p") * F.col("p"), 6))
    return _rounded(rows.groupBy(op.edge_bucket(F.col("x")).alias("bucket")).agg(F.count("*").alias("n"), F.avg("x").alias("mean_p"), F.avg("y").alias("rate")))


_DAYS = "WITH d AS (SELECT event_type AS kind, date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY ALL)"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


@query(_DAYS + """, b AS (SELECT *, (row_number() OVER (PARTITION BY kind ORDER BY day) - 1) // 7 AS b FROM d), k AS (SELECT kind, b, sum(n) AS s, count(*) AS c FROM b GROUP BY kind, b)
SELECT kind, round(var_samp(n) / avg(n), 6) AS ratio, count(*) AS days, any_value(r) AS block_ratio, any_value(m) AS blocks FROM b LEFT JOIN (SELECT kind, round(var_samp(s) / avg(s), 6) AS r, count(*) AS m FROM k WHERE c = 7 GROUP BY kind) USING (kind) GROUP BY kind""")
def overdispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-35."""
    return _rounded(op.dispersion(daily(spark, sf_dir), ["kind"], "day", 7))


@query(_DAYS + """
SELECT kind, count(r) AS n, round(stddev_samp(r), 6) AS sd FROM (SELECT kind, CASE WHEN count(n) OVER w = 7 THEN n - avg(n) OVER w END AS r FROM d WINDOW w AS (PARTITION BY kind ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) GROUP BY kind""")
def trailing_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-35, W-8."""
    rows = op.trailing_residual(daily(spark, sf_dir), ["kind"], "day", 7)
    return _rounded(rows.groupBy("kind").agg(F.count("residual").alias("n"), F.stddev_samp("residual").alias("sd")))


@query(_DAYS + """
SELECT round(sum((c - 1) * v) / sum(c - 1), 6) AS pooled, round(sum(c * m) / sum(c), 6) AS mean FROM (SELECT kind, count(*) AS c, var_samp(n) AS v, avg(n) AS m FROM d GROUP BY kind) WHERE c > 1""")
def pooled_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-35."""
    return _rounded(op.pooled_variance(daily(spark, sf_dir), "kind"))


@query()
def bootstrap_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-30: intervals of the Brier score by version, matches drawn as clusters."""
    sums = points(spark, sf_dir).groupBy("version", (F.col("match_id") % 200).alias("cluster")).agg(F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2))).alias("s"), F.count("*").alias("n"))
    return _rounded(op.cluster_bootstrap(sums, ["version"], 400))


@query(
    with_ctes("markets", body="""
SELECT count(*) AS n, count(DISTINCT group_id) AS groups, round(sum(yes), 4) AS total FROM markets WHERE group_id IN (SELECT group_id FROM markets GROUP BY group_id HAVING round(sum(yes), 6) BETWEEN 0.9 AND 1.005)""")
)
def coherent_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-18."""
    kept = op.coherent_instants(markets(spark, sf_dir).withColumn("price", F.col("yes")), ["group_id"], 0.9, 1.005)
    return kept.agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("groups"), F.round(F.sum("yes"), 4).alias("total"))
