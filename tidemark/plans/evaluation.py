"""Forecast evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quotes as q
from ..operators import evaluation as op
from ..sources.tables import points, with_ctes
from ._base import Family

FAMILY = Family()
query = FAMILY.query

_PAIRED = "(SELECT *, greatest(0.01, least(0.99, p - 0.02)) AS d FROM points WHERE market IS NOT NULL)"


def _scores_sql(by: str, source: str = _PAIRED) -> str:
    head = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {head}count(*) AS n, round(avg((p - y) ** 2), 6) AS agent, round(avg((market - y) ** 2), 6) AS market, round(avg((0.5 - y) ** 2), 6) AS coin, round(avg((d - y) ** 2), 6) AS debiased,
  round(avg(p) - avg(y), 6) AS bias, count(*) FILTER (p < 0.01 OR p > 0.99) AS clamped, round(CASE WHEN avg((market - y) ** 2) <> 0 THEN 1 - avg((p - y) ** 2) / avg((market - y) ** 2) END, 6) AS skill
FROM {source}{group}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(with_ctes("points", body=_scores_sql("")))
def forecast_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-1 to E-6."""
    return _rounded(op.scores(points(spark, sf_dir), [], 0.02))


@query(with_ctes("points", body=_scores_sql("version")))
def scores_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-12."""
    return _rounded(op.scores(points(spark, sf_dir), ["version"], 0.02))


_BAND = "CASE WHEN liquidity >= 60000 THEN 'high' WHEN liquidity >= 20000 THEN 'middle' WHEN liquidity IS NOT NULL THEN 'low' END"


@query(with_ctes("points", body=_scores_sql("band", f"(SELECT *, greatest(0.01, least(0.99, p - 0.02)) AS d, {_BAND} AS band FROM points WHERE market IS NOT NULL)")))
def scores_by_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-12, P-12."""
    rows = points(spark, sf_dir).withColumn("band", q.band(F.col("liquidity"), [(20_000, "middle"), (60_000, "high")], "low"))
    return _rounded(op.scores(rows, ["band"], 0.02))


@query(with_ctes("points", body=_scores_sql("checkpoint")))
def scores_by_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-12."""
    return _rounded(op.scores(points(spark, sf_dir), ["checkpoint"], 0.02))


def _buckets_sql(start: str, width: str, count: int, price: str = "p", outcome: str = "y", source: str = "points") -> str:
    return f"""SELECT least(floor(({price} - {start}) / {width}), {count - 1})::INT AS bucket, count(*) AS n, count(DISTINCT match_id) AS matches, avg({price}) AS mean_p, avg({outcome}) AS rate, median(spread) AS typical_spread
FROM {source} WHERE {price} >= {start} GROUP BY 1"""


@query(
    with_ctes("points", body=f"""SELECT bucket, n, matches, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate, round(typical_spread, 6) AS typical_spread, round(rate - mean_p, 6) AS gap, round(typical_spread / 2, 6) AS bar,
  CASE WHEN matches < 20 THEN 'inconclusive' WHEN typical_spread IS NULL THEN 'no spread' WHEN abs(rate - mean_p) > typical_spread / 2 THEN 'beyond spread' ELSE 'within spread' END AS verdict
FROM ({_buckets_sql('0.0', '0.1', 10)})""")
)
def reliability_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-7, E-8, E-9."""
    return _rounded(op.verdicts(op.reliability(points(spark, sf_dir), F.col("p"), 0.0, 0.1, 10)))


@query(
    with_ctes("points", body=f""", f AS (SELECT match_id, spread, round(CASE WHEN p < 0.5 THEN 1 - p ELSE p END, 6) AS price, CASE WHEN p < 0.5 THEN 1 - y ELSE y END AS won FROM points WHERE p <> 0.5)
SELECT bucket, n, matches, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate, round(typical_spread, 6) AS typical_spread FROM ({_buckets_sql('0.5', '0.05', 10, 'price', 'won', 'f')})""")
)
def reliability_favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-7, E-18: the second grid, from the favourite's side."""
    rows = op.favourites(points(spark, sf_dir)).filter("NOT tie").withColumn("y", F.col("won"))
    return _rounded(op.reliability(rows, F.col("price"), 0.5, 0.05, 10))


@query(
    with_ctes("points", body=f""", b AS ({_buckets_sql('0.0', '0.1', 10)}), base AS (SELECT sum(n * rate) / sum(n) AS r FROM b)
SELECT round(sum(n * abs(rate - mean_p)) / sum(n), 6) AS ece, round(sum(n * (mean_p - rate) ** 2) / sum(n), 6) AS reliability, round(sum(n * rate * rate) / sum(n) - any_value(r) * any_value(r), 6) AS resolution,
  round(any_value(r) * (1 - any_value(r)), 6) AS uncertainty FROM b, base""")
)
def calibration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-10, E-11."""
    buckets = op.reliability(points(spark, sf_dir), F.col("p"), 0.0, 0.1, 10)
    return _rounded(op.calibration_error(buckets).crossJoin(op.murphy(buckets)))


_HALVES = """, firsts AS (SELECT match_id, min(as_of) AS t FROM points GROUP BY match_id),
halves AS (SELECT match_id, CASE WHEN row_number() OVER (ORDER BY t, match_id) <= (SELECT count(*) FROM firsts) // 2 THEN 'train' ELSE 'test' END AS half FROM firsts)"""


@query(with_ctes("points", body=_HALVES + "\nSELECT half, count(*) AS matches, sum(match_id)::BIGINT AS checksum FROM halves GROUP BY half"))
def date_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-13, W-5."""
    return op.entity_halves(points(spark, sf_dir)).groupBy("half").agg(F.count("*").alias("matches"), F.sum("match_id").alias("checksum"))


@query(
    with_ctes("points", body=""", lasts AS (SELECT match_id, max(as_of) AS t FROM points GROUP BY match_id),
halves AS (SELECT match_id, CASE WHEN row_number() OVER (ORDER BY t, match_id) <= (SELECT count(*) FROM lasts) // 2 THEN 'train' ELSE 'test' END AS half FROM lasts)
SELECT half, count(*) AS matches, sum(match_id)::BIGINT AS checksum FROM halves GROUP BY half""")
)
def time_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-20."""
    return op.entity_halves(points(spark, sf_dir), last_seen=True).groupBy("half").agg(F.count("*").alias("matches"), F.sum("match_id").alias("checksum"))


@query(
    with_ctes("points", body=_HALVES + """, r AS (SELECT * FROM points JOIN halves USING (match_id) WHERE market IS NOT NULL),
o AS (SELECT avg(p) - avg(y) AS offset_ FROM r WHERE half = 'train'), b AS (SELECT min(as_of) AS border FROM r WHERE half = 'test'), v AS (SELECT DISTINCT version FROM r WHERE half = 'train')
SELECT half, round(any_value(offset_), 6) AS "offset", count(*) AS n, count(DISTINCT match_id) AS matches, round(avg((p - y) ** 2), 6) AS agent, round(avg((greatest(0.01, least(0.99, p - offset_)) - y) ** 2), 6) AS debiased,
  count(DISTINCT CASE WHEN half = 'train' AND as_of >= border THEN match_id END) AS straddling, count(DISTINCT version) AS versions, count(DISTINCT CASE WHEN version NOT IN (FROM v) THEN version END) AS unseen_versions
FROM r, o, b GROUP BY half""")
)
def debias_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-14, O-3, O-5."""
    return _rounded(op.debias(points(spark, sf_dir)))


@query(
    with_ctes("points", body="""
SELECT tie, count(*) AS n, round(avg(price), 6) AS mean_price, round(avg(won), 6) AS rate FROM (
  SELECT p = 0.5 AS tie, round(CASE WHEN p < 0.5 THEN 1 - p ELSE p END, 6) AS price, CASE WHEN p < 0.5 THEN 1 - y ELSE y END AS won FROM points) GROUP BY tie""")
)
def favourite_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-18: ties are counted, not dropped silently."""
    return _rounded(op.favourites(points(spark, sf_dir)).groupBy("tie").agg(F.count("*").alias("n"), F.avg("price").alias("mean_price"), F.avg("won").alias("rate")))


@query(
    with_ctes("points", body="""
SELECT count(*) AS matches, round(avg(p), 6) AS mean_p, round(avg((p - y) ** 2), 6) AS brier, sum(checkpoint)::BIGINT AS checkpoints
FROM (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY checkpoint, p, y) = 1)""")
)
def one_row_per_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-19."""
    rows = op.one_row_per_match(points(spark, sf_dir), ["p", "y"])
    return _rounded(rows.agg(F.count("*").alias("matches"), F.avg("p").alias("mean_p"), op.brier(F.col("p")).alias("brier"), F.sum("checkpoint").alias("checkpoints")))


@query(
    with_ctes("points", body="""
SELECT checkpoint, count(DISTINCT match_id) AS matches, count(*) AS n, count(market) AS priced, count(*) FILTER (market IS NULL) AS missing, max(as_of) AS last_at FROM points GROUP BY checkpoint""")
)
def checkpoint_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-16, E-21, E-58."""
    return points(spark, sf_dir).groupBy("checkpoint").agg(
        F.countDistinct("match_id").alias("matches"), F.count("*").alias("n"), F.count("market").alias("priced"), F.count_if(F.col("market").isNull()).alias("missing"), F.max("as_of").alias("last_at")
    )
