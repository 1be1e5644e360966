"""Signal detection and the roster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quotes as q
from ..functions import sizing
from ..operators import asof
from ..operators import detection as op
from ..operators import quotes as quote_op
from ..sources.tables import legs, markets, points, quotes, read, with_ctes
from ._base import Family
from .quotes import _latest_sql

FAMILY = Family()
query = FAMILY.query

#: The instant of the detectors: the last day of quotes.
NOW = 1_706_572_800_000_000
HOUR = 3_600_000_000


@query(
    with_ctes("markets", body=""", g AS (
  SELECT group_id, count(*) FILTER (mem) AS members, count(*) FILTER (act) AS active, sum(yes) FILTER (mem) AS total, sum(volume) FILTER (mem) AS volume, bool_and(live) FILTER (act) AS all_live,
    min(end_at) FILTER (mem) AS expires_at, arg_max(market_id, (volume, market_id)) FILTER (mem) AS lead
  FROM (SELECT *, status = 'O' AS act, market_id % 10 <> 3 AS live, status = 'O' AND market_id % 10 <> 3 AND yes >= 0.05 AS mem FROM markets) GROUP BY group_id),
e AS (SELECT *, members / nullif(active, 0) AS coverage, round(CASE WHEN total > 1 THEN CASE WHEN members - total > 0 THEN (total - 1) / (members - total) ELSE 0 END * 100 WHEN total > 0 THEN (1 - total) / total * 100 ELSE 0 END, 4) AS edge,
  CASE WHEN total > 1 THEN 'over' ELSE 'under' END AS side FROM g),
r AS (SELECT *, CASE WHEN members < 2 THEN 'few members' WHEN NOT all_live THEN 'not live' WHEN volume < 100000 THEN 'low volume' WHEN coverage < 0.95 THEN 'low coverage' WHEN side = 'under' AND total < 0.7 THEN 'incomplete' WHEN edge < 1 THEN 'low edge' END AS reason FROM e)
SELECT group_id, members, active, round(total, 6) AS total, round(volume, 2) AS volume, expires_at, lead, side, edge, reason, round(CASE WHEN reason IS NULL THEN least(1, edge / 10) ELSE 0 END, 6) AS confidence FROM r""")
)
def basket_arbitrage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-1, D-3, J-17."""
    rows = op.baskets(markets(spark, sf_dir), 2, 0.05, 100_000, 0.95, 1.0, F.col("market_id") % 10 != 3)
    return rows.select(
        "group_id", "members", "active", F.round("total", 6).alias("total"), F.round("volume", 2).alias("volume"), "expires_at", "lead", "side", "edge", "reason", F.round("confidence", 6).alias("confidence")
    )


_PRICES_SQL = "[CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE round(0.3 + (o_orderkey % 50) / 100.0, 2)::VARCHAR END, round(0.4 + (o_custkey % 40) / 100.0, 2)::VARCHAR]"


@query(f"""
SELECT reason, count(*) AS n, round(avg(edge), 4) AS mean_edge, round(sum(confidence), 4) AS confidence FROM (
  SELECT CASE WHEN total IS NULL THEN 'malformed' WHEN round(abs(total - 1), 6) < 0.05 THEN 'below threshold' END AS reason,
    round(CASE WHEN total > 1 THEN (total - 1) / (2 - total) ELSE (1 - total) / total END * 100, 4) AS edge, CASE WHEN round(abs(total - 1), 6) >= 0.05 THEN least(1, round(abs(total - 1), 6) / 0.15) END AS confidence
  FROM (SELECT round(TRY_CAST(p[1] AS DOUBLE) + TRY_CAST(p[2] AS DOUBLE), 6) AS total FROM (SELECT {_PRICES_SQL} AS p FROM orders))) GROUP BY reason
""")
def intra_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-2, F-34."""
    first = F.when(F.col("o_orderkey") % 17 == 0, "x").otherwise(F.round(0.3 + (F.col("o_orderkey") % 50) / 100.0, 2).cast("string"))
    rows = read(spark, sf_dir, "orders").select(F.array(first, F.round(0.4 + (F.col("o_custkey") % 40) / 100.0, 2).cast("string")).alias("prices"))
    out = op.intra_market(rows, "prices", 0.05)
    return out.groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg("edge"), 4).alias("mean_edge"), F.round(F.sum("confidence"), 4).alias("confidence"))


@query(
    with_ctes("quotes", body=f"""
SELECT event_id, outcome, n, round(sd, 6) AS sd, last_mid, round(least(1, (0.2 - sd) / 0.2 + 0.5), 6) AS confidence FROM (
  SELECT event_id, outcome, count(*) AS n, stddev_pop(mid) AS sd, arg_max(mid, (tick, seq)) AS last_mid FROM quotes WHERE mid IS NOT NULL AND tick BETWEEN {NOW - 600 * HOUR} AND {NOW} GROUP BY event_id, outcome)
WHERE n >= 5 AND sd < 0.2 AND last_mid > 0.05 AND last_mid < 0.95""")
)
def calm_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-5, A-4. The tables' mids are spread widely, so the bound is wider than in production."""
    rows = op.calm_series(quotes(spark, sf_dir), NOW, 600 * HOUR, 5, 0.2)
    return rows.select("event_id", "outcome", "n", F.round("sd", 6).alias("sd"), "last_mid", F.round("confidence", 6).alias("confidence"))


@query(
    with_ctes("quotes", body=", " + _latest_sql("tick, mid, volume_24h") + f""", w AS (SELECT *, tick - {24 * HOUR} AS target FROM latest),
p AS (SELECT w.event_id, w.outcome, q.mid AS past_mid, q.volume_24h AS past_volume FROM w JOIN quotes q USING (event_id, outcome) WHERE q.tick <= w.target AND q.mid IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY w.event_id, w.outcome ORDER BY q.tick DESC, q.seq) = 1),
x AS (SELECT w.*, past_mid, past_volume, round(CASE WHEN past_mid = 0 THEN 'Infinity'::DOUBLE ELSE abs(mid - past_mid) / past_mid END, 6) AS share, round(abs(mid - past_mid), 6) AS step, greatest(0, volume_24h - past_volume) AS hour_
  FROM w JOIN p USING (event_id, outcome) WHERE mid BETWEEN 0.15 AND 0.85 AND {NOW} - tick <= {240 * HOUR}),
y AS (SELECT *, round(hour_ / greatest(0.001, (volume_24h - hour_) / 23), 6) AS ratio FROM x)
SELECT CASE WHEN share >= 0.1 AND step >= 0.03 AND ratio >= 5 THEN 'momentum with volume' WHEN share >= 0.1 AND step >= 0.03 THEN 'momentum' WHEN ratio >= 5 AND share < 0.03 THEN 'volume' END AS kind, count(*) AS n, round(avg(share), 6) AS share, round(avg(ratio), 4) AS ratio
FROM y GROUP BY 1""")
)
def momentum_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-6, J-5."""
    rows = quotes(spark, sf_dir)
    last = quote_op.latest_quotes(rows).select("event_id", "outcome", "tick", "mid", "volume_24h").withColumn("target", F.col("tick") - 24 * HOUR)
    past = rows.filter("mid IS NOT NULL").select("event_id", "outcome", "tick", F.col("mid").alias("past_mid"), F.col("volume_24h").alias("past_volume"))
    pairs = asof.latest_before(last, past, ["event_id", "outcome"], "target", ["past_mid", "past_volume"])
    out = op.momentum(pairs, NOW, 240 * HOUR)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("share"), 6).alias("share"), F.round(F.avg("ratio"), 4).alias("ratio"))


@query(
    with_ctes("quotes", body=f""", f AS (SELECT event_id, arg_max({{'tick': tick, 'outcome': outcome, 'mid': mid, 'bid': bid, 'ask': ask, 'liquidity': liquidity}}, (tick, outcome, seq)) AS l, first(mid ORDER BY tick, outcome, seq) AS first_mid FROM quotes GROUP BY event_id)
SELECT event_id, l.outcome AS outcome, l.mid AS mid, CASE WHEN l.mid IS NULL THEN 'no price' WHEN {NOW} - l.tick > {24 * HOUR} THEN 'stale' WHEN abs(l.mid - 0.5) < 0.1 THEN 'near even' WHEN NOT l.mid BETWEEN 0.05 AND 0.95 THEN 'extreme' WHEN l.ask - l.bid >= 0.05 THEN 'wide' WHEN l.liquidity < 5000 THEN 'thin' END AS reason,
  round(CASE WHEN first_mid <> 0 THEN (l.mid - first_mid) * 100 / first_mid END, 4) AS movement FROM f""")
)
def early_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-7, S-23."""
    return op.early_markets(quotes(spark, sf_dir), NOW, 24 * HOUR)


_SIGNALS_SQL = """, s AS (SELECT event_id, CASE WHEN outcome IN ('click', 'view') THEN 'momentum' ELSE 'basket' END AS kind, tick AS seen_at, CASE WHEN seq % 3 = 0 THEN tick + 60000000 END AS dismissed_at, (seq % 7)::INT AS "count", seq AS signal_id,
  round(liquidity / 10000, 4) AS edge, [((event_id::INT + 1) % 150)::VARCHAR, ((event_id::INT + 2) % 150)::VARCHAR] AS members FROM quotes WHERE seq % 5 < 2)"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("event_id").cast("int")
    return quotes(spark, sf_dir).filter("seq % 5 < 2").select(
        "event_id", F.when(F.col("outcome").isin("click", "view"), "momentum").otherwise("basket").alias("kind"), F.col("tick").alias("seen_at"),
        F.when(F.col("seq") % 3 == 0, F.col("tick") + 60_000_000).alias("dismissed_at"), (F.col("seq") % 7).cast("int").alias("count"), F.col("seq").alias("signal_id"),
        F.round(F.col("liquidity") / 10_000, 4).alias("edge"), F.array(((number + 1) % 150).cast("string"), ((number + 2) % 150).cast("string")).alias("members"),
    )


@query(
    with_ctes("quotes", body=_SIGNALS_SQL + f""", c AS (SELECT DISTINCT event_id, CASE WHEN outcome = 'error' THEN 'other' WHEN outcome IN ('click', 'view') THEN 'momentum' ELSE 'basket' END AS kind FROM quotes WHERE seq % 5 >= 2),
p AS (SELECT event_id, kind, arg_max("count", (seen_at, "count")) FILTER (dismissed_at IS NULL) AS active, max(dismissed_at) AS dismissed, count(*) FILTER (dismissed_at IS NULL) AS n_active FROM s GROUP BY event_id, kind)
SELECT event_id, kind, CASE WHEN active IS NOT NULL THEN 'update' WHEN dismissed > {NOW - 240 * HOUR} THEN 'skip' ELSE 'insert' END AS action, coalesce(active, 0) + 1 AS "count", greatest(coalesce(n_active, 0) - 1, 0) AS older_duplicates FROM c LEFT JOIN p USING (event_id, kind)""")
)
def signal_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-8, R-6."""
    kind = F.when(F.col("outcome") == "error", "other").when(F.col("outcome").isin("click", "view"), "momentum").otherwise("basket")
    candidates = quotes(spark, sf_dir).filter("seq % 5 >= 2").select("event_id", kind.alias("kind")).distinct()
    return op.signal_actions(candidates, _signals(spark, sf_dir), NOW, 240 * HOUR)


@query(
    with_ctes("quotes", body=_SIGNALS_SQL + f""", live AS (SELECT DISTINCT event_id FROM quotes WHERE tick BETWEEN {NOW - 6 * HOUR} AND {NOW})
SELECT signal_id, count(*) AS members, count(*) FILTER (l.event_id IS NULL) AS dead, count(*) FILTER (l.event_id IS NULL) > 0 AS stale FROM (SELECT signal_id, unnest(members) AS m FROM s) LEFT JOIN live l ON l.event_id = m GROUP BY signal_id""")
)
def stale_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-9, J-17."""
    return op.stale_signals(_signals(spark, sf_dir), quotes(spark, sf_dir), NOW, 6 * HOUR)


@query(
    with_ctes("quotes", "legs", body=_SIGNALS_SQL + f""", o AS (SELECT DISTINCT event_number::VARCHAR AS event_id FROM legs WHERE NOT closed AND event_number % 4 = 0)
SELECT signal_id, event_id, kind, edge FROM s WHERE dismissed_at IS NULL AND {NOW} - seen_at <= {20 * 24 * 60 * 60000000} AND (edge >= 6 OR kind = 'basket')
  AND event_id NOT IN (FROM o) AND members[1] NOT IN (FROM o) AND members[2] NOT IN (FROM o)""")
)
def visible_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-11, J-32."""
    taken = legs(spark, sf_dir).filter("NOT closed AND event_number % 4 = 0").select(F.col("event_number").cast("string").alias("event_id"))
    return op.visible_signals(_signals(spark, sf_dir), taken, NOW, 20 * 24 * 60, 6.0, ["basket"]).select("signal_id", "event_id", "kind", "edge")


@query(
    with_ctes("markets", body=""", g AS (SELECT group_id, list(yes ORDER BY market_id) AS p FROM markets WHERE yes BETWEEN 0.02 AND 0.98 GROUP BY group_id HAVING count(*) BETWEEN 2 AND 12),
t AS (SELECT group_id, p, list_sum(p) AS total, list_sum(list_transform(p, lambda x: 10 / (1 - x))) AS others, len(p) AS n FROM g)
SELECT group_id, i::INT AS member, round(p[i + 1] / total, 6) AS chance, round(CASE WHEN total > 1 THEN others - 10 / (1 - p[i + 1]) - 10 * n ELSE 10 / p[i + 1] - 10 * n END, 4) AS profit FROM t, unnest(range(n)) AS x(i)""")
)
def basket_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-18."""
    rows = markets(spark, sf_dir).filter(F.col("yes").between(0.02, 0.98)).groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("market_id", "yes"))).alias("m"))
    rows = rows.filter(F.size("m").between(2, 12)).select("group_id", F.posexplode(op.scenarios(F.col("m.yes"), 10.0)).alias("member", "s"))
    return rows.select("group_id", "member", "s.chance", "s.profit")


@query(
    with_ctes("points", body="""
SELECT match_id, checkpoint, p, floor(greatest(0.5, round(liquidity * least(0.05::DOUBLE, p * 10 / 200), 2)))::BIGINT AS stake, ceil(checkpoint / 0.04)::BIGINT AS least_bankroll,
  round(CASE WHEN p * (1.5 + 1) - 1 <= 0 THEN 0 ELSE least((p * (1.5 + 1) - 1) / 1.5 * 0.25, 0.1) END, 6) AS kelly, round(p * p * (1 + 2 * (1 - p)), 6) AS best_of_three FROM points""")
)
def sizing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-19, D-21, E-39."""
    p = F.col("p")
    return points(spark, sf_dir).select(
        "match_id", "checkpoint", "p", F.floor(sizing.stake(F.col("liquidity"), p * 10, 0.05)).alias("stake"), sizing.least_bankroll(F.col("checkpoint"), 0.1, 0.4).alias("least_bankroll"),
        F.round(sizing.kelly(p, F.lit(1.5), 0.25, 0.1), 6).alias("kelly"), F.round(sizing.series_probability(p, 2), 6).alias("best_of_three"),
    )


@query(
    with_ctes("markets", body=""", g AS (SELECT group_id, list(yes ORDER BY market_id) AS p FROM markets GROUP BY group_id)
SELECT group_id, round(coalesce(CASE WHEN list_sum(p) > 1 THEN list_avg(list_transform(list_filter(p, lambda x: x < 1), lambda x: x * 0.02)) ELSE list_avg(list_transform(list_filter(p, lambda x: x > 0 AND x < 1), lambda x: (1 - x) * 0.02)) END, 0), 6) AS fee FROM g""")
)
def basket_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-4."""
    rows = markets(spark, sf_dir).groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("market_id", "yes"))).alias("m")).select("group_id", F.col("m.yes").alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return rows.select("group_id", F.round(sizing.basket_fee(F.col("p"), 0.02, total > 1), 6).alias("fee"))


_ROSTER = """, c AS (SELECT l.*, cust.c_mktsegment AS theme, (coalesce(bid > 0, false))::INT + (coalesce(ask > 0 AND ask < 1, false))::INT AS sides, CASE WHEN mid > 0 AND mid < 1 THEN mid END AS price,
  CASE WHEN seq % 9 <> 0 THEN (seq % 100) - 2 END AS days FROM quotes l JOIN customer cust ON cust.c_custkey::VARCHAR = l.event_id),
r AS (SELECT *, seq AS market_id, CASE WHEN sides = 0 THEN 'empty book' WHEN price IS NULL THEN 'no price' WHEN days IS NULL THEN 'no end' WHEN days <= 0 THEN 'ended' WHEN days > 90 THEN 'far' WHEN liquidity < 5000 THEN 'low liquidity'
  WHEN volume_24h < 2500 THEN 'low volume' WHEN sides = 1 THEN 'one-sided' WHEN round(ask - bid, 4) > 0.021 THEN 'wide' END AS reason FROM c)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    themes = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("event_id"), F.col("c_mktsegment").alias("theme"))
    rows = quotes(spark, sf_dir).join(themes, "event_id").withColumn("market_id", F.col("seq"))
    price = F.when((F.col("mid") > 0) & (F.col("mid") < 1), F.col("mid"))
    days = F.when(F.col("seq") % 9 != 0, F.col("seq") % 100 - 2)
    spread = F.round(F.col("ask") - F.col("bid"), 4) - 0.006
    return rows.withColumn("reason", op.reject_reason(price, F.col("liquidity"), F.col("volume_24h"), q.sides(F.col("bid"), F.col("ask")), F.round(spread, 4), days))


@query(with_ctes("quotes", body=_ROSTER + "\nSELECT theme, reason, count(*) AS n FROM r GROUP BY theme, reason"))
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-3, P-6, E-59: the first broken rule, counted by theme."""
    return _candidates(spark, sf_dir).groupBy("theme", "reason").agg(F.count("*").alias("n"))


@query(
    with_ctes("quotes", body=_ROSTER + """, k AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY liquidity DESC, market_id) AS rank FROM r WHERE reason IS NULL)
SELECT market_id, theme, liquidity, rank::INT AS rank FROM k WHERE rank <= 40 ORDER BY liquidity DESC, market_id LIMIT 150""")
)
def roster_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-4, K-4, T-7, S-25: a top-k report, the limit is its feature."""
    return op.roster(_candidates(spark, sf_dir).filter("reason IS NULL"), 40, 150)


@query(
    with_ctes("markets", body="""
SELECT a.group_id, a.market_id AS a, b.market_id AS b FROM markets a JOIN markets b ON a.group_id = b.group_id AND a.market_id < b.market_id AND round(a.yes + b.yes, 6) BETWEEN 0.17 AND 0.23""")
)
def mirror_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-26."""
    return op.mirror_markets(markets(spark, sf_dir), 0.17, 0.23)
