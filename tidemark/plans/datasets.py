"""Evaluation data sets of matches and quotes, guarded writes, nested bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets as op
from ..sources import nested
from ..sources.tables import quotes, read, with_ctes
from ._base import Family

FAMILY = Family()
query = FAMILY.query

START, DAY = 1_704_067_200_000_000, 86_400_000_000
MINUTES = (360, 60)
TEAMS = ("click", "view", "purchase", "signup", "error")

_TEAM = "CASE {k} % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TEAMS)) + " END"
_MATCHES = f""", m AS (SELECT o_orderkey AS match_id, (o_custkey % 150)::VARCHAR AS event_id, {_TEAM.format(k="o_orderkey")} AS team, {START} + (o_orderkey * 7919 % 43200) * 60000000 AS scheduled_at FROM orders),
pt AS (SELECT *, scheduled_at - checkpoint::BIGINT * 60000000 AS target FROM m, (VALUES (360), (60)) AS c(checkpoint)),
near AS (SELECT match_id, checkpoint, team, outcome, mid, ask, tick FROM pt JOIN quotes USING (event_id) WHERE abs(target - tick) <= {DAY} QUALIFY row_number() OVER (PARTITION BY match_id, checkpoint, outcome ORDER BY abs(target - tick), tick, seq) = 1),
own AS (SELECT pt.match_id, pt.checkpoint, tick, mid, CASE WHEN tick IS NULL THEN 'no_snapshot' WHEN mid IS NULL THEN 'no_mid' END AS reason FROM pt LEFT JOIN near ON near.match_id = pt.match_id AND near.checkpoint = pt.checkpoint AND outcome = pt.team)"""


def team_of(key: str):
    """A label of the stored quotes for each row."""
    return F.element_at(F.array(*[F.lit(t) for t in TEAMS]), (F.col(key) % 5 + 1).cast("int"))


def matches_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    at = F.lit(START) + (k * 7919 % 43_200) * F.lit(60_000_000)
    return read(spark, sf_dir, "orders").select(k.alias("match_id"), (F.col("o_custkey") % 150).cast("string").alias("event_id"), team_of("o_orderkey").alias("team"), at.alias("scheduled_at"))


@query(with_ctes("quotes", body=_MATCHES + """
SELECT checkpoint, reason, count(*) AS n, count(DISTINCT match_id) AS matches, max(tick) AS last_at, round(sum(mid), 4) AS mids FROM own GROUP BY checkpoint, reason"""))
def checkpoint_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-16: a point for every match and checkpoint, and what is missing."""
    rows = op.checkpoint_prices(matches_of(spark, sf_dir), quotes(spark, sf_dir), MINUTES, DAY)
    return rows.groupBy("checkpoint", "reason").agg(
        F.count("*").alias("n"), F.countDistinct("match_id").alias("matches"), F.max("captured_at").alias("last_at"), F.round(F.sum("mid"), 4).alias("mids")
    )


@query(with_ctes("quotes", body=_MATCHES + """, ab AS (SELECT match_id, checkpoint, max({'o': outcome, 'mid': mid, 'ask': ask}) FILTER (outcome = team) AS a, max({'o': outcome, 'mid': mid, 'ask': ask}) FILTER (outcome <> team) AS b, count(*) FILTER (outcome <> team) AS others FROM near GROUP BY match_id, checkpoint),
f AS (SELECT pt.match_id, pt.checkpoint, a, b, a.mid > 0.5 AS own, CASE WHEN a IS NULL THEN 'no_snapshot' WHEN a.mid IS NULL THEN 'no_mid' WHEN a.mid = 0.5 THEN 'tie' WHEN a.mid < 0.5 AND others <> 1 THEN 'no_favourite_side' WHEN CASE WHEN a.mid > 0.5 THEN a.ask ELSE b.ask END IS NULL THEN 'no_ask' END AS reason FROM pt LEFT JOIN ab USING (match_id, checkpoint))
SELECT match_id, checkpoint, CASE WHEN reason IS NULL THEN CASE WHEN own THEN a.o ELSE b.o END END AS label, CASE WHEN reason IS NULL THEN own END AS own, CASE WHEN reason IS NULL THEN round(CASE WHEN own THEN a.mid ELSE coalesce(b.mid, 1 - a.mid) END, 6) END AS mid,
  CASE WHEN reason IS NULL THEN CASE WHEN own THEN a.ask ELSE b.ask END END AS ask, reason FROM f"""))
def execution_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-17: the favourite's side of every match and checkpoint, or why there is none."""
    return op.execution_prices(matches_of(spark, sf_dir), quotes(spark, sf_dir), MINUTES, DAY)


@query(with_ctes("quotes", body=_MATCHES + """, s AS (SELECT event_id, outcome AS team, max(tick) AS last_at FROM quotes GROUP BY ALL), n AS (SELECT match_id, count(tick) AS anchors FROM own GROUP BY match_id)
SELECT CASE WHEN anchors > 0 THEN 'anchored' WHEN last_at IS NOT NULL THEN 'anchorless' WHEN event_id IN (SELECT event_id FROM quotes) THEN 'other_sides_only' ELSE 'no_series' END AS series, count(*) AS n, max(last_at) AS last_at FROM m LEFT JOIN s USING (event_id, team) LEFT JOIN n USING (match_id) GROUP BY 1"""))
def series_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-21."""
    rows = op.series_coverage(matches_of(spark, sf_dir), quotes(spark, sf_dir), MINUTES, DAY)
    return rows.groupBy("series").agg(F.count("*").alias("n"), F.max("last_at").alias("last_at"))


@query("""
WITH a AS (SELECT l_orderkey AS match_id, l_linenumber AS line, CASE WHEN l_returnflag <> 'N' THEN l_suppkey % 7 END AS side, CASE WHEN l_tax > 0.01 THEN l_discount END AS p FROM lineitem),
m AS (SELECT o_orderkey AS match_id, o_custkey % 7 AS team_a, (o_custkey + 1 + o_orderkey % 5) % 7 AS team_b, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN o_custkey % 7 END AS winner, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS resolved_at FROM orders WHERE o_totalprice > 20000),
r AS (SELECT a.*, winner, CASE WHEN m.match_id IS NULL THEN 'match_absent' WHEN o_orderpriority = '5-LOW' THEN 'filtered' WHEN p IS NULL THEN 'no_probability' WHEN side IS NULL THEN 'no_side' WHEN winner IS NULL THEN CASE WHEN resolved_at IS NULL THEN 'undecided' ELSE 'void' END WHEN side NOT IN (team_a, team_b) THEN 'incoherent_side' END AS reason FROM a LEFT JOIN m USING (match_id))
SELECT reason, CASE WHEN reason IS NULL THEN (side = winner)::INT END AS outcome, count(*) AS n, count(DISTINCT match_id) AS matches FROM r GROUP BY 1, 2
""")
def outcome_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-22: the outcome of an analysis's side, or why the analysis does not count."""
    o = F.col("o_custkey")
    matches = read(spark, sf_dir, "orders").filter("o_totalprice > 20000").select(
        F.col("o_orderkey").alias("match_id"), (o % 7).alias("team_a"), ((o + 1 + F.col("o_orderkey") % 5) % 7).alias("team_b"), "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", o % 7).alias("winner"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("resolved_at"),
    )
    analyses = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), F.when(F.col("l_returnflag") != "N", F.col("l_suppkey") % 7).alias("side"), F.when(F.col("l_tax") > 0.01, F.col("l_discount")).alias("p")
    )
    rows = op.outcomes(analyses, matches, F.col("o_orderpriority") != "5-LOW")
    return rows.groupBy("reason", "outcome").agg(F.count("*").alias("n"), F.countDistinct("match_id").alias("matches"))


_RESULT = "CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'loss' ELSE 'void' END"


@query(with_ctes("quotes", body=_MATCHES + f""", form AS (SELECT m.*, {_RESULT} AS result FROM m JOIN orders ON match_id = o_orderkey WHERE o_totalprice < 350000), h2h AS (SELECT m.*, {_RESULT} AS result FROM m JOIN orders ON match_id = o_orderkey WHERE o_totalprice > 250000),
ob AS (SELECT DISTINCT * FROM (FROM form UNION ALL FROM h2h)), pr AS (SELECT ob.match_id, result, (SELECT arg_max(mid, (tick, -seq)) FROM quotes q WHERE q.event_id = ob.event_id AND q.outcome = ob.team AND q.mid IS NOT NULL AND ob.scheduled_at - q.tick BETWEEN 0 AND {3 * DAY}) AS price FROM ob),
k AS (SELECT *, CASE WHEN result = 'void' THEN 'void' WHEN price IS NULL THEN 'no_price' WHEN price >= 0.55 THEN 'favourite' WHEN price <= 0.45 THEN 'underdog' ELSE 'pickem' END AS band FROM pr)
SELECT band, count(*) AS n, CASE WHEN band IN ('void', 'no_price') THEN 0 ELSE count(*) FILTER (result = 'win') END AS wins, CASE WHEN band NOT IN ('void', 'no_price') THEN round(avg(price), 6) END AS avg_price, CASE WHEN band NOT IN ('void', 'no_price') THEN round(avg((price - (result = 'win')::INT) ** 2), 6) END AS brier,
  band NOT IN ('void', 'no_price') AND count(*) >= 4 AS enough FROM k GROUP BY band"""))
def closing_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-37, E-60: closing prices of distinct past observations against their results, by band."""
    result = F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "O", "loss").otherwise("void")
    rows = matches_of(spark, sf_dir).join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), result.alias("result"), "o_totalprice"), "match_id")
    seen = [rows.filter(c).drop("o_totalprice") for c in ("o_totalprice < 350000", "o_totalprice > 250000")]
    out = op.band_calibration(op.priced_observations(seen, quotes(spark, sf_dir), 3 * DAY))
    return out.withColumn("avg_price", F.round("avg_price", 6)).withColumn("brier", F.round("brier", 6))


_NOW = START + 30 * DAY


@query(with_ctes("quotes", body=_MATCHES + f""", a AS (SELECT event_id, max(tick) AS t FROM quotes WHERE outcome = 'error' GROUP BY event_id), r AS (SELECT match_id, scheduled_at, coalesce({_NOW} - t < {2 * DAY}, false) AS recent FROM m LEFT JOIN a USING (event_id))
SELECT match_id, scheduled_at, (SELECT count(*) FROM r WHERE recent) AS skipped_recent, (SELECT count(*) > 40 FROM r WHERE NOT recent) AS truncated FROM r WHERE NOT recent ORDER BY scheduled_at, match_id LIMIT 40"""))
def enrichment_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-8: the next batch without recent attempts; its size is the feature."""
    tried = quotes(spark, sf_dir).filter("outcome = 'error'").select("event_id", F.col("tick").alias("at"))
    rows = matches_of(spark, sf_dir).select("match_id", "event_id", "scheduled_at")
    return op.select_due(rows, tried, "event_id", ["scheduled_at", "match_id"], _NOW, 2 * DAY, 40).drop("event_id")


@query("""
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS winner, CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS resolved_at, o_totalprice > 300000 AS needs_review FROM orders),
p AS (SELECT l_orderkey, max(l_suppkey) AS winner, bool_or(l_tax > 0.07) AS review FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey), j AS (SELECT s.*, p.winner AS w, s.winner IS NULL AND resolved_at IS NULL AND p.winner IS NOT NULL AS written, NOT needs_review AND coalesce(review, false) AS flagged FROM s LEFT JOIN p ON o_orderkey = l_orderkey)
SELECT written, flagged, count(*) AS n, count(CASE WHEN written THEN w ELSE winner END) AS decided, sum(CASE WHEN written THEN w ELSE winner END)::BIGINT AS winners, count(*) FILTER (needs_review OR flagged) AS in_review FROM j GROUP BY 1, 2
""")
def guarded_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-21: outcomes are written only where undecided, flags only once."""
    status = F.col("o_orderstatus")
    stored = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("match_id"), F.when(status == "F", F.col("o_custkey")).alias("winner"), F.when(status == "P", F.col("o_orderdate")).alias("resolved_at"), (F.col("o_totalprice") > 300_000).alias("needs_review")
    )
    patches = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("match_id")).agg(F.max("l_suppkey").alias("winner"), F.bool_or(F.col("l_tax") > 0.07).alias("needs_review"))
    rows = op.decide_once(stored, patches.withColumn("resolved_at", F.lit(None).cast("timestamp")))
    return rows.groupBy("written", "flagged").agg(F.count("*").alias("n"), F.count("winner").alias("decided"), F.sum("winner").alias("winners"), F.count_if("needs_review").alias("in_review"))


@query("""
SELECT l_orderkey AS id, l_returnflag AS bookmaker, 'bookmakers.' || l_returnflag || '.markets.' || l_linenumber || '.outcomes.x.players.' || (row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) - 1) AS path, 'line ' || l_linenumber AS outcome, l_extendedprice AS price, CASE WHEN l_linestatus = 'F' THEN true END AS active FROM lineitem
""")
def nested_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-8: odds entries of nested bodies, named by their nearest named ancestor."""
    priced = F.struct(F.col("l_extendedprice").alias("price"), F.when(F.col("l_linestatus") == "F", True).alias("isActive"))
    line = F.struct("l_partkey", "l_suppkey", "l_extendedprice", priced.alias("e"))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linenumber").agg(F.sort_array(F.collect_list(line)).alias("l"))
    players = F.struct(F.struct(F.struct(F.transform("l", lambda x: x["e"]).alias("players")).alias("x")).alias("outcomes"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("label"))
    entries = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    books = rows.groupBy("l_orderkey", "l_returnflag").agg(entries(F.col("l_linenumber").cast("string"), players).alias("markets"))
    bodies = books.groupBy(F.col("l_orderkey").alias("id")).agg(entries(F.col("l_returnflag"), F.struct("markets")).alias("bookmakers"))
    return nested.odds_entries(bodies.select("id", F.to_json(F.struct("bookmakers")).alias("body")))
