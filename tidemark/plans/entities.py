"""Matches, teams and their markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matches as op
from ..sources.tables import micros, read
from ._base import Family

FAMILY = Family()
query = FAMILY.query

_MATCHES = """WITH matches AS (SELECT o_orderkey AS match_id, o_custkey % 60 AS team_a, (o_custkey % 60 + 1 + o_orderkey % 58) % 60 AS team_b, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'V' END END AS winner,
  epoch_us(o_orderdate) AS resolved_at, CASE WHEN o_orderkey % 19 <> 0 THEN epoch_us(o_orderdate) END AS scheduled_at FROM orders),
links AS (SELECT l_orderkey AS match_id, l_partkey AS event_id, CASE WHEN l_linenumber % 4 <> 0 THEN (l_suppkey % 2)::INT END AS side_index FROM lineitem WHERE l_linenumber <= 4)"""


def matches_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, a = F.col("o_orderkey"), F.col("o_custkey") % 60
    winner = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B").when(k % 2 == 0, "V")
    return read(spark, sf_dir, "orders").select(
        k.alias("match_id"), a.alias("team_a"), ((a + 1 + k % 58) % 60).alias("team_b"), winner.alias("winner"), micros("o_orderdate").alias("resolved_at"), F.when(k % 19 != 0, micros("o_orderdate")).alias("scheduled_at")
    )


def links_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").filter(line <= 4).select(F.col("l_orderkey").alias("match_id"), F.col("l_partkey").alias("event_id"), F.when(line % 4 != 0, (F.col("l_suppkey") % 2).cast("int")).alias("side_index"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    return read(spark, sf_dir, "part").filter(k % 23 != 0).select(k.alias("event_id"), F.when(k % 10 == 0, a("x", "y", "z")).otherwise(a("home", "away")).alias("labels"))




@query(_MATCHES + """, one AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY match_id) AS n_links FROM links) QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY event_id, side_index NULLS FIRST) = 1),
ev AS (SELECT p_partkey AS event_id, CASE WHEN p_partkey % 10 = 0 THEN ['x', 'y', 'z'] ELSE ['home', 'away'] END AS labels FROM part WHERE p_partkey % 23 <> 0)
SELECT CASE WHEN o.event_id IS NULL THEN 'no market' WHEN side_index IS NULL THEN 'no side' WHEN labels IS NULL THEN 'no event' WHEN len(labels) <> 2 THEN 'not two outcomes' WHEN winner IS NULL THEN 'unresolved' WHEN winner NOT IN ('A', 'B') THEN 'void' WHEN scheduled_at IS NULL THEN 'no time' END AS reason,
  count(*) AS n, count(*) FILTER (n_links > 1) AS seen_twice, count(*) FILTER (len(labels) = 2 AND labels[side_index + 1] = 'home') AS home_is_a FROM matches m LEFT JOIN one o USING (match_id) LEFT JOIN ev e ON e.event_id = o.event_id GROUP BY reason""")
def market_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-15, J-18, J-19, J-20, S-26: every match with the first reason that leaves it out."""
    rows = op.universe(matches_of(spark, sf_dir), links_of(spark, sf_dir), _events(spark, sf_dir))
    label = op.team_label(F.col("labels"), F.col("side_index"), F.lit(True))
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.col("n_links") > 1).alias("seen_twice"), F.count_if(label == "home").alias("home_is_a"))


@query(_MATCHES + """
SELECT match_id, event_id, side_index, n_links FROM (SELECT *, count(*) OVER (PARTITION BY match_id) AS n_links FROM links WHERE side_index IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY event_id, side_index) = 1""")
def first_usable_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-18, J-38: links without a side are skipped first."""
    return op.one_link(links_of(spark, sf_dir), skip_null_index=True)


_LONG = ", long AS (SELECT match_id, team_a AS team, team_b AS other, CASE WHEN winner IN ('A', 'B') THEN winner = 'A' END AS won, resolved_at FROM matches UNION ALL SELECT match_id, team_b, team_a, CASE WHEN winner IN ('A', 'B') THEN winner = 'B' END, resolved_at FROM matches)"


@query(_MATCHES + _LONG + """
SELECT team, count(*) FILTER (won) AS wins, count(*) FILTER (NOT won) AS losses, count(*) FILTER (won IS NULL) AS voids,
  string_agg(CASE WHEN won IS NULL THEN 'V' WHEN won THEN 'W' ELSE 'L' END, '' ORDER BY r) FILTER (r <= 8) AS form FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY resolved_at DESC, match_id DESC) AS r FROM long) GROUP BY team""")
def team_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-38."""
    return op.records(op.team_matches(matches_of(spark, sf_dir)), 8)


@query(_MATCHES + _LONG + "\nSELECT team AS low, other AS high, count(*) AS n, count(*) FILTER (won) AS low_wins FROM long WHERE team < other GROUP BY team, other")
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-38, J-21."""
    return op.head_to_head(op.team_matches(matches_of(spark, sf_dir)))


@query(_MATCHES + _LONG + """, wanted AS (SELECT match_id, team, resolved_at AS as_of FROM long),
p AS (SELECT w.match_id, w.team, l.won, row_number() OVER (PARTITION BY w.match_id, w.team ORDER BY l.resolved_at DESC, l.match_id DESC) AS r FROM wanted w JOIN long l ON l.team = w.team AND l.resolved_at <= w.as_of AND l.match_id <> w.match_id)
SELECT match_id, team, count(*) AS n, count(*) FILTER (won) AS wins FROM p WHERE r <= 8 GROUP BY match_id, team""")
def past_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-21, E-60, E-37."""
    long = op.team_matches(matches_of(spark, sf_dir))
    wanted = long.select("match_id", "team", F.col("resolved_at").alias("as_of"))
    return op.past_matches(wanted, long, 8).groupBy("match_id", "team").agg(F.count("*").alias("n"), F.count_if("won").alias("wins"))


@query("""
WITH d AS (SELECT l_orderkey AS match_id, CASE l_returnflag WHEN 'R' THEN 'A' WHEN 'A' THEN CASE WHEN l_linenumber % 3 = 0 THEN 'B' ELSE 'pending' END ELSE CASE WHEN l_linenumber = 2 THEN 'void' ELSE 'no_index' END END AS decision, epoch_us(l_shipdate) AS resolved_at FROM lineitem),
p AS (SELECT match_id, count(DISTINCT CASE WHEN decision IN ('A', 'B') THEN decision END) AS winners, min(CASE WHEN decision IN ('A', 'B') THEN decision END) AS winner, bool_or(decision = 'void') AS void, bool_or(decision = 'no_index') AS no_index, min(resolved_at) AS resolved_at FROM d GROUP BY match_id)
SELECT match_id, CASE WHEN winners > 1 THEN 'ambiguous' WHEN winners = 1 THEN winner WHEN void THEN 'void' WHEN no_index THEN 'no_index' ELSE 'pending' END AS outcome, resolved_at FROM p
""")
def combined_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-44, J-37, E-22."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    decision = F.when(flag == "R", "A").when(flag == "A", F.when(line % 3 == 0, "B").otherwise("pending")).otherwise(F.when(line == 2, "void").otherwise("no_index"))
    return op.combined_outcome(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), decision.alias("decision"), micros("l_shipdate").alias("resolved_at")))


@query("""
SELECT match_id, len(g)::INT AS games, CASE WHEN g = range(1, list_max(g) + 1) AND list_max(g) <= 3 THEN 3 WHEN g = range(1, list_max(g) + 1) AND list_max(g) <= 5 THEN 5 END AS best_of FROM (SELECT l_orderkey AS match_id, list_sort(list(DISTINCT l_linenumber::BIGINT)) AS g FROM lineitem GROUP BY l_orderkey)
""")
def best_of_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-40, F-28."""
    return op.best_of(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("game")))


@query("""
WITH p AS (SELECT o_custkey % 300 AS key, o_orderstatus AS role, count(*) AS c FROM orders WHERE o_orderstatus <> 'P' OR o_custkey % 2 = 0 GROUP BY ALL)
SELECT key, arg_min(role, (-c, role)) AS role, sum(c)::BIGINT AS n, round(max(c) / sum(c), 6) AS purity FROM p GROUP BY key HAVING sum(c) >= 5 AND max(c) / sum(c) >= 0.55
""")
def learned_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-50. The tables' roles are mixed, so the purity asked for is lower than in production."""
    rows = read(spark, sf_dir, "orders").filter("o_orderstatus <> 'P' OR o_custkey % 2 = 0").select((F.col("o_custkey") % 300).alias("key"), F.col("o_orderstatus").alias("role"))
    return op.learned_roles(rows, 5, 0.55).withColumn("purity", F.round("purity", 6))


_CLUBS = ["Silver Foxes", "North Harbour", "Red Comet", "Iron Valley", "Quiet Storm", "Océan Nine", "Blue Lantern", "Paper Tigers", "Silver Falcons", "Team"]


def _names_sql(club: str, form: str) -> str:
    """A club's name in one of eight spellings."""
    return f"""CASE {form} WHEN 0 THEN {club} WHEN 1 THEN upper({club}) || ' eSports' WHEN 2 THEN {club} || ' Academy' WHEN 3 THEN regexp_replace({club}, '[aeiou ]', '', 'g')
  WHEN 4 THEN 'The ' || {club} WHEN 5 THEN substr({club}, 1, 1) || substr(split_part({club}, ' ', 2), 1, 1) WHEN 6 THEN '' ELSE 'Roster ' || substr({club}, 1, 1) END"""


def _name(club: Column, form: Column) -> Column:
    spellings = [
        club, F.concat(F.upper(club), F.lit(" eSports")), F.concat(club, F.lit(" Academy")), F.regexp_replace(club, "[aeiou ]", ""),
        F.concat(F.lit("The "), club), F.concat(F.substring(club, 1, 1), F.substring(F.split_part(club, F.lit(" "), F.lit(2)), 1, 1)), F.lit(""),
    ]
    out = F.concat(F.lit("Roster "), F.substring(club, 1, 1))
    for i, spelling in enumerate(spellings):
        out = F.when(form == i, spelling).otherwise(out)
    return out


def _tier_sql(side: str, theirs: str) -> str:
    """The tier of a side against a list of variants, by the definitions alone."""
    words = lambda x: f"list_filter(string_split_regex(translate(lower({x}), 'é', 'e'), '[^a-z0-9]+'), lambda w: w <> '')"
    bare = lambda x: f"list_filter({words(x)}, lambda w: w NOT IN ('esports', 'esport', 'gaming', 'team', 'club', 'org', 'cs', 'cs2', 'csgo', 'gg', 'the'))"
    plain = lambda x: f"array_to_string({words(x)}, '')"
    canon = lambda x: f"array_to_string(CASE WHEN len({bare(x)}) > 0 THEN {bare(x)} ELSE {words(x)} END, '')"
    first = lambda x: f"coalesce(array_to_string(list_transform({bare(x)}, lambda w: substr(w, 1, 1)), ''), '')"
    marks = lambda x: f"array_to_string(list_filter({words(x)}, lambda w: w IN ('academy', 'b')), ',')"
    inside = lambda s, l: f"(length({s}) >= 3 AND length({s}) < length({l}) AND regexp_matches({l}, array_to_string(string_split({s}, ''), '.*')))"
    o, v = f"{side}", "v"
    usable = f"{plain(v)} <> '' AND {marks(v)} = {marks(o)}"
    any_of = lambda test: f"len(list_filter({theirs}, lambda v: {usable} AND {test})) > 0"
    short = f"length({canon(v)}) >= 2 AND ((length({first(o)}) >= 2 AND {canon(v)} = {first(o)}) OR (length({canon(o)}) >= 2 AND {first(v)} = {canon(o)}) OR {inside(canon(o), canon(v))} OR {inside(canon(v), canon(o))})"
    return f"""CASE WHEN {plain(o)} = '' THEN NULL WHEN {any_of(f"{plain(v)} = {plain(o)}")} THEN 0 WHEN {any_of(f"{canon(v)} = {canon(o)}")} THEN 1 WHEN {marks(o)} <> '' THEN NULL
  WHEN length(trim({side}_code)) >= 2 AND {any_of(f"{plain(v)} = {plain(side + '_code')}")} THEN 2 WHEN {any_of(short)} THEN 3 END"""


@query(f"""
WITH n AS (SELECT {_CLUBS!r} AS clubs),
f AS (SELECT o_orderkey AS fixture_id, epoch_us(o_orderdate) AS u, clubs[o_custkey % 10 + 1] AS p, clubs[(o_custkey + 1 + o_orderkey % 3) % 10 + 1] AS q FROM orders, n WHERE o_orderkey % 4 = 1),
v AS (SELECT fixture_id, u, [{_names_sql("p", "fixture_id // 4 % 8")}, upper(substr(p, 1, 3))] AS one, CASE WHEN fixture_id % 5 <> 0 THEN [{_names_sql("q", "fixture_id // 32 % 6")}, upper(substr(q, 1, 3))] ELSE [q] END AS two FROM f),
w AS (SELECT o_orderkey AS match_id, epoch_us(o_orderdate) + 3600000000 AS t, clubs[o_custkey % 10 + 1] AS p, clubs[(o_custkey + 1 + o_orderkey % 3) % 10 + 1] AS q FROM orders, n WHERE o_orderkey % 4 = 3),
m AS (SELECT match_id, t, {_names_sql("p", "match_id // 4 % 8")} AS a, lower(substr(p, 1, 3)) AS a_code, {_names_sql("q", "match_id // 32 % 8")} AS b, CASE WHEN match_id % 3 = 0 THEN substr(q, 1, 3) END AS b_code FROM w),
s AS (SELECT fixture_id, u, 1 AS side_a, one AS x, two AS y FROM v UNION ALL SELECT fixture_id, u, 2, two, one FROM v),
c AS (SELECT match_id, fixture_id, side_a, abs(t - u) AS gap, {_tier_sql("a", "x")} AS ta, {_tier_sql("b", "y")} AS tb
  FROM m JOIN (SELECT *, u // 86400000000 AS d FROM s) s ON d BETWEEN t // 86400000000 // 7 * 7 - 1 AND t // 86400000000 // 7 * 7 + 7),
e AS (SELECT match_id, fixture_id, min(side_a) AS side_a, arg_min(greatest(ta, tb), side_a) AS tier, any_value(gap) AS gap FROM c WHERE ta IS NOT NULL AND tb IS NOT NULL GROUP BY ALL),
z AS (SELECT * FROM e QUALIFY rank() OVER (PARTITION BY match_id ORDER BY tier, gap) = 1)
SELECT match_id, any_value(tier)::INT AS tier, CASE WHEN count(*) = 1 THEN min(fixture_id) END AS fixture_id, CASE WHEN count(*) = 1 THEN min(side_a) END::INT AS side_a FROM z GROUP BY match_id
""")
def fuzzy_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-23, J-25, F-15: fixtures by names in several spellings."""
    k, names = F.col("o_orderkey"), F.array(*[F.lit(c) for c in _CLUBS])
    club = lambda place: F.get(names, (place % 10).cast("int"))
    orders = read(spark, sf_dir, "orders").withColumn("p", club(F.col("o_custkey"))).withColumn("q", club(F.col("o_custkey") + 1 + k % 3))
    p, q, starts, part = F.col("p"), F.col("q"), micros("o_orderdate"), lambda shift: F.floor(k / shift)
    start = lambda c: F.substring(c, 1, 3)
    two = F.when(k % 5 != 0, F.array(_name(q, part(32) % 6), F.upper(start(q)))).otherwise(F.array(q))
    fixtures = orders.filter(k % 4 == 1).select(k.alias("fixture_id"), F.array(_name(p, part(4) % 8), F.upper(start(p))).alias("side_1"), two.alias("side_2"), starts.alias("starts"))
    wanted = orders.filter(k % 4 == 3).select(
        k.alias("match_id"), _name(p, part(4) % 8).alias("a"), F.lower(start(p)).alias("a_code"), _name(q, part(32) % 8).alias("b"), F.when(k % 3 == 0, start(q)).alias("b_code"), (starts + 3_600_000_000).alias("starts")
    )
    return op.fuzzy_fixture(wanted, fixtures)


@query("""
SELECT match_id, checkpoint::INT AS checkpoint FROM (SELECT o_orderkey AS match_id, epoch_us(o_orderdate) AS s, unnest([60, 360, 1440]) AS checkpoint FROM orders) WHERE epoch_us(TIMESTAMP '1996-06-01') - (s - checkpoint::BIGINT * 60000000) BETWEEN 0 AND 86400000000 * 3
""")
def due_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-14, P-28, P-29."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), micros("o_orderdate").alias("scheduled_at"))
    return op.due_checkpoints(rows, [60, 360, 1440], 833_587_200_000_000, 3 * 86_400_000_000)


@query("""
SELECT gate, count(*) AS n FROM (SELECT CASE WHEN price IS NULL THEN 'no_price' WHEN coalesce(liq, 0) < 30000 THEN 'low_liquidity' WHEN spread > 0.03 THEN 'wide_spread' WHEN ctx < 2 THEN 'insufficient_context' END AS gate
  FROM (SELECT CASE WHEN l_linenumber % 6 <> 0 THEN l_discount END AS price, CASE WHEN l_suppkey % 8 <> 0 THEN l_extendedprice END AS liq, abs(l_tax) / 2 AS spread, l_partkey % 5 AS ctx FROM lineitem)) GROUP BY gate
""")
def analysis_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-15, P-25."""
    price = F.when(F.col("l_linenumber") % 6 != 0, F.col("l_discount"))
    liquidity = F.when(F.col("l_suppkey") % 8 != 0, F.col("l_extendedprice"))
    reason = op.gate(price, liquidity, F.abs("l_tax") / 2, F.col("l_partkey") % 5)
    return read(spark, sf_dir, "lineitem").groupBy(reason.alias("gate")).agg(F.count("*").alias("n"))


@query("""
SELECT match_id, enricher, kind, arg_max(fragment_id, (observed_at, fragment_id)) AS fragment_id, max(observed_at) AS observed_at FROM (SELECT conv_id AS match_id, role AS enricher, (turn // 2 % 2)::INT AS kind, conv_id * 1000 + turn AS fragment_id, turn * 1000 AS observed_at FROM conversations) WHERE observed_at <= 3000 GROUP BY match_id, enricher, kind
""")
def newest_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-10, P-16, P-17, R-10: only what was observed by the instant."""
    rows = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("match_id"), F.col("role").alias("enricher"), (F.floor(F.col("turn") / 2) % 2).cast("int").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("fragment_id"), (F.col("turn") * 1000).alias("observed_at")
    )
    return op.newest_fragments(rows, 3000)


@query("""
SELECT source, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'explicit' WHEN o_orderkey % 3 = 1 AND o_orderstatus <> 'P' THEN 'scheduled' WHEN o_custkey % 2 = 0 THEN 'game start' END AS source FROM orders) GROUP BY source
""")
def anchor_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-21."""
    k, at = F.col("o_orderkey"), micros("o_orderdate")
    a = op.anchor(F.when(k % 3 == 0, at), ("scheduled", F.when((k % 3 == 1) & (F.col("o_orderstatus") != "P"), at)), ("game start", F.when(F.col("o_custkey") % 2 == 0, at)))
    return read(spark, sf_dir, "orders").select(a.alias("a")).groupBy(F.col("a.source").alias("source")).agg(F.count("*").alias("n"))
