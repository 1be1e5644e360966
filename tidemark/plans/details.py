"""Rules on single rows and small groups: names, sides, ladders, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities as e
from ..operators import enrich
from ..operators import evaluation
from ..sources import readers
from ..sources.tables import points, read, with_ctes
from ._base import Family

FAMILY = Family()
query = FAMILY.query


def _texts(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


@query("SELECT event_id, user_id, k FROM (SELECT event_id, user_id, (props->>'k')::INT AS k FROM events WHERE props->>'k' IS NOT NULL AND props->>'none' IS NULL) WHERE k >= 50")
def json_key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-10."""
    k = F.get_json_object("props", "$.k")
    rows = read(spark, sf_dir, "events").filter(k.isNotNull() & F.get_json_object("props", "$.none").isNull())
    return rows.select("event_id", "user_id", k.cast("int").alias("k")).filter("k >= 50")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-8: the first row of each key in a stated order, with the key as the last tie."""
    order = F.struct(F.col("o_orderdate"), (-F.col("o_orderkey")).alias("k"))
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), order).alias("r")).select("o_custkey", "r.*")


@query("SELECT p_partkey FROM part WHERE p_name LIKE 'red%' OR p_name LIKE '%ring' OR p_brand LIKE 'Brand#1_'")
def like_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-10, F-10: predicates from a list of patterns."""
    rows = read(spark, sf_dir, "part")
    hit = F.exists(_texts("red%", "%ring"), lambda p: F.like(F.col("p_name"), p)) | F.col("p_brand").like("Brand#1_")
    return rows.filter(hit).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, max(least(l_discount, l_tax)) + 0.0 AS low, min(greatest(l_discount, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END)) + 0.0 AS high, ceil(sum(l_quantity) / 7)::BIGINT AS up, floor(sum(l_quantity) / 7)::BIGINT AS down FROM lineitem GROUP BY ALL")
def arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-2: least and greatest skip nulls; negative zero is normalised."""
    low, high = F.least("l_discount", "l_tax"), F.greatest(F.col("l_discount"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax")))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
    total = F.sum("l_quantity") / 7
    return rows.agg(F.count("*").alias("n"), (F.max(low) + 0.0).alias("low"), (F.min(high) + 0.0).alias("high"), F.ceil(total).alias("up"), F.floor(total).alias("down"))


@query("""
SELECT o_custkey AS group_id, CASE WHEN n * 1.0 >= 0.8 * whole THEN r END AS title FROM (SELECT o_custkey, split_part(o_orderpriority, '-', 1) AS p, any_value(whole) AS whole, max(c) AS n, arg_max(r, (c, r)) AS r
  FROM (SELECT o_custkey, r, count(*) AS c, sum(count(*)) OVER (PARTITION BY o_custkey) AS whole, min(o_orderpriority) AS o_orderpriority FROM (SELECT *, 'wins the ' || CASE WHEN o_orderkey % 6 = 0 THEN 'cup' ELSE 'final' END AS r FROM orders) GROUP BY o_custkey, r) GROUP BY o_custkey, p)
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, r DESC) = 1
""")
def group_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-20: what most titles of a group share after their first word."""
    title = F.concat(F.lit("t"), F.col("o_orderkey").cast("string"), F.lit(" wins the "), F.when(F.col("o_orderkey") % 6 == 0, "cup").otherwise("final"))
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("group_id")).agg(F.collect_list(title).alias("t"))
    return rows.select("group_id", e.common_title(F.col("t")).alias("title"))


@query("""
SELECT role, count(*) AS claims, count(DISTINCT conv_id) AS analyses, count(*) FILTER (length(text) < 60) AS short, count(*) FILTER (turn > 3) AS unsupported FROM conversations GROUP BY role
""")
def claim_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-23."""
    return read(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count("*").alias("claims"), F.countDistinct("conv_id").alias("analyses"), F.count_if(F.length("text") < 60).alias("short"), F.count_if(F.col("turn") > 3).alias("unsupported")
    )


@query("""
SELECT o_custkey AS match_id, round(max(p) FILTER (NOT game) - avg(p) FILTER (game), 6) AS gap, (max(t) - min(t)) / 1000000 AS span FROM (SELECT o_custkey, o_orderkey % 3 <> 0 AS game, round(o_totalprice / 600000, 4) AS p, epoch_us(o_orderdate) AS t FROM orders) GROUP BY o_custkey
""")
def series_against_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-41: the series price against the mean of its games, and how far apart they were seen."""
    from ..sources.tables import micros

    game, p = F.col("o_orderkey") % 3 != 0, F.round(F.col("o_totalprice") / 600_000, 4)
    rows = read(spark, sf_dir, "orders").withColumn("t", micros("o_orderdate")).groupBy(F.col("o_custkey").alias("match_id"))
    return rows.agg(F.round(F.max(F.when(~game, p)) - F.avg(F.when(game, p)), 6).alias("gap"), ((F.max("t") - F.min("t")) / 1_000_000).alias("span"))


@query("SELECT count(*) AS n, count(DISTINCT o_orderdate) AS days, min(o_orderdate)::DATE::VARCHAR AS first_day, max(o_orderdate)::DATE::VARCHAR AS last_day, count(*) IN (50, 100, 250, 500, 1000) AS may_be_cut FROM orders")
def universe_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-54, S-27: a plain count needs no bisection; the hint tells a cut page."""
    day = lambda f: F.to_date(f("o_orderdate")).cast("string")
    return read(spark, sf_dir, "orders").agg(
        F.count("*").alias("n"), F.countDistinct("o_orderdate").alias("days"), day(F.min).alias("first_day"), day(F.max).alias("last_day"), e.truncation_hint(F.count("*")).alias("may_be_cut")
    )


@query("""
SELECT kind, n_parts, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(q, '(?i)\\bbetween\\b.+\\band\\b') THEN 'range' WHEN regexp_matches(q, '(?i)\\b(and|both)\\b') THEN 'both' WHEN regexp_matches(q, '(?i)\\bor\\b') THEN 'either' ELSE 'single' END AS kind,
  CASE WHEN instr(q, ' and ') > 0 OR instr(q, ' or ') > 0 THEN 2 ELSE 1 END AS n_parts FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN p_name || ' and ' || p_type WHEN 1 THEN p_name || ' or ' || p_type WHEN 2 THEN 'between ' || p_size || ' and ' || p_brand ELSE p_name END AS q FROM part)) GROUP BY ALL
""".replace("\\\\", "\\"))
def composite_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-25."""
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat_ws(" and ", "p_name", "p_type")).when(k == 1, F.concat_ws(" or ", "p_name", "p_type")).when(k == 2, F.concat(F.lit("between "), F.col("p_size").cast("string"), F.lit(" and "), "p_brand")).otherwise(F.col("p_name"))
    rows = read(spark, sf_dir, "part").select(text.alias("q"))
    return rows.groupBy(e.composite_kind(F.col("q")).alias("kind"), F.size(e.split_at_connective(F.col("q"))).alias("n_parts")).agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, n_dates, nearest::VARCHAR AS nearest, amount FROM (SELECT o_orderkey, len(d)::INT AS n_dates, list_min(list_transform(d, lambda x: {'gap': abs(x - o_orderdate::DATE), 'x': x})).x AS nearest, amount FROM (
  SELECT o_orderkey, o_orderdate, list_filter([o_orderdate::DATE + 3, o_orderdate::DATE - 3, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE END], lambda x: x IS NOT NULL) AS d, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 50) * 1000.0 ELSE (o_orderkey % 50)::DOUBLE END AS amount FROM orders))
""")
def ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-26: dates in a text, the one nearest to the end, and amounts with units."""
    day = F.to_date("o_orderdate")
    amount = F.concat(F.lit("over $"), (F.col("o_orderkey") % 50).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "k").otherwise(""), F.lit(" by "))
    text = F.concat(amount, F.date_add(day, 3).cast("string"), F.lit(" or "), F.date_sub(day, 3).cast("string"), F.lit(" 2024-99-99 "), F.when(F.col("o_orderkey") % 2 == 0, day.cast("string")).otherwise(""))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), text.alias("q")).withColumn("d", e.dates_in(F.col("q")))
    return rows.select("o_orderkey", F.size("d").alias("n_dates"), e.nearest_date(F.col("d"), F.col("day")).cast("string").alias("nearest"), e.value_ladder(F.col("q")).alias("amount"))


@query("""
SELECT index, reason, count(*) AS n FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS index, CASE c_custkey % 5 WHEN 3 THEN 'no team label' WHEN 4 THEN 'ambiguous' END AS reason FROM customer) GROUP BY ALL
""")
def side_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-29, F-14: the label of a team, or of its opponent, or why there is none."""
    k, name = F.col("c_custkey") % 5, F.col("c_name")
    labels = (
        F.when(k == 0, F.array(F.upper(name), F.lit("Other"))).when(k == 1, F.array(F.lit("Other"), F.regexp_replace(name, "#", " "))).when(k == 2, F.array(F.lit("Unknown"), F.lit("Rival")))
        .when(k == 3, F.array(F.lit("Yes"), F.lit("No"))).otherwise(F.array(name, name))
    )
    found = e.side_index(labels, name, F.lit("rival"))
    return read(spark, sf_dir, "customer").select(found.alias("f")).groupBy("f.index", "f.reason").agg(F.count("*").alias("n"))


@query("""
SELECT team, count(*) AS n FROM (SELECT s_nationkey AS team FROM supplier WHERE s_suppkey % 100 <= 60 AND (s_suppkey % 3 = 0 OR 60 < s_suppkey % 100 + 30)) GROUP BY team
""")
def roster_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-36."""
    joined = F.col("s_suppkey") % 100
    left = F.when(F.col("s_suppkey") % 3 != 0, joined + 30)
    return read(spark, sf_dir, "supplier").filter(e.active_between(joined, left, F.lit(60))).groupBy(F.col("s_nationkey").alias("team")).agg(F.count("*").alias("n"))


@query("""
SELECT array_to_string(list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'no tournament' END, CASE WHEN o_custkey % 7 = 0 THEN 'team order' END, CASE WHEN o_totalprice < 100000 THEN 'low confidence' END], lambda x: x IS NOT NULL), ', ') AS reasons,
  count(*) AS n, round(avg(least(CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 1 END, CASE WHEN o_custkey % 7 = 0 THEN 0.7 ELSE 1 END)), 6) AS confidence FROM orders GROUP BY reasons
""")
def event_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-37, P-25: why a plan needs a review; its confidence is that of its weakest part."""
    lacking, turned = F.col("o_orderkey") % 4 == 0, F.col("o_custkey") % 7 == 0
    reasons = e.review_reasons(no_tournament=lacking, team_order=turned, low_confidence=F.col("o_totalprice") < 100_000)
    confidence = F.least(F.when(lacking, 0.5).otherwise(1.0), F.when(turned, 0.7).otherwise(1.0))
    return read(spark, sf_dir, "orders").groupBy(F.array_join(reasons, ", ").alias("reasons")).agg(F.count("*").alias("n"), F.round(F.avg(confidence), 6).alias("confidence"))


@query("""
SELECT side, count(*) AS n FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN CASE WHEN p_size % 3 = 0 THEN 'A' WHEN p_size % 3 = 1 THEN 'B' END ELSE CASE WHEN p_size % 3 = 0 THEN 'A' WHEN p_size % 3 = 1 THEN 'B' END END AS side FROM part) GROUP BY side
""")
def odds_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-38: by alias, else by the order of outcome ids."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "Alpha!").when(k == 1, "BETA").when(k == 2, "gamma").otherwise("both")
    side = e.odds_side(name, _texts("alpha", "both"), _texts("beta", "both"), F.col("p_size") % 3 + 10, F.lit(10))
    return read(spark, sf_dir, "part").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@query("SELECT a, b, review, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'two' ELSE 'one' END AS a, CASE WHEN p_partkey % 3 = 0 THEN 'one' WHEN p_partkey % 3 = 1 THEN 'two' END AS b, p_partkey % 3 <> 0 AS review FROM part) GROUP BY ALL")
def team_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-39, F-40: teams read from nested records, the home team first."""
    k = F.col("p_partkey") % 3
    body = F.when(k == 0, '{"teams":[{"name":"one","side":"away"},{"name":"two","side":"home"}]}').when(k == 1, '{"teams":[{"name":"one"},{"name":"two"}]}').otherwise('{"teams":[{"name":"one","side":"home"}]}')
    teams = F.from_json(body, "teams array<struct<name:string,side:string>>")["teams"]
    return read(spark, sf_dir, "part").select(teams.alias("t")).select(e.home_first(F.col("t")).alias("o")).groupBy("o.a", "o.b", "o.review").agg(F.count("*").alias("n"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE length(regexp_replace(lower(a.p_name), '[^a-z0-9]', '', 'g')) >= 4")
def same_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-24: keys that begin alike; the join is on the brand and the first letters."""
    from ..functions.text import plain_name

    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", plain_name(F.col("p_name")).alias("key")).withColumn("block", F.substring("key", 1, 4))
    a = rows.select(F.col("p_partkey").alias("a"), "p_brand", "block", F.col("key").alias("ka"), F.col("p_name").alias("na"))
    b = rows.select(F.col("p_partkey").alias("b"), "p_brand", "block", F.col("key").alias("kb"), F.col("p_name").alias("nb"))
    return a.join(b, ["p_brand", "block"]).filter((F.col("a") < F.col("b")) & e.same_subject(F.col("ka"), F.col("kb")) & (F.col("na") == F.col("nb"))).select("a", "b")


@query("SELECT p_partkey, substr(sha256('audit|' || p_partkey), 1, 8) AS place FROM part WHERE p_partkey % 5 <> 0 ORDER BY sha256('audit|' || p_partkey) LIMIT 25")
def discard_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-5, K-9: a seeded sample of discarded rows; the sample is the feature."""
    place = F.sha2(F.concat_ws("|", F.lit("audit"), F.col("p_partkey").cast("string")), 256)
    return read(spark, sf_dir, "part").filter("p_partkey % 5 <> 0").withColumn("full", place).orderBy("full").limit(25).select("p_partkey", F.substring("full", 1, 8).alias("place"))


@query("SELECT o_orderkey AS leg_id, round(o_totalprice / (0.05 + o_custkey % 9 / 10.0), 4) AS shares FROM orders")
def leg_sink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-29, S-30, S-17, S-18: rows for a sink with known columns; shares are stake / entry to four places."""
    rows = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("leg_id"), F.round(F.col("o_totalprice") / (0.05 + F.col("o_custkey") % 9 / F.lit(10.0)), 4).alias("shares"), F.lit(None).cast("string").alias("not_in_store")
    )
    return readers.align(rows, ["leg_id", "shares", "older_column"])


@query(
    with_ctes("points", body="""
SELECT 'agent' AS forecaster, count(p) AS n, round(avg((p - y) ** 2)::DECIMAL(18, 9), 6)::DOUBLE AS brier FROM points UNION ALL SELECT 'market', count(market), round(avg((market - y) ** 2)::DECIMAL(18, 9), 6)::DOUBLE FROM points UNION ALL SELECT 'mean', count(market), round(avg(((p + market) / 2 - y) ** 2)::DECIMAL(18, 9), 6)::DOUBLE FROM points""")
)
def any_forecaster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-7: scores of any columns in one pass; S-20: a section of a report is a table."""
    f = evaluation.forecasters()
    rows = enrich.score(points(spark, sf_dir), {"agent": f["agent"], "market": f["market"], "mean": (F.col("p") + F.col("market")) / 2}, F.col("y"))
    return rows.withColumn("brier", F.round(F.col("brier").cast("decimal(18,9)"), 6).cast("double"))


@query("SELECT enricher, count(*) AS n, max(as_of) AS newest FROM (SELECT 'roles' AS enricher, turn * 1000 AS as_of FROM conversations WHERE turn * 1000 <= 4000 UNION ALL SELECT 'first words', turn * 1000 FROM conversations WHERE turn = 0) GROUP BY enricher")
def enrichers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-8, U-6, P-16: registered sources, of which only those that know the past take part in a replay."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("match_id"), "turn", "role", "text")

    def source(condition: str, payload: str):
        fetch = lambda matches, as_of: matches.filter(condition).select("match_id", F.lit(payload).alias("kind"), (F.col("turn") * 1000).alias("as_of"), F.col(payload).alias("payload"))
        return fetch

    known = [enrich.Enricher("roles", True, source("true", "role")), enrich.Enricher("first words", True, source("turn = 0", "text")), enrich.Enricher("live", False, source("true", "text"))]
    rows = enrich.stamped(enrich.enrich(turns, known, 4000, 4_000_000_000), F.lit(0))
    return rows.groupBy("enricher").agg(F.count("*").alias("n"), F.max("as_of").alias("newest"))
