"""Retention, upserts, health, cadence, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lifecycle as op
from ..sources import readers
from ..sources.tables import micros, quotes, read, with_ctes
from ._base import Family
from .texts import _SLUG_SQL, _slug

FAMILY = Family()
query = FAMILY.query

NOW = 1_706_572_800_000_000
DAY = 86_400_000_000


@query("""
WITH b AS (SELECT o_custkey AS key, o_orderkey AS seq, o_totalprice AS amount FROM orders WHERE o_orderpriority <> '1-URGENT'), base AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
c AS (SELECT o_custkey AS key, o_orderkey AS seq, o_totalprice AS amount FROM orders WHERE o_orderpriority = '1-URGENT'), lc AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
SELECT 'replace' AS mode, count(*) AS n, sum(seq)::BIGINT AS checksum FROM (SELECT coalesce(lc.seq, base.seq) AS seq FROM base FULL JOIN lc USING (key)) UNION ALL SELECT 'ignore', count(*), sum(seq)::BIGINT FROM (SELECT coalesce(base.seq, lc.seq) AS seq FROM base FULL JOIN lc USING (key))
""")
def upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-10, S-11, S-12, S-21, S-22: the last change wins, or what exists stays."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("amount"), (F.col("o_orderpriority") == "1-URGENT").alias("change"))
    base, changes = op.last_of_each(rows.filter("NOT change").drop("change"), ["key"], "seq"), rows.filter("change").drop("change")
    total = lambda df, mode: df.agg(F.lit(mode).alias("mode"), F.count("*").alias("n"), F.sum("seq").alias("checksum"))
    return total(op.upsert(base, changes, ["key"], "seq"), "replace").unionByName(total(op.upsert(base, changes, ["key"], "seq", ignore=True), "ignore"))


@query("""
WITH k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') SELECT CASE WHEN o_custkey IN (FROM k) THEN 'known' ELSE 'new' END AS part, CASE WHEN o_custkey IN (FROM k) THEN NULL ELSE 'scan' END AS provenance, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL
""")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-13, P-27, J-36: provenance only on what is new."""
    orders = read(spark, sf_dir, "orders")
    new, known = op.split_first_seen(orders.filter("o_orderstatus <> 'F'"), orders.filter("o_orderstatus = 'F'"), ["o_custkey"], "scan")
    rows = new.withColumn("part", F.lit("new")).unionByName(known.withColumn("part", F.lit("known")), allowMissingColumns=True)
    return rows.groupBy("part", "provenance").agg(F.count("*").alias("n"))


_EVENTS = f""", ev AS (SELECT o_orderkey::VARCHAR AS event_id, CASE WHEN o_orderkey % 9 <> 0 THEN {_SLUG_SQL} END AS slug, CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE 'open' END AS status, o_orderkey % 12 = 5 AS held FROM orders)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.cast("string").alias("event_id"), F.when(k % 9 != 0, _slug()).alias("slug"), F.when(F.col("o_orderstatus") == "F", "final").otherwise("open").alias("status"), (k % 12 == 5).alias("held")
    )


@query(
    with_ctes("quotes", body=_EVENTS + f""", x AS (SELECT q.*, slug, status, coalesce(held, false) AS held, slug LIKE 'cs2-%' OR slug LIKE 'lol-%' AS safe FROM quotes q LEFT JOIN ev USING (event_id))
SELECT CASE WHEN NOT held AND NOT coalesce(safe, false) AND tick < {NOW - 20 * DAY} THEN 'old' WHEN NOT held AND slug IS NOT NULL AND NOT safe AND status = 'final' AND tick < {NOW - 5 * DAY} THEN 'finalized' END AS branch, count(*) AS n, count(DISTINCT event_id) AS events FROM x GROUP BY branch""")
)
def retention_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-8, J-15, J-33, A-9, U-4: which rows a retention run deletes, and by which rule."""
    rows = op.deletable(quotes(spark, sf_dir), _events(spark, sf_dir), NOW, 20 * DAY, 5 * DAY, [], ["cs2-%", "lol-%"])
    return rows.groupBy("branch").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


_BRANCHES = _EVENTS + f""", x AS (SELECT q.*, slug, status, coalesce(held, false) AS held, slug LIKE 'cs2-%' OR slug LIKE 'lol-%' AS safe FROM quotes q LEFT JOIN ev USING (event_id)),
br AS (SELECT *, CASE WHEN NOT held AND NOT coalesce(safe, false) AND tick < {NOW - 20 * DAY} THEN 'old' WHEN NOT held AND slug IS NOT NULL AND NOT safe AND status = 'final' AND tick < {NOW - 5 * DAY} THEN 'finalized' END AS branch FROM x)"""


@query(with_ctes("quotes", body=_BRANCHES + """
SELECT event_id, outcome, tick, branch FROM br WHERE branch IS NOT NULL ORDER BY tick, seq LIMIT 300"""))
def retention_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-11, K-2: what one run deletes, oldest first; the batch's size is the feature."""
    rows = op.deletable(quotes(spark, sf_dir), _events(spark, sf_dir), NOW, 20 * DAY, 5 * DAY, [], ["cs2-%", "lol-%"])
    return op.retention_batch(rows, ["tick", "seq"], 300).select("event_id", "outcome", "tick", "branch")


@query(with_ctes("quotes", body=_BRANCHES + """
SELECT count(*) FILTER (branch = 'old') AS old, count(*) FILTER (branch = 'finalized') AS finalized, (SELECT count(*) FROM ev WHERE held OR coalesce(slug LIKE 'cs2-%' OR slug LIKE 'lol-%', false)) AS protected FROM br"""))
def retention_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-15, U-5: counts of a whole run, and what is protected."""
    events, patterns = _events(spark, sf_dir), ["cs2-%", "lol-%"]
    return op.retention_counts(op.deletable(quotes(spark, sf_dir), events, NOW, 20 * DAY, 5 * DAY, [], patterns), events, [], patterns)


@query(with_ctes("quotes", body=f"""SELECT seq AS fragment_id, tick AS observed_at FROM quotes WHERE tick < {NOW + 20 * DAY - 30 * DAY} ORDER BY tick, seq LIMIT 250"""))
def fragment_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-13: ten days are set, thirty are kept."""
    rows = quotes(spark, sf_dir).select(F.col("seq").alias("fragment_id"), F.col("tick").alias("observed_at"))
    return op.expired_fragments(rows, NOW + 20 * DAY, 10, 250)


@query("""
WITH f AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events)) SELECT *, (SELECT count(*) > 12 FROM f) AS capped FROM f ORDER BY c_name LIMIT 12
""")
def with_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-16: the first items that have any snapshot; the cap is the feature."""
    users = read(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"))
    return op.with_any(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), users, ["c_custkey"], ["c_name"], 12)


@query(
    with_ctes("quotes", body=f""", h AS (SELECT tick // {DAY} AS day, count(*) AS n FROM quotes WHERE tick // {DAY} % 6 <> 0 GROUP BY 1), s AS (SELECT unnest(range(min(day), 19754 + 8)) AS day FROM h)
SELECT day, coalesce(n, 0) AS n, CASE WHEN day < 19754 - 30 THEN CASE WHEN n IS NOT NULL THEN 'drop' END WHEN n IS NULL THEN 'create' ELSE 'keep' END AS action FROM s LEFT JOIN h USING (day) WHERE NOT (day < 19754 - 30 AND n IS NULL)""")
)
def partition_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-12: partitions to create ahead, keep or drop."""
    rows = quotes(spark, sf_dir).withColumn("day", F.floor(F.col("tick") / F.lit(DAY))).filter("day % 6 <> 0")
    return op.partitions_to_manage(rows, "day", 19_754, 7, 10)


@query(
    with_ctes("quotes", body=f""", b AS (SELECT outcome || '/' || (event_id::INT % 10) AS component, max(tick) AS last_at, arg_max(seq, tick) % 7 = 0 AS err FROM quotes GROUP BY 1),
b2 AS (SELECT component, CASE WHEN component LIKE 'view/9' THEN NULL ELSE last_at END AS last_at, CASE WHEN err THEN 'error' ELSE 'ok' END AS status FROM b), a AS (SELECT component, 'down' AS state, last_at - 3 * 3600000000 AS notified_at FROM b WHERE component LIKE '%/1' OR component LIKE '%/2' OR component LIKE '%/3'),
j AS (SELECT b2.*, coalesce(state = 'down', false) AS alerted, notified_at, {NOW} - last_at > {5 * 3600000000} OR status = 'error' AS down FROM b2 LEFT JOIN a USING (component))
SELECT component, CASE WHEN last_at IS NULL THEN 'never_beat' WHEN down AND NOT alerted THEN 'alert' WHEN down AND {NOW} - notified_at >= {8 * 3600000000} THEN 'remind' WHEN NOT down AND alerted THEN 'recovered' ELSE 'none' END AS say FROM j""")
)
def health_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-8, R-7: what the monitor says about each component."""
    rows = quotes(spark, sf_dir).withColumn("component", F.concat_ws("/", "outcome", (F.col("event_id").cast("int") % 10).cast("string")))
    b = rows.groupBy("component").agg(F.max("tick").alias("t"), F.max_by("seq", "tick").alias("s"))
    beats = b.select("component", F.when(F.col("component") != "view/9", F.col("t")).alias("last_at"), F.when(F.col("s") % 7 == 0, "error").otherwise("ok").alias("status"))
    alerts = b.filter(F.col("component").rlike("/[123]$")).select("component", F.lit("down").alias("state"), (F.col("t") - 3 * 3_600_000_000).alias("notified_at"))
    return op.health(beats, alerts, NOW, 5 * 3_600_000_000, 8 * 3_600_000_000).select("component", "say")


@query(
    with_ctes("quotes", body=f""", b AS (SELECT event_id, CASE event_id::INT % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'soon' ELSE 'far' END AS band, event_id::INT % 2 = 0 AS derived, max(tick) AS last_run FROM quotes GROUP BY event_id)
SELECT band, derived, count(*) AS n, count(*) FILTER ({NOW} - last_run >= CASE band WHEN 'live' THEN 12000000000 WHEN 'soon' THEN 60000000000 ELSE 300000000000 END * CASE WHEN derived THEN 5 ELSE 1 END - 1000000) AS due FROM b GROUP BY band, derived""")
)
def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-4: which buckets are due; times are scaled to the tables' gaps."""
    n = F.col("event_id").cast("int")
    band = F.when(n % 3 == 0, "live").when(n % 3 == 1, "soon").otherwise("far")
    rows = quotes(spark, sf_dir).groupBy("event_id").agg(F.max("tick").alias("last_run")).withColumn("band", band).withColumn("derived", n % 2 == 0)
    out = op.due(rows, NOW, {"live": 12_000, "soon": 60_000, "far": 300_000}, 5, 1_000_000)
    return out.groupBy("band", "derived").agg(F.count("*").alias("n"), F.count_if("due").alias("due"))


@query("""
SELECT conv_id, count(*) AS n, count(*) FILTER (p IS NULL OR role IS DISTINCT FROM p) AS changes FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY conv_id
""")
def changed_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-9."""
    rows = op.changed(read(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if("changed").alias("changes"))


@query("""
WITH r AS (SELECT o_custkey AS source, o_orderkey AS seq, o_orderstatus <> 'F' AS known FROM orders), a AS (SELECT *, sum((NOT known)::INT) OVER (PARTITION BY source ORDER BY seq) AS g FROM r), b AS (SELECT *, sum(known::INT) OVER (PARTITION BY source, g ORDER BY seq) AS streak FROM a),
c AS (SELECT *, coalesce(max((streak >= 3)::INT) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS read FROM b) SELECT source, count(*) AS n, count(*) FILTER (read) AS n_read FROM c GROUP BY source
""")
def known_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-9."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") != "F").alias("known"))
    return op.known_streak(rows, ["source"], "seq", "known", 3).groupBy("source").agg(F.count("*").alias("n"), F.count_if("read").alias("n_read"))


@query(f"""
WITH s AS (SELECT o_orderkey AS event_id, {_SLUG_SQL} AS slug FROM orders), f AS (SELECT * FROM s WHERE event_id % 4 <> 0) SELECT p AS prefix, (SELECT count(*) FROM f WHERE starts_with(slug, p || '-')) AS n FROM (VALUES ('cs2'), ('lol'), ('dota2'), ('val')) AS t(p)
""")
def orphans_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-11, U-3, O-3."""
    events = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), _slug().alias("slug"))
    return op.orphans_by_prefix(events, events.filter("event_id % 4 = 0"), ["cs2", "lol", "dota2", "val"])


@query("""
SELECT event_type AS component, date_trunc('hour', ts) = TIMESTAMP '2024-01-15 06:00:00' AS in_hour, left(CASE WHEN value > 100 THEN 'large value of ' || event_type || ' seen in the feed' END, 12) AS message, count(*) AS n, round(avg(value), 4) AS mean_ms, max(value) AS top_ms FROM events GROUP BY ALL
""")
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-1, A-3, A-12, P-19: executions, errors and times by component."""
    ts = F.col("ts").cast("timestamp")
    message = F.substring(F.when(F.col("value") > 100, F.concat(F.lit("large value of "), "event_type", F.lit(" seen in the feed"))), 1, 12)
    rows = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("component"), (F.date_trunc("hour", ts) == F.lit("2024-01-15 06:00:00").cast("timestamp")).alias("in_hour"), message.alias("message"))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_ms"), F.max("value").alias("top_ms"))


@query("""
SELECT o_orderkey AS market_id, status, volume, yes FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'resolved' WHEN o_custkey % 6 = 0 THEN 'closed' ELSE 'active' END AS status, round(o_totalprice, 2) AS volume, CASE WHEN o_orderkey % 8 <> 0 THEN round((o_orderkey % 97) / 100.0, 2) END AS yes FROM orders)
""")
def api_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-5, S-6, S-9: JSON records as an API gives them, read back into typed rows."""
    k = F.col("o_orderkey")
    prices = F.when(k % 8 != 0, F.concat(F.lit('["'), F.round((k % 97) / F.lit(100.0), 2).cast("string"), F.lit('","0.5"]'))).otherwise(F.lit("oops"))
    body = F.to_json(F.struct(k.alias("id"), (F.col("o_orderstatus") == "F").alias("resolved"), (F.col("o_custkey") % 6 == 0).alias("closed"), F.round("o_totalprice", 2).cast("string").alias("volume"), prices.alias("outcomePrices")))
    return readers.market_records(read(spark, sf_dir, "orders").select(body.alias("body")))


@query("""
SELECT page_id, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::INT AS links FROM pages
""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-8, S-19: fields and repeated blocks read from raw text."""
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("links"))


@query("""
SELECT step, n FROM (SELECT 1 AS step, count(*) AS n FROM orders UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 3, count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate <= TIMESTAMP '1998-01-01' UNION ALL SELECT 4, count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate <= TIMESTAMP '1998-01-01' AND o_totalprice > 100000)
""")
def filter_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-20: rows left after each filter, all counted in one scan."""
    a = F.col("o_orderpriority") == "1-URGENT"
    b = a & (micros("o_orderdate") <= 883_612_800_000_000)
    c = b & (F.col("o_totalprice") > 100_000)
    counts = read(spark, sf_dir, "orders").agg(F.count("*").alias("c1"), F.count_if(a).alias("c2"), F.count_if(b).alias("c3"), F.count_if(c).alias("c4"))
    return counts.select(F.expr("stack(4, 1, c1, 2, c2, 3, c3, 4, c4) AS (step, n)"))


@query("""
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY abs(d) DESC NULLS LAST, o_orderkey)::INT AS place FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice - 250000 END AS d FROM orders) QUALIFY place <= 50
""")
def largest_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-7, K-8, K-9: a top-50 report, nulls last."""
    d = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") - 250_000)
    top = read(spark, sf_dir, "orders").withColumn("d", d).orderBy(F.abs("d").desc_nulls_last(), "o_orderkey").limit(50)
    place = F.row_number().over(Window.orderBy(F.abs("d").desc_nulls_last(), "o_orderkey"))
    return top.select("o_orderkey", "o_totalprice", place.alias("place"))


@query("""
SELECT outcome, failures FROM (SELECT CASE o_orderkey % 9 WHEN 0 THEN 'failed' WHEN 1 THEN 'unknown' ELSE CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END END AS outcome, count(*) AS failures FROM orders GROUP BY 1)
""")
def lookup_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-16, J-16: every requested id ends in exactly one class."""
    wanted = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    failed, answered = wanted.filter("o_orderkey % 9 = 0").select("o_orderkey", F.lit(True).alias("failed")), wanted.filter("o_orderkey % 9 > 1")
    rows = wanted.select("o_orderkey").join(failed, "o_orderkey", "left").join(answered, "o_orderkey", "left")
    outcome = F.when(F.col("failed"), "failed").when(F.col("o_orderstatus").isNull(), "unknown").when(F.col("o_orderstatus") == "F", "closed").otherwise("open")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("failures"))
