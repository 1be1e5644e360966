"""Quotes, as-of joins and the radar view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quotes as q
from ..operators import asof
from ..operators import quotes as op
from ..sources.tables import quotes, read, with_ctes
from ._base import Family

FAMILY = Family()
query = FAMILY.query

#: Distance and tolerance in seconds of each change window.
WINDOWS = {"1h": (3600, 900), "24h": (86400, 3600), "7d": (604800, 21600)}
#: The instant at which ages are taken: 2024-02-01, after the last quote.
AS_OF = 1_706_745_600_000_000


def _latest_sql(columns: str) -> str:
    return f"latest AS (SELECT event_id, outcome, {columns} FROM quotes QUALIFY row_number() OVER (PARTITION BY event_id, outcome ORDER BY tick DESC, seq DESC) = 1)"


@query(
    with_ctes("quotes", body="""
SELECT seq, event_id, volume_24h, liquidity, tick, outcome, 'Yes' AS side, bid, ask, mid FROM quotes
UNION ALL SELECT seq, event_id, volume_24h, liquidity, tick, outcome, 'No', round(1 - ask, 4), round(1 - bid, 4), round(1 - mid, 4) FROM quotes""")
)
def quote_paired_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-14."""
    return op.paired_sides(quotes(spark, sf_dir))


@query("""
WITH levels AS (
  SELECT user_id AS event_id, list({'price': CASE WHEN event_id % 13 = 0 THEN 'bad' ELSE round(value / 500, 4)::VARCHAR END, 'size': event_id::VARCHAR} ORDER BY event_id) AS l
  FROM events GROUP BY user_id
)
SELECT event_id, TRY_CAST(l[-1].price AS DOUBLE) AS best_price, round(TRY_CAST(l[-1].price AS DOUBLE) * TRY_CAST(l[-1].size AS DOUBLE), 6) AS depth, len(l)::INT AS n_levels FROM levels
""")
def book_best_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-15: the last level of a book is its best."""
    price = F.when(F.col("event_id") % 13 == 0, "bad").otherwise(F.round(F.col("value") / 500, 4).cast("string"))
    rows = read(spark, sf_dir, "events").select("user_id", F.struct("event_id", price.alias("price"), F.col("event_id").cast("string").alias("size")).alias("level"))
    books = rows.groupBy(F.col("user_id").alias("event_id")).agg(F.sort_array(F.collect_list("level")).alias("levels"))
    best = q.best_level(F.transform("levels", lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size"))))
    return books.select("event_id", best["price"].alias("best_price"), best["depth"].alias("depth"), F.size("levels").alias("n_levels"))


@query(
    with_ctes("quotes", body="""
SELECT event_id, outcome, tick, seq, bid, ask, CASE WHEN bid IS NOT NULL AND ask IS NOT NULL THEN round((bid + ask) / 2, 4) END AS mid,
  CASE WHEN bid IS NOT NULL AND ask IS NOT NULL THEN round(ask - bid, 4) END AS spread
FROM quotes WHERE bid IS NOT NULL OR ask IS NOT NULL""")
)
def quote_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-16."""
    return op.snapshots(quotes(spark, sf_dir)).select("event_id", "outcome", "tick", "seq", "bid", "ask", "mid", "spread")


@query(
    with_ctes("quotes", body="""
SELECT sides, count(*) AS n, sum(CASE WHEN price IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS priced, round(sum(price), 4) AS total
FROM (SELECT (coalesce(bid > 0, false))::INT + (coalesce(ask > 0 AND ask < 1, false))::INT AS sides,
  coalesce(CASE WHEN mid > 0 AND mid < 1 THEN mid END, CASE WHEN ask > 0 AND ask < 1 THEN ask END) AS price FROM quotes) GROUP BY sides""")
)
def book_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-4, P-5."""
    rows = quotes(spark, sf_dir).select(q.sides(F.col("bid"), F.col("ask")).alias("sides"), q.first_price(F.col("mid"), F.col("ask")).alias("price"))
    return rows.groupBy("sides").agg(F.count("*").alias("n"), F.count("price").alias("priced"), F.round(F.sum("price"), 4).alias("total"))


@query(with_ctes("quotes", body=f", {_latest_sql('tick, bid, ask, mid, volume_24h, liquidity')} SELECT * FROM latest"))
def latest_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-1, W-2."""
    return op.latest_quotes(quotes(spark, sf_dir))


def _radar_sql() -> str:
    parts, joins = [], []
    for name, (distance, tolerance) in WINDOWS.items():
        joins.append(f""", near_{name} AS (
  SELECT q.event_id, q.outcome, q.tick, q.bid, q.ask, q.mid FROM quotes q JOIN latest l USING (event_id, outcome)
  WHERE abs(q.tick - (l.tick - {distance}000000)) <= {tolerance}000000
  QUALIFY row_number() OVER (PARTITION BY q.event_id, q.outcome ORDER BY abs(q.tick - (l.tick - {distance}000000)), q.tick, q.seq) = 1
)""")
        base = f"CASE WHEN l.mid IS NOT NULL AND w{name}.mid IS NOT NULL THEN 'mid' WHEN l.ask IS NOT NULL AND w{name}.ask IS NOT NULL THEN 'ask' WHEN l.bid IS NOT NULL AND w{name}.bid IS NOT NULL THEN 'bid' END"
        pick = lambda x, b=base: f"CASE {b} WHEN 'mid' THEN {x}.mid WHEN 'ask' THEN {x}.ask WHEN 'bid' THEN {x}.bid END"
        parts.append(f"w{name}.tick AS at_{name}, {base} AS base_{name}, round(({pick('l')}) - ({pick('w' + name)}), 6) AS change_{name}, {pick('w' + name)} AS reference_{name}")
    tables = " ".join(f"LEFT JOIN near_{n} w{n} USING (event_id, outcome)" for n in WINDOWS)
    head = with_ctes("quotes", body="") + ", " + _latest_sql("tick, bid, ask, mid, volume_24h, liquidity") + "".join(joins)
    return head + f"\nSELECT l.*, {', '.join(parts)} FROM latest l {tables}"


@query(_radar_sql())
def radar_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-1, J-2, F-1, J-11, U-1: the flagship query, the last quote of each series and its changes."""
    return op.changes(quotes(spark, sf_dir), WINDOWS)


@query(
    with_ctes("quotes", body=f""", {_latest_sql('tick, bid, ask, mid, volume_24h, liquidity')}
SELECT l.event_id, l.outcome, round(({AS_OF} - l.tick) / 60000000.0, 1) AS age_minutes, round((epoch_us(TIMESTAMP '2024-03-01') - l.tick) / 86400000000.0, 2) AS days_left,
  c.c_mktsegment AS theme, l.mid
FROM latest l JOIN customer c ON c.c_custkey::VARCHAR = l.event_id WHERE c.c_acctbal > 0""")
)
def radar_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-1, P-2, F-3: tracked series with age and days left."""
    tracked = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("event_id"), F.col("c_mktsegment").alias("theme"))
    rows = op.latest_quotes(quotes(spark, sf_dir)).join(tracked, "event_id")
    minutes = (F.lit(AS_OF) - F.col("tick")) / 60_000_000
    days = (F.lit(1_709_251_200_000_000) - F.col("tick")) / 86_400_000_000
    return rows.select("event_id", "outcome", F.round(minutes, 1).alias("age_minutes"), F.round(days, 2).alias("days_left"), "theme", "mid")


def _nearest_sql(tolerance: int, condition: str, order: str, columns: str = "q.tick AS found_at, q.mid") -> str:
    return with_ctes("quotes", body=f""", wanted AS (SELECT event_id, seq, tick AS target FROM quotes WHERE outcome = 'purchase'),
price AS (SELECT event_id, tick, mid, seq FROM quotes WHERE outcome <> 'purchase')
SELECT w.event_id, w.seq, w.target, {columns} FROM wanted w LEFT JOIN (
  SELECT w.seq, q.tick, q.mid FROM wanted w JOIN price q USING (event_id) WHERE {condition}
  QUALIFY row_number() OVER (PARTITION BY w.seq ORDER BY {order}) = 1) q USING (seq)""")


def _wanted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = quotes(spark, sf_dir)
    wanted = rows.filter("outcome = 'purchase'").select("event_id", "seq", F.col("tick").alias("target"))
    return wanted, rows.filter("outcome <> 'purchase'").select("event_id", "tick", F.col("tick").alias("found_at"), "mid", "seq")


def _nearest(spark: SparkSession, sf_dir: str, hours: float, **how: str) -> DataFrame:
    wanted, price = _wanted(spark, sf_dir)
    found = asof.nearest(wanted, price, ["event_id"], ["event_id", "seq"], "target", int(hours * 3600 * asof.SECOND), ["found_at", "mid"], **how)
    return found.select("event_id", "seq", "target", "found_at", "mid")


@query(_nearest_sql(0, "abs(q.tick - w.target) <= 7200000000", "abs(q.tick - w.target), q.tick DESC, q.seq"))
def nearest_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-3: two-sided, the later row at equal distance."""
    return _nearest(spark, sf_dir, 2, tie="later")


@query(_nearest_sql(0, "abs(q.tick - w.target) <= 7200000000", "abs(q.tick - w.target), q.seq"))
def nearest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-7: two-sided, the first row of the input at equal distance."""
    return _nearest(spark, sf_dir, 2, tie="first", seq="seq")


@query(_nearest_sql(0, "w.target - q.tick BETWEEN 0 AND 21600000000", "w.target - q.tick, q.seq"))
def backward_with_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-4."""
    return _nearest(spark, sf_dir, 6, direction="backward", tie="first", seq="seq")


@query(_nearest_sql(0, "q.tick <= w.target", "q.tick DESC, q.seq"))
def backward_without_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-5."""
    wanted, price = _wanted(spark, sf_dir)
    return asof.latest_before(wanted, price, ["event_id"], "target", ["found_at", "mid"]).select("event_id", "seq", "target", "found_at", "mid")


@query(
    with_ctes("quotes", body=""", wanted AS (SELECT event_id, seq, tick AS target FROM quotes WHERE outcome = 'purchase'),
windows AS (SELECT event_id, tick - 86400000000 AS start_at, tick AS end_at, seq FROM quotes WHERE outcome = 'signup')
SELECT w.event_id, w.seq, w.target, coalesce(i.start_at, w.target - 3600000000) AS start_at, coalesce(i.end_at, w.target) AS end_at, i.end_at IS NOT NULL AS matched
FROM wanted w LEFT JOIN (SELECT w.seq, x.start_at, x.end_at FROM wanted w JOIN windows x USING (event_id) WHERE abs(x.end_at - w.target) <= 7200000000
  QUALIFY row_number() OVER (PARTITION BY w.seq ORDER BY abs(x.end_at - w.target), x.end_at) = 1) i USING (seq)""")
)
def nearest_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-8."""
    rows = quotes(spark, sf_dir)
    wanted = rows.filter("outcome = 'purchase'").select("event_id", "seq", F.col("tick").alias("target"))
    windows = rows.filter("outcome = 'signup'").select("event_id", (F.col("tick") - 86_400 * asof.SECOND).alias("start_at"), F.col("tick").alias("end_at"))
    return asof.interval_of(wanted, windows, ["event_id"], ["event_id", "seq"], "target", 7200 * asof.SECOND, 3600 * asof.SECOND)


@query(
    with_ctes("quotes", body=""", windows AS (SELECT event_id, tick - 172800000000 AS low, tick AS high, seq FROM quotes WHERE outcome = 'signup')
SELECT w.event_id, w.seq, (SELECT count(*) FROM quotes q WHERE q.event_id = w.event_id AND q.tick BETWEEN w.low AND w.high) AS n FROM windows w""")
)
def quotes_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-9: both ends inclusive."""
    rows = quotes(spark, sf_dir)
    windows = rows.filter("outcome = 'signup'").select("event_id", "seq", (F.col("tick") - 172_800 * asof.SECOND).alias("low"), F.col("tick").alias("high"))
    return asof.count_between(windows, rows.select("event_id", "tick"), ["event_id"], ["event_id", "seq"], "low", "high")


@query(
    with_ctes("quotes", body="""
SELECT kind, band, count(*) AS n, round(avg(gap), 3) AS mean_gap FROM (
  SELECT outcome AS kind, (tick - lag(tick) OVER (PARTITION BY event_id ORDER BY tick, seq)) / 1000000.0 AS gap,
    CASE WHEN (liquidity / 1000 * 60 - 1800) <= 0 AND (liquidity / 1000 * 60 - 1800) > -600 THEN 'live' WHEN (liquidity / 1000 * 60 - 1800) > 0 AND (liquidity / 1000 * 60 - 1800) <= 1200 THEN 'soon' ELSE 'far' END AS band
  FROM quotes) WHERE gap IS NOT NULL GROUP BY kind, band""")
)
def gap_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-1, A-13, P-13: mean seconds between quotes by kind and watch band."""
    start = F.lit(0) + ((F.col("liquidity") / 1000 * 60 - 1800) * 60 * asof.SECOND)
    rows = op.gaps(quotes(spark, sf_dir)).withColumn("band", op.watch_band(start, 0, 1200, 600))
    return rows.filter("gap IS NOT NULL").groupBy(F.col("outcome").alias("kind"), "band").agg(F.count("*").alias("n"), F.round(F.avg("gap"), 3).alias("mean_gap"))


_MOVES = """, s AS (SELECT event_id, outcome, seq, tick, mid FROM quotes WHERE mid IS NOT NULL),
b AS (SELECT s.seq, o.mid AS before FROM s JOIN s o USING (event_id, outcome) WHERE abs(o.tick - (s.tick - 43200000000)) <= 10800000000
  QUALIFY row_number() OVER (PARTITION BY s.seq ORDER BY abs(o.tick - (s.tick - 43200000000)), o.tick DESC) = 1),
a AS (SELECT s.seq, o.mid AS after FROM s JOIN s o USING (event_id, outcome) WHERE abs(o.tick - (s.tick + 43200000000)) <= 10800000000
  QUALIFY row_number() OVER (PARTITION BY s.seq ORDER BY abs(o.tick - (s.tick + 43200000000)), o.tick DESC) = 1),
m AS (SELECT s.*, round(s.mid - before, 6) AS move, round(after - s.mid, 6) AS forward FROM s LEFT JOIN b USING (seq) LEFT JOIN a USING (seq))"""


@query(
    with_ctes("quotes", body=_MOVES + """
SELECT CASE WHEN move <= -0.2 THEN 'big fall' WHEN move < 0 THEN 'fall' WHEN move < 0.2 THEN 'rise' ELSE 'big rise' END AS bucket, count(*) AS n, count(DISTINCT event_id) AS matches,
  round(sum(move), 4) AS sum_move, round(sum(forward), 4) AS sum_forward, count(forward) AS comparable, count(*) FILTER (sign(move) * sign(forward) < 0) AS opposite
FROM m WHERE move IS NOT NULL GROUP BY 1""")
)
def reversion_by_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-36, J-6, P-12: what follows a move, by its size."""
    moved = op.moves(quotes(spark, sf_dir), 43_200, 43_200, 10_800).filter("move IS NOT NULL")
    m = F.col("move")
    bucket = F.when(m <= -0.2, "big fall").when(m < 0, "fall").when(m < 0.2, "rise").otherwise("big rise")
    return moved.groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.countDistinct("event_id").alias("matches"), F.round(F.sum("move"), 4).alias("sum_move"), F.round(F.sum("forward"), 4).alias("sum_forward"),
        F.count("forward").alias("comparable"), F.count_if(F.signum("move") * F.signum("forward") < 0).alias("opposite"),
    )


_DELTAS = {"1h": (3600, 3600), "6h": (21600, 5400), "24h": (86400, 21600)}


def _deltas_sql() -> str:
    parts = []
    for name, (distance, tolerance) in _DELTAS.items():
        parts.append(f"""SELECT l.event_id, l.outcome, '{name}' AS span, round(l.mid - q.mid, 6) AS d_price, l.liquidity - q.liquidity AS d_liquidity,
  round((l.ask - l.bid) - (q.ask - q.bid), 6) AS d_spread, (l.tick - {distance}000000 - q.tick) / 1000000.0 AS lag_seconds, q.tick IS NULL AS missing
FROM latest l LEFT JOIN (SELECT q.* FROM quotes q JOIN latest l USING (event_id, outcome) WHERE (l.tick - {distance}000000) - q.tick BETWEEN 0 AND {tolerance}000000
  QUALIFY row_number() OVER (PARTITION BY q.event_id, q.outcome ORDER BY q.tick DESC, q.seq) = 1) q USING (event_id, outcome)""")
    return with_ctes("quotes", body=f", {_latest_sql('tick, bid, ask, mid, liquidity')}\n" + "\nUNION ALL ".join(parts))


@query(_deltas_sql())
def deltas_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-55: backward differences of price, liquidity and spread over several windows."""
    rows = quotes(spark, sf_dir)
    keys = ["event_id", "outcome"]
    last = op.latest_quotes(rows)
    out = None
    for name, (distance, tolerance) in _DELTAS.items():
        wanted = last.withColumn("target", F.col("tick") - distance * asof.SECOND)
        then = rows.select(*keys, "tick", F.col("tick").alias("then_at"), F.col("mid").alias("then_mid"), F.col("liquidity").alias("then_liquidity"), (F.col("ask") - F.col("bid")).alias("then_spread"), "seq")
        payload = ["then_at", "then_mid", "then_liquidity", "then_spread"]
        found = asof.nearest(wanted, then, keys, keys, "target", tolerance * asof.SECOND, payload, direction="backward", tie="first", seq="seq")
        part = wanted.join(found.drop("target"), keys).select(
            *keys, F.lit(name).alias("span"), F.round(F.col("mid") - F.col("then_mid"), 6).alias("d_price"), (F.col("liquidity") - F.col("then_liquidity")).alias("d_liquidity"),
            F.round(F.col("ask") - F.col("bid") - F.col("then_spread"), 6).alias("d_spread"), ((F.col("target") - F.col("then_at")) / asof.SECOND).alias("lag_seconds"),
            F.col("then_at").isNull().alias("missing"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    with_ctes("quotes", body="""
SELECT event_id, count(*) AS n, max(tick) AS last_at, count(*) FILTER (mid IS NULL) AS no_mid, count(*) >= 60 AS truncated
FROM quotes WHERE tick BETWEEN 1704672000000000 AND 1705276800000000 GROUP BY event_id""")
)
def window_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-1, S-2, S-3, S-4: a scan of a time window, with the flag a capped reader would raise."""
    rows = quotes(spark, sf_dir).filter(F.col("tick").between(1_704_672_000_000_000, 1_705_276_800_000_000))
    return rows.groupBy("event_id").agg(F.count("*").alias("n"), F.max("tick").alias("last_at"), F.count_if(F.col("mid").isNull()).alias("no_mid"), (F.count("*") >= 60).alias("truncated"))
