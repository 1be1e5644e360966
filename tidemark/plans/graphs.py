"""Text graphs: blocking, similarity, clusters, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import graphs as op
from ..sources.tables import markets, read, with_ctes
from ._base import Family
from .texts import _TOKENS

FAMILY = Family()
query = FAMILY.query

_ITEMS = f"WITH items AS (SELECT p_partkey AS id, {_TOKENS.format(x='t')} AS tokens FROM (SELECT *, p_name || ' ' || p_brand || ' ' || p_type || ' ' || 's' || p_size || ' k' || (p_partkey % 300) AS t FROM part))"


def parts_as_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.concat(F.lit("s"), F.col("p_size").cast("string")), F.concat(F.lit("k"), (F.col("p_partkey") % 300).cast("string")))
    # a table of few files is split into tokens by all tasks
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read(spark, sf_dir, "part").repartition(parts).select(F.col("p_partkey").alias("id"), tokens(text).alias("tokens"))


_PAIRS = ", pairs AS (SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(a.tokens || b.tokens)), 6) AS score FROM items a JOIN items b ON a.id < b.id WHERE round(len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(a.tokens || b.tokens)), 6) >= 0.6)"


@query(_ITEMS + _PAIRS + " SELECT * FROM pairs")
def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-9, J-27, F-23: an exact similarity join by prefixes of rare tokens."""
    return op.similar_pairs(parts_as_items(spark, sf_dir), 0.6)


@query(_ITEMS + """, df AS (SELECT token, count(*) AS df FROM (SELECT id, unnest(tokens) AS token FROM items) GROUP BY token), ok AS (SELECT token FROM df WHERE df BETWEEN 2 AND (SELECT greatest(2, floor(count(*) * 0.02)) FROM items)),
k AS (SELECT id, token FROM (SELECT id, unnest(tokens) AS token FROM items) JOIN ok USING (token)), c AS (SELECT DISTINCT x.id AS a, y.id AS b FROM k x JOIN k y ON x.token = y.token AND x.id < y.id)
SELECT a, b, round(len(list_intersect(i.tokens, j.tokens)) / len(list_distinct(i.tokens || j.tokens)), 6) AS score FROM c JOIN items i ON i.id = a JOIN items j ON j.id = b WHERE round(len(list_intersect(i.tokens, j.tokens)) / len(list_distinct(i.tokens || j.tokens)), 6) >= 0.4""")
def indexed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-28, T-3: an inverted index without frequent tokens."""
    return op.similar_pairs(parts_as_items(spark, sf_dir), 0.4, 2, 0.02)


@query(_ITEMS + """, pairs AS (SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.id <> b.id WHERE round(len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(a.tokens || b.tokens)), 6) >= 0.6) SELECT a AS id, count(*) AS links FROM pairs GROUP BY a""")
def title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-9: links per item."""
    return op.link_counts(parts_as_items(spark, sf_dir), 0.6)


_REACH = """, pairs AS (SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.id <> b.id WHERE round(len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(a.tokens || b.tokens)), 6) >= 0.6),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM r JOIN pairs p ON r.b = p.a) SELECT a, least(a, min(b)) AS component FROM r GROUP BY a),
cl AS (SELECT id, coalesce(component, id) AS component, count(*) OVER (PARTITION BY coalesce(component, id)) AS members, tokens FROM items LEFT JOIN reach ON a = id)"""


@query(_ITEMS + _REACH + """, tc AS (SELECT component, token, count(*) AS n, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, token) AS r FROM (SELECT component, unnest(tokens) AS token FROM cl) GROUP BY component, token HAVING count(*) > 1),
tp AS (SELECT component, max(token) FILTER (r = 1) AS first, max(n) FILTER (r = 1) AS n, max(token) FILTER (r = 2) AS second FROM tc GROUP BY component)
SELECT id, component, members, CASE WHEN members = 1 THEN '—' WHEN first IS NULL THEN 'grupo de ' || members || '*' WHEN n < members THEN first || coalesce('+' || second, '') || '*' ELSE first END AS label FROM cl LEFT JOIN tp USING (component)""")
def subject_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-6, T-8."""
    return op.subjects(parts_as_items(spark, sf_dir), 0.6)


@query(_ITEMS + _REACH + """
SELECT id, component, members, ((row_number() OVER (PARTITION BY component ORDER BY id) - 1) // 2)::INT AS part FROM cl WHERE members > 1""")
def component_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-3: components of similar titles, in parts of at most two."""
    return op.similar_chunks(parts_as_items(spark, sf_dir), 0.6, 2)


@query("""
WITH b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS k0, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS k1, o_custkey % 40 || o_orderpriority AS k2 FROM orders),
t AS (SELECT id, k2 FROM b QUALIFY row_number() OVER (PARTITION BY k2 ORDER BY id) <= 12),
p AS (SELECT x.id AS a, y.id AS b, 0 AS layer FROM b x JOIN b y ON x.k0 = y.k0 AND x.id < y.id UNION ALL SELECT x.id, y.id, 1 FROM b x JOIN b y ON x.k1 = y.k1 AND x.id < y.id UNION ALL SELECT x.id, y.id, 2 FROM t x JOIN t y ON x.k2 = y.k2 AND x.id < y.id)
SELECT layer, count(*) AS pairs, sum(layers - 1)::BIGINT AS redundant FROM (SELECT a, b, min(layer) AS layer, count(DISTINCT layer) AS layers FROM p GROUP BY a, b) GROUP BY layer
""")
def layered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-1, T-4: pairs by the first layer that covers them."""
    k = F.col("o_orderkey")
    items = read(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, F.col("o_custkey")).alias("k0"), F.when(k % 3 != 0, F.col("o_custkey")).alias("k1"), F.concat((F.col("o_custkey") % 40).cast("string"), "o_orderpriority").alias("k2")
    )
    return op.layer_pairs(items, [("k0", 0), ("k1", 0), ("k2", 12)]).groupBy("layer").agg(F.count("*").alias("pairs"), F.sum(F.col("layers") - 1).alias("redundant"))


@query(_ITEMS + """, e AS (SELECT id, unnest(tokens) AS token FROM items), df AS (SELECT token, count(*) AS df FROM e GROUP BY token HAVING count(*) >= 2), best AS (SELECT id, arg_min(token, (df, token)) AS token FROM e JOIN df USING (token) GROUP BY id),
s AS (SELECT token FROM best GROUP BY token HAVING count(*) BETWEEN 2 AND 40)
SELECT token, ((row_number() OVER (PARTITION BY token ORDER BY id) - 1) // 12)::INT AS part, id FROM best JOIN s USING (token)""")
def rarest_shared_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-2."""
    return op.rarest_shared(parts_as_items(spark, sf_dir), 40, 12)


@query(_ITEMS + """, e AS (SELECT id, unnest(tokens) AS token FROM items), w AS (SELECT token, ln((SELECT count(*) FROM items) / count(*)) AS w FROM e GROUP BY token HAVING count(*) <= (SELECT count(*) FROM items) * 0.05),
q AS (SELECT id AS query, token, w FROM e JOIN w USING (token) WHERE id % 50 = 0), h AS (SELECT query, id, round(sum(w) / any_value(whole), 6) AS score FROM (SELECT *, sum(w) OVER (PARTITION BY query) AS whole FROM q) JOIN e USING (token) GROUP BY query, id)
SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank FROM h QUALIFY rank <= 5""")
def weighted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-30: a top-k search of stated queries."""
    items = parts_as_items(spark, sf_dir)
    return op.search(items, items.filter("id % 50 = 0"), 0.05, 5)


@query("""
WITH l AS (SELECT l_partkey AS key, l_orderkey * 10 + l_linenumber AS o, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS n, l_returnflag AS f FROM lineitem WHERE l_returnflag = 'R'),
r AS (SELECT l_partkey AS key, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS n, l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A')
SELECT (l.key IS NOT NULL) AS has_left, (r.key IS NOT NULL) AS has_right, count(*) AS n FROM l FULL JOIN r ON l.key = r.key AND l.n = r.n GROUP BY 1, 2
""")
def queue_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-34."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("id"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("o"), "l_returnflag")
    out = op.matched_in_order(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag = 'A'"), "key", "o")
    return out.groupBy(F.col("left_id").isNotNull().alias("has_left"), F.col("right_id").isNotNull().alias("has_right")).agg(F.count("*").alias("n"))


@query(
    with_ctes("markets", body=""", r AS (SELECT group_id, market_id, CASE WHEN market_id % 13 = 0 THEN 0 ELSE volume END AS volume FROM markets), k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY volume DESC, market_id) AS rn FROM r)
SELECT a.group_id AS "group", a.market_id AS lead, b.market_id AS other, round(CASE WHEN b.volume <= 0 THEN 'Infinity'::DOUBLE ELSE a.volume / b.volume END, 6) AS ratio FROM k a JOIN k b USING (group_id) WHERE a.rn = 1 AND b.rn > 1""")
)
def lead_lag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-29."""
    rows = markets(spark, sf_dir).select(F.col("group_id").alias("group"), F.col("market_id").alias("id"), F.when(F.col("market_id") % 13 == 0, 0.0).otherwise(F.col("volume")).alias("volume"))
    return op.lead_pairs(rows)


@query("SELECT p_partkey AS id, sha256('seed|' || p_partkey) AS place FROM part WHERE p_partkey % 3 <> 0")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-5, K-6, O-3: a seeded order by hash; what is done already is left out."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    pending = rows.join(rows.filter("id % 3 = 0"), "id", "left_anti")
    return pending.select("id", F.sha2(F.concat_ws("|", F.lit("seed"), F.col("id").cast("string")), 256).alias("place")).orderBy("place", "id")
