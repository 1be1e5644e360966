"""Scalar functions on text and time, registered over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sizing
from ..functions import text as t
from ..sources.tables import points, quotes, read, with_ctes
from ._base import Family

FAMILY = Family()
query = FAMILY.query

_NORMAL = r"lower(regexp_replace(trim(text), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_NORMAL}) AS normal_sha, md5({_NORMAL}) AS normal_md5 FROM documents")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-5, F-6."""
    form = t.normal_form(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(form, 256).alias("normal_sha"), F.md5(form).alias("normal_md5"))


@query("""
SELECT md5(least(a, b) || '|' || greatest(a, b)) AS pair, count(*) AS n, bool_or(a IS DISTINCT FROM b) AS differ FROM (
  SELECT n_name AS a, r_name AS b FROM nation JOIN region ON true UNION ALL SELECT r_name, n_name FROM nation JOIN region ON true) GROUP BY 1
""")
def pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-7, F-9. Two tables of fixed size; no table that grows is crossed."""
    both = read(spark, sf_dir, "nation").crossJoin(F.broadcast(read(spark, sf_dir, "region")))
    rows = both.select(F.col("n_name").alias("a"), F.col("r_name").alias("b")).unionByName(both.select(F.col("r_name").alias("a"), F.col("n_name").alias("b")))
    return rows.groupBy(t.pair_key(F.col("a"), F.col("b")).alias("pair")).agg(F.count("*").alias("n"), F.bool_or(~F.equal_null("a", "b")).alias("differ"))


@query("""
SELECT conv_id, substr(sha256(string_agg(turn || ':' || role, ',' ORDER BY turn || ':' || role)), 1, 16) AS fingerprint FROM conversations GROUP BY conv_id
""")
def context_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-5, R-9: fingerprint of a context's sorted parts."""
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.concat_ws(":", F.col("turn").cast("string"), "role")).alias("ids"))
    return rows.select("conv_id", t.fingerprint(F.col("ids")).alias("fingerprint"))


_TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"""
WITH p AS (SELECT p_partkey, p_name, {_TRIGRAMS.format(x='p_name')} AS a, {_TRIGRAMS.format(x="'red widget x'")} AS b FROM part)
SELECT p_partkey, p_name, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS score FROM p WHERE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.15
ORDER BY score DESC, p_partkey LIMIT 10
""")
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-20, K-3, U-2: the ten most similar titles; the limit is the feature."""
    score = F.round(t.similarity(F.col("p_name"), F.lit("red widget x")), 6)
    return read(spark, sf_dir, "part").select("p_partkey", "p_name", score.alias("score")).filter("score >= 0.15").orderBy(F.col("score").desc(), "p_partkey").limit(10)


_STOP = ", ".join(f"'{w}'" for w in t.STOPWORDS)
_TOKENS = f"list_distinct(list_filter(list_transform(string_split_regex(lower({{x}}), '[^a-z0-9$%.''-]+'), lambda k: trim(k, '.''-')), lambda k: k <> '' AND k NOT IN ({_STOP})))"


@query(f"SELECT doc_id, len({_TOKENS.format(x='text')})::INT AS n_tokens, sha256(array_to_string(list_sort({_TOKENS.format(x='text')}), ' ')) AS tokens_sha FROM documents")
def question_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-21."""
    rows = read(spark, sf_dir, "documents").select("doc_id", t.tokens(F.col("text")).alias("tokens"))
    return rows.select("doc_id", F.size("tokens").alias("n_tokens"), F.sha2(F.array_join(F.sort_array("tokens"), " "), 256).alias("tokens_sha"))


@query(r"""
SELECT entity, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '(\$[A-Z]{1,6})\b', 1) || regexp_extract_all(text, '\b([A-Z]{2,6})\b', 1))) AS entity FROM documents) GROUP BY entity
""")
def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-22: tickers and acronyms; numbers and capitalized runs are tested on fixtures."""
    found = F.filter(t.entities(F.col("text")), lambda e: e.rlike(r"^\$?[A-Z]+$"))
    return read(spark, sf_dir, "documents").select(F.explode(found).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


_PLAIN = f"regexp_replace(translate(lower(text), '{t.MARKED}', '{t.PLAIN}'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query(f"SELECT doc_id, length({_PLAIN})::INT AS n, md5({_PLAIN}) AS key FROM documents")
def plain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-14: marks taken off by a table."""
    name = t.plain_name(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.length(name).alias("n"), F.md5(name).alias("key"))


@query("""
SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(lower(p_name || ' ' || p_brand), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: substr(w, 1, 1)), '') AS acronym,
  CASE WHEN levenshtein(p_name, 'red widget') > 4 THEN 5 ELSE levenshtein(p_name, 'red widget') END::INT AS distance, regexp_matches(p_name, 'r.*d.*g.*t') AS has_rdgt FROM part
""")
def name_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-15, F-16."""
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select(
        "p_partkey", t.acronym(F.concat_ws(" ", "p_name", "p_brand")).alias("acronym"), t.near_miss(name, F.lit("red widget"), 4).alias("distance"), t.is_subsequence(F.lit("rdgt"), name).alias("has_rdgt")
    )


_SLUG_SQL = """CASE o_orderkey % 7 WHEN 0 THEN 'cs2-' WHEN 1 THEN 'lol-' WHEN 2 THEN 'dota2-' WHEN 3 THEN 'cs2-extra-' ELSE 'nba-' END || 't' || o_custkey || '-u' || (o_orderkey % 97) || '-' ||
  CASE WHEN o_orderkey % 11 = 0 THEN '2024-13-40' ELSE strftime(o_orderdate, '%Y-%m-%d') END || CASE WHEN o_orderkey % 5 = 0 THEN '-game2-winner' ELSE '' END"""


def _slug() -> Column:
    k = F.col("o_orderkey")
    prefix = F.when(k % 7 == 0, "cs2-").when(k % 7 == 1, "lol-").when(k % 7 == 2, "dota2-").when(k % 7 == 3, "cs2-extra-").otherwise("nba-")
    day = F.when(k % 11 == 0, "2024-13-40").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return F.concat(prefix, F.lit("t"), F.col("o_custkey").cast("string"), F.lit("-u"), (k % 97).cast("string"), F.lit("-"), day, F.when(k % 5 == 0, "-game2-winner").otherwise(""))


@query(rf"""
WITH s AS (SELECT o_orderkey, {_SLUG_SQL} AS slug FROM orders), p AS (SELECT *, CASE WHEN starts_with(slug, 'cs2-extra-') THEN 'cs2-extra' WHEN starts_with(slug, 'dota2-') THEN 'dota2' WHEN starts_with(slug, 'cs2-') THEN 'cs2' WHEN starts_with(slug, 'lol-') THEN 'lol' END AS prefix FROM s),
r AS (SELECT *, regexp_extract(substr(slug, length(prefix) + 2), '^([a-z0-9]+)-([a-z0-9]+)-(\d{{4}}-\d{{2}}-\d{{2}})(?:-(.+))?$', ['a', 'b', 'd', 's']) AS g FROM p),
f AS (SELECT *, CASE WHEN prefix IS NULL THEN 'other' WHEN TRY_CAST(g.d AS DATE) IS NULL THEN 'malformed' END AS reason FROM r)
SELECT o_orderkey, prefix, CASE WHEN reason IS NULL THEN nullif(g.a, '') END AS a, CASE WHEN reason IS NULL THEN nullif(g.b, '') END AS b, CASE WHEN reason IS NULL THEN TRY_CAST(g.d AS DATE)::VARCHAR END AS day,
  CASE WHEN reason IS NULL THEN nullif(g.s, '') END AS suffix, reason FROM f
""")
def slug_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-17, P-7, P-9, P-30."""
    parsed = t.parse_slug(F.col("slug"), ["cs2", "lol", "dota2", "cs2-extra"])
    rows = read(spark, sf_dir, "orders").select("o_orderkey", _slug().alias("slug")).select("o_orderkey", parsed.alias("p"))
    return rows.select("o_orderkey", "p.prefix", "p.a", "p.b", F.col("p.date").cast("string").alias("day"), "p.suffix", "p.reason")


@query(f"""
SELECT role, kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(s, '-game[0-9]+-winner$') THEN 'map winner' WHEN regexp_matches(s, '-total') THEN 'total' ELSE 'moneyline' END AS role,
  CASE WHEN regexp_matches(lower(p), '(^|[^a-z])(urgent|high)($|[^a-z])') THEN 'hot' WHEN regexp_matches(lower(p), '(^|[^a-z])(medium)($|[^a-z])') THEN 'warm' ELSE 'cold' END AS kind
  FROM (SELECT {_SLUG_SQL} AS s, o_orderpriority AS p FROM orders)) GROUP BY role, kind
""")
def roles_and_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-18, F-19: ordered rules; Java's look-around gives the word boundary."""
    rows = read(spark, sf_dir, "orders").select(_slug().alias("s"), F.col("o_orderpriority").alias("p"))
    role = t.first_rule(F.col("s"), [("-game[0-9]+-winner$", "map winner"), ("-total", "total")], "moneyline")
    kind = t.first_rule(F.col("p"), [(t.whole_word(["urgent", "high"]), "hot"), (t.whole_word(["medium"]), "warm")], "cold")
    return rows.groupBy(role.alias("role"), kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""
WITH x AS (SELECT CASE l_linenumber WHEN 1 THEN l_quantity::INT || '%' WHEN 2 THEN ' ' || l_quantity::INT || ',5 %' WHEN 3 THEN 'abc' WHEN 4 THEN '' WHEN 5 THEN (l_quantity * 4)::INT::VARCHAR ELSE NULL END AS s FROM lineitem),
d AS (SELECT s, replace(trim(replace(trim(s), '%', '')), ',', '.') AS n FROM x), v AS (SELECT s, CASE WHEN regexp_full_match(n, '\\d+(\\.\\d+)?') THEN TRY_CAST(n AS DOUBLE) END AS v FROM d),
e AS (SELECT s, v, CASE WHEN s IS NULL OR trim(s) = '' THEN 'empty' WHEN v IS NULL THEN 'not a number' WHEN v > 100 THEN 'out of range' END AS error FROM v)
SELECT error, count(*) AS n, round(sum(CASE WHEN error IS NULL THEN round(v / 100, 5) END), 3) AS total FROM e GROUP BY error
""".replace("\\\\", "\\"))
def probability_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-12."""
    n, whole = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    s = (
        F.when(n == 1, F.concat(whole, F.lit("%"))).when(n == 2, F.concat(F.lit(" "), whole, F.lit(",5 %"))).when(n == 3, "abc").when(n == 4, "")
        .when(n == 5, (F.col("l_quantity") * 4).cast("int").cast("string"))
    )
    rows = read(spark, sf_dir, "lineitem").select(sizing.parse_probability(s).alias("p")).select("p.value", "p.error")
    return rows.groupBy("error").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("""
SELECT p_partkey, CASE WHEN s LIKE '%-%' THEN split_part(s, '-', 1)::INT WHEN s LIKE '%+' THEN rtrim(s, '+')::INT ELSE 0 END AS low, CASE WHEN s LIKE '%-%' THEN split_part(s, '-', 2)::INT WHEN s LIKE '<%' THEN ltrim(s, '<')::INT - 1 END AS high
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size || '-' || (p_size + 9) WHEN 1 THEN p_size || '+' ELSE '<' || p_size END AS s FROM part)
""")
def bin_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-27."""
    size = F.col("p_size").cast("string")
    s = F.when(F.col("p_partkey") % 3 == 0, F.concat(size, F.lit("-"), (F.col("p_size") + 9).cast("string"))).when(F.col("p_partkey") % 3 == 1, F.concat(size, F.lit("+"))).otherwise(F.concat(F.lit("<"), size))
    return read(spark, sf_dir, "part").select("p_partkey", t.bin_of(s).alias("b")).select("p_partkey", "b.low", "b.high")


@query("""
SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d') AS local_day, year(ts) || '-Q' || quarter(ts) AS quarter, count(*) AS n, max(CASE WHEN value < 60 THEN floor(value)::INT || 's' ELSE floor(value / 60)::INT || 'min' END) AS top_age FROM events GROUP BY ALL
""")
def calendar_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-4, F-31, F-32, F-35: days in UTC and local time, quarters, ages."""
    ts = F.col("ts").cast("timestamp")
    rows = read(spark, sf_dir, "events")
    return rows.groupBy(F.to_date(ts).cast("string").alias("day"), F.date_format(F.from_utc_timestamp(ts, "GMT-3"), "yyyy-MM-dd").alias("local_day"), t.quarter_label(ts).alias("quarter")).agg(
        F.count("*").alias("n"), F.max(t.age_label(F.col("value"))).alias("top_age")
    )


@query(r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents), h AS (SELECT *, substr(c, 1, 400) AS cut, regexp_extract(substr(c, 1, 400), '^(.*[.!?]) ', 1) AS whole, regexp_extract(substr(c, 1, 400), '^(.+) ', 1) AS words FROM c)
SELECT doc_id, md5(CASE WHEN length(c) <= 400 THEN c WHEN length(whole) > 201 THEN whole ELSE rtrim(CASE WHEN words <> '' THEN words ELSE cut END) || '…' END) AS head FROM h
""")
def first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-30."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(t.first_sentences(F.col("text"), 400)).alias("head"))


_CONTEXT = """WITH r AS (SELECT o_orderkey, epoch_us(o_orderdate) AS as_of, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE epoch_us(o_orderdate) + (o_custkey % 9 - 4) * 3600000000 END AS updated, o_orderpriority = '1-URGENT' AND o_totalprice < 60000 AS unreadable,
  epoch_us(o_orderdate) + (o_custkey % 4) * 3600000000 AS now, CASE WHEN o_totalprice > 100000 THEN epoch_us(o_orderdate) - (o_custkey % 3) * 3600000000 END AS last FROM orders),
k AS (SELECT *, CASE WHEN unreadable THEN 'refuse' WHEN updated IS NOT NULL THEN CASE WHEN updated > as_of + 3600000000 THEN 'refuse' ELSE 'source' END WHEN abs(as_of - now) > 3600000000 THEN 'refuse' ELSE 'observation' END AS kind FROM r),
a AS (SELECT *, CASE kind WHEN 'source' THEN updated WHEN 'observation' THEN as_of END AS instant FROM k)"""


@query(_CONTEXT + """
SELECT kind, CASE WHEN instant IS NOT NULL THEN CASE WHEN last IS NULL THEN false WHEN kind = 'source' THEN last = instant ELSE instant - last < 5400000000 END END AS skip, count(*) AS n FROM a GROUP BY 1, 2""")
def context_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-30: the instant that a context speaks of, and whether writing it again says anything."""
    hour, key, at = F.lit(3_600_000_000), F.col("o_custkey"), F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    urgent = F.col("o_orderpriority") == "1-URGENT"
    rows = read(spark, sf_dir, "orders").select(
        at.alias("as_of"), F.when(F.col("o_orderpriority") != "5-LOW", at + (key % 9 - 4) * hour).alias("updated"), (urgent & (F.col("o_totalprice") < 60_000)).alias("unreadable"),
        (at + key % 4 * hour).alias("now"), F.when(F.col("o_totalprice") > 100_000, at - key % 3 * hour).alias("last"),
    )
    rows = rows.withColumn("c", t.context_instant(F.col("updated"), F.col("unreadable"), F.col("as_of"), F.col("now"), 3_600_000_000))
    skip = F.when(F.col("c.at").isNotNull(), t.skip_rewrite(F.col("last"), F.col("c.at"), F.col("c.kind"), 5_400_000_000))
    return rows.groupBy("c.kind", skip.alias("skip")).agg(F.count("*").alias("n"))


@query(
    with_ctes("points", body="""
SELECT version, count(*) AS n, sum(y)::BIGINT AS hits, round(CASE WHEN count(*) = 0 THEN 0 ELSE greatest(0, (r + z * z / (2 * c) - z * sqrt(r * (1 - r) / c + z * z / (4 * c * c))) / (1 + z * z / c)) END, 6) AS low,
  round(least(1, (r + z * z / (2 * c) + z * sqrt(r * (1 - r) / c + z * z / (4 * c * c))) / (1 + z * z / c)), 6) AS high
FROM (SELECT version, y, avg(y) OVER (PARTITION BY version) AS r, count(*) OVER (PARTITION BY version) AS c, 1.959964 AS z FROM points) GROUP BY version, r, c, z""")
)
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-46."""
    rows = points(spark, sf_dir).groupBy("version").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    w = sizing.wilson(F.col("hits"), F.col("n"))
    return rows.select("version", "n", "hits", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


@query(
    with_ctes("quotes", body="""
SELECT outcome, round(quantile_cont(volume_24h, 0.9), 4) AS linear, list_sort(list(volume_24h))[floor(0.9 * count(*))::INT + 1] AS floor_rank, list_sort(list(volume_24h))[((count(*) - 1) // 2 + 1)::INT] AS lower_median, list_sort(list(volume_24h))[(count(*) // 2 + 1)::INT] AS upper_median
FROM quotes GROUP BY outcome""")
)
def quantile_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-51: ranks are found by counting per value, so no list of a whole group is built."""
    from pyspark.sql import Window

    rows = quotes(spark, sf_dir).select("outcome", "volume_24h")
    linear = rows.groupBy("outcome").agg(F.round(F.percentile("volume_24h", 0.9), 4).alias("linear"), F.count("*").alias("n"))
    per = rows.groupBy("outcome", "volume_24h").agg(F.count("*").alias("c"))
    per = per.withColumn("upto", F.sum("c").over(Window.partitionBy("outcome").orderBy("volume_24h"))).join(linear.select("outcome", "n"), "outcome")
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("volume_24h")))
    n = F.col("n")
    found = per.groupBy("outcome").agg(at(F.floor(0.9 * n)).alias("floor_rank"), at(F.floor((n - 1) / 2)).alias("lower_median"), at(F.floor(n / 2)).alias("upper_median"))
    return linear.drop("n").join(found, "outcome")
