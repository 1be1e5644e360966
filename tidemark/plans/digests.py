"""Rule digests: findings, contradictions, readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizing import cost
from ..functions.text import TYPED, TYPOGRAPHIC, first_hit
from ..operators import digests as op
from ..sources.tables import read
from ._base import Family

FAMILY = Family()
query = FAMILY.query

_N = r"lower(regexp_replace(trim({}), '\s+', ' ', 'g'))"
_BASE = f"""WITH ev AS (SELECT doc_id AS event_id, sha256(text) AS sha, n_chars * 10.0::DOUBLE AS liquidity, text FROM documents),
fi AS (SELECT doc_id AS event_id, sha256(text) AS sha, CASE doc_id % 3 WHEN 0 THEN 'trap' WHEN 1 THEN 'contradiction' ELSE 'ambiguity' END AS kind, substr(text, 1, 80) AS passage,
  CASE WHEN doc_id % 3 = 1 THEN substr(text, 41, 80) END AS conflict, (doc_id % 4 + 1)::INT AS reading, CASE WHEN doc_id % 5 = 0 THEN 'grave' ELSE 'detail' END AS severity, CASE WHEN doc_id % 2 = 0 THEN 'scenario' END AS scenario
  FROM documents),
kf AS (SELECT *, CASE kind WHEN 'trap' THEN 't' WHEN 'contradiction' THEN 'c' ELSE 'a' END || '-' || CASE WHEN kind = 'contradiction' THEN md5(least({_N.format('passage')}, {_N.format('conflict')}) || '|' || greatest({_N.format('passage')}, {_N.format('conflict')})) ELSE md5({_N.format('passage')}) END AS finding FROM fi)"""


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.sha2("text", 256).alias("sha"), (F.col("n_chars") * F.lit(10.0)).alias("liquidity"), "text")


def findings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        d.alias("event_id"), F.sha2("text", 256).alias("sha"), F.when(d % 3 == 0, "trap").when(d % 3 == 1, "contradiction").otherwise("ambiguity").alias("kind"),
        F.substring("text", 1, 80).alias("passage"), F.when(d % 3 == 1, F.substring("text", 41, 80)).alias("conflict"), (d % 4 + 1).cast("int").alias("reading"),
        F.when(d % 5 == 0, "grave").otherwise("detail").alias("severity"), F.when(d % 2 == 0, "scenario").alias("scenario"),
    )


@query(_BASE + """, de AS (SELECT sha, finding, count(*) AS times, arg_max(passage, (event_id, reading)) AS passage FROM kf WHERE kind = 'contradiction' GROUP BY sha, finding),
sp AS (SELECT ev.event_id, ev.liquidity, de.*, EXISTS (FROM kf WHERE kf.event_id = ev.event_id AND kf.finding = de.finding) AS own FROM ev JOIN de USING (sha))
SELECT substr(finding, 3) AS defect, count(DISTINCT event_id) AS markets, count(*) FILTER (own) AS accused, max(times) AS times, round(sum(liquidity), 2) AS liquidity, round(sum(liquidity) FILTER (own), 2) AS accused_liquidity, md5(arg_min(passage, sha)) AS passage
FROM sp GROUP BY 1""")
def contradiction_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-15, A-17, J-22, F-7, A-4, A-5."""
    rows = op.contradictions(findings_of(spark, sf_dir), events_of(spark, sf_dir))
    return rows.withColumn("liquidity", F.round("liquidity", 2)).withColumn("accused_liquidity", F.round("accused_liquidity", 2)).withColumn("passage", F.md5("passage"))


_BY_EVENT = """, rd AS (SELECT sha, count(DISTINCT (event_id, reading)) AS readings FROM fi GROUP BY sha), pt AS (SELECT sha, finding, kind, count(DISTINCT (event_id, reading)) AS found, max(severity) AS severity FROM kf GROUP BY sha, finding, kind),
be AS (SELECT ev.event_id, finding, kind, severity, found, readings, CASE WHEN EXISTS (FROM kf WHERE kf.event_id = ev.event_id AND kf.finding = pt.finding) THEN 'accused' ELSE 'inherited' END AS origin FROM ev JOIN pt USING (sha) JOIN rd USING (sha))"""


@query(_BASE + _BY_EVENT + "\nSELECT * FROM be")
def findings_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-16, A-7, F-8, O-1."""
    return op.findings_by_event(findings_of(spark, sf_dir), events_of(spark, sf_dir))


@query(_BASE + _BY_EVENT + """
SELECT ev.event_id, ev.liquidity, findings, contradictions, worst, confirmation FROM ev LEFT JOIN (
  SELECT event_id, count(*) AS findings, count(*) FILTER (kind = 'contradiction') AS contradictions, max(severity) AS worst, round(max(found / readings), 6) AS confirmation FROM be GROUP BY event_id) USING (event_id)""")
def market_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-56, J-31, K-1: without a digest the counts are null, not zero."""
    ev = events_of(spark, sf_dir)
    rows = op.market_summary(op.findings_by_event(findings_of(spark, sf_dir), ev), ev)
    return rows.withColumn("confirmation", F.round("confirmation", 6))


_DIGESTS = f"""WITH dg AS (SELECT sha256(text) AS sha, doc_id AS reading, source, list_transform(string_split(text, chr(10))[1:CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 3 END], lambda c: {_N.format('c')}) AS clauses FROM documents)"""


@query(_DIGESTS + """
SELECT * FROM (SELECT sha, count(*) AS readings, count(DISTINCT len(clauses)) AS sizes, count(DISTINCT array_to_string(list_sort(clauses), '|')) AS signatures, count(DISTINCT source) AS sources, count(DISTINCT array_to_string(list_sort(clauses), '|')) > 1 AS diverges FROM dg GROUP BY sha) WHERE readings >= 2""")
def reading_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-47, E-53, A-6."""
    d = F.col("doc_id")
    clauses = F.slice(F.split("text", "\n"), F.lit(1), F.when(d % 6 == 0, 2).otherwise(3))
    rows = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha"), d.alias("reading"), "source", clauses.alias("clauses"))
    return op.consistency(rows, 2)


_SEARCH = "translate({}, '" + TYPOGRAPHIC + "', '" + TYPED.replace("'", "''") + "')"


@query(f"""
SELECT presence, count(*) AS n FROM (SELECT CASE WHEN contains(text, p) THEN 'literal' WHEN contains({_N.format(_SEARCH.format('text'))}, {_N.format(_SEARCH.format('p'))}) THEN 'spacing' ELSE 'absent' END AS presence
  FROM (SELECT text, CASE WHEN n_chars > 900 THEN substr(text, 11, 60) WHEN n_chars > 300 THEN replace(translate(substr(text, 11, 60), 'abcdefghijklmnopqrstuvwxyz-' || chr(39), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ–’'), ' ', '  ') ELSE 'no such passage anywhere' END AS p FROM documents)) GROUP BY presence
""")
def passage_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-47, P-22."""
    part, n = F.substring("text", 11, 60), F.col("n_chars")
    passage = F.when(n > 900, part).when(n > 300, F.replace(F.translate(part, "abcdefghijklmnopqrstuvwxyz-'", "ABCDEFGHIJKLMNOPQRSTUVWXYZ–’"), F.lit(" "), F.lit("  "))).otherwise("no such passage anywhere")
    rows = read(spark, sf_dir, "documents").select("text", passage.alias("p"))
    return rows.groupBy(op.presence(F.col("p"), F.col("text")).alias("presence")).agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT sha256(text) AS sha, doc_id AS event_id FROM documents), n AS (SELECT sha, count(*) FILTER (event_id % 2 = 0) AS have, count(*) AS events FROM t GROUP BY sha),
m AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY event_id) - 1 AS i FROM t), p AS (SELECT sha, events, unnest(range(have + 1, 4)) AS reading FROM n WHERE have < 3)
SELECT sha, reading, event_id FROM (SELECT *, (reading - 1) % events AS i FROM p) JOIN m USING (sha, i)
""")
def levelling_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-48."""
    texts = events_of(spark, sf_dir).select("sha", "event_id")
    return op.levelling_plan(texts, texts.filter("event_id % 2 = 0"), 3)


@query(_BASE + """
SELECT verdict, count(*) AS texts, sum("first")::BIGINT AS "first", sum("all")::BIGINT AS "all" FROM (SELECT *, CASE WHEN ("all" - "first") / nullif("all", 0) >= 0.3 THEN 'read again' WHEN ("all" - "first") / nullif("all", 0) < 0.1 THEN 'enough' ELSE 'unclear' END AS verdict
  FROM (SELECT sha, count(DISTINCT finding) FILTER (reading = 1) AS "first", count(DISTINCT finding) AS "all" FROM kf GROUP BY sha)) GROUP BY verdict""")
def recall_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-49, O-4."""
    rows = op.recall_growth(op.keyed(findings_of(spark, sf_dir)))
    return rows.groupBy("verdict").agg(F.count("*").alias("texts"), F.sum("first").alias("first"), F.sum("all").alias("all"))


@query(_BASE + """, p AS (SELECT list_filter([CASE WHEN kind NOT IN ('trap', 'contradiction') THEN 'unknown kind' END, CASE WHEN NOT regexp_full_match(CASE WHEN event_id % 9 = 0 THEN 'xyz' ELSE sha END, '[0-9a-f]{64}') THEN 'bad hash' END,
  CASE WHEN length(trim(passage)) < 10 THEN 'short passage' END, CASE WHEN (kind = 'contradiction') <> (conflict IS NOT NULL) THEN 'conflict mismatch' END], lambda x: x IS NOT NULL) AS problems,
  CASE WHEN severity = 'grave' AND scenario IS NULL THEN 'detail' ELSE severity END AS severity FROM fi)
SELECT array_to_string(problems, ', ') AS problems, severity, count(*) AS n FROM p GROUP BY ALL""")
def finding_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-22, P-26, E-57."""
    rows = findings_of(spark, sf_dir).withColumn("sha", F.when(F.col("event_id") % 9 == 0, "xyz").otherwise(F.col("sha")))
    out = op.finding_problems(rows, ["trap", "contradiction"])
    return out.groupBy(F.array_join("problems", ", ").alias("problems"), "severity").agg(F.count("*").alias("n"))


@query("""
SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS tokens, round(sum(n_chars * 0.3::DOUBLE + doc_id % 100 * 1.2::DOUBLE), 1) AS micro_cost, round(median(n_chars), 1) AS median_size FROM documents GROUP BY source
""")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-52, F-33."""
    spent = cost(F.col("n_chars"), F.col("doc_id") % 100, 0.3, 1.2)
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("tokens"), F.round(F.sum(spent) * 1_000_000, 1).alias("micro_cost"), F.round(F.median("n_chars"), 1).alias("median_size"))


@query(_BASE + _BY_EVENT + """
SELECT CASE WHEN readings >= 3 THEN found || '/' || readings END AS seal, count(*) AS n FROM be GROUP BY 1""")
def confirmation_seals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-53."""
    rows = op.findings_by_event(findings_of(spark, sf_dir), events_of(spark, sf_dir))
    return rows.groupBy(op.confirmation_seal(F.col("found"), F.col("readings")).alias("seal")).agg(F.count("*").alias("n"))


_FIELDS = "(SELECT doc_id, substr(text, 1, 200) AS head, text AS body FROM documents)"
_EXCERPT = "substr({f}, greatest(length(regexp_extract({f}, '(?s)^(.*?)(?:{p})', 1)) - 40, 0) + 1, length(regexp_extract({f}, '(?s)^(.*?)(?:{p})', 1)) + 60 - greatest(length(regexp_extract({f}, '(?s)^(.*?)(?:{p})', 1)) - 40, 0))"
_OPINIONS = [(r"(?i)\bidiot", "idiot"), (r"(?i)stupid", "stupid"), (r"(?i)\bworth\b", "worth")]
_HITS = " ".join(f"WHEN regexp_matches({f}, '{p}') THEN {{{{'field': '{f}', 'term': '{t}', 'excerpt': {_EXCERPT.format(f=f, p=p)}}}}}".replace("{{", "{").replace("}}", "}") for f in ("head", "body") for p, t in _OPINIONS)


@query(f"SELECT doc_id, h.field AS field, h.term AS term, md5(h.excerpt) AS excerpt FROM (SELECT doc_id, CASE {_HITS} END AS h FROM {_FIELDS}) WHERE h IS NOT NULL")
def opinion_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-23: the first listed word in the order of fields and patterns, with its neighbourhood."""
    hit = first_hit([("head", F.substring("text", 1, 200)), ("body", F.col("text"))], _OPINIONS)
    rows = read(spark, sf_dir, "documents").select("doc_id", hit.alias("h")).filter("h IS NOT NULL")
    return rows.select("doc_id", "h.field", "h.term", F.md5("h.excerpt").alias("excerpt"))
