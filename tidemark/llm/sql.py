"""DuckDB SQL of the registered queries, where SQL can express them."""

from __future__ import annotations

SQL: dict[str, str] = {}

_ESC = "replace(replace(replace({}, '%', '%25'), '<', '%3C'), '[', '%5B')"
SQL["op3_chat_format"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), segments AS (
  SELECT *, role = 'assistant' AS reply, length({_ESC.format("text")}) + CASE WHEN role = 'assistant' THEN 7
    ELSE 14 + length(replace({_ESC.format("role")}, chr(10), '%0A')) END AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
), prefixes AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM segments)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  sum(CASE WHEN reply THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN reply THEN text ELSE '' END, '' ORDER BY place)) AS loss_sha256,
  sum(CASE WHEN reply OR place = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars,
  sum(reply::INT)::BIGINT AS n_examples
FROM prefixes GROUP BY conv_id
"""

SQL["op9_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT DISTINCT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS s, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), spots AS (
  SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT r, p, spots.n, item_id FROM spots JOIN win USING (s, n)
), words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY r
), items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hit) GROUP BY r
), tokens AS (SELECT r, unnest(w) AS t, unnest(generate_series(1, len(w))) AS p FROM d
), often AS (SELECT t, count(*) AS n FROM tokens GROUP BY t
), terms AS (SELECT item_id, s, list_distinct(string_split(s, ' ')) AS ts FROM win
), anchors AS (
  SELECT item_id, ts, arg_min(t, (coalesce(often.n, 0), t)) AS t
  FROM (SELECT item_id, s, ts, unnest(ts) AS t FROM terms) LEFT JOIN often USING (t) GROUP BY item_id, s, ts
), close AS (
  SELECT r, item_id, ts, w, p FROM anchors JOIN tokens USING (t) JOIN d USING (r) WHERE list_has_all(w[greatest(p - 14, 1):p + 14], ts)
), near AS (
  SELECT r, count(DISTINCT item_id) AS n_near_items
  FROM (SELECT r, item_id, ts, w, unnest(generate_series(greatest(p - 14, 1), p)) AS f FROM close) WHERE list_has_all(w[f:f + 14], ts) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN near USING (r)
"""

#: Mean of a source is rate; means over 32 are sums of parts, each inverted at a hash of its own.
_MIX = """
shares AS (
  SELECT source, count(*) AS n, CASE source WHEN 'src0' THEN 0.10 WHEN 'src1' THEN 0.08 WHEN 'src2' THEN 0.08 END AS w FROM {docs} GROUP BY source
), whole AS (
  SELECT sum(n)::DOUBLE AS rows, sum(n) FILTER (w IS NULL)::DOUBLE AS rest, coalesce(sum(w), 0)::DOUBLE + CASE WHEN count(*) > count(w) THEN 1 - 0.26 ELSE 0 END AS total FROM shares
), rates AS (
  SELECT source, coalesce(w::DOUBLE, n * (1 - 0.26) / rest) / total * rows / n AS rate FROM shares, whole
), parts AS (SELECT source, greatest(ceil(rate / 32), 1)::INT AS m, rate / greatest(ceil(rate / 32), 1) AS mean FROM rates
), pmf AS (
  SELECT source, m, k, CASE WHEN mean > 0 THEN exp(k * ln(mean) - mean - lgamma(k + 1)) ELSE (k = 0)::INT END AS p FROM parts, (SELECT unnest(range(128)) AS k)
), cdf AS (SELECT source, m, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf
), numbers AS (
  SELECT d.rowid AS r, count(*) AS copies
  FROM {docs} d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source, unnest(range(1, m + 1)) AS part(i)
  WHERE c <= ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':' || i), 1, 13))::BIGINT / 4503599627370496.0
  GROUP BY d.rowid
)
SELECT d.* EXCLUDE (rowid), copy::INT AS copy, md5('mix:' || coalesce(d.doc_id::VARCHAR, '') || ':order:' || copy) AS shuffle_key
FROM numbers JOIN {docs} d ON d.rowid = r, unnest(range(1, copies + 1)) AS x(copy)
"""
SQL["op6_mix_sources"] = "WITH docs AS (SELECT *, row_number() OVER () AS rowid FROM documents), " + _MIX.format(docs="docs")

SQL["op10_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS s FROM (SELECT *, unnest(generate_series(1, len(w) - 49)) AS p FROM d WHERE len(w) >= 50)),
hit AS (SELECT r, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS f FROM win) WHERE f < doc_id),
gone AS (SELECT r, list(DISTINCT q) AS g FROM (SELECT r, unnest(generate_series(p, p + 49)) AS q FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
