"""DuckDB SQL for the queries that SQL can express."""

from .chat_format import Budget
from .quality_rules import RULES, RiskControl

_c = RiskControl()
_rate = {r: f"coalesce({a}::double / nullif({b}, 0)::double, 0.0)" for r, (a, b) in RULES.items()}
_levels = " UNION ALL ".join(
    f"SELECT stratum, good, '{r}' AS rule, {float(c)}::double AS cutoff, {_rate[r]} > {float(c)} AS hit FROM marked" for r in RULES for c in _c.grid
)
_alpha = _c.alpha / len(RULES)

OP7 = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, chr(1) || 'null') AS stratum, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base
), grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), twice AS (
  SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered AS (
  SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY rid
), m AS (
  SELECT rid, doc_id, stratum, len(w)::bigint AS n_words, length(list_aggregate(w, 'string_agg', ''))::bigint AS chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint AS n_symbols,
    length(regexp_replace(text, '[^A-Z]+', '', 'g'))::bigint AS n_capitals,
    len(l)::bigint AS n_lines, (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, coalesce(c.n, 0)::bigint AS n_repeat_words
  FROM words LEFT JOIN covered c USING (rid)
), n AS (
  SELECT * EXCLUDE (chars), coalesce(chars, 0) AS word_chars, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
), truth AS (
  SELECT doc_id, max(quality) >= 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), marked AS (
  SELECT n.*, good FROM n JOIN truth USING (doc_id) WHERE NOT base_failed
), cells AS (
  SELECT stratum, rule, cutoff, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS junk,
    count(*) FILTER (good AND hit) AS k, count(*) FILTER (NOT good AND hit) AS caught
  FROM ({_levels}) GROUP BY ALL
), tested AS (
  SELECT *, CASE WHEN good <= 0 OR k >= good * {_alpha} THEN 1.0 ELSE (
      SELECT sum(exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({_alpha}) + (good - i) * ln(1 - {_alpha}))) FROM (SELECT unnest(range(k + 1)) AS i)
    ) END AS p FROM cells
), passed AS (
  SELECT *, coalesce(caught / nullif(junk, 0)::double, 0.0) - {_c.weight} * coalesce(k / nullif(good, 0)::double, 0.0) AS gain
  FROM tested QUALIFY max(p) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC ROWS UNBOUNDED PRECEDING)
    <= {_c.delta} / ((SELECT count(DISTINCT stratum) FROM base) * {len(RULES)})
), best AS (
  SELECT stratum, rule, max_by(cutoff, (round(gain, 9), cutoff)) AS cutoff FROM passed WHERE gain > 0 GROUP BY ALL
), cuts AS (
  SELECT stratum, {", ".join(f"max(cutoff) FILTER (rule = '{r}') AS cut_{r}" for r in RULES)} FROM best GROUP BY stratum
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(f"coalesce({_rate[r]} > cut_{r}, false)" for r in RULES)}) AS kept
FROM n LEFT JOIN cuts USING (stratum)
"""

_words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_words} AS w FROM documents
), i AS (
  SELECT coalesce(item_id::varchar, 'null') AS item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {_words} AS w FROM benchmark) WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM i)
), dw AS (
  SELECT rid, p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw))
), hits AS (
  SELECT DISTINCT rid, item_id, p, k FROM dw JOIN iw USING (k, g)
), covered AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM hits) GROUP BY rid
), found AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid
)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN found USING (rid)
"""

_b = Budget()
_escaped = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"

OP6 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)
), p AS (
  SELECT *, '<|im_start|>' || {_escaped.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")} || chr(10) || {_escaped.format("text")} || '<|im_end|>' || chr(10) AS piece FROM t
), c AS (
  SELECT *, len(regexp_extract_all(piece, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D\x20]')) AS c, row_number() OVER w AS ord FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), s AS (
  SELECT *, max(c) OVER v AS most, coalesce(max(c) FILTER (ord = 1 AND role = 'system') OVER v, 0) AS system,
    coalesce(sum(c) OVER (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM c WINDOW v AS (PARTITION BY conv_id)
), h AS (
  SELECT *, ord = 1 AND role = 'system' AS sys, least({_b.history}, greatest({_b.tokens} - system - most, 0)) AS history FROM s
), k AS (
  SELECT *, CASE WHEN sys THEN 0 ELSE before - system END AS p, greatest(1, {_b.tokens} - system - most - history) AS step FROM h
), turns AS (
  SELECT *, (p // step)::bigint AS k FROM k
), spans AS (
  SELECT conv_id, k, min(p) AS start FROM turns GROUP BY ALL
), shown AS (
  SELECT conv_id, piece FROM turns
  UNION ALL SELECT a.conv_id, piece FROM turns a JOIN spans b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND b.k > a.k AND b.start - a.p <= a.history WHERE NOT sys
  UNION ALL SELECT a.conv_id, piece FROM turns a JOIN spans b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND b.k > 0 WHERE sys
), size AS (
  SELECT conv_id, sum(length(piece))::bigint AS formatted_chars FROM shown GROUP BY ALL
), said AS (
  SELECT conv_id, count(*)::bigint AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY ord) FILTER (role = 'assistant'), '') AS loss FROM turns GROUP BY ALL
)
SELECT said.conv_id, n_turns, turns_sha256, length(loss)::bigint AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM said JOIN size ON said.conv_id IS NOT DISTINCT FROM size.conv_id
"""

OP3 = """
WITH p AS (
  SELECT page_id, url, sha1(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, '')))::bigint AS n FROM pages
), r AS (
  SELECT digest, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1
), t AS (
  SELECT p.*, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p LEFT JOIN r USING (digest)
)
SELECT page_id, url, n AS payload_bytes, digest AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM t
"""
