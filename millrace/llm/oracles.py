"""DuckDB SQL for the queries that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"

_OP3 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r CROSS JOIN (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS lines, count(DISTINCT line) AS kinds FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM t) WHERE x IN (STOPS) GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(l.lines - l.kinds, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  coalesce(s.n, 0) AS n_stop, coalesce(l.lines, 0) AS n_lines
  FROM t LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars >= 1.5 * n_words AND word_chars <= 16 * n_words AND n_symbols::DOUBLE / n_words <= 0.1
  AND n_stop::DOUBLE / n_words >= 0.02 AND n_dup_lines <= 0.5 * n_lines AND n_lines <= 0.5 * n_words AS kept
FROM b
"""

_OP4 = r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.last IS NOT NULL AND r.last <> doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_OP5 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
f AS (SELECT *, sum(source_size) OVER () * 150 - coalesce(sum(source_size) OVER (ORDER BY source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 200 AS num,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS den FROM w),
l AS (SELECT num, den FROM f WHERE num * w <= source_size * 200 * den AND source_size > 0 ORDER BY source_size / w, rank LIMIT 1),
t AS (SELECT f.source, f.source_size, least((f.w * l.num)::DOUBLE / (l.den * 100)::DOUBLE, (f.source_size * 2)::DOUBLE) AS target FROM f, l),
o AS (SELECT d.doc_id, d.size, t.source_size, t.target, (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT size, upto / target AS f FROM o WHERE size > 0 UNION ALL SELECT size, (upto + source_size) / target FROM o WHERE size > 0),
c AS (SELECT max(f) AS cut FROM (SELECT f, sum(size) OVER (ORDER BY f RANGE UNBOUNDED PRECEDING) AS mass FROM i) WHERE mass * 100 <= (SELECT sum(size) * 150 FROM d))
SELECT doc_id, size, source_size, target,
  (size * ((upto / target <= cut)::BIGINT + ((upto + source_size) / target <= cut)::BIGINT))::BIGINT AS taken
FROM o, c
"""

_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(s, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER + 1, 1)), '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""


def _stops() -> str:
    from millrace.llm.quality import STOP_WORDS

    return ", ".join(f"'{x}'" for x in dict.fromkeys([*STOP_WORDS, *map(str.capitalize, STOP_WORDS)]))


ORACLES = {
    "op3_quality_rules": _OP3.replace("STOPS", _stops()),
    "op4_line_dedup": _OP4,
    "op5_source_mixing": _OP5,
    "op7_warc": _OP7,
}
