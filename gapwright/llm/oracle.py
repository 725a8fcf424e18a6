"""DuckDB's words for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import chat

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS k FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, y FROM r JOIN e ON x = b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""

OP5 = """
WITH t AS (SELECT row_number() OVER () AS k, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT k, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT k, h, unnest(generate_series(0, len(h) // 2 - 200)) AS i FROM t WHERE len(h) >= 400)),
m AS (SELECT k, i FROM w SEMI JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) r USING (g)),
e AS (SELECT k, i, coalesce(i - lag(i) OVER (PARTITION BY k ORDER BY i) > 200, true) AS fresh FROM m),
s AS (SELECT k, min(i) AS a, max(i) + 200 AS b FROM (SELECT k, i, sum(fresh::INT) OVER (PARTITION BY k ORDER BY i) AS n FROM e) GROUP BY k, n),
p AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS prev FROM s),
c AS (SELECT k, sum(b - a) AS r, count(*) AS n, max(b) AS z, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS h FROM p JOIN t USING (k) GROUP BY k)
SELECT doc_id, len(t.h) // 2 AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(CASE WHEN c.k IS NULL THEN t.h ELSE c.h || substr(t.h, 2 * z + 1) END)) AS kept_sha256 FROM t LEFT JOIN c USING (k)
"""

OP7 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT g, min(doc_id) AS d FROM k GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS j FROM k JOIN f USING (g) WHERE doc_id > d),
e AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS j, unnest(ws) AS word FROM w WHERE len(ws) > 0),
a AS (SELECT e.doc_id, count(c.j) AS r, string_agg(CASE WHEN c.j IS NULL THEN word END, ' ' ORDER BY e.j) AS t FROM e LEFT JOIN c USING (doc_id, j) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN a USING (doc_id)
"""

OP8 = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)),
rp AS (SELECT doc_id, count(DISTINCT j) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g SEMI JOIN (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1) d USING (doc_id, g)) GROUP BY 1),
b AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r, 0) AS n_repeat_words FROM w LEFT JOIN rp USING (doc_id)),
m AS (SELECT *, coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS m1, coalesce(n_symbols::DOUBLE / nullif(word_chars, 0), 0) AS m2, coalesce(n_dup_lines::DOUBLE / nullif(n_words, 0), 0) AS m3, coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0) AS m4 FROM b),
u AS (SELECT lang, source, 1 AS k, m1 AS x FROM m UNION ALL SELECT lang, source, 2, m2 FROM m UNION ALL SELECT lang, source, 3, m3 FROM m UNION ALL SELECT lang, source, 4, m4 FROM m),
v AS (SELECT lang, source, k, CASE WHEN x > 0 THEN ceil(ln(x) / ln(1.02::DOUBLE)) END AS bk FROM u),
o AS (SELECT lang, source, k, bk, count(*)::HUGEINT AS n FROM v GROUP BY ALL),
g2 AS (SELECT k, bk, sum(n)::HUGEINT AS n FROM o GROUP BY ALL),
bl AS (SELECT lang, source, k, bk, n * (SELECT count(*) FROM m) AS n FROM o UNION ALL SELECT lang, source, k, g2.bk, 100 * g2.n FROM (SELECT DISTINCT lang, source, k FROM o) JOIN g2 USING (k)),
q AS (SELECT lang, source, k, min(CASE WHEN rc * 1000 >= c * 100 THEN coalesce(pow(1.02::DOUBLE, bk), 0) END) AS q0, min(CASE WHEN rc * 1000 >= c * 500 THEN coalesce(pow(1.02::DOUBLE, bk), 0) END) AS q1, min(CASE WHEN rc * 1000 >= c * 900 THEN coalesce(pow(1.02::DOUBLE, bk), 0) END) AS q2
  FROM (SELECT lang, source, k, bk, sum(n) OVER (PARTITION BY lang, source, k ORDER BY bk NULLS FIRST)::HUGEINT AS rc, sum(n) OVER (PARTITION BY lang, source, k)::HUGEINT AS c FROM (SELECT lang, source, k, bk, sum(n) AS n FROM bl GROUP BY ALL)) GROUP BY ALL),
y AS (SELECT lang, source, max(CASE WHEN k = 1 THEN least(q0 - 2 * (q1 - q0), q1 - 0.5) END) AS l1, max(CASE WHEN k = 1 THEN greatest(q2 + 2 * (q2 - q1), q1 + 0.5) END) AS h1, max(CASE WHEN k = 2 THEN greatest(q2 + 2 * (q2 - q1), q1 + 0.02) END) AS h2,
  max(CASE WHEN k = 3 THEN greatest(q2 + 2 * (q2 - q1), q1 + 0.015) END) AS h3, max(CASE WHEN k = 4 THEN greatest(q2 + 2 * (q2 - q1), q1 + 0.1) END) AS h4 FROM q GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND m1 BETWEEN l1 AND h1 AND m2 <= h2 AND m3 <= h3 AND m4 <= h4 AS kept
FROM m JOIN y ON m.lang IS NOT DISTINCT FROM y.lang AND m.source IS NOT DISTINCT FROM y.source
"""

SQL = {"op3_jaccard_join": OP3, "op5_byte_dedup": OP5, "op6_chat_formatting": chat.SQL, "op7_word_dedup": OP7, "op8_quality_rules": OP8}
