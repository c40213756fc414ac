"""SQL with the same rows as the queries, over whole tables."""

from __future__ import annotations

from strataform.llm.license_scan import LONG, PHRASES, SLACK, TEMPLATES
from strataform.llm.url_filter import RULES

#: ASCII letters.
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP9 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key
GROUP BY doc_id
"""


def _values(rows: list) -> str:
    return ", ".join(f"({i}, '{text}', '{label}')" for i, (text, label) in enumerate(rows))


_OP7 = f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_LOWER}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
p(pid, phrase, label) AS (VALUES {_values(PHRASES)}),
t(tid, template, label) AS (VALUES {_values(TEMPLATES)}),
tw AS (SELECT tid, label, string_split(template, ' ') AS tws FROM t),
tk AS (SELECT *, len(tws) AS n, len(tws) < {LONG} AS short FROM tw),
tgram AS (
  SELECT tid, label, n, 2 AS k, tpos, [tpos, tpos + g] AS covers, tws[tpos + 1] || ' ' || tws[tpos + g + 1] AS gram FROM (SELECT *, unnest(range(n - g)) AS tpos FROM (SELECT *, unnest([1, 2]) AS g FROM tk WHERE short))
  UNION ALL SELECT tid, label, n, 5, tpos, range(tpos, tpos + 5), array_to_string(tws[tpos + 1 : tpos + 5], ' ') FROM (SELECT *, unnest(range(n - 4)) AS tpos FROM tk WHERE NOT short)),
wd AS (SELECT doc_id, unnest(ws) AS w0, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT *, lead(w0, 1) OVER d AS w1, lead(w0, 2) OVER d AS w2, lead(w0, 3) OVER d AS w3, lead(w0, 4) OVER d AS w4
      FROM wd WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
base AS (
  SELECT doc_id, label, i FROM g JOIN p ON w0 || ' ' || w1 = phrase
  UNION ALL SELECT doc_id, label, i FROM g JOIN p ON w0 || ' ' || w1 || ' ' || w2 = phrase),
dgram AS (
  SELECT doc_id, i, 2 AS k, w0 || ' ' || w1 AS gram FROM g WHERE w1 IS NOT NULL
  UNION ALL SELECT doc_id, i, 2, w0 || ' ' || w2 FROM g WHERE w2 IS NOT NULL
  UNION ALL SELECT doc_id, i, 5, concat_ws(' ', w0, w1, w2, w3, w4) FROM g WHERE w4 IS NOT NULL),
hit AS (SELECT DISTINCT doc_id, tid, label, n, covers, i - tpos AS d FROM dgram JOIN tgram USING (k, gram)),
sp AS (
  SELECT doc_id, label, covered FROM (
    SELECT a.doc_id, a.label, a.n, count(DISTINCT wpos) AS held, count(DISTINCT wpos) / CAST(a.n AS DOUBLE) AS covered
    FROM (SELECT DISTINCT doc_id, tid, label, n, d FROM hit) a JOIN (SELECT doc_id, tid, d, unnest(covers) AS wpos FROM hit) b ON a.doc_id = b.doc_id AND a.tid = b.tid AND b.d BETWEEN a.d AND a.d + {SLACK}
    GROUP BY a.doc_id, a.tid, a.label, a.n, a.d)
  WHERE held >= least(ceil(n * 0.8), n - 1)),
lab AS (SELECT doc_id, label, 1.0::DOUBLE AS covered FROM base UNION ALL SELECT * FROM sp),
lb AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(covered) AS score FROM lab GROUP BY doc_id),
bb AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN bb USING (doc_id) LEFT JOIN lb USING (doc_id)
"""

_OP2 = """
WITH h AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, hex,
        list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', substr(hex, i, 1)) - 1), 4, '0')), 'string_agg', '') AS bits FROM h),
d AS (SELECT page_id, payload_bytes, hex,
        list_aggregate(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          CAST(1 + list_sum(list_transform(range(5), lambda k: (CASE substr(bits, j * 5 + k + 1, 1) WHEN '1' THEN 1 ELSE 0 END) << (4 - k))) AS BIGINT), 1)), 'string_agg', '') AS payload_digest FROM b),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

_OP5 = f"""
WITH r(rhost, rpath, rverdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule, arg_max(rverdict, length(rhost || rpath) * 1000 + length(rhost)) AS verdict
  FROM s JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT s.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM s LEFT JOIN m ON s.page_id = m.page_id
"""

SQL = {
    "op2_warc_chunks": _OP2,
    "op5_url_filter": _OP5,
    "op7_license_scan": _OP7,
    "op9_line_dedup": _OP9,
}
