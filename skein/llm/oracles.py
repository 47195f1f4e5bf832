"""The queries that SQL can say, in SQL."""

from __future__ import annotations

from skein.llm import quality as ql

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_LIST = "[" + ", ".join(f"'{w}'" for w in ql.COMMON) + "]"
_PUNCTUATION = ql.PUNCTUATION.replace("'", "''")
_COUNT = "length(t) - length(regexp_replace(t, '{0}', '', 'g'))"
_PART = "list_transform(list_zip({0}, {1}), lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END)"


def _distance(p: str, q: str) -> str:
    return f"sqrt(greatest(0, (list_sum({_PART.format(p, q)}) + list_sum({_PART.format(q, p)})) / 2))"


QUALITY = rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
e AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k FROM e),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win WHERE i <= n - 7) WHERE c > 1),
rep AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS r FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS g FROM twice) GROUP BY doc_id),
usual AS (SELECT doc_id, lower(word) AS word, count(*) AS m FROM e WHERE lower(word) IN (SELECT unnest({_LIST})) GROUP BY ALL),
own AS (SELECT doc_id, list_transform({_LIST}, lambda x: coalesce(map_from_entries(list((word, m)))[x], 0)) AS c, sum(m) AS n_common FROM usual GROUP BY doc_id),
b AS (SELECT doc_id, lang, t, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {_COUNT.format(ql.SYMBOLS)} AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, {_COUNT.format(ql.UPPER)} AS up, {_COUNT.format(ql.DIGIT)} AS dg, {_COUNT.format(_PUNCTUATION)} AS pn FROM w),
cl AS (SELECT *, [length(t) - word_chars, n_symbols, up, dg, pn, word_chars - n_symbols - up - dg - pn] AS classes FROM b),
f AS (SELECT cl.*, coalesce(r, 0) AS n_repeat_words, n_words < {ql.LEAST_WORDS} OR 100 * coalesce(r, 0) > {ql.MOST_REPEATED} * n_words AS base_failed FROM cl LEFT JOIN rep USING (doc_id)),
rc AS (SELECT lang, list_transform([sum(classes[1]), sum(classes[2]), sum(classes[3]), sum(classes[4]), sum(classes[5]), sum(classes[6])], lambda x: x / sum(length(t))) AS q, sum(length(t)) AS n, sum(n_words) AS w FROM f WHERE NOT base_failed GROUP BY lang),
rw AS (SELECT lang, map_from_entries(list((word, m))) AS c, sum(m) AS n_common FROM (SELECT lang, word, sum(m) AS m FROM usual JOIN f USING (doc_id) WHERE NOT base_failed GROUP BY ALL) GROUP BY lang),
ref AS (SELECT rc.lang, rc.q, rc.n, rc.w, list_append(list_transform({_LIST}, lambda x: coalesce(c[x], 0) / rc.w), (rc.w - coalesce(n_common, 0)) / rc.w) AS words FROM rc LEFT JOIN rw ON rw.lang IS NOT DISTINCT FROM rc.lang),
j AS (SELECT f.*, CASE WHEN length(t) >= {ql.LEAST_CHARS} AND ref.n >= {ql.LEAST_REFERENCE} THEN {_distance("list_transform(classes, lambda x: x / length(t))", "ref.q")} END AS class_distance,
CASE WHEN n_words >= {ql.LEAST_HISTOGRAM_WORDS} AND ref.w >= {ql.LEAST_REFERENCE} THEN {_distance("list_append(list_transform(coalesce(c, " + f"list_transform({_LIST}, lambda x: 0)" + "), lambda x: x / n_words), (n_words - coalesce(n_common, 0)) / n_words)", "ref.words")} END AS word_distance
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN ref ON ref.lang IS NOT DISTINCT FROM f.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(class_distance <= {ql.MOST_CLASS_DISTANCE}, true) AND coalesce(word_distance <= sqrt({ql.MOST_WORD_DISTANCE**2} + {ql.WORD_NOISE} / n_words), true) AS kept, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM j
"""

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS s, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS low FROM pages)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', 1 + CAST((CAST('0x' || substr(s, 1 + 5 * CAST(i // 4 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> low THEN low END AS refers_to FROM p
"""
