"""DuckDB SQL for the training-text queries that SQL can express."""

from __future__ import annotations

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, k, n, item FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM (SELECT DISTINCT doc_id, k, n FROM h)) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""

# 160 bits are eight groups of five hexadecimal digits, each four base32 letters
_BASE32 = """array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST('0x' || substr(d, CAST(k // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - k % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '')"""

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM m
"""

# bit by bit over the decimal digits
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda k: CAST(ascii(substr(s, k, 1)) AS BIGINT))),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [CAST(0 AS BIGINT) for i in range(8)]),
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)))"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


# key: the tree of a language; '^' is the tree over the languages, whose leaves are their tops
MANIFEST = f"""
WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS s, coalesce('+' || lang, '') AS key FROM documents),
c AS (SELECT *, CASE WHEN s IS NOT NULL THEN {_CRC} END AS crc FROM d),
l AS (SELECT doc_id, key, {_leaf("n_chars")} AS leaf, CASE WHEN crc % 7 = 0 THEN {_leaf("n_chars + 1")} END AS other FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM l),
t AS (SELECT key, 0 AS level, idx, n, leaf AS h FROM o
  UNION ALL SELECT key, level + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY idx)) FROM t WHERE n > 1 GROUP BY key, level, idx // 2),
top AS (SELECT key, h AS subroot, level AS height, row_number() OVER (ORDER BY encode(key)) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS level, place AS idx, n, subroot AS h FROM top
  UNION ALL SELECT level + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY idx)) FROM u WHERE n > 1 GROUP BY level, idx // 2),
root AS (SELECT h AS root FROM u WHERE n = 1),
every AS (SELECT t.key, t.level, t.idx, t.h FROM t JOIN top USING (key) WHERE t.n > 1 UNION ALL SELECT '^', level, idx, h FROM u WHERE n > 1),
f AS (SELECT row_number() OVER () AS r, o.doc_id, o.leaf, top.subroot, o.key, o.idx, o.n, 0 AS level, top.place, top.n AS langs, false AS over, coalesce(other, leaf) AS cur, '' AS proof
    FROM o JOIN top USING (key)
  UNION ALL SELECT r, doc_id, leaf, subroot, CASE WHEN f.n = 1 THEN '^' ELSE f.key END, CASE WHEN f.n = 1 THEN place ELSE f.idx // 2 END, CASE WHEN f.n = 1 THEN langs ELSE (f.n + 1) // 2 END,
    CASE WHEN f.n = 1 THEN 0 ELSE f.level + 1 END, place, langs, over OR f.n = 1,
    CASE WHEN f.n = 1 THEN cur WHEN e.h IS NULL THEN sha256(cur) WHEN e.idx < f.idx THEN sha256(e.h || cur) ELSE sha256(cur || e.h) END, proof || coalesce(e.h, '')
    FROM f LEFT JOIN every e ON f.n > 1 AND e.key = f.key AND e.level = f.level AND e.idx = xor(f.idx, 1) WHERE NOT (over AND f.n = 1))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM f, root WHERE over AND n = 1
"""
