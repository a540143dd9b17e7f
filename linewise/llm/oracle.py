"""SQL twins (DuckDB) of the corpus operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
      FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
o AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
hits AS (SELECT o.r, o.n, o.i, p.item FROM o JOIN p ON o.n = p.n AND o.phrase = p.phrase),
places AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)
"""

OP9 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s
      FROM (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
first AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
hits AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM w JOIN first USING (s) WHERE least < doc_id),
runs AS (SELECT r, min(i) AS a, max(i) + 50 AS b
         FROM (SELECT r, i, sum(CASE WHEN i - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM hits) GROUP BY r, run),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM runs
         UNION ALL SELECT r, max(b), NULL FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * a + 1, coalesce(2 * (b - a), length(h))), '' ORDER BY a) AS h FROM gaps JOIN d USING (r) GROUP BY r),
counts AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN counts USING (r)
"""

_TOKENS = "regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"

OP11 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_TOKENS.format('text')} AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS x
      FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM shared JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, component_id IS NULL) AS kept
FROM d JOIN least USING (r) LEFT JOIN n USING (r)
"""

#: crc32 of a decimal number, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
    lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

OP12 = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format('conv_id')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = base AND pos <= h
      UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
p AS (SELECT conv_id, row_number() OVER turns AS depth, text, string_agg(md5(length(role) || ':' || role || text), '') OVER turns AS k
      FROM r WINDOW turns AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      UNION ALL SELECT conv_id, 0, '', '' FROM c),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(strlen(text)) AS saved FROM p GROUP BY depth, k),
ends AS (SELECT depth, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS digest
         FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS top FROM p) WHERE depth = top GROUP BY depth, k),
above AS (SELECT a.depth, a.k, a.conv_id, n.depth AS n_depth, n.k AS n_k, n.saved
          FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth <= n.depth JOIN n a ON a.depth = p.depth AND a.k = p.k),
children AS (SELECT depth, k, count(*) AS n FROM above WHERE n_depth = depth + 1 GROUP BY depth, k),
under AS (SELECT a.depth, a.k, sum(saved) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
          FROM above a LEFT JOIN children c ON c.depth = n_depth AND c.k = n_k GROUP BY a.depth, a.k)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, u.leaves AS n_leaves,
       CAST(u.saved AS BIGINT) AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM n JOIN under u USING (depth, k) LEFT JOIN children c USING (depth, k) LEFT JOIN ends USING (depth, k)
LEFT JOIN above a ON a.n_depth = n.depth AND a.n_k = n.k AND a.depth = n.depth - 1
"""

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS terms FROM documents),
totals AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
items AS (SELECT row_number() OVER () AS q, item_id, {_WORDS.format('text')} AS terms FROM benchmark),
asked AS (SELECT DISTINCT q, t FROM (SELECT q, unnest(terms) AS t FROM items)),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY t, n_docs),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(terms) * n_docs) // n_terms AS m FROM d, totals WHERE len(terms) > 0),
scores AS (SELECT q, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
           FROM asked JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY q, r, doc_id),
ranked AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (q) WHERE rank <= 50
"""

ORACLE: dict[str, str] = {
    "op1_decontamination": OP1, "op9_substrings": OP9, "op11_superminhash": OP11, "op12_prefix_trie": OP12, "op13_ranked_search": OP13,
}
