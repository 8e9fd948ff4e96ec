"""DuckDB SQL for the operators that SQL can express at the size of the correctness check."""

from __future__ import annotations


def _components(nodes: str, links: str) -> str:
    """CTEs ``reach`` and ``comp``: smallest node that each node of ``nodes`` (a) reaches over ``links`` (a, b)."""
    return f"""reach(a, b) AS (
  SELECT a, a FROM {nodes} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON r.b = l.a),
comp AS (SELECT a, min(b) AS low FROM reach GROUP BY a)"""


NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id AS a, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT a, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT a, count(*) AS n FROM s GROUP BY a),
pairs AS (SELECT x.a, y.a AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.a <> y.a GROUP BY x.a, y.a),
links AS (SELECT pairs.a, pairs.b FROM pairs JOIN n p ON p.a = pairs.a JOIN n q ON q.a = pairs.b WHERE k >= 0.8 * (p.n + q.n - k) - 1e-9),
{_components("w", "links")}
SELECT w.a AS doc_id, comp.low AS class_id, (SELECT count(*) FROM links l WHERE l.a = w.a) AS n_links FROM w JOIN comp ON comp.a = w.a"""

_SIZE = r"(length({x}) + len(regexp_extract_all({x}, '[\\#<:]')))"
CHAT = rf"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + {_SIZE.format(x='role')} + 2 + {_SIZE.format(x='text')} + 8) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, octet_length(encode(h)) AS n, min(page_id) OVER (PARTITION BY h) AS first,
             array_to_string(list_transform(string_split(sha1(h), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111',
               4 * (instr('0123456789abcdef', c) - 1) + 1, 4)), '') AS bits FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * CAST(bits[5 * i + 1] AS INTEGER) + 8 * CAST(bits[5 * i + 2] AS INTEGER) + 4 * CAST(bits[5 * i + 3] AS INTEGER)
           + 2 * CAST(bits[5 * i + 4] AS INTEGER) + CAST(bits[5 * i + 5] AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d"""

EMBED_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id AS a, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT a, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.a, y.a AS b FROM good x JOIN good y ON x.a <> y.a AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
{_components("v", "links")}
SELECT v.a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = v.a) AS n_links, comp.low AS component_id, comp.low = v.a AS kept
FROM v JOIN comp ON comp.a = v.a"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id AS i, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.i AS anchor_id, a.label = r.label AS same, r.i AS i,
        CAST(list_sum(list_transform(list_zip(a.e, r.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v r ON a.i % 100 = 0 AND a.i <> r.i AND len(a.e) = len(r.e)),
p AS (SELECT anchor_id, i AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, i) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, i) AS rank,
       i AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""

#: crc32 of the decimal id, bit by bit: 256 + byte means take a byte in, 0 means shift once.
CONV_TRIE = """
WITH t AS (SELECT conv_id AS c, list(to_json([coalesce(role, ''), coalesce(text, '')]) ORDER BY turn NULLS FIRST) AS turns,
             list(length(coalesce(text, '')) ORDER BY turn NULLS FIRST) AS sizes FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT *, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda b: [256 + ascii(b), 0, 0, 0, 0, 0, 0, 0, 0])) AS ops FROM t),
h AS (SELECT c, turns, sizes, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(ops, lambda o: CAST(o AS BIGINT))),
        lambda a, o: CASE WHEN o > 0 THEN xor(a, o - 256) WHEN a % 2 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END),
        CAST(4294967295 AS BIGINT)) % 6 AS INTEGER) AS h FROM k),
r AS (SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns, list_concat(coalesce(b.sizes[1:a.h], []), a.sizes[a.h + 1:]) AS sizes
      FROM h a LEFT JOIN t b ON b.c = a.c - a.c % 100),
p AS (SELECT c, unnest(range(0, len(turns) + 1)) AS d, turns, sizes FROM r),
m AS (SELECT c, d, d = len(turns) AS ends, sha256(CAST(turns[1:d] AS VARCHAR)) AS node, sha256(CAST(turns[1:d - 1] AS VARCHAR)) AS up,
             CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size FROM p),
n AS (SELECT d, node, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY d, node),
u AS (SELECT n.*, (SELECT count(*) FROM n k WHERE k.d = n.d + 1 AND k.up = n.node) AS n_children FROM n),
below AS (SELECT DISTINCT a.d, a.node, b.d AS bd, b.node AS bn FROM m a JOIN m b ON a.c = b.c AND b.d >= a.d),
sub AS (SELECT w.d, w.node, count(*) FILTER (x.n_children = 0) AS n_leaves, sum(x.saved) AS saved FROM below w JOIN u x ON x.d = w.bd AND x.node = w.bn GROUP BY w.d, w.node)
SELECT u.conv_id, CAST(u.d AS BIGINT) AS depth, CASE WHEN u.d > 0 THEN o.conv_id END AS parent_conv_id, u.n_convs, u.n_children, sub.n_leaves,
       CAST(sub.saved AS BIGINT) AS saved_tokens, u.ends_sha256
FROM u JOIN sub USING (d, node) LEFT JOIN n o ON o.d = u.d - 1 AND o.node = u.up"""
