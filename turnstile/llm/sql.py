"""SQL of the queries that SQL can express, for another engine over the same tables."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}')"


DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_lower("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
),
sizes AS (SELECT DISTINCT n FROM sized),
places AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)
),
hits AS (SELECT p.doc_id, p.n, p.i, v.item_id FROM places p JOIN windows v ON p.n = v.n AND p.win = v.win),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM p),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0')), '') AS b FROM h),
named AS (
    SELECT page_id, payload_bytes, hex, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
        1 + 16 * CAST(b[5 * i + 1] AS INT) + 8 * CAST(b[5 * i + 2] AS INT) + 4 * CAST(b[5 * i + 3] AS INT) + 2 * CAST(b[5 * i + 4] AS INT) + CAST(b[5 * i + 5] AS INT)]), '') AS payload_digest
    FROM bits
),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""


def shards(limit: int, deepest: int = 40) -> str:
    """Depths down to `deepest` bits, which is more than distinct ids of a small table need."""
    return f"""
WITH d AS (
    SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
           CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
    FROM documents
),
ups AS (SELECT doc_id, n_bytes, h, depth, h >> (60 - depth) AS prefix FROM d CROSS JOIN range(0, {deepest + 1}) AS t(depth)),
sums AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes FROM ups GROUP BY depth, prefix),
picked AS (
    SELECT u.doc_id, u.n_bytes, u.h, min(u.depth) AS depth FROM ups u JOIN sums s ON u.depth = s.depth AND u.prefix = s.prefix
    WHERE s.shard_bytes <= {limit} OR u.depth = {deepest} GROUP BY u.doc_id, u.n_bytes, u.h
)
SELECT p.doc_id, p.n_bytes, CAST(p.depth AS INT) AS depth, substr(lpad(bin(p.h), 60, '0'), 1, CAST(p.depth AS BIGINT)) AS shard, CAST(s.shard_bytes AS BIGINT) AS shard_bytes
FROM picked p JOIN sums s ON p.depth = s.depth AND (p.h >> (60 - p.depth)) = s.prefix
"""


def perspectives(part_turns: int) -> str:
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM t),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
said AS (
    SELECT p.conv_id, perspective, place, CAST(place // {part_turns} AS INT) AS part, role = perspective AS own, text,
           '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head
    FROM placed p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id
),
sized AS (
    SELECT *, head || text || '<|im_end|>' || chr(10) AS body,
           coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY conv_id, perspective ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
    FROM said
)
SELECT conv_id, perspective, part, count(*) AS n_turns, CAST(min(begins) AS BIGINT) AS part_start, string_agg(body, '' ORDER BY place) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(CAST(begins AS BIGINT) + length(head) AS VARCHAR) || ':' || CAST(CAST(begins AS BIGINT) + length(head) + length(text) + 10 AS VARCHAR) END, ',' ORDER BY place), '') AS mask
FROM sized GROUP BY conv_id, perspective, part
"""


FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, list_transform(range(0, 4), lambda k: CAST('0x' || substr(x, 1 + 8 * k, 8) AS BIGINT)) AS h FROM d),
c AS (
    SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
           CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM h
),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def jaccard(k: int, percent: int) -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + least({k}, len(w)) - 1], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - least({k}, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= {percent} * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON d.doc_id = r.a
"""
