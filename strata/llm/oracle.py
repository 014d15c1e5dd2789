"""DuckDB SQL of the queries that SQL can express, on the pre-registered views."""

from __future__ import annotations

_OP1 = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'),
                            ('com/fr/', 'allow'), ('com/de/', 'block')),
s AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS rhost, substr(rule, strpos(rule, '/')) AS rpath FROM r),
f AS (
  SELECT page_id, host, path, rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, length(rhost) DESC) AS k
  FROM p JOIN s ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM p LEFT JOIN f ON p.page_id = f.page_id AND f.k = 1
"""

_OP3 = """
WITH m AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
w AS (
  SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role <> 'system'),
s AS (
  SELECT m.conv_id, perspective, CAST(floor(greatest(coalesce(turn, 0), 0) / 64) AS BIGINT) AS part, turn, role, text,
         CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || role || '|>' || chr(10) END AS head,
         text || '<|end|>' || chr(10) AS body
  FROM m JOIN w ON m.conv_id IS NOT DISTINCT FROM w.conv_id),
o AS (
  SELECT *, sum(length(head) + length(body)) OVER (
              PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text) AS upto
  FROM s)
SELECT conv_id, perspective, part, count(*) AS n_messages,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS text,
       coalesce(string_agg(CASE WHEN role = perspective
           THEN CAST(upto - length(body) AS BIGINT) || ':' || CAST(upto AS BIGINT) END, ','
           ORDER BY turn NULLS FIRST, role, text), '') AS mask
FROM o GROUP BY conv_id, perspective, part
"""

_OP4 = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0') AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, source) AS place FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (
  SELECT *, CAST(CASE WHEN cap / weight <= level THEN cap
                 ELSE (SELECT arg_min(level, place) FROM l WHERE cap / weight > level) * weight END AS DOUBLE) AS target FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
x AS (
  SELECT *, CAST(round(target - epochs * source_size) AS BIGINT) AS rest FROM e),
g AS (
  SELECT source, key, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY key) AS upto FROM d GROUP BY source, key)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, x.source_size, x.target,
       CAST(x.epochs * d.size + CASE WHEN g.upto <= x.rest THEN d.size WHEN g.upto - g.n >= x.rest THEN 0
            ELSE floor((x.rest - (g.upto - g.n)) * d.size / g.n) END AS BIGINT) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.key = g.key
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(LOWERED, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, list_slice(ws, i, i + 3) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r(id, root) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.id = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.root AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id
JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) m ON m.id = d.doc_id
""".replace("LOWERED", _LOWER.format("text"))

_OP6 = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item, n, list_slice(ws, i, i + n - 1) AS w
  FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
        FROM b WHERE len(ws) > 0)),
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
dw AS (
  SELECT doc_id, n, i, list_slice(ws, i, i + n - 1) AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
occ AS (SELECT doc_id, dw.i, dw.n, item FROM dw JOIN win ON dw.n = win.n AND dw.w = win.w),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
""".replace("LOWERED", _LOWER.format("text"))

_OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (  -- every 200-byte string, cut from pieces of 512 starts
  SELECT r, 512 * c + i AS i, md5_number(substr(piece, 2 * i + 1, 400)) AS k
  FROM (SELECT r, c, piece, unnest(range(0, length(piece) // 2 - 199)) AS i
        FROM (SELECT r, c, substr(h, 1024 * c + 1, 2 * 711) AS piece
              FROM (SELECT r, h, unnest(range(0, (length(h) // 2 - 200) // 512 + 1)) AS c FROM d WHERE length(h) >= 400)))),
c AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
s AS (SELECT r, i, i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 AS apart FROM w WHERE k IN (SELECT k FROM c)),
g AS (SELECT r, i, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM s),
x AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, run),
p AS (
  SELECT d.r, x.b AS kept_from, lead(x.a, 1, length(h) // 2) OVER (PARTITION BY d.r ORDER BY x.a) AS kept_to, h FROM d JOIN x ON d.r = x.r
  UNION ALL
  SELECT d.r, 0, coalesce((SELECT min(a) FROM x WHERE x.r = d.r), length(h) // 2), h FROM d),
k AS (SELECT r, string_agg(substr(h, 2 * kept_from + 1, 2 * (kept_to - kept_from)), '' ORDER BY kept_from) AS h FROM p GROUP BY r)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM d JOIN k ON d.r = k.r LEFT JOIN (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM x GROUP BY r) q ON q.r = d.r
"""

_OP11 = r"""
WITH t AS (  -- the checksum's table: eight division steps per byte value, by the polynomial of crc32
  SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(c, [0,0,0,0,0,0,0,0]),
           lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 16 AS size,
         coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
s AS (
  SELECT doc_id, size, md5(key) AS hash,
         list_transform(range(41), lambda s: {'draw': -ln((CAST('0x' || substr(md5(key || ':0:' || CAST(s AS VARCHAR)), 1, 13)
                                                        AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE), 'shard': s}) AS draws,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'),
                                                             lambda h: CAST('0x' || h AS BIGINT))),
             lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) AS text_crc32
  FROM d, t),
a AS (
  SELECT doc_id, size, hash, text_crc32, CAST(list_min(draws[1:40]).shard AS INT) AS shard,
         CAST(list_min(draws).shard AS INT) AS grown_shard FROM s)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY hash, size, text_crc32) - 1 AS slot, grown_shard
FROM a
"""

_OP12 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
k AS (SELECT *, row_number() OVER () AS r FROM d WHERE len(ws) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM k),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM k) GROUP BY r, term),
g AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM f, c GROUP BY term, n_docs),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (
  SELECT item_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ws) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN g USING (term) JOIN f USING (term) JOIN k USING (r), c GROUP BY item_id, r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM s JOIN k USING (r) WHERE score > 0) WHERE rank <= 50
""".replace("LOWERED", _LOWER.format("text"))

_OP13 = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents),
d AS (
  SELECT doc_id, part, len(ws) < 200 AS a, 100 * list_unique(ws) < 50 * len(ws) AS b,
         100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (  -- one character per failed filter
  SELECT part, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END,
                      CASE WHEN e THEN 'E' END) AS fails, count(*) AS n,
         count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM d LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order FROM x p, x q, x r, x s, x t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
u AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
m AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS own, fails, n, good, toxic,
         contains(fails, substr(filter_order, step, 1)) AS here,
         length(translate(fails, substr(filter_order, 1, step - 1), '')) < length(fails) AS before FROM f, u),
g AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT here AND NOT before), 0) AS kept,
         coalesce(sum(n) FILTER (here AND NOT before), 0) AS removed, coalesce(sum(n) FILTER (here AND before), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (here AND NOT before), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (here AND NOT before), 0) AS toxic_lost
  FROM m GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""

ORACLE = {"op1_url_filter": _OP1, "op2_jaccard_join": _OP2, "op3_chat_perspectives": _OP3, "op4_mix_sources": _OP4,
          "op6_decontaminate": _OP6, "op10_suffix_dedup": _OP10, "op11_rendezvous_shards": _OP11, "op12_ranked_search": _OP12,
          "op13_filter_audit": _OP13}
