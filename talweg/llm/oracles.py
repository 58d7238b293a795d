"""DuckDB SQL for the operators whose rules SQL can express, by other ways than the operators go."""

_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
WITH texts AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS MATERIALIZED (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS k FROM texts),
sets AS MATERIALIZED (
  SELECT doc_id, k, line, list_sort(list_distinct(regexp_extract_all({_LOWER.format('line')}, {_WORDS}))) AS s FROM lines
), firsts AS MATERIALIZED (
  SELECT s, len(s) AS n, min(struct_pack(d := doc_id, k := k)) AS p, row_number() OVER (ORDER BY min(struct_pack(d := doc_id, k := k))) AS i
  FROM sets WHERE len(s) >= 1 GROUP BY s
), tokens AS MATERIALIZED (SELECT i, n, unnest(s) AS t FROM firsts),
ranked AS MATERIALIZED (
  SELECT i, t, row_number() OVER (PARTITION BY i ORDER BY f, t) AS r, n
  FROM (SELECT *, count(*) OVER (PARTITION BY t) AS f FROM tokens)
), prefixes AS MATERIALIZED (SELECT i, t FROM ranked WHERE r <= n - ceil(0.8 * n - 1e-9) + 1),
gone AS MATERIALIZED (
  SELECT DISTINCT j FROM (SELECT DISTINCT a.i AS i, b.i AS j FROM prefixes a JOIN prefixes b ON a.t = b.t AND a.i < b.i) c
  JOIN firsts x ON x.i = c.i JOIN firsts y ON y.i = c.j
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))
), marked AS (
  SELECT e.doc_id, e.k, e.line, f.i IS NOT NULL AND (g.j IS NOT NULL OR f.p.d <> e.doc_id OR f.p.k <> e.k) AS removed
  FROM sets e LEFT JOIN firsts f ON f.s = e.s LEFT JOIN gone g ON g.j = f.i
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT removed), '')) AS text_sha256
FROM marked GROUP BY doc_id
"""

MIX = f"""
WITH sized AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size FROM documents
), hashed AS MATERIALIZED (SELECT *, ('0x' || substr(md5('7:' || doc_id || ':' || size), 1, 15))::BIGINT AS h FROM sized),
sources AS MATERIALIZED (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap,
    [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS i FROM sized GROUP BY source
), levels AS (
  SELECT a.i, a.cap / a.w AS r, ((SELECT sum(source_size) FROM sources) - coalesce(sum(b.cap), 0)) / ((SELECT sum(w) FROM sources) - coalesce(sum(b.w), 0)) AS level
  FROM sources a LEFT JOIN sources b ON (b.cap / b.w, b.i) < (a.cap / a.w, a.i) GROUP BY a.i, a.cap, a.w
), water AS (SELECT level FROM levels WHERE level < r ORDER BY r, i LIMIT 1),
targets AS MATERIALIZED (SELECT source, source_size, least(cap, coalesce(w * (SELECT level FROM water), cap)) AS target FROM sources),
queued AS MATERIALIZED (
  SELECT x.*, t.source_size, t.target, sum(x.size) OVER (PARTITION BY x.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS so_far
  FROM hashed x JOIN targets t ON t.source IS NOT DISTINCT FROM x.source
), copies AS (
  SELECT *, CASE WHEN target > 0 THEN (turn * source_size + so_far) / target ELSE 0 END AS f FROM queued, (VALUES (0), (1), (2)) v(turn)
), ordered AS (SELECT doc_id, h, size, turn, sum(size) OVER (ORDER BY f, coalesce('=' || source, '-'), h, doc_id, turn ROWS UNBOUNDED PRECEDING) AS total FROM copies),
taken AS (SELECT doc_id, h, (sum(size) FILTER (total <= (SELECT sum(size) FROM sized)))::BIGINT AS taken FROM ordered GROUP BY doc_id, h)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0) AS taken FROM queued q JOIN taken t ON t.doc_id = q.doc_id AND t.h = q.h
"""

NEAR_DEDUP = f"""
WITH RECURSIVE worded AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORDS}) AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM worded
), marks AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
ranked AS MATERIALIZED (
  SELECT doc_id, n, t, f, row_number() OVER (PARTITION BY doc_id ORDER BY f, t) AS r FROM (SELECT *, count(*) OVER (PARTITION BY t) AS f FROM marks)
), prefixes AS MATERIALIZED (SELECT doc_id, t FROM ranked WHERE f > 1 AND r <= n - ceil(0.8 * n - 1e-9) + 1),
links AS MATERIALIZED (
  SELECT c.a, c.b FROM (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM prefixes x JOIN prefixes y ON x.t = y.t AND x.doc_id < y.doc_id) c
  JOIN sets x ON x.doc_id = c.a JOIN sets y ON y.doc_id = c.b
  WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))
), ties AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM ties UNION SELECT r.doc_id, e.b FROM reach r JOIN ties e ON e.a = r.other)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(least(s.doc_id, c.m), s.doc_id) AS component_id, coalesce(c.m, s.doc_id) >= s.doc_id AS kept
FROM sets s LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) c USING (doc_id)
"""

_CRC_TABLE = "list_transform(range(256), lambda v: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, v))"

PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), hashed AS (SELECT *, md5(length(role) || ':' || role || text) AS key FROM turns),
coded AS MATERIALIZED (
  SELECT conv_id, turn, key, dense_rank() OVER (ORDER BY role, text) AS id, len(regexp_extract_all(text, {_WORDS}))::BIGINT AS words FROM hashed
), convs AS MATERIALIZED (
  SELECT conv_id, list(id ORDER BY turn NULLS FIRST, key) AS s, list(words ORDER BY turn NULLS FIRST, key) AS w FROM coded GROUP BY conv_id
), crcs AS (SELECT {_CRC_TABLE} AS t),
headed AS (
  SELECT c.*, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 4 AS h
  FROM convs c, crcs
), rebuilt AS MATERIALIZED (
  SELECT c.conv_id, list_concat(coalesce(b.s[1:c.h], []), c.s[c.h + 1:]) AS s, list_concat(coalesce(b.w[1:c.h], []), c.w[c.h + 1:]) AS w
  FROM headed c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20
), nodes AS MATERIALIZED (
  SELECT p, len(p) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '') AS ids
  FROM (SELECT conv_id, s[1:d] AS p, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words, d = len(s) AS ends FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM rebuilt)) GROUP BY p
), kids AS MATERIALIZED (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS MATERIALIZED (
  SELECT p[1:d] AS p, sum((n_convs - 1) * words)::BIGINT AS saved, count(*) FILTER (leaf) AS leaves
  FROM (SELECT n.*, k.p IS NULL AS leaf, unnest(range(depth + 1)) AS d FROM nodes n LEFT JOIN kids k ON k.p = n.p) GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM nodes n JOIN below b ON b.p = n.p LEFT JOIN kids k ON k.p = n.p LEFT JOIN nodes a ON n.depth > 0 AND a.p = n.p[1:n.depth - 1]
"""

HARD_NEGATIVES = """
WITH rows AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""
