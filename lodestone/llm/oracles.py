"""DuckDB SQL for the queries that SQL can express, over the registered views."""

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP6 = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), item_windows AS (
  SELECT item_id, CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END AS size,
         unnest(CASE WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) AS gram
  FROM item_words WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos,
         unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS gram
  FROM words, sizes WHERE len(w) >= size
), hits AS (
  SELECT d.doc_id, d.pos, d.size, i.item_id FROM doc_windows d JOIN item_windows i ON d.size = i.size AND d.gram = i.gram
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM (SELECT DISTINCT doc_id, pos, size FROM hits)) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.listed, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit_words h ON w.doc_id = h.doc_id LEFT JOIN hit_items i ON w.doc_id = i.doc_id
"""

OP8 = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), grams AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS pos,
         unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS gram
  FROM words WHERE len(w) >= 13
), firsts AS (SELECT gram, min(doc_id) AS first_doc FROM grams GROUP BY gram
), removed AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS p
  FROM (SELECT g.doc_id, g.pos FROM grams g JOIN firsts f ON g.gram = f.gram WHERE f.first_doc < g.doc_id)
), per_doc AS (SELECT doc_id, list(p) AS gone FROM removed GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(p.gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(w.w) + 1), lambda i: p.gone IS NULL OR NOT list_contains(p.gone, i)), lambda i: w.w[i]), ' ')) AS kept_sha256
FROM words w LEFT JOIN per_doc p ON w.doc_id = p.doc_id
"""

OP9 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p
), e AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest
  FROM d
), last AS (SELECT payload_digest, max(page_id) AS keeper FROM e GROUP BY payload_digest)
SELECT e.page_id, e.payload_bytes, e.payload_digest,
       CASE WHEN e.page_id = l.keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN e.page_id = l.keeper THEN NULL ELSE l.keeper END AS refers_to
FROM e JOIN last l ON e.payload_digest = l.payload_digest
"""

OP10 = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN url IS NOT NULL AND contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(regexp_extract(rest, '^([^/]*)', 1)) + 1) AS path
  FROM parts
), rules(verdict, rule, rule_host, rule_path) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
         ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), fits AS (
  SELECT s.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule) DESC) AS k
  FROM split s JOIN rules r ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path)
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON s.page_id = f.page_id AND f.k = 1
"""

OP11 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT n.b, r.root FROM reach r JOIN near n ON n.a = r.node
), roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node
), counts AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, r.root AS component_id, e.vec_id = r.root AS kept
FROM embeddings e JOIN roots r ON r.node = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL
), sizes AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0
), whole AS (SELECT CAST(count(*) AS BIGINT) AS cn, CAST(sum(n) AS BIGINT) AS cl FROM sizes
), tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * cn + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w FROM df, whole
), q AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (
    SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY item_id, term
), scored AS (
  SELECT q.item_id, tf.doc_id, CAST(sum(q.times * weights.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * s.n * cn) // cl)))) AS BIGINT) AS score
  FROM q JOIN weights USING (term) JOIN tf USING (term) JOIN sizes s ON s.doc_id = tf.doc_id, whole GROUP BY q.item_id, tf.doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

OP13 = r"""
WITH RECURSIVE bits(n, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8
), words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM documents, tab
), places AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS put, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a, (h // 10) % 8 AS g FROM words
), changed AS (
  SELECT doc_id, n, CASE WHEN put THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g)) END]) ELSE w END AS w
  FROM places
), flat AS (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS word FROM changed
), pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM flat x JOIN flat y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i
), islands AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS len
  FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs) GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, CAST(s AS BIGINT) AS s, CAST(len AS BIGINT) AS len, CAST(q AS BIGINT) AS q
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s, len ORDER BY q) AS k FROM islands WHERE len >= 24 AND len >= 3 * q) WHERE k = 1
), strongest AS (
  SELECT doc_id, s, len, q FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len // q DESC, CAST(len % q AS DOUBLE) / q DESC, s, q) AS k FROM runs) WHERE k = 1
), listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id
), gone AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s + q, s + len)) AS i FROM runs) GROUP BY doc_id)
SELECT c.doc_id, CAST(coalesce(l.n_runs, 0) AS BIGINT) AS n_runs, b.s AS start, b.len AS length, b.q AS period, (1000 * b.len) // b.q AS exponent_milli,
       sha256(coalesce(l.lines, '')) AS runs_sha256,
       sha256(array_to_string(list_transform(list_filter(range(0, c.n), lambda i: g.gone IS NULL OR NOT list_contains(g.gone, i)), lambda i: c.w[i + 1]), ' ')) AS collapsed_sha256
FROM changed c LEFT JOIN listed l ON l.doc_id = c.doc_id LEFT JOIN strongest b ON b.doc_id = c.doc_id LEFT JOIN gone g ON g.doc_id = c.doc_id
"""

SQL = {
    "op3_topk_search": OP3,
    "op6_decontaminate": OP6,
    "op8_substring_dedup": OP8,
    "op9_warc": OP9,
    "op10_url_filters": OP10,
    "op11_embedding_dedup": OP11,
    "op12_ranked_search": OP12,
    "op13_periodic_runs": OP13,
}
