"""DuckDB SQL for the queries of the corpus operators that SQL can express."""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][((rank - 1) % 3 + 1)::INT]::BIGINT AS weight, sum(source_size) OVER ()::BIGINT AS total FROM src
), filling AS (
  SELECT *, coalesce(sum(source_size) OVER f, 0)::BIGINT AS done,
         (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::BIGINT AS open
  FROM weighed
  WINDOW f AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), marked AS (
  SELECT *, (4 * source_size)::DOUBLE * open <= (3 * total - 4 * done)::DOUBLE * weight AS at_limit FROM filling
), shared AS (
  SELECT *, coalesce(sum(source_size) FILTER (at_limit) OVER (), 0)::BIGINT AS filled,
         sum(weight) FILTER (NOT at_limit) OVER ()::BIGINT AS sharing
  FROM marked
), aimed AS (
  SELECT source, source_size, rank, weight, total,
         CASE WHEN at_limit THEN (2 * source_size)::DOUBLE
              ELSE (3 * total - 4 * filled)::DOUBLE * weight / (2 * sharing)::DOUBLE END AS target
  FROM shared
), queued AS (
  SELECT row_number() OVER () AS id, d.doc_id, d.size, a.*,
         coalesce(sum(d.size) OVER (PARTITION BY a.rank ORDER BY d.h, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_start
  FROM sized d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source
), packets AS (
  SELECT *, greatest(1, total * 3 // 2 // 100000)::BIGINT AS packet FROM queued WHERE size > 0
), copies AS (
  SELECT *, first_start + epoch * source_size + place AS start, least(packet, size - place) AS words
  FROM (SELECT *, unnest(range(0, size, packet)) AS place FROM packets), (VALUES (0), (1)) e(epoch)
), cut AS (
  SELECT id, greatest(0, least(words, total * 3 // 2 - coalesce(sum(words) OVER (
           ORDER BY (start + words) / weight, rank, start
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)) AS taken
  FROM copies
), summed AS (
  SELECT id, sum(taken)::BIGINT AS taken FROM cut GROUP BY id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM queued LEFT JOIN summed USING (id)
"""

DECONTAMINATION = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
        FROM (SELECT *, least(8, len(w)) AS n FROM i WHERE len(w) > 0))
), dw AS (
  SELECT id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT d.id, d.w, k.n, unnest(range(1, len(d.w) - k.n + 2)) AS p
        FROM d, (SELECT DISTINCT n FROM iw) k WHERE len(d.w) >= k.n)
), hit AS (SELECT DISTINCT dw.id, dw.p, dw.n, iw.item_id FROM dw JOIN iw USING (n, g)),
words AS (
  SELECT id, count(DISTINCT q) AS n_hit
  FROM (SELECT id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT id, p, n FROM hit)) GROUP BY id
), items AS (
  SELECT id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
  FROM hit GROUP BY id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (id) LEFT JOIN items USING (id)
"""

JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p:p + 2], ' ')) END) AS g
    FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  WHERE 100 * least(p.n, q.n) >= 90 * greatest(p.n, q.n)
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""

SUBSTRINGS = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), g AS (
  SELECT doc_id, p, hash(array_to_string(w[p:p + 12], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)
), least AS (SELECT h, min(doc_id) AS m FROM g GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM g JOIN least USING (h) WHERE doc_id > m),
gone_of AS (SELECT doc_id, list(q) AS qs, count(*) AS n FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS s
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d) ANTI JOIN gone USING (doc_id, q)
  GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN gone_of USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

TOP_K = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

LICENSE_BASE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), p AS (
  SELECT id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS a, unnest(list_concat(w[2:], [''])) AS b, unnest(list_concat(w[3:], ['', ''])) AS c FROM d WHERE len(w) > 1
), hit AS (
  SELECT id, i - 1 AS i, CASE WHEN a = 'mit' THEN 'mit' WHEN a = 'apache' THEN 'apache' ELSE 'gpl' END AS label
  FROM p WHERE a IN ('mit', 'apache') AND b = 'license' OR a = 'general' AND b = 'public' AND c = 'license'
), found AS (
  SELECT id, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN found USING (id)
"""

SECRET_BASE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
       len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: len(x) >= 6))::BIGINT AS n_assign,
       len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20))::BIGINT AS n_access,
       len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: len(x) >= 24))::BIGINT AS n_hex
FROM d
"""
