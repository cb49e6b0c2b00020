"""SQL with the same rows as operators that SQL can express, by plain definitions instead of their methods."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS p
  FROM (SELECT item_id, unnest(CASE WHEN len(w) < 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS x FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
met AS (
  SELECT o.doc_id, o.i, o.n, item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths)) o
  JOIN windows USING (n, p)
), hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SUFFIXES = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (SELECT doc_id, s, substr(x, 2 * s + 1, 100) AS w FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS s FROM h)),
earliest AS (SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w),
starts AS (SELECT doc_id, s FROM windows JOIN earliest USING (w) WHERE first_id < doc_id),
broken AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS opens FROM starts),
runs AS (
  SELECT doc_id, min(s) AS a, max(s) + 50 AS b
  FROM (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM broken) GROUP BY doc_id, g),
pieces AS (
  SELECT doc_id, a, substr(x, 2 * coalesce(before, 0) + 1, 2 * (a - coalesce(before, 0))) AS piece, b - a AS gone
  FROM (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs) JOIN h USING (doc_id)),
cut AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY a) AS head, sum(gone)::BIGINT AS n_removed, count(*) AS n_spans, max(a + gone) AS last_end
  FROM pieces GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last_end, 0)::BIGINT + 1))) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
bags AS (
  SELECT doc_id, sh, count(*) AS n
  FROM (SELECT doc_id, array_to_string(x, ' ') AS sh
        FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS x FROM d))
  GROUP BY ALL),
sizes AS (SELECT doc_id, sum(n) AS size FROM bags GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS both_ FROM bags a JOIN bags b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE both_ / (x.size + y.size - both_)::DOUBLE >= 0.8),
reached AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT node, b FROM reached JOIN links ON a = other),
classes AS (SELECT node AS doc_id, min(other) AS class_id FROM reached GROUP BY node)
SELECT doc_id, class_id, coalesce(size, 0)::BIGINT AS n_shingles, doc_id = class_id AS is_kept
FROM classes LEFT JOIN sizes USING (doc_id)
"""
