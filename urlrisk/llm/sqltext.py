"""DuckDB texts of the queries that SQL can express."""

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, CAST(sum(length(text) + length(role) + 22
      + length(text || role) - length(replace(text || role, '\', ''))
      + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) + len(regexp_extract_all(role, '</?s>|\[/?INST\]'))
    ) OVER (PARTITION BY conv_id) AS BIGINT) AS formatted_chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  any_value(formatted_chars) AS formatted_chars
FROM sized GROUP BY conv_id
"""

JACCARD = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')
    IF x <> ''] AS w FROM documents
), grams AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END) AS g
  FROM tokens
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * i >= 80 * (p.n + q.n - i)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON r.y = l.x
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.y) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r ON r.x = d.doc_id GROUP BY 1, 2
"""

REPEATS = r"""
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), windows AS (
  SELECT doc_id, p, hash(substring(h, CAST(2 * p + 1 AS BIGINT), 400)) AS w
  FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS p FROM bytes WHERE n >= 200)
), repeated AS (
  SELECT w FROM windows GROUP BY w HAVING count(*) > 1
), hits AS (
  SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 200, true) AS fresh
  FROM windows SEMI JOIN repeated USING (w)
), runs AS (
  SELECT doc_id, min(p) AS s, max(p) + 200 AS e FROM (
    SELECT doc_id, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hits) GROUP BY doc_id, k
), cuts AS (
  SELECT doc_id, list(s ORDER BY s) AS s, list(e ORDER BY s) AS e, sum(e - s) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1
)
SELECT b.doc_id, b.n AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, coalesce(c.n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN c.doc_id IS NULL THEN h ELSE array_to_string([
    substring(h, CAST(2 * (CASE WHEN k = 1 THEN 0 ELSE c.e[k - 1] END) + 1 AS BIGINT),
      CAST(2 * ((CASE WHEN k > len(c.s) THEN b.n ELSE c.s[k] END) - (CASE WHEN k = 1 THEN 0 ELSE c.e[k - 1] END)) AS BIGINT))
    FOR k IN range(1, len(c.s) + 2)], '') END)) AS kept_sha256
FROM bytes b LEFT JOIN cuts c USING (doc_id)
"""
