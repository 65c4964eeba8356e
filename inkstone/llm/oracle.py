"""SQL that gives the results of the queries by a plainer path, where SQL can express them."""

from __future__ import annotations

_LINE_KEY = "regexp_replace(lower(translate(line, 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')), '[^\\p{L}]+', '', 'g')"

_P3 = "SELECT DISTINCT doc_id, chunk_index FROM chunks WHERE length(text) > 700 AND doc_id IS NOT NULL AND chunk_index IS NOT NULL"

_P6 = rf"""
WITH docs AS (
  SELECT DISTINCT doc_id, issuer_code AS issuer FROM (SELECT DISTINCT doc_id FROM chunks WHERE doc_id IS NOT NULL) d
  JOIN issuers ON contains(regexp_replace(lower(doc_id), '[-_\s]+', '-', 'g'), replace(replace(lower(filename_tag), '_', '-'), ' ', '-'))
), total AS (SELECT issuer, count(*) AS n FROM docs GROUP BY issuer),
lines AS (
  SELECT doc_id, chunk_index, i - 1 AS line_no, parts[i] AS line
  FROM (SELECT doc_id, chunk_index, string_split(text, chr(10)) AS parts FROM chunks WHERE text IS NOT NULL) t, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) u
), keyed AS (SELECT issuer, doc_id, chunk_index, line_no, {_LINE_KEY} AS k FROM lines JOIN docs USING (doc_id)),
hot AS (
  SELECT issuer, k FROM keyed JOIN total USING (issuer) WHERE length(k) >= 8
  GROUP BY issuer, k, n HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) * 4 >= n
)
SELECT DISTINCT doc_id, chunk_index, CAST(line_no AS INTEGER) AS line_no FROM keyed SEMI JOIN hot USING (issuer, k)
"""

_P5 = r"""
WITH RECURSIVE s AS (
  SELECT DISTINCT id, threadId, type, nullif(trim(parentId), '') AS parentId, output, CAST(createdAt AS TIMESTAMPTZ) AS ts,
    CASE WHEN regexp_matches(coalesce(output, ''), '[\p{L}\p{N}]') AND type = 'user_message' THEN 'user'
         WHEN regexp_matches(coalesce(output, ''), '[\p{L}\p{N}]') AND type = 'assistant_message' THEN 'assistant' END AS role
  FROM steps WHERE id IS NOT NULL AND threadId IN (SELECT id FROM threads)
), led AS (
  SELECT threadId, id, id AS root FROM s WHERE role = 'user'
  UNION
  SELECT c.threadId, c.id, l.root FROM s c JOIN led l ON c.threadId = l.threadId AND c.parentId = l.id WHERE c.role IS DISTINCT FROM 'user'
), bad AS (
  SELECT threadId FROM s WHERE parentId IS NOT NULL AND (threadId, id) NOT IN (SELECT threadId, id FROM led)
  UNION
  SELECT u.threadId FROM s u WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM led l JOIN s a ON a.id = l.id WHERE l.threadId = u.threadId AND l.root = u.id AND a.role = 'assistant')
), kept AS (SELECT DISTINCT threadId FROM s WHERE role = 'user' AND threadId NOT IN (SELECT threadId FROM bad)),
m AS (
  SELECT threadId, id, role, ts, id AS root, ts AS root_ts FROM s WHERE role = 'user' OR role = 'assistant' AND parentId IS NULL
  UNION ALL
  SELECT a.threadId, a.id, a.role, a.ts, l.root, u.ts FROM s a JOIN led l ON l.id = a.id JOIN s u ON u.id = l.root WHERE a.role = 'assistant' AND a.parentId IS NOT NULL
)
SELECT threadId, CAST(row_number() OVER (PARTITION BY threadId ORDER BY root_ts, root, id <> root, ts, id) - 1 AS INTEGER) AS position, id, role
FROM m WHERE threadId IN (SELECT threadId FROM kept)
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _P3, "p5_found": _P5, "p6_found": _P6}
