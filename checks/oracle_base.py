"""SQL that rebuilds the bridge tables from the driver's tables.

Written independently of the Spark side: numbering by one global window,
stitching by a running count of heads, parsing with RE2.
"""

from __future__ import annotations

LINES = r"""
base AS (
  SELECT event_id e, user_id u, event_type t, value v,
         (event_id // 64) % 3 = 0 AS polling,
         CASE WHEN (event_id // 64) % 3 = 0
              THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(2 * event_id) ELSE ts END AS moment,
         cast(round(value * 100) AS bigint) AS cents
  FROM events),
words AS (
  SELECT *,
    CASE t WHEN 'click' THEN 'LogOnline' WHEN 'view' THEN 'LogSlate' WHEN 'error' THEN 'LogNet'
           WHEN 'signup' THEN 'LogInit' WHEN 'purchase' THEN 'LogTravel' ELSE 'LogTemp' END AS cat0,
    CASE t WHEN 'error' THEN CASE WHEN v >= 50 THEN 'Fatal' WHEN v >= 15 THEN 'Error' ELSE 'Warning' END
           WHEN 'view' THEN CASE WHEN v < 5 THEN 'Verbose' ELSE 'Display' END
           WHEN 'click' THEN CASE WHEN v < 10 THEN 'Log' ELSE 'Display' END
           WHEN 'signup' THEN CASE WHEN v >= 60 THEN 'Warning' ELSE 'Display' END
           ELSE CASE WHEN v < 2 THEN 'VeryVerbose' WHEN v >= 80 THEN 'Error' ELSE 'Display' END END AS verb0,
    CASE e % 6
      WHEN 0 THEN 'Session=s' || u || ' Ticket=t-' || e || ' UserId=' || u || ' Result=ok'
      WHEN 1 THEN 'JoinSession failed. Session="abc' || (e % 7) || '" Reason="timed out after ' || cents || '"'
      WHEN 2 THEN 'Polling session state value=' || cents || ';'
      WHEN 3 THEN 'NetworkFailure: PendingConnectionFailure code=' || (e % 10) || ','
      WHEN 4 THEN 'ticketId: T' || e || ' userId: "u' || u || '" queue=' || t
      ELSE 'a=1 a=2 =skip key= next "q=5" empty="" tail="open ' || (e % 3) END AS msg0
  FROM base),
heads AS (
  SELECT *,
    CASE WHEN NOT polling AND e % 17 = 0 THEN '  ' ELSE '' END
    || CASE WHEN NOT polling AND e % 13 = 0 THEN ''
            WHEN NOT polling AND e % 29 = 0 THEN '[' || strftime(moment, '%Y.%m.%d-%H.%M.%S:%g') || ']'
            ELSE '[' || strftime(moment, '%Y.%m.%d-%H.%M.%S:%g') || '][' || (e % 1000) || ']' END
    || CASE WHEN polling THEN 'LogOnline: Display: Polling session state'
            WHEN e % 31 = 0 THEN 'Plain text line ' || e || ' without category'
            ELSE CASE WHEN e % 11 = 0 THEN 'Log' || upper(substr(cat0, 4)) ELSE cat0 END || ': '
                 || CASE WHEN e % 19 = 0 THEN ''
                         WHEN e % 5 = 0 THEN lower(verb0) || ': ' ELSE verb0 || ': ' END
                 || msg0 END AS text
  FROM words),
exploded AS (
  SELECT e, u, 0 AS j, text AS value FROM heads
  UNION ALL SELECT e, u, 1, '    {' FROM heads WHERE t = 'error' AND NOT polling
  UNION ALL SELECT e, u, 2, '      "ticket": "t-' || e || '", "user": "u' || u || '"' FROM heads
            WHERE t = 'error' AND NOT polling
  UNION ALL SELECT e, u, 3, '    }' FROM heads WHERE t = 'error' AND NOT polling
  UNION ALL SELECT e, u, 9, '   ' FROM heads WHERE NOT polling AND e % 23 = 0),
lines AS (
  SELECT 'src' || (u % 4) AS source_id,
         'log/src' || (u % 4) || '.log' AS source_path,
         row_number() OVER (PARTITION BY u % 4 ORDER BY e, j) AS line_number,
         e, value
  FROM exploded)"""

_PARSE = r"""
split_lines AS (
  SELECT *, trim(value) = '' AS blank, ltrim(value) AS l0,
    regexp_matches(ltrim(value), '^\[\d{4}\.\d\d\.\d\d-\d\d\.\d\d\.\d\d:\d{3}\][^\[]*\[\s*[+-]?\d+\s*\]') AS pfx
  FROM lines),
cut AS (
  SELECT *, CASE WHEN pfx THEN ltrim(regexp_replace(l0, '^\[[^\]]*\][^\[]*\[[^\]]*\]', '')) ELSE l0 END AS rest
  FROM split_lines),
judged AS (
  SELECT *,
    regexp_matches(rest, '^Log[\pL\p{Nd}_]*\s*:') AND trim(regexp_replace(rest, '^[^:]*:', '')) <> '' AS two,
    regexp_matches(rest, '(?i)^[^:]*:\s*(fatal|error|warning|display|log|verbose|veryverbose)\s*:')
      AND regexp_matches(rest, '^Log[\pL\p{Nd}_]*\s*:') AS three
  FROM cut),
flagged AS (
  SELECT *, NOT blank AND (value = l0 OR two OR three
      OR line_number = min(CASE WHEN NOT blank THEN line_number END) OVER (PARTITION BY source_id)) AS is_head
  FROM judged),
owned AS (
  SELECT *, max(CASE WHEN is_head THEN line_number END)
      OVER (PARTITION BY source_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS event_line
  FROM flagged WHERE NOT blank),
tails AS (
  SELECT source_id, event_line, list(trim(value) ORDER BY line_number) AS conts
  FROM owned WHERE NOT is_head GROUP BY ALL),
ev AS (
  SELECT h.source_id, h.source_path, h.line_number, h.value AS raw,
    CASE WHEN pfx THEN strptime(substr(l0, 2, 23), '%Y.%m.%d-%H.%M.%S:%g') END AS ts,
    CASE WHEN pfx THEN cast(trim(regexp_extract(l0, '^\[[^\]]*\][^\[]*\[([^\]]*)\]', 1)) AS integer) END AS frame,
    CASE WHEN two OR three THEN trim(split_part(rest, ':', 1)) ELSE 'Unknown' END AS category,
    CASE WHEN three THEN trim(split_part(rest, ':', 2)) ELSE 'Display' END AS verbosity,
    CASE WHEN three THEN trim(regexp_replace(rest, '^[^:]*:[^:]*:', ''))
         WHEN two THEN trim(regexp_replace(rest, '^[^:]*:', ''))
         ELSE trim(h.value) END AS message,
    coalesce(t.conts, []) AS conts,
    'sha256:' || sha256(h.value) AS raw_text_hash
  FROM owned h LEFT JOIN tails t ON t.source_id = h.source_id AND t.event_line = h.line_number
  WHERE h.is_head)"""

_DOCS = r"""
doc_lines AS (
  SELECT d.source AS source_id, d.doc_id, d.lang, p.j, p.value
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(d.parts) AS value, generate_subscripts(d.parts, 1) AS j) p),
tv AS (
  SELECT l.source_id, 'doc/' || l.source_id AS source_path,
    row_number() OVER (PARTITION BY l.source_id ORDER BY l.doc_id, l.j) AS line_number,
    cast(NULL AS timestamp) AS ts,
    'Log' || l.lang AS category,
    CASE WHEN b.toxic = 1 THEN 'Error' WHEN b.quality = 0 THEN 'Warning' ELSE 'Display' END AS verbosity,
    l.value AS message
  FROM doc_lines l LEFT JOIN labels b ON b.doc_id = l.doc_id)"""


def with_lines(body: str) -> str:
    """``lines``: numbered raw lines."""
    return f"WITH {LINES}\n{body}"


def with_events(body: str, *more: str) -> str:
    """``ev``: parsed events; further CTEs may follow."""
    return "WITH " + ",".join([LINES, _PARSE, *more]) + "\n" + body


def with_documents(body: str, *more: str) -> str:
    """``tv``: document events; further CTEs may follow."""
    return "WITH " + ",".join([_DOCS, *more]) + "\n" + body
