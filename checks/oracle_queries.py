"""The SQL each query is checked against, written for DuckDB on the driver's tables."""

from __future__ import annotations

from checks.oracle_base import with_documents, with_events, with_lines

US = "chr(31)"
SHORT = "source_id, line_number, category, verbosity, message"
RANK = (
    "CASE lower(verbosity) WHEN 'fatal' THEN 5 WHEN 'error' THEN 4 WHEN 'warning' THEN 3 "
    "WHEN 'display' THEN 2 ELSE 1 END"
)
NOISE = "('logslate', 'logrhi', 'logrenderer', 'logshadercompilers')"
IMPORTANT = (
    "(lower(category) IN ('logonline', 'lognet', 'logtravel', 'logoutputdevice') "
    "OR contains(lower(message), 'networkfailure') OR contains(lower(message), 'travelfailure') "
    "OR contains(lower(message), 'joinsession') OR contains(lower(message), 'fatal error'))"
)
CONT = f"array_to_string(conts, {US})"

_TOKEN = r"""([^\s=]+)=(?:"([^"]*)(?:"|\z)|([^\s"]\S*)|\s)|\S+"""


def pairs_cte(source: str) -> str:
    """``kv``: one row per event and field key."""
    return rf"""
tok AS (
  SELECT source_id, line_number, unnest(regexp_extract_all(message, '{_TOKEN}', 1)) AS k,
    unnest(regexp_extract_all(message, '{_TOKEN}', 2)) AS q,
    unnest(regexp_extract_all(message, '{_TOKEN}', 3)) AS b,
    generate_subscripts(regexp_extract_all(message, '{_TOKEN}', 0), 1) AS i
  FROM {source}),
kv AS (
  SELECT source_id, line_number, k,
    arg_max(CASE WHEN coalesce(q, '') <> '' THEN q ELSE rtrim(coalesce(b, ''), ',;') END, i) AS v
  FROM tok WHERE coalesce(k, '') <> '' GROUP BY ALL)"""


def texts_cte(key: str = "k", value: str = "v", name: str = "ft") -> str:
    return f"""
{name} AS (
  SELECT source_id, line_number, string_agg({key} || '=' || {value}, {US} ORDER BY {key}) AS fields
  FROM kv GROUP BY ALL)"""


def _one(text: str, stem: str, tail: str, value: str, placeholder: str) -> str:
    first, rest = stem[0], stem[1:]
    pattern = rf'(\b[{first.upper()}{first}]{rest}{tail}"?\s*(?:=|:)\s*"?){value}'
    return rf"regexp_replace({text}, '{pattern}', '\1<{placeholder}>', 'g')"


def red(text: str) -> str:
    word = "[A-Za-z0-9_-]+"
    text = _one(text, "session", "(?:Id)?", word, "session_id")
    text = _one(text, "ticket", "(?:Id)?", word, "ticket_id")
    return _one(text, "user", "(?:Id)?", word, "user_id")


def red_more(text: str) -> str:
    word = "[A-Za-z0-9_-]+"
    text = red(text)
    text = _one(text, "lobby", "(?:Id)?", word, "lobby_id")
    text = _one(text, "entity", "(?:Id)?", word, "entity_id")
    text = _one(text, "queue", "(?:Name)?", word, "queue_name")
    text = _one(text, "machine", "(?:Name)?", "[A-Za-z0-9_.-]+", "machine_name")
    text = _one(text, "project", "(?:Name)?", word, "project_name")
    return rf"regexp_replace({text}, '(\b)(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}\b', '\1<ip_address>', 'g')"


RED_CONTS = f"list_transform(conts, lambda c: {red('c')})"
RED_VALUE = (
    "CASE WHEN lower(k) IN ('session', 'sessionid') THEN '<session_id>' "
    "WHEN lower(k) IN ('ticket', 'ticketid') THEN '<ticket_id>' "
    f"WHEN lower(k) IN ('user', 'userid') THEN '<user_id>' ELSE {red('v')} END"
)

_FIELDS = (pairs_cte("ev"), texts_cte())
_RED_FIELDS = (pairs_cte("ev"), texts_cte(value=RED_VALUE))
# Redacted events.
_RV = f"""
rv AS (
  SELECT e.* REPLACE ({red('e.message')} AS message, {RED_CONTS} AS conts), coalesce(f.fields, '') AS fields
  FROM ev e LEFT JOIN ft f USING (source_id, line_number))"""


def flat(source: str, fields: str = "fields", extra: str = "") -> str:
    return (
        f"SELECT source_id, source_path, line_number, ts AS timestamp, frame, category, verbosity, message, "
        f"{CONT} AS continuation, {fields} AS fields, raw_text_hash{extra} FROM {source}"
    )


EV_FIELDS = "(SELECT e.*, coalesce(f.fields, '') AS fields FROM ev e LEFT JOIN ft f USING (source_id, line_number))"


def flat_events(where: str = "true", extra: str = "") -> str:
    return with_events(f"{flat(EV_FIELDS, extra=extra)} WHERE {where}", *_FIELDS)


def short(where: str = "true", extra: str = "") -> str:
    return with_events(f"SELECT {SHORT}{extra} FROM ev WHERE {where}")


def facet(column: str, source: str = "ev", where: str = "true", key: str = "") -> str:
    keys = f"{key}, " if key else ""
    return (
        f"SELECT {keys}first({column} ORDER BY source_id, line_number) AS name, count(*) AS count "
        f"FROM {source} WHERE {where} GROUP BY {keys}lower({column})"
    )


def dedupe(source: str, columns: str) -> str:
    """First row per exact key and source, with the number of rows."""
    return f"""
SELECT {columns}, count FROM (
  SELECT *, count(*) OVER w AS count, row_number() OVER (w ORDER BY line_number) AS rn
  FROM (SELECT *, {CONT} AS ctext FROM {source})
  WINDOW w AS (PARTITION BY source_id, category, verbosity, message, ctext))
WHERE rn = 1"""


_BURST = f"""
bk AS (
  SELECT *, {CONT} AS ctext,
    lag(line_number) OVER o AS pl, lag(category) OVER o AS pc, lag(verbosity) OVER o AS pv,
    lag(message) OVER o AS pm, lag({CONT}) OVER o AS pt, lag(ts) OVER o AS pts
  FROM ev WINDOW o AS (PARTITION BY source_id ORDER BY line_number)),
bi AS (
  SELECT *, sum(CASE WHEN pl IS NOT NULL AND category = pc AND verbosity = pv AND message = pm AND ctext = pt
      AND ts - pts <= INTERVAL 10 SECOND THEN 0 ELSE 1 END)
    OVER (PARTITION BY source_id ORDER BY line_number ROWS UNBOUNDED PRECEDING) AS burst
  FROM bk),
bursts AS (
  SELECT source_id, min(line_number) AS line_number, min(category) AS category, min(verbosity) AS verbosity,
    min(message) AS message, arg_min(ts, line_number) AS first_ts, arg_max(ts, line_number) AS last_ts,
    count(*) AS count
  FROM bi GROUP BY source_id, burst)"""

_INDEXED = """
ix AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY line_number) - 1 AS idx FROM ev)"""

_RULES = """
hits AS (
  SELECT *, 'net.failure' AS rule_id, 'network.failure' AS kind, 'high' AS severity, 'Connection failed' AS reason,
    cast(0.9 AS double) AS confidence FROM ranked
  WHERE lower(category) IN ('lognet', 'lognettraffic') AND rank >= 2
    AND (contains(m, 'networkfailure') OR contains(m, 'pendingconnectionfailure') OR contains(m, 'connectiontimeout'))
  UNION ALL SELECT *, 'session.join', 'online.session', 'high', 'Joining a session failed', 0.85 FROM ranked
  WHERE contains(m, 'joinsession') AND contains(m, 'failed')
  UNION ALL SELECT *, 'login.failed', 'online.login', 'medium', 'Login failed', 0.8 FROM ranked
  WHERE lower(category) = 'logonline' AND (contains(m, 'login failed') OR contains(m, 'authentication failed'))
  UNION ALL SELECT *, 'travel.failure', 'travel.failure', 'high', 'Travel failed', 0.6 FROM ranked
  WHERE lower(category) IN ('logtravel', 'logworld') AND rank >= 3
  UNION ALL SELECT *, 'load.failure', 'load.failure', 'medium', 'Loading or streaming failed', 0.7 FROM ranked
  WHERE lower(category) IN ('logload', 'logstreaming', 'logpakfile') AND rank >= 3
    AND (contains(m, 'failed') OR contains(m, 'missing') OR contains(m, 'could not'))
  UNION ALL SELECT *, 'script.error', 'script.error', 'medium', 'Script error', 0.7 FROM ranked
  WHERE lower(category) IN ('logscript', 'logblueprint') AND rank >= 3),
fallback AS (
  SELECT r.*, CASE WHEN rank = 5 OR contains(m, 'fatal error') THEN 'fallback.fatal' ELSE 'fallback.error' END AS rule_id,
    CASE WHEN rank = 5 OR contains(m, 'fatal error') THEN 'runtime.fatal' ELSE 'runtime.error' END AS kind,
    CASE WHEN rank = 5 OR contains(m, 'fatal error') THEN 'critical' ELSE 'high' END AS severity,
    CASE WHEN rank = 5 OR contains(m, 'fatal error') THEN 'Fatal error' ELSE 'Unclassified error' END AS reason,
    CASE WHEN rank = 5 OR contains(m, 'fatal error') THEN cast(1.0 AS double) ELSE 0.5 END AS confidence
  FROM ranked r ANTI JOIN hits h ON h.source_id = r.source_id AND h.line_number = r.line_number
  WHERE rank >= 4 OR contains(m, 'fatal error')),
findings AS (
  SELECT *, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 END AS urgency
  FROM (SELECT * FROM hits UNION ALL SELECT * FROM fallback))"""
_RANKED = f"ranked AS (SELECT *, lower(message) AS m, {RANK} AS rank FROM ev)"

_REDACT_KEYS = (
    f"rk AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY line_number) - 1 AS idx, "
    f"category || {US} || verbosity || {US} || {red('message')} || {US} || array_to_string({RED_CONTS}, {US}) AS key FROM ev)"
)
_ORDER_PAIRS = """
pairs AS (
  SELECT coalesce(l.idx, r.idx) AS event_index, l.line_number AS left_line, r.line_number AS right_line,
    coalesce(l.key = r.key, false) AS same
  FROM (SELECT * FROM rk WHERE source_id = 'src0') l
  FULL JOIN (SELECT * FROM rk WHERE source_id = 'src1') r ON l.idx = r.idx)"""

_FILES = """
files AS (
  SELECT source_id || '-' || (e // 4096) AS file, line_number AS whole, value FROM lines),
numbered AS (
  SELECT file AS source_id, row_number() OVER (PARTITION BY file ORDER BY whole) AS line_number, value FROM files)"""

# The parse of `oracle_base`, but over the files as sources.
_FILE_LINES = "file_lines AS (SELECT source_id, 'x' AS source_path, line_number, value FROM numbered)"


def with_files(body: str) -> str:
    return with_lines(f", {_FILES}\n{body}")


def with_file_events(body: str) -> str:
    from checks.oracle_base import _PARSE, LINES

    parse = _PARSE.replace("FROM lines)", "FROM file_lines)")
    return f"WITH {LINES}, {_FILES}, {_FILE_LINES}, {parse}\n{body}"


def epoch_ms(interval: str) -> str:
    return f"cast(epoch({interval}) * 1000 AS bigint)"


def ms_between(start: str, end: str) -> str:
    """Milliseconds from start to end."""
    return f"datediff('millisecond', {start}, {end})"


def _iso(column: str) -> str:
    text = f"rtrim(rtrim(strftime({column}, '%Y-%m-%dT%H:%M:%S.%g'), '0'), '.')"
    # Whole seconds keep their own zeros.
    return f"(CASE WHEN {column} IS NOT NULL THEN CASE WHEN date_part('millisecond', {column}) % 1000 = 0 " \
           f"THEN strftime({column}, '%Y-%m-%dT%H:%M:%S') ELSE {text} END || '+00:00' END)"


_BASE = "bases AS (SELECT source_id, min(ts) AS base FROM ev GROUP BY 1)"
_EB = "eb AS (SELECT e.*, b.base FROM ev e LEFT JOIN bases b USING (source_id))"

_COUNTS_JSON = (
    "(SELECT '[' || string_agg('{{\"name\":\"' || name || '\",\"count\":' || count || '}}', ',' "
    "ORDER BY count DESC, upper(name)) || ']' FROM ({}))"
)

ORACLES: dict[str, str] = {
    "scan_lines": with_files("SELECT source_id, value FROM numbered"),
    "line_numbering": with_files("SELECT * FROM numbered"),
    "line_numbering_rotated": with_lines("SELECT source_id, line_number, value FROM lines"),
    "parse_text_files": with_file_events(
        f"SELECT {SHORT}, ts AS timestamp, frame, {CONT} AS continuation, raw_text_hash FROM ev"
    ),
    "parse_compressed_files": with_file_events(
        f"SELECT {SHORT}, ts AS timestamp, frame, {CONT} AS continuation, raw_text_hash FROM ev"
    ),
    "skip_blank_lines": with_lines("SELECT source_id, line_number, value FROM lines WHERE trim(value) <> ''"),
    "source_contract": flat_events(),
    "ndjson_roundtrip": flat_events(),
    "sink_json": flat_events("true", ", 'logevent.v1' AS schema_version, cast(NULL AS varchar) AS relative_time").replace(
        "ts AS timestamp", f"{_iso('ts')} AS timestamp"
    ),
    "event_lake_loads": flat_events(
        "true", f", lower(category) AS category_key, cast({RANK} AS integer) AS severity_rank"
    ),
    "event_lake": flat_events(
        f"source_id = 'src1' AND lower(category) IN ('lognet', 'logonline') AND {RANK} >= 3",
        f", lower(category) AS category_key, cast({RANK} AS integer) AS severity_rank",
    ),
    "filter_text": with_events(
        f"SELECT source_id, line_number, line_number || ': [' || category || '] ' || verbosity || ': ' || "
        f"{red('message')} AS value FROM ev WHERE lower(category) NOT IN {NOISE} AND {RANK} >= 3"
    ),
    "clean_text": with_events(
        f"SELECT source_id, line_number, CASE WHEN count > 1 THEN '[' || count || 'x] ' ELSE '' END || category "
        f"|| ': ' || verbosity || ': ' || {red('message')} AS value FROM ({dedupe('ev', '*')})"
    ),
    "categories_text": with_events(
        f"SELECT name || chr(9) || count AS value FROM ({facet('category', where=f'lower(category) NOT IN {NOISE}')})"
    ),
    "facet_summary_json": with_events(
        "SELECT '{\"totalEvents\":' || count(*) || ',\"warningCount\":' || count(*) FILTER (lower(verbosity) = 'warning') "
        "|| ',\"errorCount\":' || count(*) FILTER (lower(verbosity) IN ('error', 'fatal')) "
        f"|| ',\"firstTimestamp\":\"' || {_iso('min(ts)')} || '\",\"lastTimestamp\":\"' || {_iso('max(ts)')} "
        f"|| '\",\"categoryCounts\":' || {_COUNTS_JSON.format(facet('category', 'kept'))} "
        f"|| ',\"verbosityCounts\":' || {_COUNTS_JSON.format(facet('verbosity', 'kept'))} || '}}' AS value FROM kept".replace(
            "'}}'", "'}'"
        ),
        f"kept AS (SELECT * FROM ev WHERE lower(category) NOT IN {NOISE})",
    ),
    "parse_prefix": with_events("SELECT source_id, line_number, ts AS timestamp, frame FROM ev"),
    "parse_events": short(extra=", 'logevent.v1' AS schema_version"),
    "parse_fallback": short("category = 'Unknown'", ", ts AS timestamp, frame"),
    "head_lines": with_events("SELECT source_id, line_number, is_head, value FROM flagged WHERE NOT blank"),
    "event_lines": with_events("SELECT source_id, event_line, is_head, value FROM owned"),
    "stitch_continuations": with_events(f"SELECT source_id, line_number, raw, {CONT} AS continuation FROM ev"),
    "event_chunks": with_events(f"SELECT source_id, line_number, raw, {CONT} AS continuation FROM ev"),
    "parse_no_continuation": with_events(
        flat("(SELECT e.* REPLACE ([] AS conts, '' AS raw_text_hash), coalesce(f.fields, '') AS fields "
             "FROM ev e LEFT JOIN ft f USING (source_id, line_number))"),
        *_FIELDS,
    ),
    "extract_fields": with_events(f"SELECT source_id, line_number, message, fields FROM {EV_FIELDS}", *_FIELDS),
    "extract_fields_documents": with_documents(
        "SELECT t.source_id, t.line_number, coalesce(f.fields, '') AS fields "
        "FROM tv t LEFT JOIN ft f USING (source_id, line_number)",
        pairs_cte("tv"),
        texts_cte(),
    ),
    "raw_hash": with_events("SELECT source_id, line_number, raw_text_hash FROM ev"),
    "redact_message": with_events(f"SELECT source_id, line_number, {red('message')} AS message FROM ev"),
    "redact_continuations": with_events(
        f"SELECT source_id, line_number, array_to_string({RED_CONTS}, {US}) AS continuation FROM ev"
    ),
    "redact_fields": with_events(f"SELECT source_id, line_number, fields FROM {EV_FIELDS}", *_RED_FIELDS),
    "redact_events": with_events(flat("rv"), *_RED_FIELDS, _RV),
    "redact_extended": with_events(
        f"SELECT source_id, line_number, category, verbosity, {red_more('message')} AS message FROM ev"
    ),
    "profile_fields": with_events(
        f"SELECT e.source_id, e.line_number, coalesce(string_agg(k || '=' || v, {US} ORDER BY k), '') AS fields "
        "FROM ev e LEFT JOIN final USING (source_id, line_number) GROUP BY ALL",
        pairs_cte("ev"),
        r"""found AS (
  SELECT source_id, line_number, 'Failure' AS k, regexp_extract(message, '(\w+Failure)\b', 1) AS v FROM ev
  WHERE regexp_matches(message, '(\w+Failure)\b')
  UNION ALL SELECT source_id, line_number, 'code', regexp_extract(message, 'code=(\d+)', 1) FROM ev
  WHERE regexp_matches(message, 'code=(\d+)')
  UNION ALL SELECT source_id, line_number, 'a', regexp_extract(message, '(?:^| )a=(\d)', 1) FROM ev
  WHERE regexp_matches(message, '(?:^| )a=(\d)')),
final AS (
  SELECT * FROM found
  UNION ALL SELECT kv.* FROM kv ANTI JOIN found USING (source_id, line_number, k))""",
    ),
    "severity_rank": with_events(
        f"SELECT verbosity, cast({RANK} AS bigint) AS rank, count(*) AS count FROM ev GROUP BY ALL"
    ),
    "filter_include": short("lower(category) IN ('lognet', 'logtravel')"),
    "filter_exclude": short("lower(category) NOT IN ('logslate', 'unknown')"),
    "filter_noise": short(f"lower(category) NOT IN {NOISE}"),
    "filter_noise_join": short(f"lower(category) NOT IN {NOISE}"),
    "filter_min_level": short(f"{RANK} >= 3"),
    "filter_contains": with_documents(f"SELECT {SHORT} FROM tv WHERE contains(lower(message), 'er th')"),
    "filter_time_window": with_events(
        f"SELECT {SHORT}, ts AS timestamp FROM eb "
        "WHERE base IS NULL OR (ts - base >= INTERVAL 1 MINUTE AND ts - base <= INTERVAL 3 DAY)",
        _BASE,
        _EB,
    ),
    "filter_time_window_untimed": with_documents("SELECT source_id, count(*) AS count FROM tv GROUP BY 1"),
    "base_timestamp": with_events("SELECT source_id, min(ts) AS base_timestamp FROM ev GROUP BY 1"),
    "base_timestamp_stored": with_events("SELECT source_id, min(ts) AS base_timestamp FROM ev GROUP BY 1"),
    "filter_compound": with_events(
        f"SELECT {SHORT}, ts AS timestamp FROM eb WHERE lower(category) IN ('lognet', 'logonline') AND {RANK} >= 2 "
        "AND contains(lower(message), 'session') AND (base IS NULL OR "
        "(ts >= base + INTERVAL 30 MINUTE AND ts <= base + INTERVAL 12 DAY))",
        _BASE,
        _EB,
    ),
    "important_events": short(IMPORTANT),
    "summary": with_events(
        f"""SELECT * FROM (
  SELECT 1 AS position, 'Total events' AS metric, count(*) AS value FROM ev
  UNION ALL SELECT 2, 'Warnings', count(*) FROM ev WHERE lower(verbosity) = 'warning'
  UNION ALL SELECT 3, 'Errors', count(*) FROM ev WHERE lower(verbosity) IN ('error', 'fatal')
  UNION ALL SELECT 4, 'Important events', count(*) FROM ev WHERE {IMPORTANT})"""
    ),
    "summary_row": with_events(
        "SELECT count(*) AS total_events, count(*) FILTER (lower(verbosity) = 'warning') AS warning_count, "
        "count(*) FILTER (lower(verbosity) IN ('error', 'fatal')) AS error_count, min(ts) AS first_timestamp, "
        "max(ts) AS last_timestamp FROM ev"
    ),
    "facet_category": with_events(facet("category")),
    "facet_verbosity": with_events(facet("verbosity", key="source_id")),
    "facet_category_denoised": with_events(facet("category", where=f"lower(category) NOT IN {NOISE}")),
    "important_count": with_events(f"SELECT count(*) AS important_events FROM ev WHERE {IMPORTANT}"),
    "faceted_search": with_events(
        f"SELECT name, count, 'facet' AS part FROM ({facet('category', where=f'lower(category) NOT IN {NOISE}')}) "
        f"UNION ALL SELECT lower(category), count(*), 'match' FROM ev WHERE lower(category) NOT IN {NOISE} "
        f"AND {RANK} >= 4 GROUP BY 1"
    ),
    "top_repeated": with_events(
        f"""SELECT category, verbosity, message, continuation, count FROM (
  SELECT category, verbosity, {red('message')} AS message, array_to_string({RED_CONTS}, {US}) AS continuation,
    count(*) AS count, min((source_id, line_number)) AS first FROM ev GROUP BY ALL ORDER BY count DESC, first LIMIT 20)""".replace(
            "GROUP BY ALL", "GROUP BY 1, 2, 3, 4"
        )
    ),
    "top_repeated_documents": with_documents(
        f"""SELECT category, verbosity, message, continuation, count FROM (
  SELECT category, verbosity, {red('message')} AS message, '' AS continuation,
    count(*) AS count, min((source_id, line_number)) AS first FROM tv GROUP BY 1, 2, 3, 4
  ORDER BY count DESC, first LIMIT 50)"""
    ),
    "suppressed_counts": with_events(
        f"""SELECT first(category ORDER BY source_id, line_number) AS category, count(*) AS suppressed,
  min(ts) AS first_timestamp, max(ts) AS last_timestamp, {ms_between('min(ts)', 'max(ts)')} AS duration_ms
FROM ev WHERE lower(category) IN {NOISE} GROUP BY lower(category)"""
    ),
    "log_metadata": with_events(
        f"""SELECT e.source_id, count(*) AS event_count, count(DISTINCT lower(category)) AS category_count,
  min(ts) AS first_timestamp, max(ts) AS last_timestamp, {ms_between('min(ts)', 'max(ts)')} AS duration_ms,
  any_value(p.physical_lines) AS physical_lines
FROM ev e JOIN (SELECT source_id, count(*) AS physical_lines FROM lines GROUP BY 1) p USING (source_id) GROUP BY 1"""
    ),
    "dedupe_none": short(extra=", cast(1 AS bigint) AS count"),
    "dedupe_exact": with_events(
        dedupe(
            EV_FIELDS,
            "source_id, source_path, line_number, ts AS timestamp, frame, category, verbosity, message, "
            "ctext AS continuation, fields, raw_text_hash",
        ),
        *_FIELDS,
    ),
    "dedupe_exact_documents": with_documents(dedupe("(SELECT *, [] AS conts FROM tv)", SHORT)),
    "dedupe_profile": with_events(
        dedupe("rp", SHORT),
        *_RED_FIELDS,
        _RV,
        r"""rp AS (SELECT * REPLACE (regexp_replace(regexp_replace(message, 'code=\d+', '<code>', 'g'),
  'after -?\d+', '<delay>', 'g') AS message) FROM rv)""",
    ),
    "dedupe_normalized": with_events(
        dedupe(
            "rv",
            "source_id, source_path, line_number, ts AS timestamp, frame, category, verbosity, message, "
            "ctext AS continuation, fields, raw_text_hash",
        ),
        *_RED_FIELDS,
        _RV,
    ),
    "dedupe_burst": with_events(f"SELECT {SHORT}, first_ts AS timestamp, count FROM bursts", _BURST),
    "burst_span": with_events(
        f"SELECT {SHORT}, count, {ms_between('first_ts', 'last_ts')} AS span_ms FROM bursts WHERE count > 1", _BURST
    ),
    "page": with_events(
        f"SELECT {SHORT}, (SELECT count(*) FROM ev WHERE {RANK} >= 3) AS total_matches FROM ev WHERE {RANK} >= 3 "
        "ORDER BY source_id, line_number LIMIT 30 OFFSET 20"
    ),
    "page_deep": with_events(f"SELECT {SHORT} FROM ev ORDER BY source_id, line_number LIMIT 40 OFFSET 500"),
    "context_window": with_events(
        f"""SELECT {SHORT} FROM ix WHERE source_id = 'src1' AND idx BETWEEN
  (SELECT idx FROM ix WHERE source_id = 'src1' AND line_number = 40) - 5 AND
  (SELECT idx FROM ix WHERE source_id = 'src1' AND line_number = 40) + 7""",
        _INDEXED,
    ),
    "context_multi": with_events(
        """SELECT i.source_id, i.line_number, i.category, i.verbosity, i.message, a.line_number AS anchor_line
FROM ix a JOIN ix i ON i.source_id = a.source_id AND i.idx BETWEEN a.idx - 2 AND a.idx + 3
WHERE lower(a.verbosity) = 'fatal'""",
        _INDEXED,
    ),
    "preview": with_documents(
        """SELECT source_id, line_number, printf('%6d %-18s %-7s ', line_number, category, verbosity)
  || CASE WHEN length(message) <= 100 THEN message ELSE left(message, 99) || '...' END AS row
FROM tv ORDER BY source_id, line_number LIMIT 500"""
    ),
    "time_gaps": with_events(
        f"""SELECT source_id, previous_line, line_number, previous_timestamp, ts AS timestamp,
  {ms_between('previous_timestamp', 'ts')} AS gap_ms
FROM (SELECT *, lag(line_number) OVER o AS previous_line, lag(ts) OVER o AS previous_timestamp FROM ev
  WHERE ts IS NOT NULL WINDOW o AS (PARTITION BY source_id ORDER BY line_number))
WHERE ts - previous_timestamp > INTERVAL 1 HOUR"""
    ),
    "relative_time": with_events(
        f"SELECT source_id, line_number, {ms_between('base', 'ts')} AS relative_ms FROM eb", _BASE, _EB
    ),
    "semantic_match": with_events(
        f"SELECT {SHORT}, rule_id, kind, severity, reason, confidence FROM hits", _RANKED, _RULES
    ),
    "semantic_fallback": with_events(f"SELECT {SHORT}, kind, severity FROM fallback", _RANKED, _RULES),
    "semantic_findings": with_events("SELECT kind, count(*) AS count FROM findings GROUP BY 1", _RANKED, _RULES),
    "first_failure": with_events(
        f"""SELECT source_id, line_number, ts AS timestamp, category, verbosity, message, rule_id, kind, severity, reason,
  confidence FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY urgency, line_number, rule_id) AS rn
  FROM findings WHERE urgency IS NOT NULL) WHERE rn = 1""",
        _RANKED,
        _RULES,
    ),
    "first_failure_by_system": with_events(
        """SELECT source_id, system, line_number, kind, severity, rule_id FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, system ORDER BY urgency, line_number, rule_id) AS rn
  FROM (SELECT *, split_part(kind, '.', 1) AS system FROM findings WHERE urgency IS NOT NULL)) WHERE rn = 1""",
        _RANKED,
        _RULES,
    ),
    "timeline": with_events(
        f"""SELECT source_id, line_number, ts AS timestamp, category, verbosity, message, kinds, is_important FROM (
  SELECT e.*, {IMPORTANT} AS is_important, coalesce(k.kinds, '') AS kinds,
    row_number() OVER (PARTITION BY source_id ORDER BY line_number) AS rn
  FROM ev e LEFT JOIN (
    SELECT source_id, line_number, string_agg(kind, ',' ORDER BY CASE rule_id WHEN 'net.failure' THEN 1
      WHEN 'session.join' THEN 2 WHEN 'login.failed' THEN 3 WHEN 'travel.failure' THEN 4 ELSE 5 END) AS kinds
    FROM findings GROUP BY ALL) k USING (source_id, line_number)
  WHERE k.kinds IS NOT NULL OR {IMPORTANT}) WHERE rn <= 25""",
        _RANKED,
        _RULES,
    ),
    "report_markdown": with_events(
        f"""SELECT source_id, c || coalesce(chr(10) || chr(10) || f, '') || coalesce(chr(10) || chr(10) || k, '')
  || coalesce(chr(10) || chr(10) || t, '') AS report
FROM (SELECT source_id, 'Total events: ' || count(*) || chr(10) || 'Warnings: '
    || count(*) FILTER (lower(verbosity) = 'warning') || chr(10) || 'Errors: '
    || count(*) FILTER (lower(verbosity) IN ('error', 'fatal')) || chr(10) || 'Important events: '
    || count(*) FILTER ({IMPORTANT}) AS c FROM ev GROUP BY 1)
LEFT JOIN (SELECT source_id, 'First likely failure:' || chr(10) || '- [' || line_number || '] ' || kind || ' '
    || severity || ': ' || reason AS f
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY urgency, line_number, rule_id) AS rn
    FROM findings WHERE urgency IS NOT NULL) WHERE rn = 1) USING (source_id)
LEFT JOIN (SELECT source_id, 'Semantic findings:' || chr(10)
    || string_agg('- ' || kind || ': ' || n, chr(10) ORDER BY n DESC, kind) AS k
  FROM (SELECT source_id, kind, count(*) AS n FROM findings GROUP BY ALL) GROUP BY 1) USING (source_id)
LEFT JOIN (SELECT source_id, 'Important timeline:' || chr(10) || string_agg('- [' || line_number || '] ' || category
    || ' ' || verbosity || ': ' || message, chr(10) ORDER BY line_number) AS t
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY line_number) AS rn FROM ev
    WHERE {IMPORTANT} OR (source_id, line_number) IN (SELECT (source_id, line_number) FROM findings))
  WHERE rn <= 5 GROUP BY 1) USING (source_id)""",
        _RANKED,
        _RULES,
    ),
    "compare_by_time": with_events(
        """SELECT l.line_number AS left_line, l.ts AS left_timestamp, r.line_number AS right_line,
  r.ts AS right_timestamp
FROM (SELECT * FROM ev WHERE source_id = 'src0' AND ts IS NOT NULL) l
ASOF LEFT JOIN (SELECT ts, max(line_number) AS line_number FROM ev WHERE source_id = 'src1' AND ts IS NOT NULL
  GROUP BY 1) r ON l.ts >= r.ts"""
    ),
    "compare_by_order": with_events(
        "SELECT event_index, left_line, right_line, same FROM pairs", _REDACT_KEYS, _ORDER_PAIRS
    ),
    "compare_divergence": with_events(
        """SELECT 'src0|src1' AS pair, d.*, lf.line_number AS left_failure_line, lf.kind AS left_failure_kind,
  rf.line_number AS right_failure_line, rf.kind AS right_failure_kind,
  CASE WHEN lf.line_number IS NOT NULL AND rf.line_number IS NULL
      AND (SELECT max(ts) FROM ev WHERE source_id = 'src1') > lf.ts THEN 'src1'
    WHEN rf.line_number IS NOT NULL AND lf.line_number IS NULL
      AND (SELECT max(ts) FROM ev WHERE source_id = 'src0') > rf.ts THEN 'src0' END AS continued
FROM (SELECT event_index, left_line, right_line FROM pairs WHERE NOT same ORDER BY event_index LIMIT 1) d
LEFT JOIN (SELECT * FROM ff WHERE source_id = 'src0') lf ON true
LEFT JOIN (SELECT * FROM ff WHERE source_id = 'src1') rf ON true""",
        _RANKED,
        _RULES,
        _REDACT_KEYS,
        _ORDER_PAIRS,
        """ff AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY urgency, line_number, rule_id) AS rn
  FROM findings WHERE urgency IS NOT NULL) WHERE rn = 1)""",
    ),
    "stream_redact": with_events(f"{flat('rv')} WHERE {RANK} >= 3", *_RED_FIELDS, _RV),
    "stream_burst": with_events(
        f"""SELECT source_id, category, verbosity, message, ctext AS continuation, min(ts) AS first_timestamp,
  max(ts) AS last_timestamp, count(*) AS count,
  max(ts) + INTERVAL 10 SECOND < (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR AS closed
FROM (SELECT *, sum(CASE WHEN ts - pts <= INTERVAL 10 SECOND THEN 0 ELSE 1 END) OVER (
    PARTITION BY source_id, category, verbosity, message, ctext ORDER BY ts, line_number ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT *, {CONT} AS ctext, lag(ts) OVER (PARTITION BY source_id, category, verbosity, message, {CONT}
      ORDER BY ts, line_number) AS pts FROM ev WHERE ts IS NOT NULL))
GROUP BY source_id, category, verbosity, message, ctext, s"""
    ),
}

for _name in ("filter_text", "clean_text"):
    ORACLES[f"{_name}_file"] = (
        f"SELECT row_number() OVER (ORDER BY source_id, line_number) AS line_number, value FROM ({ORACLES[_name]})"
    )
