"""The SQL each catalog query must equal.

Written against the test tables alone: expected columns are computed from the
tables' own columns, never by parsing a rendered line.
"""

from __future__ import annotations

from collections.abc import Iterable

_BASE = """
ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id % 250 AS u FROM events
),
sys AS (
  SELECT event_id, event_id + 1 AS id, ts AS c_isodate, ts AS r_isodate,
         ts - to_seconds(user_id % 5) AS s_isodate,
         CASE WHEN event_type IN ('error', 'signup') THEN 'auth' WHEN event_type = 'click' THEN 'mail'
              ELSE 'daemon' END AS facility,
         'web' || (user_id % 9) AS host, 'relay' || (user_id % 2) AS host_from,
         CASE WHEN value >= 2 AND value < 5 THEN NULL ELSE 1000 + event_id END AS pid,
         CASE WHEN event_type = 'error' THEN 'err' ELSE 'info' END AS priority,
         CASE event_type WHEN 'error' THEN 'sshd' WHEN 'signup' THEN 'sshd-session' WHEN 'view' THEN 'nginx'
              WHEN 'click' THEN 'postfix/smtpd' ELSE 'cron' END AS program,
         '10.0.' || (user_id % 4) || '.' || u AS sourceip,
         event_type IN ('error', 'signup') AS is_sshd,
         CASE WHEN event_type IN ('error', 'signup')
              THEN 'Failed password for invalid user u' || user_id || ' from 203.0.113.' || u || ' port '
                   || (40000 + event_id % 1000) || ' ssh2'
              ELSE event_type || ' by user ' || user_id || ' for ' || CAST(round(value * 100) AS BIGINT)
         END AS message,
         CASE WHEN event_type = 'click' OR (event_type = 'view' AND value >= 10 AND value < 20) THEN NULL
              WHEN event_type = 'signup' THEN k || '.0' ELSE CAST(k AS VARCHAR) END AS k_text,
         CASE WHEN event_type IN ('click', 'purchase') OR (event_type = 'view' AND value >= 10 AND value < 20)
              THEN NULL ELSE k END AS k_number,
         round(value * 100) AS vx, event_type || '-' || k AS tag, user_id, k, u, event_type, value
  FROM ev WHERE value >= 2
),
acc AS (
  SELECT event_id, event_id + 1 AS id, ts AS r_isodate, user_id, k, value < 1 AS bad, event_type,
         CASE WHEN value < 1 THEN NULL ELSE date_trunc('second', ts) END AS req_isodate,
         'web01' AS host, 'www.example.com' AS vhost, CAST(443 AS INTEGER) AS vhost_port,
         CASE WHEN value < 1 THEN NULL WHEN user_id % 2 = 0 THEN '81.2.69.' || u ELSE '10.9.8.' || u END AS client_ip,
         CASE WHEN value < 1 THEN NULL ELSE '-' END AS ident,
         CASE WHEN value < 1 THEN NULL WHEN event_type = 'signup' THEN 'frank' ELSE '-' END AS auth,
         CASE WHEN value < 1 THEN NULL WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method,
         CASE WHEN value < 1 THEN NULL ELSE '/item/' || k END AS request,
         CASE WHEN value < 1 THEN NULL ELSE '1.1' END AS http_version,
         CAST(CASE WHEN value < 1 THEN NULL WHEN event_type = 'error' THEN 500 WHEN event_type = 'view' THEN 304
              WHEN event_type = 'click' THEN 200 WHEN event_type = 'signup' THEN 302 ELSE 404 END AS INTEGER) AS status,
         CASE WHEN value < 1 OR event_type = 'view' THEN NULL ELSE 100 + event_id % 5000 END AS bytes,
         CASE WHEN value < 1 OR event_type IN ('view', 'click') THEN NULL
              ELSE 'https://example.org/?u=' || user_id END AS referrer,
         CASE WHEN value < 1 OR event_type IN ('view', 'click') THEN NULL
              ELSE 'agent/' || k || ' (\\"quoted\\")' END AS user_agent,
         CASE WHEN value < 1 OR user_id % 2 = 1 OR u > 255 THEN NULL
              WHEN u BETWEEN 160 AND 191 THEN 'IE' ELSE 'GB' END AS country
  FROM ev
),
err AS (
  SELECT event_id, event_id + 1 AS id, ts AS r_isodate, user_id, k, value < 1 AS bad,
         CASE WHEN value < 1 THEN 'none' WHEN event_type IN ('error', 'view') THEN 'new'
              WHEN event_type IN ('click', 'signup') THEN 'old' ELSE 'nginx' END AS layout, ts, u
  FROM ev
),
errs AS (
  SELECT id, r_isodate,
         CASE layout WHEN 'none' THEN NULL WHEN 'new' THEN ts ELSE date_trunc('second', ts) END AS err_isodate,
         'web01' AS host, 'www.example.com' AS vhost, CAST(443 AS INTEGER) AS vhost_port,
         CASE layout WHEN 'new' THEN '81.2.69.' || u WHEN 'old' THEN '10.9.8.' || u
              WHEN 'nginx' THEN '203.0.113.' || u END AS client_ip,
         CASE layout WHEN 'new' THEN 'error' WHEN 'old' THEN 'warn' WHEN 'nginx' THEN 'crit' END AS loglevel,
         CASE WHEN layout IN ('new', 'nginx') THEN 1000 + event_id END AS pid,
         CASE WHEN layout = 'new' THEN 'AH00' || (100 + k) END AS code,
         CASE WHEN layout = 'nginx' THEN 's' || (user_id % 4) || '.example.com' END AS server,
         CASE WHEN layout = 'nginx' THEN 'GET /x/' || k || ' HTTP/1.1' END AS request,
         CASE WHEN layout IN ('new', 'old') THEN 'File does not exist: /var/www/' || k
              WHEN layout = 'nginx' THEN 'open() "/x/' || k || '" failed (2: No such file or directory)' END AS message,
         CASE WHEN layout = 'new' THEN CASE WHEN u BETWEEN 160 AND 191 THEN 'IE' ELSE 'GB' END
              WHEN layout = 'nginx' THEN CASE WHEN u < 128 THEN 'AU' ELSE 'NZ' END END AS country,
         event_id, user_id, k, u, layout, ts
  FROM err
)
"""

_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def _since(column: str, interval: str) -> str:
    return f"{column} >= {_AS_OF} - INTERVAL '{interval}'"


_SYSLOG_COLUMNS = "c_isodate, r_isodate, s_isodate, facility, host, host_from, pid, priority, program, sourceip"
_ACCESS_COLUMNS = (
    "r_isodate, req_isodate, host, vhost, vhost_port, client_ip, ident, auth, method, request, http_version,"
    " status, bytes, referrer, user_agent"
)
_ERROR_COLUMNS = (
    "r_isodate, err_isodate, host, vhost, vhost_port, client_ip, loglevel, pid, code, server, request, message"
)

_SSH_FIELDS = (
    """json_object('ssh_src_ip', '203.0.113.' || u, 'ssh_src_port', 40000 + event_id % 1000,"""
    """ 'ssh_user', 'u' || user_id)"""
)

# The enriched block the rendered record carries itself, keys sorted.
_OWN_BLOCK = """
'{' || CASE WHEN event_type = 'click' THEN ''
            WHEN event_type = 'purchase' THEN '"k":"' || k || '",'
            WHEN event_type = 'view' AND vx >= 1000 AND vx < 2000 THEN '"k":null,'
            ELSE '"k":' || k || ',' END
    || '"tag":"' || tag || '","v.x":' || CAST(vx AS BIGINT) || '}'
"""

_ACCESS_LINE = r"""
CASE WHEN bad THEN 'garbage ' || event_id ELSE
  client_ip || ' - ' || auth || ' ['
  || CASE WHEN event_type = 'error' THEN strftime(r_isodate - INTERVAL '7 hours', '%d/%b/%Y:%H:%M:%S') || ' -0700'
          ELSE strftime(r_isodate, '%d/%b/%Y:%H:%M:%S') || ' +0000' END
  || '] "' || method || ' ' || request || ' HTTP/1.1" ' || status || ' ' || coalesce(CAST(bytes AS VARCHAR), '-')
  || CASE WHEN event_type IN ('view', 'click') THEN '' ELSE ' "' || referrer || '" "' || user_agent || '"' END
END
"""

_ACCESS_TIME = """
CASE WHEN event_type = 'error' THEN strftime(r_isodate - INTERVAL '7 hours', '%d/%b/%Y:%H:%M:%S') || ' -0700'
     ELSE strftime(r_isodate, '%d/%b/%Y:%H:%M:%S') || ' +0000' END
"""

_STAMP = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"

# The line a good syslog row was read from, which is what its record keeps.
_SYSLOG_RAW = f"""
'{{"C_ISODATE":"' || {_STAMP.format("c_isodate")} || '","R_ISODATE":"' || {_STAMP.format("r_isodate")}
  || '","S_ISODATE":"' || {_STAMP.format("s_isodate")} || '","FACILITY":"' || facility || '","HOST":"' || host
  || '","HOST_FROM":"' || host_from || '","PRIORITY":"' || priority || '","PROGRAM":"' || program
  || '","SOURCEIP":"' || sourceip
  || CASE WHEN value < 3 THEN '","PID":"7120033.250117' WHEN value < 4 THEN ''
          WHEN value < 5 THEN '","PID":"9223372036854775808' ELSE '","PID":"' || (1000 + event_id) END
  || '","MESSAGE":"' || message || '","enriched":{{'
  || CASE WHEN event_type = 'click' THEN '' WHEN event_type = 'purchase' THEN '"k":"' || k || '",'
          WHEN event_type = 'signup' THEN '"k":' || k || '.0,'
          WHEN event_type = 'view' AND value >= 10 AND value < 20 THEN '"k":null,' ELSE '"k":' || k || ',' END
  || '"v.x":' || CAST(CAST(vx AS DOUBLE) AS VARCHAR) || ',"tag":"' || tag || '"}}}}'
"""

_NEW_TIME = "strftime(ts, '%a %b %d %H:%M:%S.%f %Y')"
_OLD_TIME = "strftime(ts, '%a %b %d %H:%M:%S %Y')"
_NGINX_TIME = "strftime(ts, '%Y/%m/%d %H:%M:%S')"

# The record of an error line: the line, then the fields found in it.
_ERROR_RAW = f"""
CASE layout
  WHEN 'none' THEN '{{"MESSAGE":"garbage ' || event_id || '"}}'
  WHEN 'new' THEN '{{"MESSAGE":"[' || {_NEW_TIME} || '] [core:error] [pid ' || pid || ':tid 140' || event_id || '] [client '
    || client_ip || ':' || (1024 + event_id % 5000) || '] ' || code || ': ' || message
    || '","enriched":{{"http_error_client_ip":"' || client_ip || '","http_error_client_port":' || (1024 + event_id % 5000)
    || ',"http_error_code":"' || code || '","http_error_loglevel":"error","http_error_message":"' || message
    || '","http_error_module":"core","http_error_pid":' || pid || ',"http_error_tid":140' || event_id
    || ',"http_error_timestamp":"' || {_NEW_TIME} || '"}}}}'
  WHEN 'old' THEN '{{"MESSAGE":"[' || {_OLD_TIME} || '] [warn] [client ' || client_ip || '] ' || message
    || '","enriched":{{"http_error_client_ip":"' || client_ip || '","http_error_loglevel":"warn","http_error_message":"'
    || message || '","http_error_timestamp":"' || {_OLD_TIME} || '"}}}}'
  ELSE '{{"MESSAGE":' || CAST(to_json({_NGINX_TIME} || ' [crit] ' || pid || '#0: *' || event_id || ' ' || message
    || ', client: ' || client_ip || ', server: ' || server || ', request: "' || request || '", host: "h' || (user_id % 4)
    || '.example.com"') AS VARCHAR) || ',"enriched":{{"http_error_client_ip":"' || client_ip
    || '","http_error_connection":' || event_id || ',"http_error_host":"h' || (user_id % 4)
    || '.example.com","http_error_loglevel":"crit","http_error_message":' || CAST(to_json(message) AS VARCHAR)
    || ',"http_error_pid":' || pid || ',"http_error_request":"' || request || '","http_error_server":"' || server
    || '","http_error_tid":0,"http_error_timestamp":"' || {_NGINX_TIME} || '"}}}}'
END
"""

_SQUASHED = r"regexp_replace({}, '[\r\n\t]+', ' ', 'g')"

_HALF = "TIMESTAMP '2024-01-16 00:00:00'"

_STORE_IDS = "row_number() OVER (ORDER BY r_isodate, event_id) AS sid"

_ORACLES: dict[str, str] = {
    "syslog_ingest": f"SELECT id, {_SYSLOG_COLUMNS}, {_SYSLOG_RAW} AS raw FROM sys",
    "syslog_rejects": """
        SELECT CASE WHEN value < 0.25 THEN 'C_ISODATE is not a time' WHEN value < 0.5 THEN 'not valid JSON' WHEN value < 1 THEN 'PROGRAM is missing'
                    WHEN value < 1.5 THEN 'not a JSON object' ELSE 'HOST is missing' END AS reject_reason,
               count(*) AS n
        FROM ev WHERE value < 2 GROUP BY 1""",
    "ingest_counts": "SELECT count(*) FILTER (value >= 2) AS ingested, count(*) AS total FROM ev",
    "http_access_ingest": f"SELECT id, {_ACCESS_COLUMNS} FROM acc",
    "http_error_ingest": f"SELECT id, {_ERROR_COLUMNS}, {_ERROR_RAW} AS raw FROM errs",
    "http_raw_record": f"""
        SELECT id, CASE WHEN bad THEN CAST(json_object('MESSAGE', {_ACCESS_LINE}) AS VARCHAR)
          ELSE rtrim(CAST(json_object('MESSAGE', {_ACCESS_LINE}) AS VARCHAR), '}}') || ',"enriched":{{'
            || CASE WHEN user_agent IS NULL THEN '' ELSE '"http_agent":' || CAST(to_json(user_agent) AS VARCHAR) || ',' END
            || '"http_auth":"' || auth || '",'
            || CASE WHEN bytes IS NULL THEN '' ELSE '"http_bytes":' || bytes || ',' END
            || '"http_clientip":"' || client_ip || '","http_httpversion":"1.1","http_ident":"-",'
            || CASE WHEN referrer IS NULL THEN '' ELSE '"http_referrer":"' || referrer || '",' END
            || '"http_request":"' || request || '","http_response":' || status
            || ',"http_timestamp":"' || {_ACCESS_TIME} || '","http_verb":"' || method || '"}}}}' END AS raw
        FROM acc""",
    "vhost_from_path": """
        SELECT 'www' || (user_id % 4) || '.example.com' AS vhost, CAST(443 AS INTEGER) AS vhost_port, count(*) AS n
        FROM ev GROUP BY 1, 2""",
    "web_sets_ingest": """
        SELECT vhost, vhost_port, country, count(*) AS n, 'access' AS kind FROM acc GROUP BY 1, 2, 3
        UNION ALL
        SELECT 'plain', CAST(8080 AS INTEGER), NULL, count(*), 'access' FROM acc WHERE user_id % 4 = 1
        UNION ALL
        SELECT vhost, vhost_port, country, count(*), 'error' FROM errs GROUP BY 1, 2, 3""",
    "display_syslog": "SELECT id, s_isodate AS time, host, program, message FROM sys",
    "tsv_rows": f"""
        SELECT doc_id || chr(9) || '2024-01-01 00:00:00' || chr(9) || source || chr(9) || lang || chr(9) || {_SQUASHED.format("text")} AS line
        FROM documents""",
    "json_rows": """
        SELECT '{"MESSAGE":"' || m || '","enriched":{"http_error_client_ip":"' || client_ip
          || '","http_error_client_port":' || (1024 + event_id % 5000) || ',"http_error_code":"' || code
          || '","http_error_loglevel":"error","http_error_message":"' || message
          || '","http_error_module":"core","http_error_pid":' || pid || ',"http_error_tid":140' || event_id
          || ',"http_error_timestamp":"' || stamp || '"}}' AS line
        FROM (SELECT *, strftime(ts, '%a %b %d %H:%M:%S.%f %Y') AS stamp,
                     '[' || strftime(ts, '%a %b %d %H:%M:%S.%f %Y') || '] [core:error] [pid ' || pid || ':tid 140' || event_id
                     || '] [client ' || client_ip || ':' || (1024 + event_id % 5000) || '] ' || code || ': ' || message AS m
              FROM errs WHERE code = 'AH00150')""",
    "adhoc_sql": """
        SELECT host, CAST(r_isodate AS DATE) AS day, count(*) AS n, max(r_isodate) AS latest,
               count(DISTINCT sourceip) AS senders
        FROM sys WHERE facility = 'mail' GROUP BY 1, 2""",
    "adhoc_record_path": """
        SELECT tag, CASE WHEN k_text IS NOT NULL THEN k END AS k, host, count(*) AS n, CAST(0 AS BIGINT) AS absent
        FROM sys GROUP BY 1, 2, 3""",
    "field_repeated_key": """
        SELECT 'tag=view-7' AS field, id FROM sys WHERE tag = 'view-7'
        UNION ALL SELECT 'tag!=view-7', id FROM sys WHERE tag <> 'view-7'
        UNION ALL SELECT 'tag~^view-[12]', id FROM sys WHERE regexp_matches(tag, '^view-[12]')
        UNION ALL SELECT 'tag!~^view', id FROM sys WHERE NOT regexp_matches(tag, '^view')
        UNION ALL SELECT 'tag=~W-2', id FROM sys WHERE tag ILIKE '%W-2%'
        UNION ALL SELECT 'tag>purchase-5', id FROM sys WHERE tag > 'purchase-5'
        UNION ALL SELECT 'tag=old', id FROM sys WHERE tag = 'old'""",
    "search_http_status": "SELECT id, client_ip, status, request FROM acc WHERE status = 404 AND method = 'POST'",
    "search_program_like": "SELECT id, program, host FROM sys WHERE program LIKE 'sshd%' AND host = 'web3'",
    "search_message": "SELECT doc_id AS id, lang AS program FROM documents WHERE text ILIKE '%The_of%'",
    "search_since": f"SELECT id, s_isodate, program FROM sys WHERE {_since('s_isodate', '36 hours')}",
    "field_eq": "SELECT id, program FROM sys WHERE tag = 'view-7'",
    "field_eq_numeric": "SELECT id, program FROM sys WHERE k_number = 38 OR (event_type = 'purchase' AND k = 38)",
    "field_ne": "SELECT id, program FROM sys WHERE k_text IS DISTINCT FROM '38'",
    "field_regex": "SELECT id, program FROM sys WHERE regexp_matches(tag, '^(view|click)-[12][0-9]$')",
    "field_not_regex": "SELECT id, program FROM sys WHERE NOT regexp_matches(k_text, '^[0-4]')",
    "field_regex_words": r"SELECT id, program FROM sys WHERE regexp_matches(tag, '\bview\b|\b1[0-9]$')",
    "field_regex_classes": """
        SELECT id, program FROM sys WHERE length(split_part(tag, '-', 1)) IN (4, 5) AND length(split_part(tag, '-', 2)) = 2
          AND split_part(tag, '-', 2) NOT LIKE '4%'""",
    "field_regex_literal": "SELECT id, program FROM sys WHERE contains(tag, 'w-1')",
    "field_contains": "SELECT id, program FROM sys WHERE tag ILIKE '%W-2%'",
    "field_gt_numeric": "SELECT id, program FROM sys WHERE k_number > 41.5",
    "field_gt_text": "SELECT id, program FROM sys WHERE tag > 'purchase-5'",
    "field_dotted_key": "SELECT id, program FROM sys WHERE vx >= 2500 AND vx < 5000",
    "field_multi": f"""
        SELECT id, program FROM sys WHERE k_number >= 20 AND tag <> 'error-38' AND program LIKE 'sshd%'
          AND {_since("s_isodate", "10 days")} AND message ILIKE '%FAILED%port 40%'""",
    "search_newest": """
        SELECT id, s_isodate AS time, host, program, message FROM sys WHERE program = 'nginx' ORDER BY id DESC LIMIT 50""",
    "search_oldest": """
        SELECT id, err_isodate AS time, loglevel AS level, client_ip AS client, code, message
        FROM errs WHERE loglevel = 'crit' ORDER BY id LIMIT 20""",
    "tail_last": """
        SELECT id, r_isodate AS time, vhost, client_ip AS client, status, method, request
        FROM acc WHERE status = 500 ORDER BY id DESC LIMIT 10""",
    "tail_after_cursor": f"""
        SELECT id, s_isodate AS time, host, program, message FROM sys
        WHERE id > 500 AND program = 'cron' AND {_since("s_isodate", "20 days")}""",
    "stats_program": 'SELECT program AS key, count(*) AS "count" FROM sys GROUP BY 1',
    "stats_status": """
        SELECT coalesce(CAST(status AS VARCHAR), '(null)') AS key, count(*) AS "count" FROM acc GROUP BY 1""",
    "stats_code": """
        SELECT code AS key, count(*) AS "count" FROM errs GROUP BY 1
        ORDER BY 2 DESC, 1 ASC NULLS LAST LIMIT 40""",
    "stats_host_since": f"""
        SELECT host AS key, count(*) AS "count" FROM sys WHERE {_since("s_isodate", "5 days")}
        GROUP BY 1 ORDER BY 2 DESC, 1 ASC NULLS LAST LIMIT 5""",
    "top_values_window": f"""
        SELECT client_ip AS key, count(*) AS "count" FROM acc WHERE {_since("r_isodate", "7 days")}
        GROUP BY 1 ORDER BY 2 DESC, 1 ASC NULLS LAST LIMIT 30""",
    "distinct_hosts_window": f"""
        SELECT 'host' AS dimension, count(DISTINCT host) AS n FROM sys WHERE {_since("r_isodate", "24 hours")}
        UNION ALL
        SELECT 'program', count(DISTINCT program) FROM sys WHERE {_since("r_isodate", "30 days")}
        UNION ALL
        SELECT 'client_ip', count(DISTINCT client_ip) FROM acc WHERE {_since("r_isodate", "3 days")}""",
    "distinct_sketched_window": f"""
        SELECT 'host' AS dimension, '24h' AS since, count(DISTINCT host) AS n, TRUE AS near FROM sys WHERE {_since("r_isodate", "24 hours")}
        UNION ALL
        SELECT 'program', '30d', count(DISTINCT program), TRUE FROM sys WHERE {_since("r_isodate", "30 days")}
        UNION ALL
        SELECT 'client_ip', '30d', count(DISTINCT client_ip), TRUE FROM acc WHERE {_since("r_isodate", "30 days")}
        UNION ALL
        SELECT 'client_ip', '100h', count(DISTINCT client_ip), TRUE FROM acc WHERE {_since("r_isodate", "100 hours")}""",
    "countries_window": f"""
        SELECT country, count(*) AS "count" FROM acc WHERE {_since("r_isodate", "14 days")} GROUP BY 1""",
    "file_outcomes": """
        SELECT event_type, 'read' AS status, count(*) AS lines FROM events GROUP BY 1
        UNION ALL VALUES ('broken', 'unreadable', 0), ('none', 'missing', 0)""",
    "geoip_networks": """
        SELECT event_id + 1 AS id, CASE event_id % 8
          WHEN 0 THEN '2001:db8:' || lower(hex(c_nationkey)) || ':0:0:' || lower(hex(c_custkey)) || '::' || lower(hex(event_id % 4096))
          WHEN 1 THEN '2001:0DB8:' || lpad(hex(c_nationkey), 4, '0') || ':0000:0000:' || lpad(hex(c_custkey), 4, '0') || ':0000:0001'
          WHEN 2 THEN '2001:db8:' || lower(hex(c_nationkey)) || ':ffff::' || lower(hex(event_id % 4096))
          WHEN 3 THEN '10.' || c_nationkey || '.0.' || event_id % 32
          WHEN 4 THEN '10.' || c_nationkey || '.' || c_custkey || '.' || event_id % 256
          WHEN 5 THEN '::ffff:10.' || c_nationkey || '.' || c_custkey || '.9' WHEN 6 THEN '2001:db9::1' ELSE 'unknown' END AS address,
          CASE WHEN event_id % 8 > 5 THEN NULL WHEN event_id % 8 = 3 AND event_id % 32 BETWEEN 7 AND 19 THEN 'R' || c_nationkey
               ELSE 'N' || c_nationkey END AS country,
          CASE WHEN event_id % 8 IN (0, 1, 4, 5) THEN CAST(c_custkey AS BIGINT) END AS city
        FROM events JOIN customer ON c_custkey = user_id + 1""",
    "geoip_country": "SELECT id, client_ip, country FROM acc",
    "context_join": """
        SELECT id, host, r_isodate, program FROM sys s WHERE EXISTS (
          SELECT 1 FROM events a WHERE a.event_type = 'purchase' AND a.value >= 60
            AND 'web' || (a.user_id % 9) = s.host
            AND s.r_isodate BETWEEN a.ts - INTERVAL '10 minutes' AND a.ts + INTERVAL '20 minutes')""",
    "enrich_sshd": f"""
        SELECT id, CASE WHEN is_sshd THEN CAST({_SSH_FIELDS} AS VARCHAR) ELSE {_OWN_BLOCK} END AS enriched, message
        FROM sys""",
    "enrich_fields": f"""
        SELECT id, CASE WHEN is_sshd THEN CAST({_SSH_FIELDS} AS VARCHAR) ELSE '{{}}' END AS fields FROM sys""",
    "enrich_full": f"""
        SELECT id, CAST(CASE WHEN is_sshd
            THEN json_object('MESSAGE', message, 'PROGRAM', 'sshd-session', 'enriched', {_SSH_FIELDS})
            ELSE json_object('MESSAGE', message, 'PROGRAM', 'sshd-session') END AS VARCHAR) AS raw
        FROM sys""",
    "enrich_explain": f"""
        SELECT id, is_sshd AS matched, CASE WHEN is_sshd THEN 'sshd' END AS rule,
               CASE WHEN is_sshd THEN CAST({_SSH_FIELDS} AS VARCHAR) END AS fields
        FROM sys""",
    "rule_coverage": """
        SELECT program, CASE WHEN is_sshd THEN 'sshd' END AS rule, is_sshd AS matched, count(*) AS n
        FROM sys GROUP BY 1, 2, 3""",
    "dense_ids": """
        SELECT 100 + row_number() OVER (ORDER BY r_isodate, event_id) AS id, event_id, program FROM sys""",
    "promoted_fields": """
        SELECT id, k_text AS field_k_text, CAST(k_number AS DOUBLE) AS field_k_number,
               CASE WHEN event_type = 'click' THEN NULL
                    WHEN event_type = 'purchase' THEN '"' || k || '"'
                    WHEN k_text IS NULL THEN 'null' ELSE CAST(k AS VARCHAR) END AS field_k_json,
               tag AS field_tag_text
        FROM sys""",
    "prune_survivors": f"""
        SELECT id, err_isodate FROM errs
        WHERE err_isodate IS NULL OR err_isodate >= {_AS_OF} - INTERVAL '12 days'""",
    "prune_store": f"""
        SELECT sid AS id, r_isodate, program FROM (SELECT *, {_STORE_IDS} FROM sys)
        WHERE r_isodate >= {_AS_OF} - INTERVAL '250 hours'""",
    "prune_store_requests": f"""
        SELECT id, r_isodate, req_isodate, gone FROM (
          SELECT row_number() OVER (ORDER BY r_isodate, event_id) AS id, r_isodate, req_isodate,
                 count(*) FILTER (req_isodate < {_AS_OF} - INTERVAL '12 days') OVER () AS gone FROM acc)
        WHERE req_isodate IS NULL OR req_isodate >= {_AS_OF} - INTERVAL '12 days'""",
    "store_replayed_batch": f"SELECT sid AS id, r_isodate, program FROM (SELECT *, {_STORE_IDS} FROM sys)",
    "store_compacted": "SELECT r_isodate, host, pid, program, 1 AS folders FROM sys",
    "prune_dry_run": f"""
        SELECT count(*) FILTER (r_isodate < {_AS_OF} - INTERVAL '250 hours') AS would_delete FROM sys""",
    "reenrich_changed": f"""
        SELECT sid AS id, r_isodate,
               CASE WHEN program = 'sshd' AND {_since("r_isodate", "20 days")}
                    THEN CAST({_SSH_FIELDS} AS VARCHAR) ELSE {_OWN_BLOCK} END AS enriched
        FROM (SELECT *, {_STORE_IDS} FROM sys)""",
    "reenrich_counts": f"""
        SELECT count(*) AS scanned, count(*) FILTER (NOT is_sshd) AS changed
        FROM sys WHERE {_since("r_isodate", "20 days")}""",
    "store_newest": f"""
        SELECT sid AS id, s_isodate AS time, host, program, message FROM (SELECT *, {_STORE_IDS} FROM sys)
        WHERE k_number >= 90 AND program LIKE 'sshd%' AND {_since("r_isodate", "25 days")}
        ORDER BY sid DESC LIMIT 40""",
    "store_stats_window": f"""
        SELECT program AS key, count(*) AS "count" FROM sys WHERE {_since("r_isodate", "8 days")} GROUP BY 1""",
    "stream_syslog_ingest": """
        SELECT r_isodate, host, program, pid, CASE WHEN is_sshd THEN 'u' || user_id END AS ssh_user, message FROM sys
        UNION ALL
        SELECT NULL, NULL, NULL, NULL, NULL,
               CASE WHEN value < 0.25 THEN 'C_ISODATE is not a time' WHEN value < 0.5 THEN 'not valid JSON'
                    WHEN value < 1 THEN 'PROGRAM is missing' WHEN value < 1.5 THEN 'not a JSON object'
                    ELSE 'HOST is missing' END FROM ev WHERE value < 2""",
    "stream_http_ingest": """
        SELECT req_isodate, vhost, vhost_port, client_ip, method, request, status, bytes, referrer, user_agent FROM acc""",
    "stream_two_sets": """
        SELECT req_isodate, CASE WHEN user_id % 4 < 2 THEN 'first.example.com' ELSE 'second.example.com' END AS vhost,
               CAST(CASE WHEN user_id % 4 < 2 THEN 443 ELSE 8443 END AS INTEGER) AS vhost_port,
               client_ip, method, request, status, bytes, referrer, user_agent, 1 AS rows_of_id FROM acc""",
    "stream_follow": f"""
        SELECT sid AS id, s_isodate, host, program, 1 AS times FROM (SELECT *, {_STORE_IDS} FROM sys)
        WHERE sid > 100 AND program = 'sshd' AND {_since("s_isodate", "25 days")}""",
}


def oracle_sql(names: Iterable[str] | None = None) -> dict[str, str]:
    chosen = _ORACLES if names is None else {n: _ORACLES[n] for n in names if n in _ORACLES}
    return {name: f"WITH {_BASE.strip()}\n{body.strip()}" for name, body in chosen.items()}
