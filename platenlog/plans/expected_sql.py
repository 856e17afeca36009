"""What the registered queries must return, as SQL over the same tables."""

from __future__ import annotations

from platenlog.functions import codes, device
from platenlog.sources.devices import CAPABILITIES

REQUESTS = """
requests AS (
  SELECT d.doc_id AS seq, d.source AS session_id, e.ts AS arrived_at,
         CASE WHEN CAST(floor(d.doc_id / 20) AS INT) % 10 < 6 THEN 2
              WHEN CAST(floor(d.doc_id / 20) AS INT) % 10 = 6 THEN 4
              WHEN CAST(floor(d.doc_id / 20) AS INT) % 10 = 7 THEN 9
              WHEN CAST(floor(d.doc_id / 20) AS INT) % 10 = 8 THEN 11
              ELSE 18 END AS op_code,
         CASE WHEN d.doc_id % 13 = 0 THEN 'Untitled' 
              ELSE d.source || ' / ' || d.lang || ' №' || d.doc_id || ' é中' || repeat(' seite', d.doc_id % 19)
              END AS job_name,
         coalesce(c.c_name, 'unknown') AS user_name,
         CASE d.doc_id % 7 WHEN 0 THEN 'image/urf' WHEN 1 THEN 'application/PDF'
              WHEN 2 THEN 'application/octet-stream' ELSE 'application/pdf' END AS document_format,
         CAST(CASE WHEN d.doc_id % 17 = 0 THEN 0 ELSE strlen(d.text) END AS BIGINT) AS doc_bytes,
         CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE 1 + d.doc_id % 25 END AS lookup_job_id,
         CAST(CASE WHEN d.doc_id % 19 = 0 THEN NULL WHEN d.doc_id % 23 = 0 THEN 10485760
                   ELSE 1073741824 END AS BIGINT) AS avail_bytes,
         d.text AS text
  FROM documents d
  JOIN events e ON e.event_id = d.doc_id
  LEFT JOIN customer c ON c.c_custkey = d.doc_id % (SELECT max(c_custkey) + 1 FROM customer) AND d.doc_id % 5 <> 0
)"""

ADMITTED = (
    REQUESTS
    + f""",
verdicts AS (
  SELECT *,
         document_format IN ('application/pdf', 'application/octet-stream') AS format_ok,
         avail_bytes IS NULL OR avail_bytes >= 2 * doc_bytes + 10485760 AS space_ok
  FROM requests
),
admitted AS (
  SELECT *,
         CASE WHEN op_code NOT IN (2, 4, 9, 11) THEN 1281
              WHEN op_code = 2 AND NOT format_ok THEN 1034
              WHEN op_code = 2 AND doc_bytes = 0 THEN 1024
              WHEN op_code = 2 AND NOT space_ok THEN 1280
              WHEN op_code = 9 AND lookup_job_id IS NULL THEN 1024
              ELSE 0 END AS status,
         CASE WHEN op_code NOT IN (2, 4, 9, 11) THEN '{codes.MESSAGE_NOT_SERVED}'
              WHEN op_code = 2 AND NOT format_ok THEN '{codes.MESSAGE_FORMAT}'
              WHEN op_code = 2 AND doc_bytes = 0 THEN '{codes.MESSAGE_EMPTY}'
              WHEN op_code = 2 AND NOT space_ok THEN '{codes.MESSAGE_SPACE}'
              WHEN op_code = 9 AND lookup_job_id IS NULL THEN '{codes.MESSAGE_NO_JOB_ID}'
              WHEN op_code = 11 THEN NULL
              ELSE 'successful-ok' END AS reason
  FROM verdicts
)"""
)

JOBS = (
    ADMITTED
    + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS job_id,
         CAST(floor(epoch(arrived_at)) AS BIGINT) AS time_created
  FROM admitted WHERE op_code = 2 AND format_ok AND doc_bytes > 0
),
jobs AS (
  SELECT session_id, job_id, seq AS created_seq, 9 AS state, job_name AS name, user_name AS originating_user,
         time_created,
         time_created || '_' || job_id || '_'
           || substring(regexp_replace(job_name, '[^\\p{L}\\p{N}_.-]', '_', 'g'), 1, 64) || '.pdf' AS file_name,
         doc_bytes AS size_bytes, text
  FROM numbered WHERE status = 0
)"""
)

JOB_COLUMNS = "session_id, job_id, created_seq, state, name, originating_user, time_created, file_name, size_bytes"

LISTED = (
    JOBS
    + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY time_created DESC, file_name) - 1 AS position,
         count(*) OVER (PARTITION BY session_id) AS files
  FROM jobs
),
listed AS (
  SELECT *, position // 5 AS page, greatest(1, CAST(ceil(files / 5) AS BIGINT)) AS pages FROM ranked
)"""
)

LOOKUPS = (
    JOBS
    + f""",
lookups AS (
  SELECT r.seq, r.session_id,
         CASE WHEN r.lookup_job_id IS NULL THEN 1024 WHEN j.job_id IS NULL THEN 1030 ELSE 0 END AS status,
         CASE WHEN r.lookup_job_id IS NULL THEN '{codes.MESSAGE_NO_JOB_ID}'
              WHEN j.job_id IS NULL THEN '{codes.MESSAGE_NO_JOB}' ELSE 'successful-ok' END AS reason,
         CAST(j.job_id AS INT) AS job_id,
         'ipp://192.0.2.1:6310/ipp/print/jobs/' || j.job_id AS job_uri,
         j.state,
         CASE WHEN j.job_id IS NOT NULL THEN 'job-completed-successfully' END AS state_reasons,
         j.name AS job_name, j.originating_user,
         CAST(CASE WHEN j.job_id IS NOT NULL THEN greatest(1, j.size_bytes // 1024) END AS INT) AS k_octets,
         CAST(j.time_created AS INT) AS time_at_creation
  FROM admitted r
  LEFT JOIN jobs j
    ON j.session_id = r.session_id AND j.job_id = r.lookup_job_id AND j.created_seq < r.seq
  WHERE r.op_code = 9
)"""
)

TOKENS = """
tokens AS (
  SELECT l_orderkey AS msg, 1 + l_partkey % 2 AS grp,
         (l_partkey * 1000000 + l_suppkey) * 10 + l_linenumber AS pos,
         CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'attr-' || l_returnflag END AS name,
         CAST(65 + l_suppkey % 3 AS INT) AS tag,
         l_linestatus || l_linenumber AS value
  FROM lineitem
),
islands AS (
  SELECT *, CAST(sum(CASE WHEN name <> '' THEN 1 ELSE 0 END)
                 OVER (PARTITION BY msg, grp ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attr_pos
  FROM tokens
)"""

ATTRIBUTES = """
grouped AS (SELECT *, 1 + l_linenumber % 3 AS group_pos FROM lineitem),
attributes AS (
  SELECT l_orderkey AS msg, CAST(group_pos AS BIGINT) AS group_pos,
         CASE WHEN (l_orderkey + group_pos) % 2 = 0 THEN 1 ELSE 4 END AS delimiter,
         (l_partkey * 1000000 + l_suppkey) * 10 + l_linenumber AS attr_pos,
         CASE l_partkey % 4 WHEN 0 THEN 'requested-attributes' WHEN 1 THEN 'job-name'
              WHEN 2 THEN 'document-format' ELSE 'job-id' END AS name,
         CASE l_suppkey % 4 WHEN 0 THEN 68 WHEN 1 THEN 66 WHEN 2 THEN 73 ELSE 33 END AS tag,
         l_returnflag || l_linenumber AS value
  FROM grouped
),
first_groups AS (SELECT msg, min(group_pos) AS group_pos FROM attributes WHERE delimiter = 1 GROUP BY msg),
mine AS (SELECT a.* FROM attributes a JOIN first_groups USING (msg, group_pos))"""

HTTP = """
http AS (
  SELECT doc_id AS seq,
         CASE WHEN doc_id % 9 = 0 THEN 'GET' ELSE 'POST' END AS method,
         CASE doc_id % 8 WHEN 0 THEN '/ipp/other' WHEN 1 THEN '/' ELSE '/ipp/print' END AS path,
         CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'application/ipp; charset=utf-8' WHEN 2 THEN 'text/html'
              WHEN 3 THEN 'Application/ipp' ELSE 'application/ipp' END AS content_type,
         CASE doc_id % 10 WHEN 0 THEN 536870913 WHEN 1 THEN 536870912 ELSE strlen(text) END AS body_bytes
  FROM documents
)"""

# A captured header in bytes: 8 of fixed fields, 1 group marker, then per attribute 1 tag, 2 and 2 of
# lengths, its name and its value, and 1 end marker. Needs the attributes as ``written``.
DAMAGE = """
sized AS (
  SELECT seq, place, tag, length(name) AS names, CASE WHEN s IS NULL THEN 4 ELSE strlen(s) END AS valued FROM written
),
laid AS (
  SELECT *, CAST(9 + sum(5 + names + valued) OVER (PARTITION BY seq ORDER BY place) AS BIGINT) - 5 - names - valued AS start
  FROM sized
),
headers AS (SELECT seq, CAST(10 + sum(5 + names + valued) AS BIGINT) AS header_len FROM sized GROUP BY seq),
cuts AS (SELECT seq, header_len, CASE WHEN seq % 9 BETWEEN 1 AND 6 THEN seq * 7919 % header_len END AS cut FROM headers),
met AS (
  SELECT c.seq, c.cut, l.names, l.valued, c.cut - l.start - 1 AS room
  FROM cuts c LEFT JOIN laid l ON l.seq = c.seq AND c.cut > l.start AND c.cut < l.start + 5 + l.names + l.valued
),
damage AS (
  SELECT seq,
         CASE WHEN seq % 9 = 0 THEN NULL WHEN seq % 9 >= 7 THEN 'bad-utf8' ELSE 'end-of-data' END AS wrong,
         CAST(CASE WHEN cut < 2 THEN 1 WHEN cut < 4 THEN 2 WHEN cut < 8 THEN 4 WHEN room IS NULL AND cut IS NOT NULL THEN 1
                   WHEN room < 2 THEN 2 WHEN room < 2 + names THEN names
                   WHEN room < 4 + names THEN 2 WHEN cut IS NOT NULL THEN valued END AS BIGINT) AS need,
         CAST(CASE WHEN cut < 2 THEN 0 WHEN cut < 4 THEN cut - 2 WHEN cut < 8 THEN cut - 4 WHEN room IS NULL AND cut IS NOT NULL THEN 0
                   WHEN room < 2 THEN room WHEN room < 2 + names THEN room - 2
                   WHEN room < 4 + names THEN room - 2 - names WHEN cut IS NOT NULL THEN room - 4 - names END AS BIGINT) AS have
  FROM met
)"""

# The damaged bodies themselves, as hexadecimal digits until they are hashed.
BODIES = """
shown AS (
  SELECT l.seq, l.place, l.start, l.names, l.valued,
         printf('%02x%04x', l.tag, l.names) || lower(hex(encode(w.name))) || printf('%04x', l.valued)
           || CASE WHEN w.s IS NULL THEN printf('%08x', w.i) ELSE lower(hex(encode(w.s))) END AS digits
  FROM laid l JOIN written w USING (seq, place)
),
whole AS (
  SELECT r.seq, h.header_len,
         printf('0101%04x%08x01', r.op_code, r.seq)
           || (SELECT string_agg(digits, '' ORDER BY place) FROM shown s WHERE s.seq = r.seq) || '03' AS head,
         CASE WHEN r.doc_bytes = 0 THEN '' ELSE lower(hex(encode(r.text))) END AS tail
  FROM requests r JOIN headers h USING (seq)
),
garbled AS (
  SELECT seq, start + 3 + seq % names AS at FROM (
    SELECT *, row_number() OVER (PARTITION BY seq ORDER BY place) - 1 AS n, count(*) OVER (PARTITION BY seq) AS many
    FROM laid WHERE seq % 9 = 7) WHERE n = seq % many
  UNION ALL
  SELECT seq, start + 5 + names + seq % valued FROM (
    SELECT *, row_number() OVER (PARTITION BY seq ORDER BY place) - 1 AS n, count(*) OVER (PARTITION BY seq) AS many
    FROM laid WHERE seq % 9 = 8 AND tag <> 33) WHERE n = seq % many
),
bodies AS (
  SELECT w.seq, md5(unhex(CASE WHEN c.cut IS NOT NULL THEN left(head, 2 * c.cut)
      WHEN g.at IS NOT NULL THEN left(head, 2 * g.at) || 'ff' || substr(head, 2 * g.at + 3) || tail
      ELSE head || tail END)) AS digest
  FROM whole w JOIN cuts c USING (seq) LEFT JOIN garbled g USING (seq)
)"""

NOT_HERE = "content_type IS NULL OR NOT starts_with(content_type, 'application/ipp')"


def _values(rows) -> str:
    return ", ".join(f"({code}, '{name}')" for code, name in rows)


def _named(column: str, rows, alias: str) -> str:
    listed = " ".join(f"WHEN {code} THEN '{name}'" for code, name in rows)
    return f"CASE {column} {listed} ELSE format('unknown-0x{{:04x}}', {column}) END AS {alias}"


def _capabilities() -> str:
    rows = [
        f"({pos}, '{name}', {at}, {tag}, '{value}')"
        for pos, (name, tag, values) in enumerate(CAPABILITIES, start=1)
        for at, value in enumerate(values, start=1)
    ]
    return f"capabilities(pos, name, value_pos, tag, value) AS (VALUES {', '.join(rows)})"


def _devices(table: str, key: str, label: str) -> str:
    host = f"'10.0.0.' || ({key} % 256) || ':' || (6310 + {key} % 10)"
    return f"""
devices AS (
  SELECT {key} AS device_id, {host} AS host, {label} AS label,
         '00000000-0000-0000-0000-' || lpad(CAST({key} AS VARCHAR), 12, '0') AS uuid, 1704067200 + {key} AS up_time
  FROM {table}
),
held AS (
  SELECT device_id, pos, name, value_pos, tag,
         CASE value WHEN ':uri' THEN 'ipp://' || host || '/ipp/print' WHEN ':name' THEN label
                    WHEN ':model' THEN 'Virtual PDF Printer' WHEN ':info' THEN 'Printer of ' || label
                    WHEN ':location' THEN '' WHEN ':more_info' THEN 'http://' || host || '/'
                    WHEN ':uuid' THEN 'urn:uuid:' || uuid WHEN ':up_time' THEN CAST(up_time AS VARCHAR)
                    ELSE value END AS value
  FROM devices CROSS JOIN capabilities
)"""


def _presence(ttl: int) -> str:
    life = ttl * 1_000_000
    return f"""
WITH heard AS (SELECT user_id AS device_id, epoch_us(ts) AS at_us FROM events),
marked AS (
  SELECT *, CASE WHEN at_us < lag(at_us) OVER (PARTITION BY device_id ORDER BY at_us) + {life} THEN 0 ELSE 1 END AS breaks
  FROM heard
),
spanned AS (
  SELECT *, sum(breaks) OVER (PARTITION BY device_id ORDER BY at_us ROWS UNBOUNDED PRECEDING) AS span FROM marked
),
spans AS (
  SELECT device_id, min(at_us) AS first_us, max(at_us) AS last_us, count(*) AS announcements
  FROM spanned GROUP BY device_id, span
)
SELECT device_id, first_us AS online_from_us, last_us + {life} AS offline_at_us, announcements FROM spans"""


DECODED_ATTRIBUTES = """
written AS (
  SELECT seq, 1 AS place, 'attributes-charset' AS name, 71 AS tag, 'utf-8' AS s, NULL::BIGINT AS i FROM requests
  UNION ALL SELECT seq, 2, 'attributes-natural-language', 72, 'en', NULL FROM requests
  UNION ALL SELECT seq, 3, 'printer-uri', 69, 'ipp://192.0.2.1:6310/ipp/print', NULL FROM requests
  UNION ALL SELECT seq, 4, 'requesting-user-name', 66, user_name, NULL FROM requests WHERE user_name <> 'unknown'
  UNION ALL SELECT seq, 5, 'job-name', 66, job_name, NULL FROM requests WHERE job_name <> 'Untitled'
  UNION ALL SELECT seq, 6, 'document-format', 73, document_format, NULL FROM requests
    WHERE document_format <> 'application/octet-stream'
  UNION ALL SELECT seq, 7, 'job-id', 33, NULL, lookup_job_id FROM requests WHERE lookup_job_id IS NOT NULL
)"""

EXTENSION = "CASE WHEN contains(file_name, '.') THEN lower(regexp_extract(file_name, '[^.]*$')) ELSE '' END"

N = "(o_orderkey * 1000003 - 3000000000)"
LOW = f"({N} & 4294967295)"
SIGNED = f"(CASE WHEN {LOW} >= 2147483648 THEN {LOW} - 4294967296 ELSE {LOW} END)"

EXPECTED = {
    "gate_status": f"""WITH {HTTP}
        SELECT seq, CASE WHEN method <> 'POST' OR path NOT IN ('/ipp/print', '/') THEN 404
                         WHEN {NOT_HERE} THEN 400 WHEN body_bytes > 536870912 THEN 413 ELSE 200 END AS http_status
        FROM http""",
    "admission": f"WITH {ADMITTED} SELECT seq, session_id, op_code, status, reason FROM admitted",
    "dispatch": f"""WITH {REQUESTS}
        SELECT seq, op_code, op_code IN (2, 4, 9, 11) AS supported,
               CASE WHEN op_code IN (2, 4, 9, 11) THEN 0 ELSE 1281 END AS dispatch_status FROM requests""",
    "request_rollup": f"""WITH {ADMITTED}
        SELECT op_code, status, count(*) AS requests, CAST(sum(doc_bytes) AS BIGINT) AS doc_bytes,
               {_named("op_code", codes.OPERATIONS, "op_name")}, {_named("status", codes.STATUSES, "status_name")}
        FROM admitted GROUP BY op_code, status""",
    "code_names": f"""
        WITH k AS (SELECT CAST(o_orderkey % 90 AS INT) AS tag, CAST(o_orderkey % 7 AS INT) AS delimiter,
                          CAST(o_custkey % 11 AS INT) AS state FROM orders)
        SELECT tag, delimiter, state, count(*) AS n, {_named("tag", codes.VALUE_TAGS, "tag_name")},
               {_named("delimiter", codes.DELIMITERS, "delimiter_name")},
               {_named("state", codes.JOB_STATES, "state_name")}
        FROM k GROUP BY tag, delimiter, state""",
    "job_registry": f"WITH {JOBS} SELECT {JOB_COLUMNS}, greatest(1, size_bytes // 1024) AS k_octets FROM jobs",
    "id_gaps": f"""WITH {JOBS} SELECT session_id, count(*) AS jobs, max(job_id) AS last_job_id,
        max(job_id) - count(*) AS missing FROM jobs GROUP BY session_id""",
    "job_lookup": f"WITH {LOOKUPS} SELECT * FROM lookups",
    "print_answers": f"""WITH {JOBS}
        SELECT a.seq, a.session_id, a.status, a.reason, CAST(j.job_id AS INT) AS job_id,
               'ipp://192.0.2.1:6310/ipp/print/jobs/' || j.job_id AS job_uri, j.state,
               CASE WHEN j.job_id IS NOT NULL THEN 'job-completed-successfully' END AS state_reasons
        FROM admitted a LEFT JOIN jobs j ON j.created_seq = a.seq WHERE a.op_code = 2""",
    "status_ok": f"""WITH {LOOKUPS} SELECT seq, status,
        {_named("status", codes.CLIENT_STATUSES, "status_name")}, status < 256 AS ok FROM lookups""",
    "device_attributes": f"WITH {_capabilities()}, {_devices('supplier', 's_suppkey', 's_name')} SELECT * FROM held",
    "attribute_query": f"""WITH {REQUESTS}, {_capabilities()}, {_devices('customer', 'c_custkey', 'c_name')}
        SELECT r.seq, h.* FROM requests r JOIN held h ON h.device_id = r.seq % (SELECT max(c_custkey) + 1 FROM customer)
        WHERE r.op_code = 11
          AND (r.seq % 4 IN (0, 1)
               OR (r.seq % 4 = 2 AND h.name IN ('printer-name', 'printer-state', 'no-such-name'))
               OR (r.seq % 4 = 3 AND h.name IN ('media-col-database', 'printer-more-info')))""",
    "attribute_answers": f"""WITH {REQUESTS}, {_capabilities()}, {_devices('customer', 'c_custkey', 'c_name')}
        SELECT r.seq, h.* FROM requests r JOIN held h ON h.device_id = r.seq % (SELECT max(c_custkey) + 1 FROM customer)
        WHERE r.op_code = 11
          AND (r.seq % 4 IN (0, 1)
               OR (r.seq % 4 = 2 AND h.name IN ('printer-name', 'printer-state', 'no-such-name'))
               OR (r.seq % 4 = 3 AND h.name IN ('media-col-database', 'printer-more-info')))""",
    "dated_answers": f"""WITH {REQUESTS}, {_capabilities()}, {_devices('customer', 'c_custkey', 'c_name')},
        dated AS (SELECT c_custkey AS device_id, n, 1704067200 + (c_custkey % 7) * 7200 + n * 36000 AS taken_s
                  FROM customer CROSS JOIN range(3) t(n)),
        asked AS (SELECT *, seq % (SELECT max(c_custkey) + 1 FROM customer) AS device_id FROM requests WHERE op_code = 11),
        known AS (SELECT a.seq, a.device_id, max(d.taken_s) AS taken_s, max(d.n) AS n
                  FROM asked a JOIN dated d ON d.device_id = a.device_id AND make_timestamp(d.taken_s * 1000000) <= a.arrived_at
                  GROUP BY a.seq, a.device_id)
        SELECT k.seq, k.device_id, k.taken_s, h.pos, h.name, h.value_pos, h.tag,
               CASE WHEN c.value = ':name' THEN h.value || ' v' || k.n ELSE h.value END AS value
        FROM known k JOIN held h ON h.device_id = k.device_id
        JOIN capabilities c ON c.pos = h.pos AND c.value_pos = h.value_pos
        WHERE k.seq % 4 IN (0, 1)
           OR (k.seq % 4 = 2 AND h.name IN ('printer-name', 'printer-state', 'no-such-name'))
           OR (k.seq % 4 = 3 AND h.name IN ('media-col-database', 'printer-more-info'))""",
    "requested_attributes": f"""WITH {ATTRIBUTES}
        SELECT msg, string_agg(DISTINCT value, ',' ORDER BY value)
                      FILTER (WHERE name = 'requested-attributes' AND tag = 68) AS wanted
        FROM mine GROUP BY msg""",
    "first_value": f"""WITH {ATTRIBUTES},
        hits AS (SELECT *, row_number() OVER (PARTITION BY msg ORDER BY attr_pos) AS n FROM mine WHERE name = 'job-name')
        SELECT m.msg, coalesce(CASE WHEN h.tag IN (65, 66) THEN h.value END, 'Untitled') AS value
        FROM (SELECT DISTINCT msg FROM mine) m LEFT JOIN hits h ON h.msg = m.msg AND h.n = 1""",
    "first_group": f"WITH {ATTRIBUTES} SELECT msg, group_pos, count(*) AS attributes FROM mine GROUP BY msg, group_pos",
    "value_islands": f"WITH {TOKENS} SELECT msg, grp, pos, attr_pos FROM islands",
    "grouped_values": f"""WITH {TOKENS}
        SELECT msg, grp, attr_pos, max(name) AS name, string_agg(tag || ':' || value, ',' ORDER BY pos) AS values
        FROM islands WHERE attr_pos > 0 GROUP BY msg, grp, attr_pos""",
    "typed_values": """
        WITH k AS (SELECT *, o_orderkey % 8 AS kind, o_custkey AS c FROM orders)
        SELECT o_orderkey,
               CASE kind WHEN 0 THEN 33 WHEN 1 THEN 35 WHEN 2 THEN 34 WHEN 3 THEN 65 WHEN 4 THEN 49
                         WHEN 5 THEN 50 WHEN 6 THEN 51 ELSE 48 END AS tag,
               CAST(CASE kind WHEN 0 THEN -c WHEN 1 THEN c END AS INT) AS int_value,
               CASE WHEN kind = 2 THEN c % 3 <> 0 AND c % 2 = 1 END AS bool_value,
               CASE WHEN kind = 3 THEN o_orderpriority END AS str_value,
               CASE WHEN kind = 7 THEN format('{:08X}', c) END AS bin_hex,
               CAST(CASE WHEN kind = 5 THEN 300 + c % 100 END AS INT) AS cross_feed,
               CAST(CASE WHEN kind = 5 THEN 600 + c % 100 END AS INT) AS feed,
               CASE WHEN kind = 5 THEN 3 END AS units,
               CAST(CASE WHEN kind = 6 THEN -c - 1 END AS INT) AS lower,
               CAST(CASE WHEN kind = 6 THEN c END AS INT) AS upper,
               CASE WHEN kind = 4 AND c % 50 <> 0 THEN
                 epoch_us(o_orderdate) + ((c % 24) * 3600 + (c % 60) * 60 + c % 59) * 1000000 + (c % 10) * 100000
                 - (CASE WHEN c % 2 = 0 THEN 1 ELSE -1 END)
                   * ((c % 14) * 3600 + (CASE WHEN c % 3 = 0 THEN 30 ELSE 0 END) * 60) * 1000000
               END AS instant_us
        FROM k""",
    "newest_page": f"""WITH {LISTED}
        SELECT session_id, position, page, file_name, size_bytes, files, pages FROM listed WHERE page = 0""",
    "later_page": f"""WITH {LISTED}
        SELECT session_id, position, page, file_name, size_bytes, files, pages FROM listed
        WHERE page = CASE WHEN pages > 3 THEN 3 ELSE 0 END""",
    "deep_page": f"""WITH {LISTED}
        SELECT session_id, position, page, file_name, size_bytes, files, pages FROM listed
        WHERE page = CASE WHEN pages > 300 THEN 300 ELSE 0 END""",
    "indexed_page": f"""WITH {LISTED}
        SELECT session_id, position, page, file_name, size_bytes, files, pages FROM listed
        WHERE page = CASE WHEN pages > 2 THEN 2 ELSE 0 END""",
    "newest_first": f"WITH {JOBS} SELECT session_id, file_name, size_bytes FROM jobs ORDER BY time_created DESC, file_name",
    "page_numbers": f"WITH {LISTED} SELECT session_id, file_name, position, page FROM listed",
    "archive_counts": f"WITH {LISTED} SELECT DISTINCT session_id, files, pages FROM listed",
    "catalogue_from_names": f"""WITH {JOBS}
        SELECT session_id, time_created, job_id,
               substring(regexp_replace(name, '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g'), 1, 64) AS safe_name,
               file_name, size_bytes FROM jobs""",
    "display_columns": f"""
        WITH f AS (
          SELECT 'Doc_' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.ps' WHEN 2 THEN ''
                                                     WHEN 3 THEN '.tar.gz' ELSE '.pdf' END AS file_name,
                 n_chars * CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1048576 END AS size_bytes, ts
          FROM documents JOIN events ON event_id = doc_id),
        x AS (SELECT *, {EXTENSION} AS ext FROM f)
        SELECT file_name, ext AS extension,
               CASE ext WHEN 'pdf' THEN 'application/pdf' WHEN 'ps' THEN 'application/postscript' ELSE '*/*' END AS mime,
               CASE ext WHEN 'pdf' THEN chr(128196) WHEN 'ps' THEN chr(128424) ELSE chr(128193) END AS kind,
               CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN size_bytes // 1024 || ' KB'
                    ELSE size_bytes // 1048576 || ' MB' END AS size,
               strftime(ts, '%m/%d %H:%M') AS stamp
        FROM x""",
    "name_functions": """
        WITH k AS (SELECT *, '192.168.' || (c_custkey % 256) || '.7:' || (6000 + c_custkey % 1000) AS hp FROM customer)
        SELECT c_custkey,
               regexp_replace(c_name || ' / ' || c_mktsegment || ' №é中', '[^\\p{L}\\p{N}_.-]', '_', 'g') AS safe_name,
               'ipp://' || hp || '/ipp/print' AS printer_uri,
               'ipp://' || hp || '/ipp/print/jobs/' || c_custkey AS job_uri,
               hp AS host_port,
               lower(c_mktsegment) || '-printer-' || c_custkey || '.local.' AS host_slug
        FROM k""",
    "safe_names": """SELECT doc_id, substring(regexp_replace(text, '[^\\p{L}\\p{N}_.-]', '_', 'g'), 1, 64) AS safe_name
        FROM documents""",
    "number_functions": f"""
        SELECT o_orderkey, CAST({SIGNED} AS INT) AS wrapped,
               greatest(1, o_orderkey * 100 // 1024) AS k_octets,
               greatest(1, CAST(ceil((o_orderkey % 40) / 5) AS BIGINT)) AS pages,
               CASE WHEN o_orderkey * 7919 < 1024 THEN (o_orderkey * 7919) || ' B'
                    WHEN o_orderkey * 7919 < 1048576 THEN (o_orderkey * 7919 // 1024) || ' KB'
                    ELSE (o_orderkey * 7919 // 1048576) || ' MB' END AS size,
               format('unknown-0x{{:04x}}', o_orderkey % 65536) AS code,
               {SIGNED} AS signed, o_orderkey % 65536 AS unsigned
        FROM orders""",
    "announcement_records": f"""
        WITH fixed(property, setting) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in device.ANNOUNCED)})
        SELECT s_suppkey, property, setting FROM supplier CROSS JOIN fixed
        UNION ALL SELECT s_suppkey, 'ty', 'Virtual Printer' FROM supplier
        UNION ALL SELECT s_suppkey, 'adminurl', 'http://10.0.0.' || (s_suppkey % 256) || ':6310/' FROM supplier
        UNION ALL SELECT s_suppkey, 'UUID', lpad(CAST(s_suppkey AS VARCHAR), 8, '0') FROM supplier
        UNION ALL SELECT s_suppkey, 'note', s_name FROM supplier""",
    "media_sizes": """SELECT p_partkey, (20000 + p_size * 10) / 100 AS width_mm, (29000 + p_size * 11) / 100 AS height_mm
        FROM part""",
    "nested_values": """WITH layout(attr_pos, name, place, level, collection, member, item, tag, kind) AS (VALUES
            (1, 'printer-name', 1, 0, 0, NULL, 1, 65, 'name'),
            (2, 'media-col-database', 1, 0, 0, NULL, 1, 52, NULL),
            (2, 'media-col-database', 3, 1, 1, 'media-col', 1, 52, NULL),
            (2, 'media-col-database', 5, 2, 3, 'media-size', 1, 52, NULL),
            (2, 'media-col-database', 7, 3, 5, 'x-dimension', 1, 33, 'x1'),
            (2, 'media-col-database', 9, 3, 5, 'y-dimension', 1, 33, 'y1'),
            (2, 'media-col-database', 12, 2, 3, 'media-type', 1, 68, 'type'),
            (2, 'media-col-database', 13, 2, 3, 'media-type', 2, 68, 'type'),
            (2, 'media-col-database', 15, 1, 1, 'media-col', 2, 52, NULL),
            (2, 'media-col-database', 17, 2, 15, 'media-size', 1, 52, NULL),
            (2, 'media-col-database', 19, 3, 17, 'x-dimension', 1, 33, 'x2'),
            (2, 'media-col-database', 21, 3, 17, 'y-dimension', 1, 33, 'y2'),
            (2, 'media-col-database', 24, 2, 15, 'media-type', 1, 68, 'type'),
            (2, 'media-col-database', 25, 2, 15, 'media-type', 2, 68, 'type'),
            (2, 'media-col-database', 28, 1, 1, 'media-bottom-margin', 1, 33, 'none'),
            (3, 'media-size-ready', 1, 0, 0, NULL, 1, 52, NULL),
            (3, 'media-size-ready', 3, 1, 1, 'y-dimension', 1, 33, 'side'),
            (3, 'media-size-ready', 5, 1, 1, 'x-dimension', 1, 33, 'twice'))
        SELECT p_partkey, attr_pos, name, place, level, collection, member, item, tag,
               CASE kind WHEN 'name' THEN p_name WHEN 'type' THEN lower(p_brand) WHEN 'none' THEN '0'
                    WHEN 'x1' THEN CAST(20000 + p_size * 10 AS VARCHAR) WHEN 'y1' THEN CAST(29000 + p_size * 11 AS VARCHAR)
                    WHEN 'x2' THEN CAST(10000 + p_size AS VARCHAR) WHEN 'y2' THEN CAST(14000 + p_size AS VARCHAR)
                    WHEN 'side' THEN CAST(p_size AS VARCHAR) WHEN 'twice' THEN CAST(p_size * 2 AS VARCHAR) END AS shown
        FROM part CROSS JOIN layout""",
    "decoded_media_sizes": """
        SELECT p_partkey, 'media-col-database' AS name, 5 AS place, 2 AS level,
               (20000 + p_size * 10) / 100 AS width_mm, (29000 + p_size * 11) / 100 AS height_mm FROM part
        UNION ALL
        SELECT p_partkey, 'media-col-database', 17, 2, (10000 + p_size) / 100, (14000 + p_size) / 100 FROM part""",
    "decode_roundtrip": f"""WITH {REQUESTS}
        SELECT seq, session_id, 1 AS major, 1 AS minor, op_code, seq AS request_id, true AS has_group, job_name,
               user_name, document_format, doc_bytes, lookup_job_id FROM requests""",
    "long_headers": """
        WITH p AS (SELECT doc_id, text, greatest(1, CAST(ceil(length(text) / 16000) AS INT)) AS pieces FROM documents)
        SELECT doc_id, 10 + pieces * (5 + length('piece')) + strlen(text) AS header_len, CAST(0 AS BIGINT) AS doc_bytes, pieces,
               md5(text) AS digest FROM p""",
    "document_tails": f"""WITH {REQUESTS}
        SELECT seq, md5(CASE WHEN doc_bytes = 0 THEN '' ELSE text END) AS digest FROM requests""",
    "exploded_attributes": f"""WITH {REQUESTS}, {DECODED_ATTRIBUTES}
        SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY place) AS INT) AS attr_pos, name, 1 AS value_pos,
               tag, s AS str_value, CAST(i AS INT) AS int_value FROM written""",
    "split_rejects": f"WITH {REQUESTS}, {DECODED_ATTRIBUTES}, {DAMAGE} SELECT seq, wrong AS reason, need, have FROM damage WHERE wrong IS NOT NULL",
    "reject_rollup": f"""WITH {REQUESTS}, {DECODED_ATTRIBUTES}, {DAMAGE}
        SELECT wrong AS reason, need, have, count(*) AS messages FROM damage WHERE wrong IS NOT NULL
        GROUP BY wrong, need, have""",
    "judged_messages": f"""WITH {ADMITTED}, {HTTP}, {DECODED_ATTRIBUTES}, {DAMAGE},
        g AS (SELECT a.seq, a.status, a.reason, d.wrong,
                     CASE WHEN method <> 'POST' OR path NOT IN ('/ipp/print', '/') THEN 404
                          WHEN {NOT_HERE} THEN 400 ELSE 200 END AS gate
              FROM admitted a JOIN http h USING (seq) JOIN damage d USING (seq))
        SELECT seq, CASE WHEN gate = 200 AND wrong IS NOT NULL THEN 400 ELSE gate END AS http_status,
               CASE WHEN gate = 200 AND wrong IS NULL THEN status END AS status,
               CASE WHEN gate = 200 THEN coalesce(wrong, reason) END AS reason FROM g""",
    "read_messages": f"""WITH {REQUESTS} SELECT op_code AS code, count(*) AS messages,
        CAST(sum(doc_bytes) AS BIGINT) AS doc_bytes FROM requests GROUP BY op_code""",
    "capture_registry": f"WITH {JOBS} SELECT {JOB_COLUMNS} FROM jobs",
    "archive_documents": f"""WITH {JOBS}
        SELECT session_id, file_name, size_bytes, time_created AS modified_s, md5(text) AS digest FROM jobs""",
    "list_archive": f"WITH {JOBS} SELECT session_id, file_name, size_bytes, time_created AS modified_s FROM jobs",
    "id_blocks": f"WITH {JOBS} SELECT session_id, job_id, created_seq FROM jobs",
    "value_blocks": f"WITH {TOKENS} SELECT msg, grp, pos, attr_pos FROM islands",
    "presence_intervals": _presence(3600),
    "presence_record_lifetime": _presence(120),
    "stream_admission": f"""WITH {ADMITTED}, {DECODED_ATTRIBUTES}, {DAMAGE}
        SELECT seq, CASE WHEN wrong IS NULL THEN 200 ELSE 400 END AS http_status,
               CASE WHEN wrong IS NULL THEN status END AS status, coalesce(wrong, reason) AS reason
        FROM admitted JOIN damage USING (seq)""",
    "stream_registry": f"WITH {JOBS} SELECT {JOB_COLUMNS} FROM jobs",
    "stream_archive": f"""WITH {JOBS}
        SELECT session_id, file_name, size_bytes, md5(text) AS digest,
               strftime(make_timestamp(time_created * 1000000), '%Y-%m-%d') AS day FROM jobs""",
    # Rejects draw no number.
    "stream_capture": f"""WITH {ADMITTED}, {DECODED_ATTRIBUTES}, {DAMAGE}, {BODIES},
        sound AS (SELECT a.* FROM admitted a JOIN damage d USING (seq) WHERE wrong IS NULL),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS job_id,
                            CAST(floor(epoch(arrived_at)) AS BIGINT) AS time_created
                     FROM sound WHERE op_code = 2 AND format_ok AND doc_bytes > 0)
        SELECT 'job' AS kind, seq, session_id, job_id,
               time_created || '_' || job_id || '_'
                 || substring(regexp_replace(job_name, '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g'), 1, 64) || '.pdf' AS file_name,
               doc_bytes AS size_bytes, md5(text) AS digest, NULL AS reason, NULL::BIGINT AS need, NULL::BIGINT AS have
        FROM numbered WHERE status = 0
        UNION ALL
        SELECT 'reject', seq, session_id, NULL, NULL, NULL, digest, wrong, need, have
        FROM damage JOIN requests USING (seq) JOIN bodies USING (seq) WHERE wrong IS NOT NULL""",
    "stream_lookup": f"WITH {LOOKUPS} SELECT * FROM lookups",
    "stream_listing": f"""WITH {LISTED}
        SELECT session_id, position, file_name, size_bytes, files FROM listed WHERE page = 0""",
    "notify_jobs": f"""WITH {JOBS} SELECT job_id, '/archive/' || file_name AS file_path, file_name, size_bytes, session_id
        FROM jobs""",
    "committed_notices": f"""WITH {JOBS} SELECT job_id, '/archive/' || file_name AS file_path, file_name, size_bytes, session_id
        FROM jobs""",
    "stream_presence": _presence(3600),
    # The watermark, in whole milliseconds, stands two minutes below the last announcement.
    "stream_presence_changes": f"""WITH spans AS ({_presence(3600)}),
        settled AS (SELECT epoch_us(max(ts)) // 1000 * 1000 - 120000000 AS upto FROM events)
        SELECT device_id, 'online' AS change, online_from_us AS at_us, online_from_us, NULL::BIGINT AS announcements
        FROM spans, settled WHERE online_from_us <= upto
        UNION ALL
        SELECT device_id, 'offline', offline_at_us, online_from_us, announcements FROM spans, settled
        WHERE offline_at_us <= upto""",
}
