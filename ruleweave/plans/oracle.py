"""ANSI SQL (DuckDB dialect) for every query of ``plans.queries``.

Written independently of the Spark code: plain window functions, joins and
JSON/string functions over the pre-registered ``events`` view.  Nothing is
imported from the engine: the reference's texts, the demo rule history and the
split rule are spelled here once more.
"""

from __future__ import annotations

# Texts of the reference, and the rule history of the queries.
STATIC_ACTION, STATIC_DETAIL = "发优惠券", "满100打骨折"
DYNAMIC_ACTION, DYNAMIC_DETAIL = "发送优惠卷", "满1000打骨折"
THRESHOLD_RULE = "type = 'view' AND cnt >= 2"
EXACT_NTH_RULE = "type = 'view' AND cnt = 2"
HISTORY_METRIC = "user_event_count"
LOOKUP_PARAMS = ["7", "c1", "view", "2024-01-01 00:00:00", "2024-01-31 00:00:00"]
DEMO_RULE_CHANGES = [
    ("2024-01-01 00:00:00", 1, 1, "type = 'view' AND cnt >= 2", "2024-01-01", "2024-01-11", 2),
    ("2024-01-05 00:00:00", 2, 1, "type = 'view' AND cnt = 2", "2024-01-01", "2024-01-31", 3),
    ("2024-01-10 00:00:00", 3, 1, "type = 'purchase' AND cnt >= 1", "2024-01-01", "2024-01-31", 0),
    ("2024-01-15 00:00:00", 1, 2, "type = 'view' AND cnt >= 3", "2024-01-05", "2024-01-21", 1),
    ("2024-01-20 00:00:00", 2, 3, None, None, None, None),
]


def _s(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


EV = """ev AS (
  SELECT event_id AS seq, ts, CAST(user_id AS VARCHAR) AS uid,
         'c' || CAST(CAST(floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 20) AS BIGINT) AS VARCHAR) AS cid,
         event_type AS type
  FROM events)"""

COUNTED = """counted AS (
  SELECT seq, ts, uid, cid, type,
         CAST(row_number() OVER (PARTITION BY uid, cid, type ORDER BY seq) AS BIGINT) AS cnt
  FROM ev)"""

LINES = """lines AS (
  SELECT seq, CASE seq % 50
      WHEN 0 THEN u || ',' || c
      WHEN 1 THEN u || ',' || c || ','
      WHEN 2 THEN u || ',' || c || ',' || t || ',extra'
      WHEN 3 THEN u || ',,' || t
      ELSE u || ',' || c || ',' || t END AS value
  FROM (SELECT seq, coalesce(uid, '') AS u, coalesce(cid, '') AS c, coalesce(type, '') AS t FROM ev))"""

# Java's split drops empty fields at the end; three have to be left.
LINE_OK = "coalesce(len(string_split(rtrim(value, ','), ',')) >= 3, false)"

HIST = """hist AS (
  SELECT uid, cid, type, ts AS start_time, ts + INTERVAL 1 MINUTE AS end_time FROM ev)"""


def _rule_json(rid: str, status: str) -> str:
    return (f"""'{{"id":"' || {rid} || '","name":"r' || {rid} || '","code":"type = ''' || et || ''' AND cnt >= ' || (k % 3 + 1)"""
            f""" || '","sql":"{HISTORY_METRIC}","start_time":"' || CAST(d AS VARCHAR) || '","end_time":"' || CAST(d + 10 AS VARCHAR)"""
            f""" || '","counts":"' || (k % 4) || '","status":"' || {status} || '"}}'""")


CDC_LINES = f"""raw AS (
  SELECT event_id AS topic_offset, ts AS commit_ts, event_type AS et,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(ts AS DATE) AS d
  FROM events),
r AS (SELECT *, CAST(floor(k / 4) AS INTEGER) AS rid FROM raw),
cdc AS (
  SELECT topic_offset, commit_ts, CASE
    WHEN et = 'view' THEN '{{"type":"INSERT","data":[' || {_rule_json('rid', '1')} || ']}}'
    WHEN et = 'click' THEN '{{"type":"UPDATE","data":[' || {_rule_json('rid', '2')} || ',{{"id":"' || ((rid + 3) % 25) || '"}},' || {_rule_json('((rid + 1) % 25)', '3')} || ']}}'
    WHEN et = 'purchase' THEN '{{"type":"UPDATE","data":[' || {_rule_json('rid', '(k % 2 + 1)')} || ',{{"id":"x' || k || '","status":"1"}},' || {_rule_json('((rid + 2) % 25)', '1')} || ']}}'
    WHEN et = 'signup' THEN '{{"type":"DELETE","data":[' || {_rule_json('rid', '3')} || ']}}'
    WHEN k % 4 = 0 THEN 'not json ' || topic_offset
    WHEN k % 4 = 1 THEN '{{"type":"UPDATE","data":null}}'
    WHEN k % 4 = 2 THEN '{{"type":"insert","data":[' || {_rule_json('rid', '1')} || ']}}'
    ELSE '{{"type":"INSERT","data":[{{"id":' || rid || ',"status":' || (k % 3 + 1) || '}}]}}' END AS value
  FROM r)"""

CDC_PARSE = """env AS (
  SELECT topic_offset, commit_ts, value,
         coalesce(CASE WHEN json_valid(value) THEN json_type(value) = 'OBJECT' ELSE false END, false) AS is_obj
  FROM cdc),
parsed AS (
  SELECT topic_offset, commit_ts, is_obj,
         CASE WHEN is_obj THEN json_extract_string(value, '$.type') END AS op,
         CASE WHEN is_obj AND json_type(value, '$.data') = 'ARRAY' THEN json_extract(value, '$.data') END AS data
  FROM env),
elems AS (
  SELECT topic_offset, commit_ts, pos, json_extract(data, '$[' || pos || ']') AS x
  FROM (SELECT topic_offset, commit_ts, data, unnest(range(CAST(json_array_length(data) AS BIGINT))) AS pos
        FROM parsed WHERE op IN ('INSERT', 'UPDATE') AND data IS NOT NULL)),
fields AS (
  SELECT topic_offset, commit_ts, CAST(pos AS INTEGER) AS pos,
         json_extract_string(x, '$.id') AS id_s, json_extract_string(x, '$.name') AS name,
         json_extract_string(x, '$.code') AS code, json_extract_string(x, '$.sql') AS sql,
         json_extract_string(x, '$.start_time') AS start_time,
         json_extract_string(x, '$.end_time') AS end_time,
         json_extract_string(x, '$.counts') AS counts_s, json_extract_string(x, '$.status') AS status_s,
         (x IS NULL OR json_type(x) <> 'OBJECT'
          OR TRY_CAST(json_extract_string(x, '$.id') AS INTEGER) IS NULL
          OR (json_extract_string(x, '$.status') IS NOT NULL
              AND TRY_CAST(json_extract_string(x, '$.status') AS INTEGER) IS NULL)
          OR (json_extract_string(x, '$.counts') IS NOT NULL
              AND TRY_CAST(json_extract_string(x, '$.counts') AS INTEGER) IS NULL)) AS bad
  FROM elems),
marked AS (
  SELECT *, min(CASE WHEN bad THEN pos END) OVER (PARTITION BY topic_offset) AS first_bad FROM fields),
changes AS (
  SELECT topic_offset, pos, commit_ts, TRY_CAST(id_s AS INTEGER) AS id, name, code, sql,
         start_time, end_time, TRY_CAST(counts_s AS INTEGER) AS counts,
         TRY_CAST(status_s AS INTEGER) AS status,
         CASE WHEN TRY_CAST(status_s AS INTEGER) IN (1, 2) THEN 'UPSERT' ELSE 'REMOVE' END AS action
  FROM marked WHERE status_s IS NOT NULL AND (first_bad IS NULL OR pos < first_bad))"""

RULE_COLS = "id, name, code, sql, start_time, end_time, counts, status"


def _demo_versions() -> str:
    rows = []
    for off, (ts, rid, status, code, start, end, counts) in enumerate(DEMO_RULE_CHANGES):
        rows.append(f"({off}, TIMESTAMP '{ts}', {rid}, {status}, {_s(code)}, "
                    f"{_s(HISTORY_METRIC if code else None)}, {_s(start)}, {_s(end)}, "
                    f"{'NULL' if counts is None else counts})")
    return ("chg(topic_offset, commit_ts, id, status, code, sql, start_time, end_time, counts) AS (VALUES\n  "
            + ",\n  ".join(rows) + "),\n"
            "ver AS (\n  SELECT * FROM (SELECT *, commit_ts AS valid_from, lead(commit_ts) OVER (PARTITION BY id ORDER BY topic_offset) AS valid_to"
            " FROM chg) WHERE status IN (1, 2))")


def _match(alias_v: str = "v", alias_e: str = "c") -> str:
    codes = sorted({c for (_, _, _, c, _, _, _) in DEMO_RULE_CHANGES if c})
    branches = " ".join(f"WHEN {alias_v}.code = {_s(c)} THEN coalesce(({_qualify(c, alias_e)}), false)"
                        for c in codes)
    return f"(CASE {branches} ELSE false END)"


def _qualify(code: str, alias: str) -> str:
    # conditions use the bare event columns; qualify them for the join
    import re
    return re.sub(r"\b(uid|cid|type|cnt|seq|ts)\b", lambda m: f"{alias}.{m.group(1)}", code)


IN_FORCE = "c.ts >= v.valid_from AND (v.valid_to IS NULL OR c.ts < v.valid_to)"


def _strict_pairs() -> str:
    return (f"pairs AS (\n  SELECT c.*, v.id AS rule_id, v.sql, v.start_time, v.end_time, v.counts\n"
            f"  FROM counted c JOIN ver v ON {IN_FORCE} AND {_match()})")


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _history_keys() -> str:
    return f"""keys AS (
  SELECT DISTINCT uid, cid, type, start_time, end_time FROM pairs WHERE sql = '{HISTORY_METRIC}'),
hc AS (
  SELECT k.uid, k.cid, k.type, k.start_time, k.end_time, CAST(count(h.uid) AS BIGINT) AS hist_cnt
  FROM keys k LEFT JOIN hist h
    ON h.uid = k.uid AND h.cid = k.cid AND h.type = k.type
   AND h.start_time >= TRY_CAST(k.start_time AS TIMESTAMP) AND h.end_time <= TRY_CAST(k.end_time AS TIMESTAMP)
  GROUP BY ALL)"""


def _decisions() -> str:
    return f"""dec AS (
  SELECT p.seq, p.uid, p.cid, p.type, p.cnt, p.rule_id, p.sql, p.start_time, p.end_time, p.counts,
         hc.hist_cnt, coalesce(hc.hist_cnt >= p.counts, false) AS is_hit
  FROM pairs p LEFT JOIN hc
    ON p.sql = '{HISTORY_METRIC}' AND p.uid IS NOT DISTINCT FROM hc.uid AND p.cid IS NOT DISTINCT FROM hc.cid
   AND p.type IS NOT DISTINCT FROM hc.type AND p.start_time IS NOT DISTINCT FROM hc.start_time
   AND p.end_time IS NOT DISTINCT FROM hc.end_time)"""


def _lookup_sql() -> str:
    uid, cid, typ, lo, hi = (_s(p) for p in LOOKUP_PARAMS)
    return (_with(EV, HIST)
            + f"SELECT count(*) AS counts FROM hist WHERE uid = {uid} AND cid = {cid} AND type = {typ} "
              f"AND start_time >= CAST({lo} AS TIMESTAMP) AND end_time <= CAST({hi} AS TIMESTAMP) GROUP BY uid, cid")


def oracle_sql() -> dict[str, str]:
    ev_base = _with(EV, COUNTED)
    cdc_base = _with(CDC_LINES, CDC_PARSE)
    dyn = _with(EV, COUNTED, _demo_versions(), _strict_pairs())
    hist = _with(EV, COUNTED, HIST, _demo_versions(), _strict_pairs(), _history_keys(), _decisions())
    return {
        "q01_parse_event_lines": _with(EV, LINES)
        + f"SELECT seq, split_part(value, ',', 1) AS uid, split_part(value, ',', 2) AS cid, "
          f"split_part(value, ',', 3) AS type FROM lines WHERE {LINE_OK}",
        "q02_malformed_event_lines": _with(EV, LINES)
        + "SELECT seq, value, CASE WHEN value IS NULL THEN 'null_record' "
          "WHEN len(string_split(value, ',')) < 3 THEN 'too_few_fields' "
          f"ELSE 'empty_trailing_fields' END AS reason FROM lines WHERE NOT {LINE_OK}",
        "q03_cdc_rule_changes": cdc_base
        + f"SELECT topic_offset, pos, commit_ts, {RULE_COLS}, action FROM changes",
        "q04_cdc_rejects": cdc_base
        + "SELECT topic_offset, CAST(NULL AS INTEGER) AS pos, "
          "CASE WHEN NOT is_obj THEN 'not_a_json_object' ELSE 'data_not_an_array' END AS reason "
          "FROM parsed WHERE NOT is_obj OR (op IN ('INSERT', 'UPDATE') AND data IS NULL) "
          "UNION ALL SELECT topic_offset, pos, CASE WHEN pos = first_bad THEN 'bad_element' "
          "ELSE 'after_bad_element' END AS reason FROM marked WHERE pos >= first_bad "
          "UNION ALL SELECT topic_offset, pos, 'null_status' AS reason FROM marked "
          "WHERE status_s IS NULL AND (first_bad IS NULL OR pos < first_bad)",
        "q05_current_rules": cdc_base
        + f"SELECT {RULE_COLS}, commit_ts AS valid_from FROM (SELECT *, row_number() OVER "
          "(PARTITION BY id ORDER BY topic_offset DESC, pos DESC) AS rn FROM changes) "
          "WHERE rn = 1 AND action = 'UPSERT'",
        "q06_rule_versions": cdc_base
        + f"SELECT {RULE_COLS}, topic_offset, pos, commit_ts AS valid_from, valid_to FROM "
          "(SELECT *, lead(commit_ts) OVER (PARTITION BY id ORDER BY topic_offset, pos) AS valid_to "
          "FROM changes) WHERE action = 'UPSERT'",
        "q07_keyed_running_count": ev_base + "SELECT seq, ts, uid, cid, type, cnt FROM counted",
        "q08_keyed_count_state": _with(EV)
        + "SELECT uid, cid, type, CAST(count(*) AS BIGINT) AS cnt FROM ev GROUP BY uid, cid, type",
        "q09_rule_threshold": ev_base
        + f"SELECT seq, uid, {_s(STATIC_ACTION)} AS action, {_s(STATIC_DETAIL)} AS detail "
          f"FROM counted WHERE {THRESHOLD_RULE}",
        "q10_rule_exact_nth": ev_base
        + f"SELECT seq, uid, cid, type, cnt FROM counted WHERE {EXACT_NTH_RULE}",
        "q11_rule_match_trace": dyn
        + "SELECT seq, uid, cid, type, cnt, rule_id, sql, start_time, end_time, counts FROM pairs "
          "WHERE sql IS NOT NULL AND counts IS NOT NULL",
        "q12_dynamic_rules_strict": dyn
        + f"SELECT seq, uid, rule_id, {_s(DYNAMIC_ACTION)} AS action, {_s(DYNAMIC_DETAIL)} AS detail FROM pairs",
        "q13_dynamic_rules_sticky": _with(EV, COUNTED, _demo_versions())
        + f"SELECT seq, uid, rule_id, {_s(DYNAMIC_ACTION)} AS action, {_s(DYNAMIC_DETAIL)} AS detail FROM ("
          f"SELECT c.seq, c.uid, v.id AS rule_id, bool_or({_match()}) OVER (PARTITION BY c.seq ORDER BY v.id "
          f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sticky "
          f"FROM counted c JOIN ver v ON {IN_FORCE}) WHERE sticky",
        "q14_history_range_count": hist + "SELECT uid, cid, type, start_time, end_time, hist_cnt FROM hc",
        "q24_history_before_events": _with(EV, HIST)
        + "SELECT k.uid, k.cid, k.type, k.start_time, k.end_time, CAST(count(h.uid) AS BIGINT) AS hist_cnt "
          "FROM (SELECT DISTINCT uid, cid, type, ts - INTERVAL 7 DAY AS start_time, ts AS end_time FROM ev) k "
          "LEFT JOIN hist h ON h.uid = k.uid AND h.cid = k.cid AND h.type = k.type "
          "AND h.start_time >= k.start_time AND h.end_time <= k.end_time GROUP BY ALL",
        "q15_history_gate": hist + "SELECT * FROM dec",
        "q16_dynamic_rules_history": hist
        + f"SELECT seq, uid, rule_id, {_s(DYNAMIC_ACTION)} AS action, {_s(DYNAMIC_DETAIL)} AS detail "
          "FROM dec WHERE is_hit",
        "q17_parameterized_lookup": _lookup_sql(),
        "q18_daily_threshold": _with(EV)
        + "SELECT seq, uid, cid, type, day, cnt FROM (SELECT *, CAST(ts AS DATE) AS day, "
          "CAST(row_number() OVER (PARTITION BY uid, cid, type, CAST(ts AS DATE) ORDER BY seq) AS BIGINT) AS cnt "
          "FROM ev) WHERE type = 'view' AND cnt > 2",
        "q20_rejected_rules": cdc_base
        + "SELECT * FROM (SELECT id, topic_offset, pos, CASE topic_offset % 10 "
          "WHEN 1 THEN 'nosuch > 1' WHEN 2 THEN 'cnt + 1' "
          "WHEN 3 THEN 'reflect(''java.lang.Math'', ''abs'', 1) = ''1''' "
          "WHEN 4 THEN 'cast(cid AS INT) > 3' WHEN 5 THEN '' "
          "WHEN 6 THEN 'type = ''a''''b'' AND nosuch > 1' "
          "WHEN 7 THEN 'cnt > 12345678901 AND nosuch = 1' WHEN 8 THEN 'cnt IN (SELECT 1)' "
          "WHEN 9 THEN 'type LIKE ''v%''' ELSE code END AS code, "
          "CASE WHEN topic_offset % 10 IN (1, 6, 7) THEN 'does not compile: AnalysisException' "
          "WHEN topic_offset % 10 = 2 THEN 'not a boolean condition: bigint' "
          "WHEN topic_offset % 10 = 3 THEN 'operation not allowed: reflect' "
          "WHEN topic_offset % 10 = 4 THEN 'operation not allowed: cast from string to int' "
          "WHEN topic_offset % 10 = 8 THEN 'operation not allowed: InSubquery' "
          "WHEN topic_offset % 10 = 5 OR (topic_offset % 10 = 0 AND (code IS NULL OR trim(code) = '')) "
          "THEN 'empty condition' END AS reason FROM changes WHERE action = 'UPSERT') "
          "WHERE reason IS NOT NULL",
        "q21_current_rules": _with(CDC_LINES, CDC_PARSE, EV, COUNTED)
        + f"SELECT c.seq, c.uid, r.id AS rule_id, {_s(DYNAMIC_ACTION)} AS action, {_s(DYNAMIC_DETAIL)} AS detail "
          "FROM counted c JOIN (SELECT * FROM (SELECT *, row_number() OVER "
          "(PARTITION BY id ORDER BY topic_offset DESC, pos DESC) AS rn FROM changes) "
          "WHERE rn = 1 AND action = 'UPSERT') r "
          "ON c.type = regexp_extract(r.code, 'type = ''([a-z]+)''', 1) "
          "AND c.cnt >= TRY_CAST(regexp_extract(r.code, 'cnt >= ([0-9]+)', 1) AS INTEGER)",
        "q22_free_conditions": _with(CDC_LINES, CDC_PARSE, EV, COUNTED)
        + "SELECT c.seq, v.id AS rule_id, v.topic_offset, v.pos FROM counted c JOIN ("
          "SELECT * FROM (SELECT *, lead(commit_ts) OVER (PARTITION BY id ORDER BY topic_offset, pos) AS valid_to, "
          "topic_offset % 6 AS k FROM changes) WHERE action = 'UPSERT') v "
          "ON c.ts >= v.commit_ts AND (v.valid_to IS NULL OR c.ts < v.valid_to) AND CASE v.k "
          "WHEN 0 THEN c.type = 'view' AND c.cnt >= 2 "
          "WHEN 2 THEN c.type = 'click' AND c.cnt % 3 = 0 "
          "WHEN 4 THEN coalesce(TRY_CAST(c.uid AS INTEGER) > 50, false) AND c.cnt >= 3 "
          "WHEN 5 THEN v.code IS NOT NULL AND c.type = regexp_extract(v.code, 'type = ''([a-z]+)''', 1) "
          "AND c.cnt >= TRY_CAST(regexp_extract(v.code, 'cnt >= ([0-9]+)', 1) AS INTEGER) "
          "ELSE false END",
        "q23_rules_at_moments": cdc_base
        + "SELECT d.ts, id, name, code, counts, status, topic_offset, pos, valid_from, valid_to FROM "
          "(SELECT DISTINCT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts FROM events) d JOIN "
          "(SELECT *, commit_ts AS valid_from, lead(commit_ts) OVER (PARTITION BY id ORDER BY topic_offset, pos) AS valid_to "
          "FROM changes) v ON v.action = 'UPSERT' AND d.ts >= valid_from AND (valid_to IS NULL OR d.ts < valid_to)",
        "q19_rule_state_trace": cdc_base
        + "SELECT topic_offset, pos, id, action, delta, CAST(sum(delta) OVER (ORDER BY topic_offset, pos "
          "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_active FROM ("
          "SELECT *, CASE WHEN action = 'UPSERT' AND NOT coalesce(prev = 'UPSERT', false) THEN 1 "
          "WHEN action = 'REMOVE' AND coalesce(prev = 'UPSERT', false) THEN -1 ELSE 0 END AS delta FROM ("
          "SELECT *, lag(action) OVER (PARTITION BY id ORDER BY topic_offset, pos) AS prev FROM changes))",
    }
