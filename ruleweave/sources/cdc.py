"""Rule-table change feeds.

Two feeds are provided:

* ``cdc_lines_from_events``: one change record per row of the ``events``
  table, built with string functions only, so the change-feed operators run
  over a feed that grows with the data.  The records cover every case the
  reference's parser meets (the SQL oracle builds the same text):

  ====================  ====================================================
  event_type            record
  ====================  ====================================================
  view                  INSERT of rule ``id`` with status 1
  click                 UPDATE: rule ``id`` status 2, an element without a
                        status (quarantined alone), rule ``id+1`` status 3
  purchase              UPDATE: rule ``id`` (status 1 or 2), a bad element
                        (id ``x<k>``), rule ``id+2``: only the first survives
  signup                DELETE of rule ``id`` (ignored by the reference)
  error, k % 4 = 0      not JSON
  error, k % 4 = 1      UPDATE with ``data`` null
  error, k % 4 = 2      lower-case ``insert`` (ignored)
  error, k % 4 = 3      INSERT with numeric id/status and no condition
  ====================  ====================================================

  with ``k`` = ``props.k``, ``id = floor(k / 4)`` (25 rules), condition
  ``type = '<event_type>' AND cnt >= k % 3 + 1``, ``counts = k % 4`` and the
  rule's history range ``[day of ts, day of ts + 10 days]``.

* ``demo_rule_lines``: the fixed five-change rule history used for the
  dynamic-rule queries (FIXTURES §3), serialised as change records.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conditions import EXACT_NTH_RULE, THRESHOLD_RULE
from ..schemas import CDC_LINE
from .events import read_table

# Fixed value: name of the history metric the demo rules refer to in ``sql``.
HISTORY_METRIC = "user_event_count"
N_DERIVED_RULES = 25


def _q(text: str) -> Column:
    return F.lit(text)


def _rule_json(rid: Column, status: Column, etype: Column, k: Column, day: Column) -> Column:
    thr = (F.pmod(k, F.lit(3)) + 1).cast("string")
    return F.concat(
        _q('{"id":"'), rid.cast("string"),
        _q('","name":"r'), rid.cast("string"),
        _q('","code":"type = \''), etype, _q("' AND cnt >= "), thr,
        _q('","sql":"' + HISTORY_METRIC + '","start_time":"'), day.cast("string"),
        _q('","end_time":"'), F.date_add(day, 10).cast("string"),
        _q('","counts":"'), F.pmod(k, F.lit(4)).cast("string"),
        _q('","status":"'), status.cast("string"), _q('"}'))


def cdc_lines_from_events(raw_events: DataFrame) -> DataFrame:
    """``events`` table → ``(topic_offset, commit_ts, value)`` change records.

    ``k`` and the rule id are computed in their own projection: they are
    referenced many times by the record text, and Catalyst does not inline a
    non-trivial expression into several consumers, so the JSON of ``props``
    is read once per row.
    """
    base = raw_events.select(
        F.col("event_id").alias("topic_offset"), F.col("ts").alias("commit_ts"),
        F.col("event_type").alias("et"), F.to_date("ts").alias("day"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    base = base.withColumn("rid", F.floor(F.col("k") / F.lit(4)).cast("int"))
    k, rid, etype, day = F.col("k"), F.col("rid"), F.col("et"), F.col("day")
    nxt = lambda d: F.pmod(rid + d, F.lit(N_DERIVED_RULES))
    rule = lambda r, s: _rule_json(r, F.lit(s) if isinstance(s, int) else s, etype, k, day)
    record = lambda op, *elems: F.concat(
        _q('{"type":"' + op + '","data":['), F.concat_ws(",", *elems), _q("]}"))
    bad = F.concat(_q('{"id":"x'), k.cast("string"), _q('","status":"1"}'))
    no_status = F.concat(_q('{"id":"'), nxt(3).cast("string"), _q('"}'))
    numeric = F.concat(_q('{"id":'), rid.cast("string"), _q(',"status":'),
                       (F.pmod(k, F.lit(3)) + 1).cast("string"), _q("}"))
    e = F.pmod(k, F.lit(4))
    value = (F.when(etype == "view", record("INSERT", rule(rid, 1)))
             .when(etype == "click", record("UPDATE", rule(rid, 2), no_status, rule(nxt(1), 3)))
             .when(etype == "purchase",
                   record("UPDATE", rule(rid, F.pmod(k, F.lit(2)) + 1), bad, rule(nxt(2), 1)))
             .when(etype == "signup", record("DELETE", rule(rid, 3)))
             .when(e == 0, F.concat(_q("not json "), F.col("topic_offset").cast("string")))
             .when(e == 1, _q('{"type":"UPDATE","data":null}'))
             .when(e == 2, record("insert", rule(rid, 1)))
             .otherwise(record("INSERT", numeric)))
    return base.select("topic_offset", "commit_ts", value.alias("value"))


def load_cdc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc_lines_from_events(read_table(spark, sf_dir, "events"))


# Condition texts given to derived rule versions by ``topic_offset``, in turn;
# null keeps the version's own.  The first list holds usable free conditions
# beside two that could raise an error; the second one what can't be used.
FREE_CONDITIONS = [
    'type = "view" AND cnt >= 2',
    "cid = 201",
    "type = 'click' AND try_mod(cnt, 3) = 0",
    "cnt % 0 = 1",
    "try_cast(uid AS INT) > 50 AND cnt >= 3",
    None,
]
BAD_CONDITIONS = [
    None,
    "nosuch > 1",
    "cnt + 1",
    "reflect('java.lang.Math', 'abs', 1) = '1'",
    "cast(cid AS INT) > 3",
    "",
    "type = 'a''b' AND nosuch > 1",
    "cnt > 12345678901 AND nosuch = 1",
    "cnt IN (SELECT 1)",
    "type LIKE 'v%'",
]


def _replaced(versions: DataFrame, texts: list) -> DataFrame:
    code, at = F.col("code"), F.pmod(F.col("topic_offset"), F.lit(len(texts)))
    for i, text in enumerate(texts):
        if text is not None:
            code = F.when(at == i, F.lit(text)).otherwise(code)
    return versions.withColumn("code", code)


def with_free_conditions(versions: DataFrame) -> DataFrame:
    return _replaced(versions, FREE_CONDITIONS)


def with_bad_conditions(versions: DataFrame) -> DataFrame:
    return _replaced(versions, BAD_CONDITIONS)


# The demo rule history (FIXTURES §3).  Columns: commit time,
# id, status, condition, history range start, end, history threshold.
DEMO_RULE_CHANGES = [
    ("2024-01-01 00:00:00", 1, 1, THRESHOLD_RULE, "2024-01-01", "2024-01-11", 2),
    ("2024-01-05 00:00:00", 2, 1, EXACT_NTH_RULE, "2024-01-01", "2024-01-31", 3),
    ("2024-01-10 00:00:00", 3, 1, "type = 'purchase' AND cnt >= 1", "2024-01-01", "2024-01-31", 0),
    ("2024-01-15 00:00:00", 1, 2, "type = 'view' AND cnt >= 3", "2024-01-05", "2024-01-21", 1),
    ("2024-01-20 00:00:00", 2, 3, None, None, None, None),
]


def demo_rule_records(changes=DEMO_RULE_CHANGES) -> list[tuple[int, str, str]]:
    """The rule history as (topic_offset, commit_ts, change-record text)."""
    out = []
    for offset, (ts, rid, status, code, start, end, counts) in enumerate(changes):
        elem = {"id": str(rid), "name": f"rule-{rid}", "status": str(status)}
        if code is not None:
            elem.update(code=code, sql=HISTORY_METRIC)
        for key, val in (("start_time", start), ("end_time", end), ("counts", counts)):
            if val is not None:
                elem[key] = str(val)
        op = "INSERT" if offset == 0 else "UPDATE"
        out.append((offset, ts, json.dumps({"type": op, "data": [elem]}, ensure_ascii=False)))
    return out


def demo_rule_lines(spark: SparkSession, changes=DEMO_RULE_CHANGES) -> DataFrame:
    rows = demo_rule_records(changes)
    df = spark.createDataFrame([(o, t, v) for o, t, v in rows],
                               "topic_offset BIGINT, commit_ts STRING, value STRING")
    return df.select("topic_offset", F.col("commit_ts").cast("timestamp_ntz"), "value")


def read_cdc_text(spark: SparkSession, path: str) -> DataFrame:
    """Change records stored as JSON lines of ``CDC_LINE``."""
    return spark.read.schema(CDC_LINE).json(path)
