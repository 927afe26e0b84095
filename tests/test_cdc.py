"""Change-record parsing (B3-B7, X8-X11, X23) on the records of FIXTURES §4,
and the rule table built from them (D1-D3)."""

import datetime as dt

from conftest import rows
from ruleweave.operators.rules import current_rules, parse_cdc, rule_state_trace, rule_versions
from ruleweave.sources.cdc import demo_rule_lines

RECORDS = [
    '{"type":"INSERT","data":[{"id":"1","name":"a","code":"x","start_time":"2024-01-01 00:00:00",'
    '"counts":"2","status":"1"},{"id":"2","status":"3"}]}',
    '{"type":"DELETE","data":[{"id":"1"}]}',
    "not json",
    "",
    '{"type":"UPDATE","data":null}',
    '{"type":"UPDATE","data":[{"id":1,"status":2},{"id":"zz","status":"1"}]}',
    '{"type":"UPDATE","data":[{"id":"zz","status":"1"},{"id":"4","status":"1"}]}',
    '{"type":"insert","data":[{"id":"5","status":"1"}]}',
    '{"type":"INSERT","data":[{"id":"6"}]}',
    # an element that can't be applied doesn't take later ones with it
    '{"type":"INSERT","data":[{"id":"7","status":"1"},{"id":"8"},{"id":"9","status":"2"},{"id":"x"},{"id":"1","status":"3"}]}',
]


def _lines(spark):
    base = dt.datetime(2024, 1, 1)
    data = [(i, base + dt.timedelta(days=i), v) for i, v in enumerate(RECORDS)]
    return spark.createDataFrame(data, "topic_offset BIGINT, commit_ts TIMESTAMP_NTZ, value STRING")


def test_edge_records(spark):
    changes, rejects = parse_cdc(_lines(spark))
    assert rows(changes, "topic_offset", "pos", "id", "status", "action") == [
        (0, 0, 1, 1, "UPSERT"), (0, 1, 2, 3, "REMOVE"), (5, 0, 1, 2, "UPSERT"),
        (9, 0, 7, 1, "UPSERT"), (9, 2, 9, 2, "UPSERT")]
    got = rows(rejects, "topic_offset", "pos", "reason")
    assert got == sorted([
        (2, None, "not_a_json_object"), (3, None, "not_a_json_object"),
        (4, None, "data_not_an_array"), (5, 1, "bad_element"),
        (6, 0, "bad_element"), (6, 1, "after_bad_element"), (8, 0, "null_status"),
        (9, 1, "null_status"), (9, 3, "bad_element"), (9, 4, "after_bad_element")], key=repr)


def test_physical_delete_keeps_rule(spark):
    changes, _ = parse_cdc(_lines(spark))
    cur = current_rules(changes)
    # rule 1: upsert at 0, DELETE record ignored, upsert again at 5; rule 2 removed
    assert rows(cur, "id", "status") == [(1, 2), (7, 1), (9, 2)]


def test_demo_rule_history(spark):
    changes, rejects = parse_cdc(demo_rule_lines(spark))
    assert rejects.count() == 0
    assert rows(current_rules(changes), "id") == [(1,), (3,)]
    for block in (1 << 20, 2, 1):
        v = rule_versions(changes, block_size=block)
        assert rows(v, "id", "valid_from", "valid_to") == [
            (1, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 15)),
            (1, dt.datetime(2024, 1, 15), None),
            (2, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20)),
            (3, dt.datetime(2024, 1, 10), None)]
        trace = rule_state_trace(changes, block_size=block)
        assert rows(trace, "topic_offset", "n_active") == [(0, 1), (1, 2), (2, 3), (3, 3), (4, 2)]
