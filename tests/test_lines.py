"""Event-record parsing (B1, B2, X22) on the edge records of FIXTURES §5."""

import pytest
from pyspark.errors import PySparkException

from conftest import rows
from ruleweave.operators.parse import parse_lines

EDGE = [
    (1, "u,c,view"),    # valid
    (2, "a,b,c,d"),     # valid, type c (fields after the third ignored)
    (3, "u,,view"),     # valid, empty cid
    (4, "u,c,,x"),      # valid, empty type
    (5, "u,c,"),        # malformed: trailing empty token dropped by the split rule
    (6, "u,c"),         # malformed
    (7, ""),            # malformed
    (8, "u1001,c201,view"),  # the reference's sample line
]


def test_edge_records(spark):
    df = spark.createDataFrame(EDGE, "seq BIGINT, value STRING")
    good, bad = parse_lines(df)
    assert rows(good) == [(1, "u", "c", "view"), (2, "a", "b", "c"), (3, "u", "", "view"),
                          (4, "u", "c", ""), (8, "u1001", "c201", "view")]
    assert rows(bad, "seq", "reason") == [(5, "empty_trailing_fields"), (6, "too_few_fields"),
                                          (7, "too_few_fields")]


def test_fail_mode_raises(spark):
    df = spark.createDataFrame([(1, "u,c,view"), (2, "u,c")], "seq BIGINT, value STRING")
    good, _ = parse_lines(df, mode="fail")
    with pytest.raises(PySparkException):
        good.collect()
    ok, _ = parse_lines(df.where("seq = 1"), mode="fail")
    assert rows(ok) == [(1, "u", "c", "view")]


def test_every_line_is_good_or_bad(spark):
    from ruleweave.sources.events import event_lines, load_events
    lines = event_lines(load_events(spark, "/root/testdata/sf0.001"))
    good, bad = parse_lines(lines)
    assert good.count() + bad.count() == lines.count() == 1000
