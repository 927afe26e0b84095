"""Static and dynamic rule evaluation: golden numbers (FIXTURES §3),
invariants (SURVEY §5) and both join strategies."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF001, rows
from ruleweave.operators import evaluate
from ruleweave.functions.conditions import condition
from ruleweave.operators.rules import parse_cdc, rule_versions
from ruleweave.plans import queries as Q
from ruleweave.sources.cdc import demo_rule_lines


@pytest.fixture(scope="module")
def counted(spark):
    return Q.counted_events(spark, SF001)


@pytest.fixture(scope="module")
def rule_set(spark):
    return Q.demo_rule_set(spark)


def test_threshold_invariants(spark, counted):
    views = counted.where("type = 'view'").groupBy("uid", "cid", "type").count()
    expect_ge2 = views.agg(F.sum(F.greatest(F.col("count") - 1, F.lit(0)))).first()[0]
    expect_eq2 = views.where("count >= 2").count()
    assert Q.q09_rule_threshold(spark, SF001).count() == expect_ge2 == 1292
    assert Q.q10_rule_exact_nth(spark, SF001).count() == expect_eq2 == 553


def test_dynamic_golden_and_containment(spark, counted, rule_set):
    strict = evaluate.dynamic_rules(counted, rule_set, "strict")
    sticky = evaluate.dynamic_rules(counted, rule_set, "sticky")
    assert strict.count() == 2712 and sticky.count() == 3914
    assert strict.exceptAll(sticky).count() == 0  # strict ⊆ sticky
    gated = Q.q16_dynamic_rules_history(spark, SF001)
    assert gated.count() == 2474
    assert gated.exceptAll(strict).count() == 0  # history gate only removes
    # rule 3 has threshold 0: the history never blocks it
    assert gated.where("rule_id = 3").count() == strict.where("rule_id = 3").count()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loops(spark, counted, rule_set):
    for mode in ("strict", "sticky"):
        plan = _plan(evaluate.dynamic_rules(counted, rule_set, mode))
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_joins_without_broadcast(spark, counted, rule_set):
    """The same pairs when nothing may be broadcast."""
    small = evaluate.matched_pairs(counted, rule_set)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        large = evaluate.matched_pairs(counted, rule_set)
        assert small.exceptAll(large).count() == 0 and large.exceptAll(small).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_sticky_does_not_leak_between_events(spark):
    """Two events with one seq (offsets repeat over partitions): only the one
    that is hit gets the later rules."""
    when = dt.datetime(2024, 1, 2)
    ev = spark.createDataFrame([(1, when, "u", "c", "view", 1, 0), (1, when, "v", "c", "click", 1, 1)],
                               "seq BIGINT, ts TIMESTAMP_NTZ, uid STRING, cid STRING, type STRING, cnt BIGINT, kafka_partition INT")
    changes = [("2024-01-01 00:00:00", 1, 1, "type='view'", None, None, None),
               ("2024-01-01 00:00:00", 2, 1, "cnt > 5", None, None, None)]
    ch, _ = parse_cdc(demo_rule_lines(spark, changes))
    rs = evaluate.compile_rules(spark, rule_versions(ch))
    assert rows(evaluate.dynamic_rules(ev, rs, "sticky"), "uid", "rule_id") == [("u", 1), ("u", 2)]


def test_sticky_semantics(spark):
    # one event, three rules in force: 1 misses, 2 hits, 3 misses → rules 2 and 3 emit
    ev = spark.createDataFrame([(1, dt.datetime(2024, 1, 2), "u", "c", "view", 1)],
                               "seq BIGINT, ts TIMESTAMP_NTZ, uid STRING, cid STRING, type STRING, cnt BIGINT")
    changes = [("2024-01-01 00:00:00", 1, 1, "cnt >= 5", None, None, None),
               ("2024-01-01 00:00:00", 2, 1, "type = 'view'", None, None, None),
               ("2024-01-01 00:00:00", 3, 1, "type = 'click'", None, None, None)]
    ch, _ = parse_cdc(demo_rule_lines(spark, changes))
    rs = evaluate.compile_rules(spark, rule_versions(ch))
    assert rows(evaluate.dynamic_rules(ev, rs, "strict"), "rule_id") == [(2,)]
    assert rows(evaluate.dynamic_rules(ev, rs, "sticky"), "rule_id") == [(2,), (3,)]


def test_rejected_condition_never_matches(spark, counted):
    changes = [("2024-01-01 00:00:00", 1, 1, "reflect('a','b') = 'x'", None, None, None),
               ("2024-01-01 00:00:00", 2, 1, "type = 'view' AND cnt >= 2", None, None, None)]
    ch, _ = parse_cdc(demo_rule_lines(spark, changes))
    rs = evaluate.compile_rules(spark, rule_versions(ch))
    assert list(rs.rejected) == ["reflect('a','b') = 'x'"]
    out = evaluate.dynamic_rules(counted, rs, "strict")
    assert out.where("rule_id = 1").count() == 0 and out.count() == 1292


def test_independent_of_partitioning(spark, counted, rule_set):
    base = evaluate.dynamic_rules(counted, rule_set, "sticky")
    shuffled = evaluate.dynamic_rules(counted.repartition(13, "seq"), rule_set, "sticky")
    assert base.exceptAll(shuffled).count() == 0 and shuffled.exceptAll(base).count() == 0


def test_current_rules_without_time_travel(spark, counted):
    from ruleweave.operators.rules import current_rules
    changes, _ = parse_cdc(demo_rule_lines(spark))
    rs = evaluate.current_rule_set(spark, current_rules(changes))
    got = evaluate.dynamic_rules(counted, rs, "strict")
    # after all changes: rule 1 = view and cnt >= 3, rule 3 = purchase and cnt >= 1
    want1 = counted.where("type = 'view' AND cnt >= 3").count()
    want3 = counted.where("type = 'purchase' AND cnt >= 1").count()
    assert got.where("rule_id = 1").count() == want1
    assert got.where("rule_id = 3").count() == want3
    assert got.count() == want1 + want3


def test_mixed_guarded_and_unguarded_rules(spark, counted):
    changes = [("2024-01-01 00:00:00", 1, 1, "type = 'view' AND cnt >= 2", None, None, None),
               ("2024-01-03 00:00:00", 2, 1, "cnt = 3 AND cid = 'c1'", None, None, None),
               ("2024-01-05 00:00:00", 3, 1, "type = 'click' AND cnt = 1 OR type = 'error'", None, None, None),
               ("2024-01-20 00:00:00", 1, 3, None, None, None, None)]
    ch, _ = parse_cdc(demo_rule_lines(spark, changes))
    rs = evaluate.compile_rules(spark, rule_versions(ch))
    got = evaluate.matched_pairs(counted, rs).select("seq", "id")
    force = (F.col("ts") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("ts") < F.col("valid_to")))
    want = None
    for code in [c[3] for c in changes if c[3]]:
        part = counted.crossJoin(rs.versions.where(F.col("code") == code)).where(force & condition(code)).select("seq", "id")
        want = part if want is None else want.unionByName(part)
    assert want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_many_rules_equal_brute_force(spark, counted):
    """Simple conditions of every form, and free ones, against each text alone."""
    codes = [f"type = '{t}' AND cnt >= {k}" for t in ("view", "click", "error") for k in (1, 2, 3)]
    codes += ["cid = 'c1' OR cnt = 4", "try_mod(cnt, 2) = 0 AND type = 'view'", "cnt <> 2 AND CID='c1'",
              "type != 'view' and cnt<3 and cnt > 1", "uid = '7' AND type = 'view' AND type = 'view'",
              "type = 'view' AND type = 'click'", "seq < 500", "cnt = 2 AND cnt >= 3", "uid >= '5' AND uid < '6'",
              'type = "click" AND cid = "c3"', "type = 'a AND cnt = 1'", " TYPE == 'view' AND cnt >= 2 "]
    changes = [("2024-01-02 00:00:00", i, 1, c, None, None, None) for i, c in enumerate(codes)]
    ch, _ = parse_cdc(demo_rule_lines(spark, changes))
    rs = evaluate.compile_rules(spark, rule_versions(ch))
    assert not rs.rejected and not rs.codes
    got = evaluate.matched_pairs(counted, rs).select("seq", "id")
    want = None
    for ts, rid, _, code, *_ in changes:
        part = (counted.where(F.col("ts") >= F.lit(ts).cast("timestamp_ntz")).where(condition(code))
                .select("seq", F.lit(rid).alias("id")))
        want = part if want is None else want.unionByName(part)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
