"""The index of rules: against brute force, and how many pairs it tests."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from ruleweave.operators import asof, evaluate
from ruleweave.plans import queries as Q
from ruleweave.sources.cdc import with_free_conditions

EVENT = "seq BIGINT, ts TIMESTAMP_NTZ, uid STRING, cid STRING, type STRING, cnt BIGINT"
VERSION = ("id INT, name STRING, code STRING, sql STRING, start_time STRING, end_time STRING, counts INT, status INT, "
           "topic_offset BIGINT, pos INT, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ")
T0 = dt.datetime(2024, 1, 1)
# each condition as text and as a Python function of (seq, uid, cid, type, cnt); null counts as not known
CONDITIONS = [
    ("type = 'view'", lambda s, u, c, t, n: t == "view"),
    ("type IN ('view', 'click') AND cnt >= 2", lambda s, u, c, t, n: t in ("view", "click") and n is not None and n >= 2),
    ("cnt = 3", lambda s, u, c, t, n: n == 3),
    ("cnt >= 40 OR type = 'view' OR uid = 'u1'", lambda s, u, c, t, n: (n is not None and n >= 40) or t == "view" or u == "u1"),
    ("cnt > 16 AND cnt <= 300 AND type <> 'view'", lambda s, u, c, t, n: n is not None and 16 < n <= 300 and t is not None and t != "view"),
    ('uid = "u2" AND cid = "c1"', lambda s, u, c, t, n: u == "u2" and c == "c1"),
    ("cid NOT IN ('c0', 'c1') AND type LIKE '%i%'", lambda s, u, c, t, n: c is not None and c not in ("c0", "c1") and t is not None and "i" in t),
    ("cnt <= 2", lambda s, u, c, t, n: n is not None and n <= 2),
    ("try_mod(cnt, 4) IN (1, -1) AND seq >= 100", lambda s, u, c, t, n: n is not None and s >= 100 and (abs(n) % 4 * (1 if n >= 0 else -1)) in (1, -1)),
    ("lower(type) = 'click'", lambda s, u, c, t, n: t is not None and t.lower() == "click"),
    ("cnt = 5 AND cnt = 6", lambda s, u, c, t, n: False),
    ("type NOT LIKE 'v%'", lambda s, u, c, t, n: t is not None and not t.startswith("v")),
]


def made(seed, n_events=250, n_versions=260, largest_id=5000):
    rnd = random.Random(seed)
    at = lambda: T0 + dt.timedelta(microseconds=rnd.choice([0, 1, rnd.randrange(10 ** 6), rnd.randrange(86_400 * 10 ** 6 * 40)]))
    events = [(i, None if i % 50 == 7 else at(), f"u{rnd.randrange(4)}", f"c{rnd.randrange(3)}",
               rnd.choice(["view", "click", "Click", None]), rnd.choice([None, -1, 0, 1, 2, 3, 5, 16, 17, 64, 65, 300, 5000, 10 ** 13]))
              for i in range(n_events)]
    versions = []
    for i in range(n_versions):
        start = at() if i % 9 else dt.datetime(1, 1, 1)
        stop = None if i % 3 == 0 else start + dt.timedelta(microseconds=rnd.choice([0, 1, 10 ** 6, 10 ** 9, 10 ** 12]) * rnd.randrange(1, 5))
        code = CONDITIONS[i % len(CONDITIONS)][0]
        versions.append((rnd.choice([1, 2, 3, rnd.randrange(largest_id)]), "r", code, None, None, None, 0, 1, i, 0, start, stop))
    return events, versions


def strict(events, versions):
    tests = dict(CONDITIONS)
    return [(e, v) for e in events if e[1] is not None for v in versions
            if v[10] <= e[1] and (v[11] is None or e[1] < v[11]) and tests[v[2]](e[0], *e[2:])]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    events, versions = made(seed)
    rs = evaluate.compile_rules(spark, spark.createDataFrame(versions, VERSION))
    assert rs.codes == ["lower(type) = 'click'"]
    counted = spark.createDataFrame(events, EVENT)
    want = strict(events, versions)
    got = evaluate.matched_pairs(counted, rs).select("seq", "topic_offset").collect()
    assert sorted(map(tuple, got)) == sorted((e[0], v[8]) for e, v in want)   # each pair once

    first = {}
    for e, v in want:
        first[e[0]] = min(first.get(e[0], v[0]), v[0])
    later = [(e[0], v[8]) for e in events if e[0] in first for v in versions
             if v[10] <= e[1] and (v[11] is None or e[1] < v[11]) and v[0] >= first[e[0]]]
    got = evaluate.sticky_pairs(counted, rs).select("seq", "topic_offset").collect()
    assert sorted(map(tuple, got)) == sorted(later) and len(later) > 1000


def test_nothing_to_join(spark):
    events, versions = made(3, 20, 20)
    counted, rules = spark.createDataFrame(events, EVENT), spark.createDataFrame(versions, VERSION)
    none = evaluate.compile_rules(spark, rules.limit(0))
    for mode in ("strict", "sticky"):
        assert evaluate.dynamic_rules(counted, none, mode).count() == 0
        assert evaluate.dynamic_rules(counted.limit(0), evaluate.compile_rules(spark, rules), mode).count() == 0
        later = rules.withColumn("valid_from", F.lit("2099-01-01").cast("timestamp_ntz"))
        assert evaluate.dynamic_rules(counted, evaluate.compile_rules(spark, later), mode).count() == 0


def met(events, index):
    """Pairs whose conditions are tested."""
    keys = asof.lookup_keys(events, index)
    return keys.join(index.drop("__kind", "__level", "__way"), asof.KEYS).count()


def test_pairs_tested_follow_the_events(spark):
    """Ten times the events and rule versions: ten times the pairs, not a hundred."""
    tested = {}
    for sf in (SF001.replace("sf0.01", "sf0.001"), SF001):
        counted = Q.counted_events(spark, sf)
        rs = evaluate.compile_rules(spark, with_free_conditions(Q.derived_versions(spark, sf)))
        span = Q._span(spark, sf)
        tested[sf] = met(counted, asof.rule_index(rs.alternatives(), span)), counted.count(), rs.versions.count()
    (few, n, k), (many, n10, k10) = tested.values()
    assert n10 == 10 * n and k10 > 9 * k and n10 * k10 > 50_000_000
    assert many < 12 * few and many < 12 * n10, tested


def test_many_rules_of_one_type(spark):
    """Thousands of thresholds and users in force at once: an event tests few
    rules that it doesn't satisfy."""
    when = T0
    codes = ([f"type = 'view' AND cnt = {k}" for k in range(1, 2001)] + [f"uid = 'u{k}'" for k in range(2000)]
             + [f"type = 'view' AND cnt >= {4 ** 8 + k}" for k in range(1000)])
    versions = [(i, "r", c, None, None, None, 0, 1, i, 0, when, None) for i, c in enumerate(codes)]
    events = [(i, when + dt.timedelta(hours=i), f"u{i}", "c", "view", i + 1) for i in range(500)]
    counted = spark.createDataFrame(events, EVENT)
    rs = evaluate.compile_rules(spark, spark.createDataFrame(versions, VERSION))
    index = asof.rule_index(rs.alternatives(), asof.event_span(counted))
    hits = evaluate.matched_pairs(counted, rs).count()
    assert hits == 1000 and met(counted, index) <= 2 * hits


def test_rules_in_force(spark):
    events, versions = made(5, 60, 200)
    moments, rules = spark.createDataFrame(events, EVENT), spark.createDataFrame(versions, VERSION)
    got = asof.rules_in_force(moments, rules).select("seq", "topic_offset").collect()
    want = [(e[0], v[8]) for e in events if e[1] for v in versions if v[10] <= e[1] and (v[11] is None or e[1] < v[11])]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 1000
    assert asof.rules_in_force(moments.limit(0), rules).count() == asof.rules_in_force(moments, rules.limit(0)).count() == 0
