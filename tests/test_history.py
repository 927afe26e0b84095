"""History check (C4-C6, E3, E4, X17, X18) against brute force."""

import datetime as dt
import random

import pytest

from conftest import SF0001, rows
from ruleweave.operators.history import history_counts, history_gate, lookup_count, positional_to_named
from ruleweave.sources.events import load_history

T = dt.datetime


def _history(spark):
    data = [("u", "c", "view", T(2024, 1, 1, 10), T(2024, 1, 1, 11)),
            ("u", "c", "view", T(2024, 1, 5), T(2024, 1, 5, 1)),
            ("u", "c", "view", T(2024, 1, 10, 23), T(2024, 1, 11, 0, 0)),   # ends on the bound
            ("u", "c", "view", T(2024, 1, 10, 23), T(2024, 1, 11, 0, 1)),   # ends past it
            ("u", "c", "click", T(2024, 1, 2), T(2024, 1, 2, 1)),
            ("v", "c", "view", T(2024, 1, 2), T(2024, 1, 2, 1))]
    return spark.createDataFrame(data, "uid STRING, cid STRING, type STRING, "
                                       "start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ")


def test_counts_inclusive_containment(spark):
    keys = spark.createDataFrame(
        [("u", "c", "view", "2024-01-01", "2024-01-11"), ("u", "c", "view", "2024-01-02", "2024-01-31"),
         ("w", "c", "view", "2024-01-01", "2024-01-31")],
        "uid STRING, cid STRING, type STRING, start_time STRING, end_time STRING")
    got = history_counts(keys, _history(spark))
    assert rows(got, "uid", "start_time", "hist_cnt") == [
        ("u", "2024-01-01", 3), ("u", "2024-01-02", 3), ("w", "2024-01-01", 0)]


def test_gate_threshold_and_quarantine(spark):
    cand = spark.createDataFrame(
        [(1, "u", "c", "view", 1, "m", "2024-01-01", "2024-01-11", 3),
         (2, "u", "c", "view", 2, "m", "2024-01-01", "2024-01-11", 4),
         (3, "w", "c", "view", 1, "m", "2024-01-01", "2024-01-11", 0),     # no row → 0 >= 0
         (4, "u", "c", "view", 1, "other", "2024-01-01", "2024-01-11", 0),  # unknown metric
         (5, "u", None, "view", 1, "m", "2024-01-01", "2024-01-11", 0)],   # null key → 0
        "seq BIGINT, uid STRING, cid STRING, type STRING, rule_id INT, sql STRING, "
        "start_time STRING, end_time STRING, counts INT")
    got = history_gate(cand, {"m": _history(spark)})
    assert rows(got, "seq", "hist_cnt", "is_hit") == [
        (1, 3, True), (2, 3, False), (3, 0, True), (4, None, False), (5, 0, True)]


def test_bulk_equals_single_lookups(spark):
    hist = load_history(spark, SF0001)
    keys = hist.select("uid", "cid", "type").distinct().limit(5).collect()
    for k in keys:
        params = [k.uid, k.cid, k.type, "2024-01-03 00:00:00", "2024-01-20 00:00:00"]
        single = lookup_count(spark, hist, params).collect()
        n = single[0]["counts"] if single else 0
        kdf = spark.createDataFrame([(k.uid, k.cid, k.type, params[3], params[4])],
                                    "uid STRING, cid STRING, type STRING, start_time STRING, end_time STRING")
        assert history_counts(kdf, hist).first()["hist_cnt"] == n


def test_positional_markers():
    text, names = positional_to_named("SELECT '?' AS q FROM t WHERE a = ? AND b = \"?\" AND c > ?")
    assert names == ["__p0", "__p1"]
    assert text == "SELECT '?' AS q FROM t WHERE a = :__p0 AND b = \"?\" AND c > :__p1"


def test_hot_history_key_is_counted_before_the_shuffle(spark):
    """A key with a third of the history: equal rows are counted where they are
    read; the count is exact."""
    from pyspark.sql import functions as F
    h = load_history(spark, "/root/testdata/sf0.01")
    hot = F.pmod(F.hash("start_time"), F.lit(3)) == 0
    h = h.select(*[F.when(hot, F.lit("hot")).otherwise(F.col(c)).alias(c) for c in ["uid", "cid", "type"]],
                 "start_time", "end_time")
    keys = (h.select("uid", "cid", "type").distinct()
            .withColumn("start_time", F.lit("2024-01-01")).withColumn("end_time", F.lit("2024-01-31")))
    got = history_counts(keys, h)
    plan = got._jdf.queryExecution().executedPlan().toString()
    res = {r.uid: r.hist_cnt for r in got.collect() if r.uid == "hot"}
    want = h.where("uid = 'hot' AND start_time >= '2024-01-01' AND end_time <= '2024-01-31'").count()
    assert "partial_count(1)" in plan and "NestedLoop" not in plan
    assert res["hot"] == want and want > 3000


@pytest.mark.parametrize("block_size", [1 << 20, 40])
def test_many_ranges_against_brute_force(spark, block_size):
    """Many distinct ranges a key, equal times, ends before starts, nulls, texts that
    are no time; with small blocks, keys of very many rows."""
    rnd = random.Random(5)
    hour = lambda n: T(2024, 1, 1) + dt.timedelta(hours=n)
    hist = []
    for _ in range(600):
        start = rnd.randrange(60)
        hist.append((rnd.choice(["u", "u", "v", "w", None]), "c", rnd.choice(["view", "click"]),
                     None if rnd.random() < 0.03 else hour(start), hour(start + rnd.randrange(-2, 12))))
    hist += hist[:50]
    look = {(rnd.choice(["u", "v", "x", None]), "c", rnd.choice(["view", "click"]),
             str(hour(rnd.randrange(-3, 65))), str(hour(rnd.randrange(-3, 80)))) for _ in range(600)}
    look |= {("u", "c", "view", "2024-01-01", "2024-01-03"), ("u", "c", "view", "2024-01-01 00:00:00", "2024-01-03"),
             ("u", "c", "view", "soon", "2024-01-03"), ("u", "c", "view", None, "2024-01-03")}
    def when(text):
        try:
            return T.fromisoformat(text or "")
        except ValueError:
            return None
    def count(u, c, e, lo, hi):
        if u is None or when(lo) is None or when(hi) is None:
            return 0
        return sum(1 for r in hist if r[:3] == (u, c, e) and r[3] and when(lo) <= r[3] and r[4] <= when(hi))
    keys = spark.createDataFrame(sorted(look, key=repr), "uid STRING, cid STRING, type STRING, "
                                                         "start_time STRING, end_time STRING")
    h = spark.createDataFrame(hist, "uid STRING, cid STRING, type STRING, "
                                    "start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ")
    got = {tuple(r)[:5]: r.hist_cnt for r in history_counts(keys, h, block_size=block_size).collect()}
    assert got == {key: count(*key) for key in look}
    assert sum(v > 0 for v in got.values()) > 100
    assert all(r.hist_cnt == 0 for r in history_counts(keys, h.limit(0), block_size=block_size).collect())
    assert history_counts(keys.limit(0), h, block_size=block_size).count() == 0
