"""Skew-safe order operators equal the plain window, at any block size,
also when one key holds a third of all rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF001, rows
from ruleweave.operators.sequence import neighbor, running_count, running_sum
from ruleweave.sources.events import load_events

KEYS = ["uid", "cid", "type"]


@pytest.fixture(scope="module")
def events(spark):
    return load_events(spark, SF001)


@pytest.fixture(scope="module")
def skewed(spark, events):
    # every third event is re-keyed to one hot (uid, cid, type)
    hot = F.pmod(F.col("seq"), F.lit(3)) == 0
    return events.select("seq", "ts", *[F.when(hot, F.lit("hot")).otherwise(F.col(k)).alias(k)
                                        for k in KEYS])


def _plain_count(df):
    return df.withColumn("cnt", F.row_number().over(Window.partitionBy(*KEYS).orderBy("seq")).cast("long"))


@pytest.mark.parametrize("block", [7, 333, 1 << 20])
def test_running_count_matches_window(events, block):
    got = running_count(events, KEYS, block_size=block)
    want = _plain_count(events)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_hot_key_is_split_and_exact(skewed):
    block = 500
    got = running_count(skewed, KEYS, block_size=block, keep_block="blk")
    want = _plain_count(skewed)
    assert got.drop("blk").exceptAll(want).count() == 0
    assert want.exceptAll(got.drop("blk")).count() == 0
    # the hot key (a third of the rows) spans many window partitions, none
    # larger than the block
    per_part = got.where("uid = 'hot'").groupBy("blk").count()
    assert per_part.count() == 20
    assert per_part.agg(F.max("count")).first()[0] <= block


def test_global_running_sum(events):
    got = running_sum(events, [], ["seq"], "n", value=F.lit(2), block_size=97)
    assert got.where(F.col("n") != 2 * (F.col("seq") + 1)).count() == 0


@pytest.mark.parametrize("block", [5, 1 << 20])
def test_neighbor_matches_lag_lead(skewed, block):
    w = Window.partitionBy("uid").orderBy("seq")
    want = (skewed.withColumn("p", F.lag(F.struct("seq", "ts")).over(w))
            .withColumn("n", F.lead(F.struct("seq", "ts")).over(w)))
    got = neighbor(skewed, ["uid"], ["seq"], ["seq", "ts"], "p", "prev", block_size=block)
    got = neighbor(got, ["uid"], ["seq"], ["seq", "ts"], "n", "next", block_size=block)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_null_keys_group_together(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, None)], "seq BIGINT, k STRING")
    for block in (1 << 20, 2, 1):   # the null key is heavy for the smaller ones
        got = running_count(df, ["k"], block_size=block)
        assert rows(got, "seq", "cnt") == [(1, 1), (2, 2), (3, 1), (4, 3)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_data_shuffle_and_no_single_partition(events):
    """The data is dealt once, by key and block, whatever the block size; a
    running total without keys has no task of its own for all rows."""
    for block in (1 << 20, 100):
        plan = _plan(running_count(events, KEYS, block_size=block))
        assert plan.count("hashpartitioning(uid#") - plan.count("functions=[count(1)") >= 0
        assert "SinglePartition" not in plan and "RoundRobin" not in plan
    total = _plan(running_sum(events, [], ["seq"], "n", block_size=100))
    assert "SinglePartition" not in total


def test_light_keys_have_no_markers(events, skewed):
    """Only the hot key is cut: with few heavy keys, blocks other than 0 are its own."""
    got = running_count(skewed, KEYS, block_size=500, keep_block="blk")
    assert got.where("blk <> 0 AND uid <> 'hot'").count() == 0
    assert running_count(events, KEYS, block_size=500, keep_block="blk").where("blk <> 0").count() == 0


def test_running_total_over_far_blocks(spark):
    """Dyadic ranges of blocks far apart add up to the plain running sum."""
    seqs = [0, 1, 5, 6, 7, 1000, 1001, 2 ** 31, 2 ** 31 + 1, 2 ** 40, 2 ** 40 + 3]
    df = spark.createDataFrame([(s, i + 1) for i, s in enumerate(seqs)], "seq BIGINT, v BIGINT")
    got = running_sum(df, [], ["seq"], "n", value=F.col("v"), block_size=2)
    assert rows(got, "seq", "n") == sorted(
        ((s, (i + 1) * (i + 2) // 2) for i, s in enumerate(seqs)), key=repr)
