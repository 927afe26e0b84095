"""Streaming jobs S1-S3 give the batch answers."""

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from ruleweave.plans import queries as Q
from ruleweave.schemas import CDC_LINE
from ruleweave.sources.cdc import HISTORY_METRIC, demo_rule_lines
from ruleweave.sources.events import events_from_table
from ruleweave.sources.events import event_lines, load_history
from ruleweave.streaming.jobs import (KAFKA_ORDER, checkpoint_location, committed_batches, read_count_state,
                                     read_daily_state, read_rule_changes, start_configured_counts, start_counts,
                                     start_daily_counts, start_offers, start_rule_changes)


@pytest.fixture(scope="module")
def run_dir():
    return tempfile.mkdtemp(prefix="ruleweave-stream-", dir="/tmp")


@pytest.fixture(scope="module")
def event_files(spark, run_dir):
    """The sf0.001 events table cut into four files by arrival order."""
    src = spark.read.parquet(f"{SF0001}/events.parquet")
    for i in range(4):
        (src.where((F.col("event_id") >= i * 250) & (F.col("event_id") < (i + 1) * 250))
         .coalesce(1).write.parquet(f"{run_dir}/events/part{i}"))
    return src.schema


def _stream(spark, schema, path):
    return events_from_table(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                             .parquet(path))


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_s1_equals_batch(spark, run_dir, event_files):
    out = f"{run_dir}/s1"
    start_counts(_stream(spark, event_files, f"{run_dir}/events/*"), f"{out}/out",
                 f"{out}/ckpt").awaitTermination()
    got = spark.read.parquet(f"{out}/out")
    assert _same(got, Q.counted_events(spark, SF0001))
    assert got.where("type = 'view' AND cnt >= 2").count() == 122
    # the count state itself (C3) equals the batch count per key
    state = read_count_state(spark, f"{out}/ckpt")
    assert state.count() == 348
    assert _same(state, Q.q08_keyed_count_state(spark, SF0001))


def test_s1_restart_same_checkpoint(spark, run_dir, event_files):
    """Stop after two files, restart the same query with more input: the
    union of outputs equals the batch running count."""
    import shutil
    base = f"{run_dir}/s1r"
    shutil.copytree(f"{run_dir}/events/part0", f"{base}/in/part0")
    shutil.copytree(f"{run_dir}/events/part1", f"{base}/in/part1")
    start_counts(_stream(spark, event_files, f"{base}/in/*"), f"{base}/out",
                 f"{base}/ckpt").awaitTermination()
    shutil.copytree(f"{run_dir}/events/part2", f"{base}/in/part2")
    shutil.copytree(f"{run_dir}/events/part3", f"{base}/in/part3")
    start_counts(_stream(spark, event_files, f"{base}/in/*"), f"{base}/out",
                 f"{base}/ckpt").awaitTermination()
    assert _same(spark.read.parquet(f"{base}/out"), Q.counted_events(spark, SF0001))


def test_daily_counts_equal_batch(spark, run_dir, event_files):
    """Four micro-batches give q18; only the last days of a key stay in the state."""
    from pyspark.sql import Window
    out = f"{run_dir}/daily"
    start_daily_counts(_stream(spark, event_files, f"{run_dir}/events/*"), f"{out}/out", f"{out}/ckpt",
                       keep_days=2).awaitTermination()
    got = spark.read.parquet(f"{out}/out")
    ev = events_from_table(spark.read.parquet(f"{SF0001}/events.parquet")).withColumn("day", F.to_date("ts"))
    want = ev.withColumn("cnt", F.row_number().over(
        Window.partitionBy("uid", "cid", "type", "day").orderBy("seq")).cast("long"))
    assert _same(got.select(*want.columns), want) and got.where("cnt > 1").count() > 10
    assert _same(got.where("type = 'view' AND cnt > 2").select("seq", "uid", "cid", "type", "day", "cnt"),
                 Q.q18_daily_threshold(spark, SF0001))
    newest = Window.partitionBy("uid", "cid", "type")
    kept = (want.groupBy("uid", "cid", "type", "day").agg(F.max("cnt").alias("cnt"))
            .withColumn("last", F.max("day").over(newest)).where("day > date_sub(last, 2)").drop("last"))
    state = read_daily_state(spark, f"{out}/ckpt")
    assert _same(state, kept) and state.count() < want.select("uid", "cid", "type", "day").distinct().count()


def test_daily_counts_of_late_events(spark, run_dir):
    """An event of a kept day goes on counting; one of a day that is gone has no count."""
    import datetime as dt
    at = lambda day: dt.datetime(2024, 1, day, 12)
    rows = [[(1, at(1)), (2, at(1)), (3, at(2))], [(4, at(2)), (5, at(1)), (6, at(9))], [(7, at(2)), (8, at(9)), (9, at(8))]]
    schema = "seq long, ts timestamp_ntz, uid string, cid string, type string"
    for i, part in enumerate(rows):
        (spark.createDataFrame([(n, t, "u", None, "view") for n, t in part], schema).coalesce(1)
         .write.parquet(f"{run_dir}/late/in/part{i}"))
        stream = spark.readStream.schema(schema).parquet(f"{run_dir}/late/in/*")
        start_daily_counts(stream, f"{run_dir}/late/out", f"{run_dir}/late/ckpt").awaitTermination()
    got = {r.seq: r.cnt for r in spark.read.parquet(f"{run_dir}/late/out").collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2, 5: 3, 6: 1, 7: None, 8: 2, 9: 1}


def test_s2_s3_equal_batch(spark, run_dir, event_files):
    demo_rule_lines(spark).coalesce(1).write.json(f"{run_dir}/cdc")
    cdc = spark.readStream.schema(CDC_LINE).json(f"{run_dir}/cdc")
    start_rule_changes(cdc, f"{run_dir}/rules", f"{run_dir}/rules-ckpt").awaitTermination()
    assert read_rule_changes(spark, f"{run_dir}/rules").count() == 5

    for mode, query in (("strict", Q.q12_dynamic_rules_strict), ("sticky", Q.q13_dynamic_rules_sticky)):
        out = f"{run_dir}/offers-{mode}"
        start_offers(_stream(spark, event_files, f"{run_dir}/events/*"), f"{run_dir}/rules", out,
                     mode=mode, checkpoint=f"{out}-ckpt").awaitTermination()
        assert _same(spark.read.parquet(out).drop("batch_id"), query(spark, SF0001))


def test_s3_with_history_counts_each_event_once(spark, run_dir, event_files):
    """Level 3 as a stream (after the rule table of the test before)."""
    out = f"{run_dir}/offers-history"
    start_offers(_stream(spark, event_files, f"{run_dir}/events/*"), f"{run_dir}/rules", out,
                 histories={HISTORY_METRIC: load_history(spark, SF0001)},
                 checkpoint=f"{out}-ckpt").awaitTermination()
    assert _same(spark.read.parquet(out).drop("batch_id"), Q.q16_dynamic_rules_history(spark, SF0001))
    counted = spark.read.parquet(f"{out}-counted").drop("batch_id")
    assert _same(counted, Q.counted_events(spark, SF0001))


def test_rule_table_reads_committed_batches_only(spark, run_dir):
    import os
    import shutil
    table = f"{run_dir}/rules-copy"
    shutil.copytree(f"{run_dir}/rules", table)
    assert read_rule_changes(spark, f"{run_dir}/no-such-table").count() == 0
    one = committed_batches(spark, table)
    n = read_rule_changes(spark, table).count()
    shutil.copytree(one[0].removeprefix("file:"), f"{table}/batch_id=77")
    for f in ("_COMMITTED", "._COMMITTED.crc"):
        if os.path.exists(f"{table}/batch_id=77/{f}"):
            os.remove(f"{table}/batch_id=77/{f}")
    assert committed_batches(spark, table) == one and read_rule_changes(spark, table).count() == n


def test_lines_to_counts_as_configured(spark, run_dir):
    """Text lines of two partitions, as a topic would give them, with a restart:
    counts, malformed lines and offers equal the batch queries."""
    import shutil
    base = f"{run_dir}/lines"
    events = events_from_table(spark.read.parquet(f"{SF0001}/events.parquet"))
    lines = (event_lines(events, spoil=True).join(events.select("seq", "ts"), "seq")
             .select(F.floor(F.col("seq") / 2).cast("long").alias("seq"), "ts", "value",
                     (F.col("seq") % 2).cast("int").alias("kafka_partition"), F.col("seq").alias("event_id")))
    for i in range(2):
        (lines.where((F.col("event_id") >= i * 500) & (F.col("event_id") < (i + 1) * 500))
         .coalesce(1).write.parquet(f"{base}/all/part{i}"))
    conf = {"bootstrap.servers": "unused:1", "kafka.input.topics": "t", "checkpoint.path": f"{base}/ckpt"}
    for i in range(2):   # the second start goes on where the first one ended
        shutil.copytree(f"{base}/all/part{i}", f"{base}/in/part{i}")
        stream = spark.readStream.schema(lines.schema).parquet(f"{base}/in/*")
        for q in start_configured_counts(spark, conf, f"{base}/out", f"{base}/bad", f"{base}/offers", lines=stream,
                                         trigger={"availableNow": True}):
            q.awaitTermination()
    got = spark.read.parquet(f"{base}/out").select(F.col("event_id").alias("seq"), "uid", "cid", "type", "cnt")
    parsed = Q.q01_parse_event_lines(spark, SF0001)
    assert _same(got.drop("cnt"), parsed)
    from pyspark.sql import Window
    by_time = parsed.join(events.select("seq", "ts"), "seq").withColumn(
        "cnt", F.row_number().over(Window.partitionBy("uid", "cid", "type").orderBy("ts", F.col("seq") % 2, "seq")).cast("long"))
    assert _same(got, by_time.select("seq", "uid", "cid", "type", "cnt"))
    assert _same(spark.read.parquet(f"{base}/bad").select(F.col("event_id").alias("seq"), "value", "reason"),
                 Q.q02_malformed_event_lines(spark, SF0001))
    assert spark.read.parquet(f"{base}/offers").count() == got.where("type = 'view' AND cnt >= 2").count()


def test_checkpoint_folder_is_required(spark):
    from types import SimpleNamespace
    def session(folder, scratch=None):
        conf = SimpleNamespace(get=lambda key, default: folder)
        return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, _ruleweave_scratch=scratch))
    assert checkpoint_location(session("/shared"), "counts") == "/shared/streams/counts"
    for bare in (session(None), session("/tmp/x", "/tmp/x")):   # unset, or a scratch folder of this start
        with pytest.raises(ValueError):
            checkpoint_location(bare, "counts")
    with pytest.raises(ValueError):
        start_configured_counts(spark, {"bootstrap.servers": "b"}, "o", "m", "f")
    assert KAFKA_ORDER == ("ts", "kafka_partition", "seq")
