"""Structured Streaming jobs.

* S1 ``counted_stream``: the keyed running count of the reference's
  ``KeyedProcessFunction`` as a ``transformWithStateInPandas`` operator keyed by
  (uid, cid, type), with the count as its state.  The rows of a key and
  micro-batch are numbered at once, in arrival order; the count survives
  restarts through the checkpoint (RocksDB state store).
* ``start_line_counts``: text lines → parsed events, a table of malformed lines,
  the running count and the offers of the static rule (level 1).
* ``start_daily_counts``: the count within each day (G12), with the last days of a
  key as its state.
* S2 ``start_rule_changes``: the rule change feed parsed and appended to a
  Parquet change table, one folder per micro-batch.  A folder counts as
  committed once it holds the marker that the job writes after it, whatever the
  session's settings for Spark's own ``_SUCCESS`` are; a committed folder
  is never written again, so a reader sees whole batches only.
* S3 ``start_offers``: S1 + ``foreachBatch``: each micro-batch of counted events
  is written once and read back, joined with the rule versions known when the
  batch starts (read from S2's committed folders), evaluated (strict or
  sticky), optionally gated by the history check, and written per batch.

Arrival order is ``order``: ``seq`` alone for a source with one partition, (ts,
partition, offset) for a topic with several.  Counts equal the batch query
(q07) when events arrive in that order across micro-batches.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import evaluate, history, rules
from ..operators.parse import parse_lines
from ..schemas import RULE_CHANGE
from ..session import scratch, ship_package, staged
from ..sources.connectors import read_kafka_lines, stream_settings

KEY = ["uid", "cid", "type"]
# arrival order of a topic with several partitions
KAFKA_ORDER = ("ts", "kafka_partition", "seq")


class RunningCount(StatefulProcessor):
    """Running count of one (uid, cid, type); emits every row with ``cnt``."""

    STATE = "cnt BIGINT"

    def __init__(self, order: Sequence[str], columns: Sequence[str]):
        self.order, self.columns = list(order), list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = list(rows)
        batch = chunks[0] if len(chunks) == 1 else pd.concat(chunks, ignore_index=True)
        if len(batch) > 1:
            batch = batch.sort_values(self.order, kind="stable")
        seen = self.count.get()
        start = int(seen[0]) if seen is not None else 0
        batch["cnt"] = np.arange(start + 1, start + len(batch) + 1, dtype=np.int64)
        self.count.update((start + len(batch),))
        yield batch[self.columns]

    def close(self) -> None:
        pass


def counted_stream(events: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Stream of events (seq, ts, uid, cid, type, ...) → same + ``cnt``."""
    ship_package(events.sparkSession)
    schema = T.StructType(events.schema.fields + [T.StructField("cnt", T.LongType())])
    return events.groupBy(*KEY).transformWithStateInPandas(
        RunningCount(order, schema.fieldNames()), schema, "append", "none")


EPOCH = 719163   # ordinal of 1970-01-01


class DailyCount(StatefulProcessor):
    """Running count of one (uid, cid, type) within each day.  The count of a day goes
    once the key has an event ``keep_days`` or more days later, so a key holds at most
    ``keep_days`` counts; a key without further events keeps its last ones.  (Spark's time
    to live of states runs on the wall clock, and has available-now queries never end.)"""

    def __init__(self, order: Sequence[str], columns: Sequence[str], keep_days: int):
        self.order, self.columns, self.keep_days = list(order), list(columns), keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", "day INT", "cnt BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        seen = {int(day[0]): int(cnt[0]) for day, cnt in self.days.iterator()}   # keep_days entries at most
        oldest = max(seen) - self.keep_days + 1 if seen else None
        day = batch["day"].map(lambda d: d.toordinal() - EPOCH)
        batch["cnt"] = (batch.groupby(day).cumcount() + 1 + day.map(seen).fillna(0).astype("int64")).astype("Int64")
        if oldest is not None:
            batch.loc[day < oldest, "cnt"] = pd.NA
        last = batch.groupby(day)["cnt"].last().dropna()
        newest = max([*seen, *last.index], default=None)
        for d, cnt in last.items():
            if d > newest - self.keep_days:
                self.days.updateValue((int(d),), (int(cnt),))
        for d in seen:
            if d <= newest - self.keep_days:
                self.days.removeKey((d,))
        yield batch[self.columns]

    def close(self) -> None:
        pass


def daily_counted_stream(events: DataFrame, order: Sequence[str] = ("seq",), keep_days: int = 2) -> DataFrame:
    """Stream of events → same + ``day`` and ``cnt``, the running count of the
    event's key on its day.  An event of a day whose count is gone has ``cnt`` null."""
    ship_package(events.sparkSession)
    dated = events.withColumn("day", F.to_date("ts"))
    fields = dated.schema.fields + [T.StructField("cnt", T.LongType())]
    return dated.where("day IS NOT NULL").groupBy(*KEY).transformWithStateInPandas(
        DailyCount(order, [f.name for f in fields], keep_days), T.StructType(fields), "append", "none")


def start_daily_counts(events: DataFrame, out_path: str, checkpoint: str | None = None, keep_days: int = 2,
                       trigger: dict | None = None, order: Sequence[str] = ("seq",)):
    """The daily count as a job, appended to Parquet (file sink, exactly once)."""
    spark = events.sparkSession
    return (daily_counted_stream(events, order, keep_days).writeStream.format("parquet").option("path", out_path)
            .option("checkpointLocation", checkpoint or checkpoint_location(spark, "daily_counts"))
            .trigger(**(trigger or {"availableNow": True})).start())


def read_daily_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Days kept by the daily count, as ``(uid, cid, type, day, cnt)``."""
    st = spark.read.format("statestore").option("stateVarName", "days").load(checkpoint)
    return st.select(*[F.col(f"key.{k}").alias(k) for k in KEY],
                     F.date_from_unix_date(F.col("user_map_key.day")).alias("day"),
                     F.col("user_map_value.cnt").alias("cnt"))


def read_count_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Current content of S1's count state (C3) as ``(uid, cid, type, cnt)``,
    read with Spark's state-store data source from the query checkpoint."""
    st = spark.read.format("statestore").option("stateVarName", "count").load(checkpoint)
    return st.select(*[F.col(f"key.{k}").alias(k) for k in KEY], F.col("value.cnt").alias("cnt"))


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """A query's checkpoint folder under ``spark.checkpoint.dir``, which must be
    set: a folder that changes with each start would restart the counts at 0."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured or configured == getattr(sc, "_ruleweave_scratch", None):
        raise ValueError(f"give query {name} a checkpoint folder, or set spark.checkpoint.dir")
    return os.path.join(configured, "streams", name)


def _batch_path(root: str, batch_id: int) -> str:
    return os.path.join(root, f"batch_id={batch_id}")


COMMITTED = "_COMMITTED"   # names with an underscore are no data to Spark's readers


def _commit(spark: SparkSession, folder: str) -> None:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{COMMITTED}")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).create(marker, True).close()


def committed_batches(spark: SparkSession, table_path: str) -> list[str]:
    """Folders of ``table_path`` whose micro-batch is written to the end."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/batch_id=*/{COMMITTED}")
    found = marker.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marker)
    return sorted(s.getPath().getParent().toString() for s in found or [])


def start_rule_changes(cdc_lines: DataFrame, table_path: str, checkpoint: str | None = None,
                       rejects_path: str | None = None, trigger: dict | None = None):
    """Change records → Parquet rule-change table (and rejects)."""
    spark = cdc_lines.sparkSession
    changes, rejects = rules.parse_cdc(cdc_lines)

    def write(batch: DataFrame, batch_id: int) -> None:
        path = _batch_path(table_path, batch_id)
        if not any(p.endswith(f"/batch_id={batch_id}") for p in committed_batches(spark, table_path)):
            batch.write.mode("overwrite").parquet(path)
            _commit(spark, path)

    q = (changes.writeStream.foreachBatch(write)
         .option("checkpointLocation", checkpoint or checkpoint_location(spark, "rule_changes")))
    q = q.trigger(**(trigger or {"availableNow": True})).start()
    if rejects_path:
        r = (rejects.writeStream.format("parquet").option("path", rejects_path)
             .option("checkpointLocation", (checkpoint or checkpoint_location(spark, "rule_changes"))
                     + "-rejects")
             .trigger(**(trigger or {"availableNow": True})).start())
        return q, r
    return q


def read_rule_changes(spark: SparkSession, table_path: str) -> DataFrame:
    """All committed change batches; an empty table when there is none yet.  Any
    other failure to read is raised."""
    paths = committed_batches(spark, table_path)
    if not paths:
        return spark.createDataFrame([], RULE_CHANGE)
    return spark.read.schema(RULE_CHANGE).parquet(*paths)


def offers_for_batch(counted: DataFrame, changes: DataFrame, mode: str = "strict",
                     histories: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """One micro-batch of counted events → offers, with the rule versions of
    ``changes``.  With ``histories`` the level-3 history gate applies."""
    spark = counted.sparkSession
    rs = evaluate.compile_rules(spark, rules.rule_versions(changes))
    if histories is None:
        return evaluate.dynamic_rules(counted, rs, mode)
    pairs = evaluate.matched_pairs(counted, rs)
    cand = staged(pairs.select("seq", "uid", "cid", "type", "cnt", F.col("id").alias("rule_id"),
                               "sql", "start_time", "end_time", "counts"), "candidates")
    decided = history.history_gate(cand, histories, history.range_bounds(rs.versions))
    return evaluate.offers(decided.where("is_hit"), rule_col="rule_id")


def start_offers(events: DataFrame, rule_table: str, out_path: str, mode: str = "strict",
                 histories: Mapping[str, DataFrame] | None = None, checkpoint: str | None = None,
                 trigger: dict | None = None, counted_path: str | None = None,
                 order: Sequence[str] = ("seq",)):
    """S3: events stream → running count → offers per micro-batch.  The counted
    events of each batch are kept in ``counted_path`` (``out_path`` + -counted)."""
    spark = events.sparkSession
    kept = counted_path or f"{out_path.rstrip('/')}-counted"

    def write(batch: DataFrame, batch_id: int) -> None:
        # the stateful count must run once: what follows uses the batch more than once
        path = _batch_path(kept, batch_id)
        batch.write.mode("overwrite").parquet(path)
        counted = spark.read.schema(batch.schema).parquet(path)
        with scratch(spark):
            offers = offers_for_batch(counted, read_rule_changes(spark, rule_table), mode, histories)
            offers.write.mode("overwrite").parquet(_batch_path(out_path, batch_id))

    return (counted_stream(events, order).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint or checkpoint_location(spark, "offers"))
            .trigger(**(trigger or {"availableNow": True})).start())


def start_counts(events: DataFrame, out_path: str, checkpoint: str | None = None,
                 trigger: dict | None = None, order: Sequence[str] = ("seq",)):
    """S1 as a job: counted events appended to Parquet (file sink, exactly once)."""
    spark = events.sparkSession
    return (counted_stream(events, order).writeStream.format("parquet").option("path", out_path)
            .option("checkpointLocation", checkpoint or checkpoint_location(spark, "counts"))
            .trigger(**(trigger or {"availableNow": True})).start())


def start_line_counts(lines: DataFrame, out_path: str, malformed_path: str, offers_path: str,
                      checkpoint: str, trigger: dict | None = None, order: Sequence[str] = ("seq",),
                      rule: str | None = None) -> list:
    """Text lines (seq, ts, value, ...) → counted events, malformed lines and the
    offers of the static rule (level 1).  Returns the two queries: events, and
    malformed lines."""
    spark = lines.sparkSession
    keep = tuple(c for c in lines.columns if c != "value")
    events, malformed = parse_lines(lines, keep=keep)

    def write(batch: DataFrame, batch_id: int) -> None:
        path = _batch_path(out_path, batch_id)
        batch.write.mode("overwrite").parquet(path)
        counted = spark.read.schema(batch.schema).parquet(path)
        offers = evaluate.static_offers(counted, rule) if rule else evaluate.static_offers(counted)
        offers.write.mode("overwrite").parquet(_batch_path(offers_path, batch_id))

    how = trigger or {"availableNow": True}
    counting = (counted_stream(events, order).writeStream.foreachBatch(write)
                .option("checkpointLocation", checkpoint).trigger(**how).start())
    rejecting = (malformed.writeStream.format("parquet").option("path", malformed_path)
                 .option("checkpointLocation", f"{checkpoint.rstrip('/')}-malformed").trigger(**how).start())
    return [counting, rejecting]


def start_configured_counts(spark: SparkSession, conf: Mapping[str, str], out_path: str, malformed_path: str,
                            offers_path: str, lines: DataFrame | None = None,
                            trigger: dict | None = None, order: Sequence[str] = KAFKA_ORDER) -> list:
    """The level-1 job as the properties describe it: Kafka reader, trigger
    interval and checkpoint folder (``checkpoint.path``, required).  ``lines``
    and ``trigger`` stand in for them where there is no broker."""
    settings = stream_settings(dict(conf))
    checkpoint = settings.pop("checkpointLocation", None)
    if not checkpoint:
        raise ValueError("checkpoint.path must be set: without it a restart counts from 0")
    source = read_kafka_lines(spark, dict(conf)) if lines is None else lines
    return start_line_counts(source, out_path, malformed_path, offers_path, checkpoint,
                             trigger or settings, order)


__all__ = ["RunningCount", "counted_stream", "start_counts",
           "DailyCount", "daily_counted_stream", "start_daily_counts", "read_daily_state", "start_rule_changes", "start_offers",
           "start_line_counts", "start_configured_counts", "offers_for_batch", "read_rule_changes",
           "committed_batches", "read_count_state", "checkpoint_location"]
