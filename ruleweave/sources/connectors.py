"""External sources: job configuration, Kafka streams, JDBC history
(A2-A5, A7, A8, G1-G5).

The reference reads a ``.properties`` file into a string map and builds its
Kafka consumer and checkpointing from it.  Here the same keys map onto the
options of Spark's own connectors; no connector code is written.  The Kafka
and JDBC connectors are not installed in the test image, so these readers are
exercised through their option mapping only (file streams and Parquet stand
in for them in tests).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults of the reference's configuration keys.
DEFAULT_CHECKPOINT_INTERVAL_MS = 30_000
DEFAULT_OFFSET_RESET = "latest"
# Keys of the job itself, those given as reader options, and the consumer
# properties that Spark's reader sets itself and refuses.
_NOT_FOR_KAFKA = frozenset("""
checkpoint.interval checkpoint.path kafka.input.topics bootstrap.servers auto.offset.reset
key.deserializer value.deserializer enable.auto.commit interceptor.classes
""".split())


def parse_properties(text: str) -> dict[str, str]:
    """``key=value`` / ``key: value`` lines; ``#`` and ``!`` start comments."""
    conf = {}
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line[0] in "#!":
            continue
        sep = min((i for i in (line.find("="), line.find(":")) if i >= 0), default=-1)
        key, value = (line, "") if sep < 0 else (line[:sep], line[sep + 1:])
        conf[key.strip()] = value.strip()
    return conf


def load_properties(path: str) -> dict[str, str]:
    with open(path, encoding="utf-8") as fh:
        return parse_properties(fh.read())


def kafka_source_options(conf: dict[str, str], topics: str | None = None) -> dict[str, str]:
    """Reader options of ``format("kafka")`` from the job configuration.

    ``topics`` is a comma-separated list (the reference's argument); when
    omitted, ``kafka.input.topics`` of the configuration is used.  Offsets
    live in the streaming checkpoint, not in Kafka (Spark's default, as in
    the reference).
    """
    topics = topics or conf.get("kafka.input.topics")
    if not topics:
        raise ValueError("no topic given")
    opts = {
        "kafka.bootstrap.servers": conf["bootstrap.servers"],
        "subscribe": topics,
        "startingOffsets": conf.get("auto.offset.reset", DEFAULT_OFFSET_RESET),
    }
    # every other consumer property is handed on under Kafka's own name
    for key, value in conf.items():
        if key not in _NOT_FOR_KAFKA:
            opts[f"kafka.{key}"] = value
    return opts


def stream_settings(conf: dict[str, str]) -> dict[str, str]:
    """Trigger interval and checkpoint folder of a streaming query."""
    interval = int(conf.get("checkpoint.interval", DEFAULT_CHECKPOINT_INTERVAL_MS))
    out = {"processingTime": f"{interval} milliseconds"}
    if conf.get("checkpoint.path"):
        out["checkpointLocation"] = conf["checkpoint.path"]
    return out


def read_kafka_lines(spark: SparkSession, conf: dict[str, str], topics: str | None = None) -> DataFrame:
    """Kafka records as text lines (A5: raw string value) with their offset
    and broker time: ``(seq, kafka_partition, ts, value)``.  ``seq``, the offset,
    is unique and in arrival order within a partition only: the order over
    several is (ts, kafka_partition, seq)."""
    raw = spark.readStream.format("kafka").options(**kafka_source_options(conf, topics)).load()
    return raw.select(F.col("offset").alias("seq"), F.col("partition").alias("kafka_partition"),
                      F.col("timestamp").cast("timestamp_ntz").alias("ts"),
                      F.col("value").cast("string").alias("value"))


def read_kafka_cdc(spark: SparkSession, conf: dict[str, str], topics: str) -> DataFrame:
    """The rule-table change feed from Kafka as ``CDC_LINE`` rows."""
    lines = read_kafka_lines(spark, conf, topics)
    return lines.select(F.col("seq").alias("topic_offset"), F.col("ts").alias("commit_ts"), "value")


def jdbc_history_options(url: str, table: str, lower: str, upper: str, num_partitions: int,
                         partition_column: str = "start_time", **extra: str) -> dict[str, str]:
    """One bulk, parallel scan of the history table instead of one connection
    per lookup (A8): ``num_partitions`` range reads over the time column;
    ``lower``/``upper`` are also applied as a filter pushed to the database."""
    query = (f"(SELECT uid, cid, type, start_time, end_time FROM {table} "
             f"WHERE start_time >= '{lower}' AND end_time <= '{upper}') AS history")
    opts = {"url": url, "dbtable": query, "partitionColumn": partition_column,
            "lowerBound": lower, "upperBound": upper, "numPartitions": str(num_partitions),
            "fetchsize": "10000"}
    opts.update(extra)
    return opts


def read_history_jdbc(spark: SparkSession, url: str, table: str, lower: str, upper: str,
                      num_partitions: int = 64, **extra: str) -> DataFrame:
    return (spark.read.format("jdbc")
            .options(**jdbc_history_options(url, table, lower, upper, num_partitions, **extra))
            .load()
            .select("uid", "cid", "type", F.col("start_time").cast("timestamp_ntz"),
                    F.col("end_time").cast("timestamp_ntz")))
