"""Configuration → connector options."""

import pytest

from ruleweave.sources.connectors import (jdbc_history_options, kafka_source_options,
                                          parse_properties, stream_settings)

# both comment marks, both separators, an empty value, blanks around, a repeated key
TEXT = """
# offsets of a fresh group
auto.offset.reset : earliest
bootstrap.servers=broker-a:19092
  max.poll.records =  250
! timings
checkpoint.interval=4500
checkpoint.interval=7500
checkpoint.path=
fetch.min.bytes
"""


def test_properties():
    assert parse_properties(TEXT) == {
        "auto.offset.reset": "earliest", "bootstrap.servers": "broker-a:19092", "max.poll.records": "250",
        "checkpoint.interval": "7500", "checkpoint.path": "", "fetch.min.bytes": ""}
    assert parse_properties("a=b=c:d\n\n") == {"a": "b=c:d"}


def test_kafka_options():
    conf = {"bootstrap.servers": "x:1", "group.id": "team", "isolation.level": "read_committed",
            "max.poll.records": "250", "checkpoint.path": "/c", "key.deserializer": "no"}
    assert kafka_source_options(conf, "one,two") == {
        "kafka.bootstrap.servers": "x:1", "subscribe": "one,two", "startingOffsets": "latest",
        "kafka.isolation.level": "read_committed", "kafka.group.id": "team", "kafka.max.poll.records": "250"}
    assert kafka_source_options({**conf, "kafka.input.topics": "t"})["subscribe"] == "t"
    with pytest.raises(ValueError):
        kafka_source_options(conf)  # no topic argument and none configured


def test_stream_settings():
    assert stream_settings(parse_properties(TEXT)) == {"processingTime": "7500 milliseconds"}
    assert stream_settings({"checkpoint.path": "s3a://b/c"}) == {
        "processingTime": "30000 milliseconds", "checkpointLocation": "s3a://b/c"}


def test_jdbc_history_is_one_parallel_scan():
    o = jdbc_history_options("jdbc:x://h/db", "user_events", "2024-01-01", "2024-02-01", 32)
    assert o["numPartitions"] == "32" and o["partitionColumn"] == "start_time"
    assert "start_time >= '2024-01-01'" in o["dbtable"]
