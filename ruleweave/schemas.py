"""Explicit schemas of every table the engine reads or writes (no inference)."""

from pyspark.sql import types as T

# A counted event is the rule fact: (uid, cid, type) of an event plus the
# running count of its key.  ``seq`` is the arrival order, ``ts`` its time.
EVENT = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("uid", T.StringType()),
    T.StructField("cid", T.StringType()),
    T.StructField("type", T.StringType()),
])

COUNTED_EVENT = T.StructType(EVENT.fields + [T.StructField("cnt", T.LongType())])

# One raw text record of the event stream.
EVENT_LINE = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("value", T.StringType()),
])

# One raw record of the rule-table change feed.  ``topic_offset`` orders the
# records (arrival order of a one-partition topic); ``commit_ts`` is the time
# from which the change is in force.
CDC_LINE = T.StructType([
    T.StructField("topic_offset", T.LongType()),
    T.StructField("commit_ts", T.TimestampNTZType()),
    T.StructField("value", T.StringType()),
])

# Every field of a rule element is read as text first and converted with
# try_cast afterwards, so that both "1" and 1 are accepted and bad numbers are
# detected instead of failing the job.
CDC_ELEMENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("sql", T.StringType()),
    T.StructField("start_time", T.StringType()),
    T.StructField("end_time", T.StringType()),
    T.StructField("counts", T.StringType()),
    T.StructField("status", T.StringType()),
])

CDC_ENVELOPE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("data", T.ArrayType(CDC_ELEMENT)),
])

RULE_COLUMNS = ["id", "name", "code", "sql", "start_time", "end_time", "counts", "status"]

RULE_CHANGE = T.StructType([
    T.StructField("topic_offset", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("commit_ts", T.TimestampNTZType()),
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("sql", T.StringType()),
    T.StructField("start_time", T.StringType()),
    T.StructField("end_time", T.StringType()),
    T.StructField("counts", T.IntegerType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("action", T.StringType()),
])

# History of user events, queried over a rule's time range.
HISTORY = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("cid", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("start_time", T.TimestampNTZType()),
    T.StructField("end_time", T.TimestampNTZType()),
])

OFFER = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("uid", T.StringType()),
    T.StructField("rule_id", T.IntegerType()),
    T.StructField("action", T.StringType()),
    T.StructField("detail", T.StringType()),
])
