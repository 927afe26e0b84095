"""Event inputs: the driver's ``events`` table, event text lines, history.

The reference receives ``uid,cid,type`` text lines and queries a history table
of user events.  Here both are derived from the ``events`` table with built-in
expressions only, so that every query reads the whole table and its work grows
with it.  The mapping (fixed; the SQL oracle spells the same rule):

* ``seq``  = ``event_id`` (arrival order; equals ``ts`` order in the data)
* ``uid``  = ``user_id`` as text
* ``cid``  = ``'c'`` followed by ``floor(props.k / 20)``
* ``type`` = ``event_type``
* history interval = ``[ts, ts + 1 minute]``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_DURATION = "INTERVAL 1 MINUTE"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def category_of(props: Column) -> Column:
    k = F.get_json_object(props, "$.k").cast("int")
    return F.concat(F.lit("c"), F.floor(k / F.lit(20)).cast("string"))


def events_from_table(raw: DataFrame) -> DataFrame:
    """``events`` table → ``(seq, ts, uid, cid, type)``; only 5 columns read."""
    return raw.select(
        F.col("event_id").alias("seq"),
        F.col("ts"),
        F.col("user_id").cast("string").alias("uid"),
        category_of(F.col("props")).alias("cid"),
        F.col("event_type").alias("type"),
    )


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_from_table(read_table(spark, sf_dir, "events"))


def event_lines(events: DataFrame, spoil: bool = True) -> DataFrame:
    """Events as text records ``uid,cid,type`` with ``seq`` kept as the key.

    With ``spoil`` a fixed share of lines carries the malformations the
    reference's split rule must handle: ``seq % 50`` = 0 drops the third field,
    1 leaves it empty (``u,c,``), 2 appends a fourth field (still valid), 3
    empties the category (still valid).  Every event still yields one line.
    """
    u, c, t = F.coalesce("uid", F.lit("")), F.coalesce("cid", F.lit("")), F.coalesce("type", F.lit(""))
    clean = F.concat_ws(",", u, c, t)
    if not spoil:
        return events.select("seq", clean.alias("value"))
    m = F.pmod(F.col("seq"), F.lit(50))
    value = (F.when(m == 0, F.concat_ws(",", u, c))
             .when(m == 1, F.concat(F.concat_ws(",", u, c), F.lit(",")))
             .when(m == 2, F.concat_ws(",", u, c, t, F.lit("extra")))
             .when(m == 3, F.concat_ws(",", u, F.lit(""), t))
             .otherwise(clean))
    return events.select("seq", value.alias("value"))


def history_from_events(events: DataFrame) -> DataFrame:
    """History table ``(uid, cid, type, start_time, end_time)`` from events."""
    return events.select(
        "uid", "cid", "type",
        F.col("ts").alias("start_time"),
        (F.col("ts") + F.expr(HISTORY_DURATION)).alias("end_time"),
    )


def load_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_from_events(load_events(spark, sf_dir))
