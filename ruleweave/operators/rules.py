"""Rule table as a changelog.

The reference keeps the active rules in broadcast state: an upsert (status
1 or 2) puts a rule under its id, any other status removes the id.  Here the
change feed is parsed into a change table and turned into

* the current rule set (last change per id wins, removed ids gone),
* rule *versions* with validity intervals ``[valid_from, valid_to)``, which
  make the "rules in force when the event arrives" relation a join,
* a trace of the number of active rules after each change.

Changes are ordered by arrival: ``(topic_offset, pos)``; ``commit_ts`` is the
time from which a change is in force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cdc
from ..schemas import RULE_COLUMNS
from .sequence import DEFAULT_BLOCK_SIZE, neighbor, running_sum

CHANGE_ORDER = ["topic_offset", "pos"]


def parse_cdc(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Change records ``(topic_offset, commit_ts, value)`` →
    ``(changes, rejects)``.  No shuffle: all row-local expressions.

    ``changes``: one row per applied rule element, columns ``topic_offset,
    pos, commit_ts`` + rule columns (typed) + ``action`` (UPSERT/REMOVE).
    ``rejects``: ``topic_offset, pos, reason`` for records or elements that
    the reference would lose to an exception (pos null for whole records).
    """
    # The envelope is parsed once; every later use refers to its columns.
    # No Filter sits between the parse and the explode: a filter would be
    # pushed below the projection and parse the JSON a second time.
    env = lines.select("topic_offset", "commit_ts", "value",
                       cdc.envelope(F.col("value")).alias("__env"))
    op, data = F.col("__env.type"), F.col("__env.data")
    env = env.withColumn("__p", cdc.first_bad_position(data))
    kept_data = F.when(op.isin(*cdc.KEPT_OPS), cdc.kept_elements(data, F.col("__p")))

    elements = env.select(
        "topic_offset", "commit_ts",
        F.posexplode(kept_data).alias("pos", "__e"))
    e = F.col("__e")
    changes = elements.where(e["status"].isNotNull()).select(
        "topic_offset", F.col("pos").cast("int").alias("pos"), "commit_ts",
        cdc.as_int(e["id"]).alias("id"),
        e["name"].alias("name"), e["code"].alias("code"), e["sql"].alias("sql"),
        e["start_time"].alias("start_time"), e["end_time"].alias("end_time"),
        cdc.as_int(e["counts"]).alias("counts"),
        cdc.as_int(e["status"]).alias("status"),
    ).withColumn("action", cdc.action_of(F.col("status")))

    # Rejects are generated per record (0..n rows) rather than filtered, for
    # the same reason: one parse per record.
    is_object = F.json_object_keys(F.col("value")).isNotNull()
    kept_op = op.isin(*cdc.KEPT_OPS)
    entry = lambda pos, reason: F.struct(pos.cast("int").alias("pos"),
                                         F.lit(reason).alias("reason"))
    none = F.array().cast("array<struct<pos:int,reason:string>>")
    record_level = (F.when(~is_object, F.array(entry(F.lit(None), "not_a_json_object")))
                    .when(kept_op & data.isNull(), F.array(entry(F.lit(None), "data_not_an_array")))
                    .otherwise(none))
    lost = F.filter(
        F.transform(data, lambda x, i: F.struct(
            i.cast("int").alias("pos"),
            F.when(i == F.col("__p") - 1, F.lit("bad_element"))
             .otherwise(F.lit("after_bad_element")).alias("reason"))),
        lambda r: r["pos"] >= F.col("__p") - 1)
    element_level = F.when(kept_op & (F.col("__p") > 0), lost).otherwise(none)
    unapplied = F.filter(
        F.transform(cdc.kept_elements(data, F.col("__p")), lambda x, i: F.struct(
            F.when(cdc.element_has_no_status(x), i).cast("int").alias("pos"),
            F.lit("null_status").alias("reason"))),
        lambda r: r["pos"].isNotNull())
    element_level = F.concat(element_level, F.when(kept_op, F.coalesce(unapplied, none)).otherwise(none))
    rejects = (env.select("topic_offset",
                          F.explode(F.concat(record_level, element_level)).alias("__r"))
               .select("topic_offset", "__r.pos", "__r.reason"))
    return changes, rejects


def current_rules(changes: DataFrame) -> DataFrame:
    """Active rule set after all changes (D1): last change per id by arrival,
    kept when it is an upsert.  One aggregation with map-side partials, so a
    rule id with many changes is combined before the shuffle."""
    last = F.max_by(F.struct(*RULE_COLUMNS, "action", "commit_ts"), F.struct(*CHANGE_ORDER))
    return (changes.where(F.col("id").isNotNull())
            .groupBy("id").agg(last.alias("__last"))
            .where(F.col("__last.action") == "UPSERT")
            .select(*[F.col(f"__last.{c}").alias(c) for c in RULE_COLUMNS],
                    F.col("__last.commit_ts").alias("valid_from")))


def rule_versions(changes: DataFrame, block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """Every upsert becomes a version valid from its commit time until the next
    change (of any kind) to the same id (D2); ``valid_to`` null = still open."""
    with_next = neighbor(changes.where(F.col("id").isNotNull()), ["id"], CHANGE_ORDER,
                         ["commit_ts"], "__next", "next", block_col="topic_offset",
                         block_size=block_size)
    return (with_next.where(F.col("action") == "UPSERT")
            .select(*RULE_COLUMNS, "topic_offset", "pos",
                    F.col("commit_ts").alias("valid_from"),
                    F.col("__next.commit_ts").alias("valid_to")))


def rule_state_trace(changes: DataFrame, block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """Number of active rules after each change (D3), in arrival order.

    Per change the active-set delta is +1 (id becomes active), -1 (active id
    removed) or 0, from the previous change of the same id; the trace is the
    running sum of the deltas over the whole feed.  The full set in force at
    any change is the point query ``valid_from <= t < valid_to`` on
    ``rule_versions``.
    """
    with_prev = neighbor(changes.where(F.col("id").isNotNull()), ["id"], CHANGE_ORDER,
                         ["action"], "__prev", "prev", block_col="topic_offset",
                         block_size=block_size)
    was_active = F.coalesce(F.col("__prev.action") == "UPSERT", F.lit(False))
    delta = (F.when((F.col("action") == "UPSERT") & ~was_active, 1)
             .when((F.col("action") == "REMOVE") & was_active, -1).otherwise(0))
    traced = running_sum(with_prev.withColumn("delta", delta), [], CHANGE_ORDER, "n_active",
                         value=F.col("delta"), block_col="topic_offset", block_size=block_size)
    return traced.select("topic_offset", "pos", "id", "action", "delta", "n_active")


def versions_at(ts_col: Column) -> Column:
    """Condition: a version is in force at time ``ts_col``."""
    return ((ts_col >= F.col("valid_from"))
            & (F.col("valid_to").isNull() | (ts_col < F.col("valid_to"))))

