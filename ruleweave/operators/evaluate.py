"""Rule evaluation and offers.

* ``static_rule``: one fixed condition on every counted event (level 1).
* ``dynamic_rules``: every rule version in force when the event arrives
  (level 2); ``mode="strict"`` emits one offer per hitting rule,
  ``mode="sticky"`` reproduces the level-2 loop where the hit flag is shared
  by all rules of an event and never reset, so after the first hitting rule
  (rule id ascending) every later rule emits as well (X12, X13).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conditions import (THRESHOLD_RULE, match_column, normal_form, posting_columns,
                                    posting_match, split_valid)
from ..session import staged
from .asof import event_span, join_from_id, join_index, rule_index

# Offer texts of the reference.  Level 1 (static rule) and
# levels 2-3 (dynamic rules) use different wording.
STATIC_ACTION = "发优惠券"
STATIC_DETAIL = "满100打骨折"
DYNAMIC_ACTION = "发送优惠卷"
DYNAMIC_DETAIL = "满1000打骨折"


FORMS = "__forms"
PARSED = [FORMS, "__normal", "__lo", "__hi", "__rest", "__before"]


@dataclass
class RuleSet:
    """A version table whose conditions are analysed (B14, B15).  ``versions``
    is written once and carries the normal form of its conditions; ``codes`` are
    the usable free condition texts, ``rejected`` maps unusable ones to the
    reason."""
    versions: DataFrame
    codes: list = field(default_factory=list)
    rejected: dict = field(default_factory=dict)

    def alternatives(self) -> DataFrame:
        """A row per alternative of each condition in normal form, and one per
        version with a usable free condition, with what it is found by."""
        normal = (self.versions.select("*", F.posexplode(FORMS).alias("__nth", "__atoms"))
                  .withColumn("__before", F.slice(FORMS, F.lit(1), F.col("__nth")))
                  .withColumns(posting_columns(F.col("__atoms"))).drop(FORMS, "__nth", "__atoms")
                  .withColumn("__normal", F.lit(True)))
        if not self.codes:
            return normal
        types = dict(normal.dtypes)
        none = {c: F.lit(None).cast(types[c]) for c in ("__lo", "__hi")}
        free = (self.versions.where(F.col(FORMS).isNull() & F.col("code").isin(self.codes)).drop(FORMS)
                .withColumns({"__before": F.array().cast(types["__before"]), "__kind": F.lit(""),
                              "__keys": F.array(F.lit("")), **none, "__rest": F.array().cast(types["__rest"]),
                              "__normal": F.lit(False)}))
        return normal.unionByName(free)

    @property
    def matches(self) -> Column:
        """Whether an alternative holds, but for the key that it was found by."""
        if not self.codes:
            return posting_match()
        return F.when(F.col("__normal"), posting_match()).otherwise(match_column(self.codes))


def compile_rules(spark: SparkSession, versions: DataFrame) -> RuleSet:
    """Analyse the conditions of a version table, which is written to the shared
    folder first: its size is then known to Spark, and the change feed isn't
    computed again by each use.  Only the distinct *free* texts reach the
    driver."""
    versions = staged(versions.withColumn(FORMS, normal_form(F.col("code"))), "rule-versions")
    free = versions.where(F.col(FORMS).isNull() & F.col("code").isNotNull()).select("code").distinct()
    ok, bad = split_valid(spark, [r["code"] for r in free.collect()])
    return RuleSet(versions, ok, bad)


def rejected_rules(spark: SparkSession, versions: DataFrame) -> DataFrame:
    """Versions whose condition cannot be used (B15), with the reason:
    ``(id, topic_offset, pos, code, reason)``."""
    rs = compile_rules(spark, versions)
    table = spark.createDataFrame(list(rs.rejected.items()), "rejected_code STRING, reason STRING")
    empty = F.coalesce(F.trim("code") == "", F.lit(True))
    return (rs.versions.where(F.col(FORMS).isNull())
            .join(table, F.col("code") == F.col("rejected_code"), "left")
            .withColumn("reason", F.when(empty, F.lit("empty condition")).otherwise(F.col("reason")))
            .where(F.col("reason").isNotNull())
            .select("id", "topic_offset", "pos", "code", "reason"))


def current_rule_set(spark: SparkSession, current: DataFrame) -> RuleSet:
    """The current rule table (e.g. ``rules.current_rules``) as a rule set in
    force for every event, with no time travel (E2): each rule becomes one
    version open on both sides."""
    versions = (current.withColumn("valid_from", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
                .withColumn("valid_to", F.lit(None).cast("timestamp_ntz")))
    return compile_rules(spark, versions)


def offers(df: DataFrame, action: str = DYNAMIC_ACTION, detail: str = DYNAMIC_DETAIL,
           rule_col: str | None = "id") -> DataFrame:
    cols = [F.col("seq"), F.col("uid")]
    if rule_col:
        cols.append(F.col(rule_col).alias("rule_id"))
    return df.select(*cols, F.lit(action).alias("action"), F.lit(detail).alias("detail"))


def static_rule(counted: DataFrame, code: str = THRESHOLD_RULE) -> DataFrame:
    """Counted events that satisfy one fixed condition (F1).

    The bare expression is used as the filter (a null outcome drops the row
    anyway), so Catalyst can split its conjuncts: a conjunct on the count's
    key columns (``type = 'view'``) moves below the window, into the Parquet
    scan, and the other types are neither read nor shuffled.
    """
    return counted.where(F.expr(code))


def static_offers(counted: DataFrame, code: str = THRESHOLD_RULE) -> DataFrame:
    return offers(static_rule(counted, code), STATIC_ACTION, STATIC_DETAIL, rule_col=None)


def matched_pairs(counted: DataFrame, rules: RuleSet, span: tuple | None = None) -> DataFrame:
    """(event, version) pairs where the version is in force and its condition
    holds: the strict hits.  Events meet rules through the index of ``asof``;
    the condition is part of the join condition, so pairs that don't match are
    never materialised.  ``span`` is the time span of the events, looked up if
    it isn't given."""
    span = span or event_span(counted)
    if span is None:
        return counted.join(rules.versions.drop(FORMS), F.lit(False))
    return join_index(counted, rule_index(rules.alternatives(), span), rules.matches).drop(*PARSED)


def sticky_pairs(counted: DataFrame, rules: RuleSet, span: tuple | None = None) -> DataFrame:
    """(event, version) pairs emitted by the level-2 loop (X12): all versions
    in force whose id is >= the smallest hitting id of that event.

    The smallest hitting id comes from the strict pairs, by an aggregate with
    map-side partials over the whole event (``seq`` alone may repeat over the
    partitions of a topic); only events that are hit look up the versions of that
    id and the ones behind it."""
    span = span or event_span(counted)
    first = matched_pairs(counted, rules, span).groupBy(*counted.columns).agg(F.min("id").alias("__first"))
    versions = rules.versions.drop(FORMS)
    if span is None:
        return first.join(versions, F.lit(False)).drop("__first")
    return join_from_id(first, versions, "__first", span).drop("__first")


def dynamic_rules(counted: DataFrame, rules: RuleSet, mode: str = "strict", span: tuple | None = None) -> DataFrame:
    if mode == "strict":
        pairs = matched_pairs(counted, rules, span)
    elif mode == "sticky":
        pairs = sticky_pairs(counted, rules, span)
    else:
        raise ValueError("mode must be 'strict' or 'sticky'")
    return offers(pairs)
