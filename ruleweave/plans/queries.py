"""The query catalogue: one ``(spark, sf_dir) -> DataFrame`` builder per
operator of the reference, each over the whole ``events`` table.

Levels of the reference and where they live:

* level 1 (static rule):      q07 → q09 (threshold), q10 (exact nth), q08
* event records:              q01 (parse), q02 (malformed)
* rule change feed:           q03 (changes), q04 (rejects), q05 (current),
                              q06 (versions), q19 (state trace)
* level 2 (dynamic rules):    q12 (strict), q13 (sticky), q11 (match trace)
* level 3 (+ history check):  q14 (history counts), q15 (decisions),
                              q16 (offers), q17 (single parameterised lookup)
* daily count (commented intent of the reference, not its code): q18
* rule texts that cannot be used (B15): q20
* every event against the current rules (E2): q21
* free rule texts (B14: double quotes, casts, numbers, modulo): q22
* the rules themselves at given moments (D3, A11): q23
* history counts of as many ranges as events (C4, E3): q24
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conditions import EXACT_NTH_RULE
from ..operators import evaluate, history, rules
from ..operators.asof import event_span, rules_in_force
from ..operators.parse import parse_lines
from ..operators.sequence import DEFAULT_BLOCK_SIZE, running_count
from ..session import staged
from ..sources import cdc as cdc_src
from ..sources import events as ev_src

EVENT_KEY = ["uid", "cid", "type"]
# Rows above which a key is cut into blocks of the arrival order (tests lower
# it, so that small data has heavy keys).
BLOCK_SIZE = DEFAULT_BLOCK_SIZE

# The parameters of the single lookup query (q17), bound in the
# reference's order uid, cid, type, range start, range end.
LOOKUP_PARAMS = ["7", "c1", "view", "2024-01-01 00:00:00", "2024-01-31 00:00:00"]


# ---------------------------------------------------------------- building blocks

def counted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_count(ev_src.load_events(spark, sf_dir), EVENT_KEY, block_size=BLOCK_SIZE)


def derived_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return rules.parse_cdc(cdc_src.load_cdc_lines(spark, sf_dir))


def demo_rule_set(spark: SparkSession) -> evaluate.RuleSet:
    lines = cdc_src.demo_rule_lines(spark)
    changes, _ = rules.parse_cdc(lines)
    versions = rules.rule_versions(changes, block_size=BLOCK_SIZE)
    return evaluate.compile_rules(spark, versions)


def _histories(spark: SparkSession, sf_dir: str) -> dict:
    return {cdc_src.HISTORY_METRIC: ev_src.load_history(spark, sf_dir)}


def _span(spark: SparkSession, sf_dir: str) -> tuple | None:
    """Time span of the events, from their table: the count isn't needed for it."""
    return event_span(ev_src.load_events(spark, sf_dir))


def _strict_candidates(spark: SparkSession, sf_dir: str):
    rs = demo_rule_set(spark)
    pairs = evaluate.matched_pairs(counted_events(spark, sf_dir), rs, _span(spark, sf_dir))
    return rs, pairs


# ---------------------------------------------------------------- queries

def q01_parse_event_lines(spark, sf_dir):
    lines = ev_src.event_lines(ev_src.load_events(spark, sf_dir), spoil=True)
    return parse_lines(lines)[0]


def q02_malformed_event_lines(spark, sf_dir):
    lines = ev_src.event_lines(ev_src.load_events(spark, sf_dir), spoil=True)
    return parse_lines(lines)[1]


def q03_cdc_rule_changes(spark, sf_dir):
    return derived_changes(spark, sf_dir)[0]


def q04_cdc_rejects(spark, sf_dir):
    return derived_changes(spark, sf_dir)[1]


def q05_current_rules(spark, sf_dir):
    return rules.current_rules(derived_changes(spark, sf_dir)[0])


def q06_rule_versions(spark, sf_dir):
    return rules.rule_versions(derived_changes(spark, sf_dir)[0], block_size=BLOCK_SIZE)


def q07_keyed_running_count(spark, sf_dir):
    return counted_events(spark, sf_dir)


def q08_keyed_count_state(spark, sf_dir):
    return (ev_src.load_events(spark, sf_dir).groupBy(*EVENT_KEY)
            .agg(F.count(F.lit(1)).alias("cnt")))


def q09_rule_threshold(spark, sf_dir):
    return evaluate.static_offers(counted_events(spark, sf_dir))


def q10_rule_exact_nth(spark, sf_dir):
    return evaluate.static_rule(counted_events(spark, sf_dir), EXACT_NTH_RULE).select(
        "seq", "uid", "cid", "type", "cnt")


def q11_rule_match_trace(spark, sf_dir):
    _, pairs = _strict_candidates(spark, sf_dir)
    params = ["sql", "start_time", "end_time", "counts"]
    return (pairs.where(F.col("sql").isNotNull() & F.col("counts").isNotNull())
            .select("seq", "uid", "cid", "type", "cnt", F.col("id").alias("rule_id"), *params))


def q12_dynamic_rules_strict(spark, sf_dir):
    return evaluate.dynamic_rules(counted_events(spark, sf_dir), demo_rule_set(spark), "strict", _span(spark, sf_dir))


def q13_dynamic_rules_sticky(spark, sf_dir):
    return evaluate.dynamic_rules(counted_events(spark, sf_dir), demo_rule_set(spark), "sticky", _span(spark, sf_dir))


def q14_history_range_count(spark, sf_dir):
    rs, pairs = _strict_candidates(spark, sf_dir)
    keys = pairs.where(F.col("sql") == cdc_src.HISTORY_METRIC).select(*history.KEY_COLS)
    return history.history_counts(keys, ev_src.load_history(spark, sf_dir),
                                  history.range_bounds(rs.versions))


def q24_history_before_events(spark, sf_dir):
    """The history of the event's key in the week up to it: about as many distinct
    ranges as events."""
    ev = ev_src.load_events(spark, sf_dir)
    keys = ev.select(*EVENT_KEY, (F.col("ts") - F.expr("INTERVAL 7 DAYS")).alias("start_time"),
                     F.col("ts").alias("end_time"))
    return history.history_counts(keys, ev_src.load_history(spark, sf_dir), block_size=BLOCK_SIZE)


def history_decisions(spark, sf_dir):
    rs, pairs = _strict_candidates(spark, sf_dir)
    cand = pairs.select("seq", "uid", "cid", "type", "cnt", F.col("id").alias("rule_id"),
                        "sql", "start_time", "end_time", "counts")
    # the candidates feed both the lookup keys and the decisions: written once
    cand = staged(cand, "candidates")
    return history.history_gate(cand, _histories(spark, sf_dir), history.range_bounds(rs.versions))


def q15_history_gate(spark, sf_dir):
    return history_decisions(spark, sf_dir)


def q16_dynamic_rules_history(spark, sf_dir):
    decided = history_decisions(spark, sf_dir)
    return evaluate.offers(decided.where(F.col("is_hit")), rule_col="rule_id")


def q17_parameterized_lookup(spark, sf_dir):
    return history.lookup_count(spark, ev_src.load_history(spark, sf_dir), LOOKUP_PARAMS)


def q18_daily_threshold(spark, sf_dir):
    ev = ev_src.load_events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    daily = running_count(ev, [*EVENT_KEY, "day"], block_size=BLOCK_SIZE)
    return daily.where((F.col("type") == "view") & (F.col("cnt") > 2)).select(
        "seq", "uid", "cid", "type", "day", "cnt")


def q19_rule_state_trace(spark, sf_dir):
    return rules.rule_state_trace(derived_changes(spark, sf_dir)[0], block_size=BLOCK_SIZE)


def derived_versions(spark, sf_dir):
    return rules.rule_versions(derived_changes(spark, sf_dir)[0], block_size=BLOCK_SIZE)


def q20_rejected_rules(spark, sf_dir):
    return evaluate.rejected_rules(spark, cdc_src.with_bad_conditions(derived_versions(spark, sf_dir)))


def q21_current_rules(spark, sf_dir):
    current = rules.current_rules(derived_changes(spark, sf_dir)[0])
    return evaluate.dynamic_rules(counted_events(spark, sf_dir), evaluate.current_rule_set(spark, current),
                                  span=_span(spark, sf_dir))


def q22_free_conditions(spark, sf_dir):
    versions = cdc_src.with_free_conditions(derived_versions(spark, sf_dir))
    rs = evaluate.compile_rules(spark, versions)
    pairs = evaluate.matched_pairs(counted_events(spark, sf_dir), rs, _span(spark, sf_dir))
    return pairs.select("seq", F.col("id").alias("rule_id"), "topic_offset", "pos")


def q23_rules_at_moments(spark, sf_dir):
    """The rules in force at the start of each day that has an event."""
    days = ev_src.load_events(spark, sf_dir).select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).distinct()
    listed = rules_in_force(days, derived_versions(spark, sf_dir))
    return listed.select("ts", "id", "name", "code", "counts", "status", "topic_offset", "pos", "valid_from", "valid_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q01_parse_event_lines": q01_parse_event_lines,
    "q02_malformed_event_lines": q02_malformed_event_lines,
    "q03_cdc_rule_changes": q03_cdc_rule_changes,
    "q04_cdc_rejects": q04_cdc_rejects,
    "q05_current_rules": q05_current_rules,
    "q06_rule_versions": q06_rule_versions,
    "q07_keyed_running_count": q07_keyed_running_count,
    "q08_keyed_count_state": q08_keyed_count_state,
    "q09_rule_threshold": q09_rule_threshold,
    "q10_rule_exact_nth": q10_rule_exact_nth,
    "q11_rule_match_trace": q11_rule_match_trace,
    "q12_dynamic_rules_strict": q12_dynamic_rules_strict,
    "q13_dynamic_rules_sticky": q13_dynamic_rules_sticky,
    "q14_history_range_count": q14_history_range_count,
    "q15_history_gate": q15_history_gate,
    "q16_dynamic_rules_history": q16_dynamic_rules_history,
    "q17_parameterized_lookup": q17_parameterized_lookup,
    "q18_daily_threshold": q18_daily_threshold,
    "q19_rule_state_trace": q19_rule_state_trace,
    "q20_rejected_rules": q20_rejected_rules,
    "q21_current_rules": q21_current_rules,
    "q22_free_conditions": q22_free_conditions,
    "q23_rules_at_moments": q23_rules_at_moments,
    "q24_history_before_events": q24_history_before_events,
}
