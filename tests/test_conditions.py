"""Rule conditions as SQL."""

import pytest
from pyspark.sql import functions as F

from ruleweave.functions.conditions import (EXACT_NTH_RULE, THRESHOLD_RULE, match_column,
                                            normal_form, posting_columns, rejection_reason, split_valid)
from ruleweave.operators.evaluate import static_rule


def test_single_event_check(spark):
    # one event (view, count 3) with the threshold rule: hit
    ev = spark.createDataFrame([(1, None, "u", "c", "view", 3)],
                               "seq BIGINT, ts TIMESTAMP_NTZ, uid STRING, cid STRING, type STRING, cnt BIGINT")
    assert static_rule(ev, THRESHOLD_RULE).count() == 1
    assert static_rule(ev, EXACT_NTH_RULE).count() == 0


def test_rejections(spark):
    assert rejection_reason(spark, THRESHOLD_RULE) is None
    assert rejection_reason(spark, "lower(type) IN ('view', 'click') AND cnt BETWEEN 1 AND 3") is None
    assert "not allowed" in rejection_reason(spark, "reflect('java.lang.System', 'exit', 0) = 1")
    assert "not allowed" in rejection_reason(spark, "java_method('a', 'b') IS NULL")
    assert "not allowed" in rejection_reason(spark, "exists(array(1), x -> x > 0)")
    assert "not allowed" in rejection_reason(spark, "cnt IN (SELECT 1)")
    assert "compile" in rejection_reason(spark, "type = = 'view'")
    assert "compile" in rejection_reason(spark, "no_such_column > 1")
    assert "boolean" in rejection_reason(spark, "cnt + 1")
    assert rejection_reason(spark, None) == "empty condition"
    # a function name inside a string literal is not a call
    assert rejection_reason(spark, "type = 'reflect('") is None


def test_match_column(spark):
    ok, bad = split_valid(spark, [THRESHOLD_RULE, EXACT_NTH_RULE, "cnt +", None])
    assert ok == sorted([THRESHOLD_RULE, EXACT_NTH_RULE]) and list(bad) == ["cnt +"]
    df = spark.createDataFrame(
        [(THRESHOLD_RULE, "view", 3), (EXACT_NTH_RULE, "view", 3), ("cnt +", "view", 3),
         (THRESHOLD_RULE, "click", 5), (EXACT_NTH_RULE, "view", None)],
        "code STRING, type STRING, cnt BIGINT")
    got = df.select(match_column(ok).alias("m"))
    assert [r.m for r in got.collect()] == [True, False, False, False, False]


def test_nothing_that_can_raise(spark):
    """Each of these would end the job for some event."""
    for code in ("cid = 201", "cast(cid AS INT) > 3", "cnt % 0 = 1", "cnt / 0 > 1", "cnt * 9223372036854775807 > 0",
                 "cnt + 1 > 2", "ts >= 'no date'", "uid > 5", "CASE WHEN type = 'x' THEN cid ELSE cnt END = 3"):
        assert rejection_reason(spark, code) is not None, code
    for code in ("try_cast(cid AS INT) > 3", "try_mod(cnt, 0) = 1", "try_add(cnt, 1) > 2", "ts >= '2024-01-01'",
                 "cast(cnt AS STRING) = '2'", 'type = "view"', "cnt > 12345678901"):
        assert rejection_reason(spark, code) is None, code


def test_reserved_names_are_unknown(spark):
    for code in ("__N__ > 3", "__nums IS NOT NULL", "__guard = 'view'", "__lo IS NULL", "code = 'x'"):
        assert "compile" in rejection_reason(spark, code), code


def test_normal_form(spark):
    normal = ["type = 'view' AND cnt >= 2", "cnt = 3", "uid = 'a AND cnt = 1' AND type = 'v'", 'type = "view"',
              "type = 'x' OR cnt = 1", "type = 'view' AND type = 'click'", 'cid IN ("a", "b\'c")',
              "try_mod(cnt, 3) = 0", "TRY_CAST(uid as int) > 50 and cnt >= 3", "type NOT  LIKE 'v%' or seq not in (1,-2 )"]
    other = ["CNT<5 and cnt > 1 AND cid != 'c''", "cnt > 12345678901", "type = 'a''b'", "", None, "cid = 201",
             "cnt >= 2 AND nosuch = 1", "(cnt = 1)", "cnt % 2 = 1", "cnt = 1 AND NOT type = 'a'", "type = 'a\\'", "cnt <=> 1",
             "cnt IN ('1')", "uid IN (1)", "cnt = 1 OR", "cnt LIKE '1'", "try_cast(cnt AS INT) = 1"]
    df = spark.createDataFrame([(t,) for t in normal + other], "code STRING")
    got = {r["code"]: r["f"] for r in df.select("code", normal_form(F.col("code")).alias("f")).collect()}
    assert [t for t in normal + other if got[t] is not None] == normal
    atoms = lambda t: [[(a["col"], a["made"], a["by"], a["op"], a["texts"] or a["numbers"]) for a in alt] for alt in got[t]]
    assert atoms("type = 'x' OR cnt = 1") == [[("type", "text", None, "=", ["x"])], [("cnt", "number", None, "=", [1])]]
    assert atoms(normal[7]) == [[("cnt", "mod", 3, "=", [0])]]
    assert atoms(normal[8]) == [[("uid", "int", None, ">", [50]), ("cnt", "number", None, ">=", [3])]]
    assert atoms(normal[9]) == [[("type", "text", None, "NOT LIKE", ["v%"])], [("seq", "number", None, "NOT IN", [1, -2])]]


def test_posting_columns(spark):
    cases = {"type = 'view' AND cnt >= 2": ("type", ["view"], 2, None, 0), "cnt = 3": ("", [""], 3, 3, 0),
             "uid = 'a AND cnt = 1' AND type = 'v'": ("uid", ["a AND cnt = 1"], None, None, 1),
             "type = 'view' AND type = 'click'": ("type", ["view"], None, None, 1), "cnt > 4 AND cnt < 9 AND cnt <> 6": ("", [""], 5, 8, 1),
             "cid IN ('a', 'b', 'a') AND type <> 'x'": ("cid", ["a", "b"], None, None, 1), "cnt IN (7, 3)": ("", [""], 3, 7, 1),
             "type LIKE 'v%' AND try_mod(cnt, 2) = 1": ("", [""], None, None, 2)}
    df = spark.createDataFrame([(t,) for t in cases], "code STRING")
    rows = df.select("code", *[c.alias(n) for n, c in posting_columns(normal_form(F.col("code"))[0]).items()]).collect()
    assert {r["code"]: (r["__kind"], r["__keys"], r["__lo"], r["__hi"], len(r["__rest"])) for r in rows} == cases


def test_load_condition(spark, tmp_path):
    from ruleweave.functions.conditions import load_condition
    (tmp_path / "rule.sql").write_text("type = 'view'\n  AND cnt >= 2\n")
    code = load_condition(spark, str(tmp_path / "rule.sql"))
    ev = spark.createDataFrame([("view", 2), ("view", 1), ("click", 5)], "type STRING, cnt BIGINT")
    assert static_rule(ev, code).count() == 1
    for name, text in (("bad.sql", "nosuch = 1"), ("empty.sql", " ")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            load_condition(spark, str(tmp_path / name))
