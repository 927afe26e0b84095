"""Rule conditions as data.

A rule's ``code`` is a Spark SQL boolean expression over the counted event
(``seq, ts, uid, cid, type, cnt``).  Two forms are told apart by Spark on the
rule rows themselves:

* conditions in **normal form**: comparisons joined by AND, and such
  alternatives joined by OR, without parentheses.  A comparison relates a text
  column to quoted literals (single or double quotes) by an operator, [NOT] IN
  or [NOT] LIKE, or a number (``cnt``, ``seq``, ``try_mod`` of them,
  ``try_cast`` of a text column) to integers of up to nine digits by an operator
  or [NOT] IN.  They become rows of the rule table, one per alternative: the
  literals it is found by, bounds on ``cnt``, and the rest as an array of
  comparisons.  No driver work, no compiled branch, whatever their number;
* **free** conditions, every other text.  Each distinct one is analysed once
  against the event schema and becomes one ``CASE`` branch.  A text is rejected
  when it doesn't compile, isn't boolean, or when its *analysed* expression
  holds an operation outside the allow-list: that includes all that can raise
  an error for some event (implicit or explicit casts from text, arithmetic,
  division), which must be written in their ``try_`` form.

A rejected rule never matches, and neither does one whose outcome is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import COUNTED_EVENT

# The first two conditions are the static rules of the reference
# (threshold and exact-nth); they are also the default rule texts.
THRESHOLD_RULE = "type = 'view' AND cnt >= 2"
EXACT_NTH_RULE = "type = 'view' AND cnt = 2"

_TEXT_COLUMNS, _NUMBER_COLUMNS = ("uid", "cid", "type"), ("cnt", "seq")
# Java regular expressions, evaluated by Spark on the rule rows.
_TEXT, _NUMBER = (f"(?:{'|'.join(c)})" for c in (_TEXT_COLUMNS, _NUMBER_COLUMNS))
_QUOTED_TEXT, _INTEGER = r"""(?:'[^'\\]*'|"[^"\\]*")""", r"-?[0-9]{1,9}"
_OPERATOR = r"(?:<=|>=|<>|!=|==|=|<|>)"
_NUMERIC = (rf"(?:{_NUMBER}|try_mod\(\s*{_NUMBER}\s*,\s*{_INTEGER}\s*\)"
            rf"|try_cast\(\s*{_TEXT}\s+AS\s+(?:INT|INTEGER|BIGINT|LONG)\s*\))")
_IN = r"\s+(?:NOT\s+)?IN\s*\(\s*{0}(?:\s*,\s*{0})*\s*\)"
_ATOM = (rf"(?:{_TEXT}\s*{_OPERATOR}\s*{_QUOTED_TEXT}|{_NUMERIC}\s*{_OPERATOR}\s*{_INTEGER}"
         rf"|{_TEXT}{_IN.format(_QUOTED_TEXT)}|{_NUMERIC}{_IN.format(_INTEGER)}"
         rf"|{_TEXT}\s+(?:NOT\s+)?LIKE\s+{_QUOTED_TEXT})")
_CONJUNCTION = rf"{_ATOM}(?:\s+AND\s+{_ATOM})*"
NORMAL_PATTERN = rf"(?i)^\s*{_CONJUNCTION}(?:\s+OR\s+{_CONJUNCTION})*\s*$"
_HEAD = (rf"(?i)^(?:try_mod\(\s*({_NUMBER})\s*,\s*({_INTEGER})\s*\)|try_cast\(\s*({_TEXT})\s+AS\s+(\w+)\s*\)"
         rf"|({_TEXT}|{_NUMBER}))\s*")
_RELATION = rf"(?i)^({_OPERATOR}|(?:NOT\s+)?(?:IN|LIKE))"

# Names of the expressions an analysed condition may hold.  All are total: none
# raises an error, whatever the event.
ALLOWED_EXPRESSIONS = frozenset("""
Alias AttributeReference Literal And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual
GreaterThan GreaterThanOrEqual In InSet IsNull IsNotNull Coalesce If CaseWhen NullIf Nvl
Like RLike StartsWith EndsWith Contains Lower Upper StringTrim StringTrimLeft StringTrimRight
Length OctetLength Substring StringInstr Concat ConcatWs Left Right SplitPart Least Greatest
Hour Minute Second DayOfMonth DayOfWeek DayOfYear Month Quarter Year WeekOfYear LastDay ToDate
TruncTimestamp TruncDate LikeAny LikeAll Between With CommonExpressionDef CommonExpressionRef
TryEval TryToTimestamp TryElementAt TryAdd TrySubtract TryMultiply TryDivide TryMod
""".split())


# Analysing a call of these would already load the class it names.
_REFLECTION = re.compile(r"\b(reflect|java_method|try_reflect)\s*\(", re.IGNORECASE)
_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"")


def _atom(text: Column) -> Column:
    """One comparison as a struct: the column, what is made of it (``text``,
    ``number``, ``mod`` with ``by``, ``int``, ``long``), the relation, and its
    literals as texts or numbers."""
    head = lambda i: F.regexp_extract(text, _HEAD, i)
    tail = F.regexp_replace(text, _HEAD, "")
    relation = F.regexp_replace(F.upper(F.regexp_extract(tail, _RELATION, 1)), r"\s+", " ")
    column = F.lower(F.concat(head(1), head(3), head(5)))
    made = (F.when(head(1) != "", "mod").when(F.lower(head(4)).isin("int", "integer"), "int").when(head(4) != "", "long")
            .when(column.isin(*_TEXT_COLUMNS), "text").otherwise("number"))
    quoted = F.transform(F.regexp_extract_all(tail, F.lit(_QUOTED_TEXT), F.lit(0)),
                         lambda v: F.substring(v, F.lit(2), F.length(v) - 2))
    numbers = F.transform(F.regexp_extract_all(tail, F.lit(_INTEGER), F.lit(0)), lambda v: v.try_cast("bigint"))
    return F.struct(
        column.alias("col"), made.alias("made"), head(2).try_cast("bigint").alias("by"),
        F.when(relation == "==", "=").when(relation == "!=", "<>").otherwise(relation).alias("op"),
        F.when(made == "text", quoted).alias("texts"), F.when(made != "text", numbers).alias("numbers"))


def normal_form(code: Column) -> Column:
    """The condition as an array of alternatives (OR), each an array of
    comparisons (AND); null for a text of any other form."""
    parts = lambda x, pattern: F.regexp_extract_all(x, F.lit(f"(?i){pattern}"), F.lit(0))
    return F.when(code.rlike(NORMAL_PATTERN), F.transform(
        parts(code, _CONJUNCTION), lambda c: F.transform(parts(c, _ATOM), _atom)))


# Columns by which a condition may be found, the most selective first.
POSTING_COLUMNS = ("uid", "cid", "type")


def posting_columns(atoms: Column) -> dict[str, Column]:
    """What an alternative is found by: ``__kind``, the first of the posting
    columns that it wants to equal some literals, and these (``__keys``); the
    bounds of cnt (``__lo``, ``__hi``); and ``__rest``, the other comparisons."""
    wanting = lambda c: lambda x: (x["col"] == c) & x["op"].isin("=", "IN") & (x["made"] == "text")
    kind = F.lit("")
    for c in reversed(POSTING_COLUMNS):
        kind = F.when(F.exists(atoms, wanting(c)), c).otherwise(kind)
    key = F.get(F.filter(atoms, wanting(kind)), 0)
    counts = lambda x: (x["col"] == "cnt") & (x["made"] == "number")
    lows = F.transform(F.filter(atoms, lambda x: counts(x) & x["op"].isin("=", ">=", ">", "IN")),
                       lambda x: F.array_min(x["numbers"]) + F.when(x["op"] == ">", 1).otherwise(0))
    highs = F.transform(F.filter(atoms, lambda x: counts(x) & x["op"].isin("=", "<=", "<", "IN")),
                        lambda x: F.array_max(x["numbers"]) - F.when(x["op"] == "<", 1).otherwise(0))
    bound = lambda x: counts(x) & x["op"].isin("=", "<", "<=", ">", ">=")
    rest = F.filter(atoms, lambda x: ~bound(x) & ((kind == "") | (x != key)))
    return {"__kind": kind, "__keys": F.when(kind == "", F.array(F.lit(""))).otherwise(F.array_distinct(key["texts"])),
            "__lo": F.array_max(lows), "__hi": F.array_min(highs), "__rest": rest}


def _related(value: Column, op: Column, literals: Column, is_text: bool) -> Column:
    one = F.get(literals, 0)
    out = F.when(op == "=", value == one)
    for name, result in (("<>", value != one), ("<", value < one), ("<=", value <= one), (">", value > one),
                         (">=", value >= one), ("IN", F.array_contains(literals, value))):
        out = out.when(op == name, result)
    if is_text:
        out = out.when(op == "LIKE", F.like(value, one)).when(op == "NOT LIKE", ~F.like(value, one))
    return out.when(op == "NOT IN", ~F.array_contains(literals, value))


def _holds(x: Column) -> Column:
    """Whether the event satisfies one comparison; null if it isn't known."""
    def of(columns, value):
        out = F.lit(None)
        for c in columns:
            out = F.when(x["col"] == c, value(F.col(c))).otherwise(out)
        return out
    number = of(_NUMBER_COLUMNS, lambda c: c)
    number = (F.when(x["made"] == "number", number).when(x["made"] == "mod", F.try_mod(number, x["by"]))
              .when(x["made"] == "int", of(_TEXT_COLUMNS, lambda c: c.try_cast("int").cast("bigint")))
              .otherwise(of(_TEXT_COLUMNS, lambda c: c.try_cast("bigint"))))
    return F.when(x["made"] == "text", _related(of(_TEXT_COLUMNS, lambda c: c), x["op"], x["texts"], True)).otherwise(
        _related(number, x["op"], x["numbers"], False))


def all_hold(atoms: Column) -> Column:
    return F.coalesce(F.forall(atoms, _holds), F.lit(False))


def posting_match() -> Column:
    """Whether the event satisfies the row's alternative, but for its key, and
    none of the condition's alternatives before it (a condition hits once)."""
    cnt = F.col("cnt")
    return ((F.col("__lo").isNull() | (cnt >= F.col("__lo"))) & (F.col("__hi").isNull() | (cnt <= F.col("__hi")))
            & ((F.size("__rest") == 0) | all_hold(F.col("__rest")))
            & ((F.size("__before") == 0) | ~F.exists("__before", all_hold)))


def _constant(expr) -> bool:
    """Whether a (JVM) expression is a constant that can be computed."""
    try:
        return expr.foldable() and (expr.eval(None), True)[1]
    except Exception:  # the computation raises an error
        return False


def _unsafe(expr) -> str | None:
    """The first operation of an analysed (JVM) expression that a condition may
    not hold; None when there is none."""
    name = expr.getClass().getSimpleName()
    if name == "Cast":
        source, target = expr.child().dataType().simpleString(), expr.dataType().simpleString()
        numbers = ("tinyint", "smallint", "int", "bigint")
        widens = source in numbers and target in numbers and numbers.index(source) <= numbers.index(target)
        safe = widens or target == "string" or source == "void" or (source, target) in (
            ("timestamp_ntz", "date"), ("date", "timestamp_ntz"), ("date", "timestamp"), ("timestamp_ntz", "timestamp"))
        if not safe and expr.evalMode().toString() != "TRY" and not _constant(expr):
            return f"operation not allowed: cast from {source} to {target}"
    elif name in ("Add", "Subtract", "Multiply", "Divide", "Remainder", "IntegralDivide"):
        context = expr.evalMode().toString() if hasattr(expr, "evalMode") else ""
        if context != "TRY":
            return f"operation not allowed: {name}"
    elif name not in ALLOWED_EXPRESSIONS:
        return f"operation not allowed: {name}"
    children = expr.children()
    for i in range(children.size()):
        found = _unsafe(children.apply(i))
        if found:
            return found
    return None


def rejection_reason(spark: SparkSession, code: str | None) -> str | None:
    """None when ``code`` is a usable condition, else why it is rejected."""
    if code is None or not code.strip():
        return "empty condition"
    called = _REFLECTION.search(_QUOTED.sub("''", code))
    if called:
        return f"operation not allowed: {called[1].lower()}"
    try:
        df = spark.createDataFrame([], COUNTED_EVENT).select(F.expr(code).alias("m"))
        dtype = df.schema["m"].dataType
    except Exception as exc:  # ParseException, AnalysisException
        return f"does not compile: {type(exc).__name__}"
    if not isinstance(dtype, T.BooleanType):
        return f"not a boolean condition: {dtype.simpleString()}"
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "Project" or plan.children().apply(0).children().size():
        return "operation not allowed: more than one expression"
    return _unsafe(plan.projectList().apply(0))


def split_valid(spark: SparkSession, codes: Iterable[str | None]) -> tuple[list[str], dict]:
    """Distinct conditions → (usable, {rejected: reason})."""
    ok, bad = [], {}
    for code in sorted({c for c in codes if c is not None}):
        reason = rejection_reason(spark, code)
        if reason is None:
            ok.append(code)
        else:
            bad[code] = reason
    return ok, bad


def load_condition(spark: SparkSession, path: str) -> str:
    """A rule text from a file that Spark can read (A6), as the static job takes
    it at its start; the condition must be usable."""
    lines = spark.read.text(path, wholetext=True).limit(2).collect()   # a rule is one short text
    code = lines[0][0].strip() if len(lines) == 1 else None
    reason = rejection_reason(spark, code)
    if reason:
        raise ValueError(f"{path}: {reason if code is not None else 'not one rule text'}")
    return code


def condition(code: str) -> Column:
    """One condition as a column; an unknown (null) outcome does not match."""
    return F.coalesce(F.expr(code), F.lit(False))


def match_column(codes: Iterable[str], code_col: str = "code") -> Column:
    """True where the row's free condition, one of the validated ``codes``, holds."""
    result = F.lit(False)
    for code in sorted(set(codes)):
        result = F.when(F.col(code_col) == F.lit(code), condition(code)).otherwise(result)
    return result
