"""History check of level 3.

The reference runs, for every (event, hitting rule), one JDBC query
``SELECT count(*) counts FROM <history table> WHERE uid=? AND cid=? AND type=?
AND start_time >= ? AND end_time <= ? GROUP BY uid, cid`` and emits the offer
when the count (0 when no row) reaches the rule's ``counts``.

Here all lookups of a batch become one plan:

1. the distinct lookups ``(uid, cid, type, range)`` of the candidates (many
   events share one), written once.  History rows of other (uid, cid, type) go;
   equal rows are counted before any shuffle, the overall range prunes the scan;
2. each history row gets the rank of its start among the distinct range starts of
   its key (a running sum in time order), so a row starts inside a range when its
   rank isn't below the range's own;
3. rows are filed under the nodes of a binary indexed tree over these ranks, and a
   range reads the nodes that make up "this rank or above": each row is met in just
   one of them.  Both numbers are at most the logarithm of the ranges of one key;
4. a running sum in the order of the ends gives, per node, the rows that end by the
   range's end; they are added up per lookup.  A lookup without rows counts 0.

So the work is that of the rows and the lookups, however many ranges there are: no
history row meets a range.  Both running sums are cut into blocks of time for keys
with very many rows (``sequence.running_sum``).

``rule.sql`` names a registered history metric (a DataFrame with columns
``uid, cid, type, start_time, end_time``), never free SQL per event.  The
single parameterised lookup of the reference is ``lookup_count``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from .asof import seconds
from .sequence import DEFAULT_BLOCK_SIZE, running_sum

EVENT_KEY = ["uid", "cid", "type"]
KEY_COLS = ["uid", "cid", "type", "start_time", "end_time"]


def _ts(col: str):
    return F.col(col).try_cast("timestamp_ntz")


def _millis(ts: Column) -> Column:
    # rises with the time; a block of 2^20 of them is about 17 minutes
    return seconds(ts) * 1000


def _nodes_of(rank: Column) -> Column:
    """Tree nodes that a row of this rank is filed under."""
    bits = F.sequence(F.lit(0), F.length(F.bin(rank)) - 1)
    held = F.filter(bits, lambda k: F.call_function("shiftright", rank, k).bitwiseAND(F.lit(1)) == 1)
    return F.transform(held, lambda k: F.call_function("shiftleft", F.call_function("shiftright", rank, k), k))


def _nodes_from(rank: Column, last: Column) -> Column:
    """Tree nodes that together hold the ranks from ``rank`` on, up to ``last``."""
    one = F.lit(1).cast("long")
    steps = F.sequence(F.lit(0), F.length(F.bin(last)))
    size = lambda k: F.call_function("shiftleft", one, k)
    up = F.transform(steps, lambda k: F.call_function(
        "shiftleft", F.call_function("shiftright", rank + size(k) - 1, k), k))
    return F.filter(F.array_distinct(up), lambda n: n <= last)


def history_counts(keys: DataFrame, history: DataFrame, bounds: tuple | None = None,
                   block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """``keys(uid, cid, type, start_time, end_time)`` (range bounds as text or
    timestamps) → same columns + ``hist_cnt``: number of history rows of that
    (uid, cid, type) whose interval lies inside the range, both ends inclusive.
    Keys without history rows, with a null or with a bound that is no time get 0."""
    k = staged(keys.select(*KEY_COLS).distinct()
               .withColumns({"__lo": _ts("start_time"), "__hi": _ts("end_time")}), "history-keys")
    wanted = k.dropna(subset=[*EVENT_KEY, "__lo", "__hi"]).select(*EVENT_KEY, "__lo", "__hi").distinct()
    h = history.select(*EVENT_KEY, F.col("start_time").alias("h_start"), F.col("end_time").alias("h_end"))
    if bounds is not None:
        lo, hi = bounds
        lo_c = F.lit(lo.isoformat(sep=" ")).cast("timestamp_ntz")
        hi_c = F.lit(hi.isoformat(sep=" ")).cast("timestamp_ntz")
        h = h.where((F.col("h_start") >= lo_c) & (F.col("h_end") <= hi_c))
    found = (h.dropna().join(wanted.select(*EVENT_KEY).distinct(), EVENT_KEY, "left_semi")
             .groupBy(*EVENT_KEY, "h_start", "h_end").agg(F.count(F.lit(1)).alias("n")))

    # ranks of starts: a range start comes before the rows of its own time
    starts = wanted.select(*EVENT_KEY, F.col("__lo").alias("t"), F.lit(0).alias("kind")).distinct()
    at_start = (found.withColumnsRenamed({"h_start": "t"}).withColumn("kind", F.lit(1))
                .unionByName(starts, allowMissingColumns=True).withColumn("ms", _millis(F.col("t"))))
    ranked = staged(running_sum(at_start, EVENT_KEY, ["t", "kind"], "rank", (F.col("kind") == 0).cast("long"),
                                "ms", block_size).where("rank > 0").drop("ms"), "history-ranks")
    ranges = (wanted.join(ranked.where("kind = 0").select(*EVENT_KEY, F.col("t").alias("__lo"), "rank"),
                          [*EVENT_KEY, "__lo"])
              .join(starts.groupBy(*EVENT_KEY).agg(F.count(F.lit(1)).alias("last")), EVENT_KEY)
              .withColumn("node", F.explode(_nodes_from(F.col("rank"), F.col("last")))))

    # rows by end, per node: a range comes after the rows that end with it
    rows = (ranked.where("kind = 1").withColumn("node", F.explode(_nodes_of(F.col("rank"))))
            .groupBy(*EVENT_KEY, "node", F.col("h_end").alias("t")).agg(F.sum("n").alias("n")))
    at_end = (rows.withColumn("kind", F.lit(0))
              .unionByName(ranges.select(*EVENT_KEY, "node", F.col("__hi").alias("t"), "__lo", F.lit(1).alias("kind"),
                                         F.lit(0).cast("long").alias("n")), allowMissingColumns=True)
              .withColumn("ms", _millis(F.col("t"))))
    inside = (running_sum(at_end, [*EVENT_KEY, "node"], ["t", "kind"], "upto", F.col("n"), "ms", block_size)
              .where("kind = 1").groupBy(*EVENT_KEY, "__lo", F.col("t").alias("__hi"))
              .agg(F.sum("upto").alias("hist_cnt")))
    return (k.join(inside, [*EVENT_KEY, "__lo", "__hi"], "left")
            .select(*KEY_COLS, F.coalesce("hist_cnt", F.lit(0)).cast("long").alias("hist_cnt")))


def range_bounds(versions: DataFrame) -> tuple | None:
    """Overall ``(min start, max end)`` of the rule ranges: one scalar
    aggregate over the version table (written once, see ``compile_rules``).  Rows without a usable range cannot match any
    history row and do not widen the bounds."""
    row = versions.agg(F.min(_ts("start_time")).alias("lo"), F.max(_ts("end_time")).alias("hi")).first()
    if row is None or row["lo"] is None or row["hi"] is None:
        return None
    return row["lo"], row["hi"]


def history_gate(candidates: DataFrame, histories: Mapping[str, DataFrame],
                 bounds: tuple | None = None) -> DataFrame:
    """Candidates (counted event ⨝ hitting rule version, with the rule's
    ``sql, start_time, end_time, counts``) → same rows + ``hist_cnt``,
    ``is_hit``.  A candidate whose rule names no registered metric, or has no
    threshold, is quarantined (``hist_cnt`` null, not a hit) where the
    reference job would fail (X23)."""
    parts = []
    for metric, hist in histories.items():
        keys = candidates.where(F.col("sql") == metric).select(*KEY_COLS)
        parts.append(history_counts(keys, hist, bounds).withColumn("sql", F.lit(metric)))
    if not parts:
        raise ValueError("no history metric registered")
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    c = counts.select(*[F.col(n).alias(f"__{n}") for n in ["sql", *KEY_COLS]], "hist_cnt")
    on = None
    for n in ["sql", *KEY_COLS]:
        eq = F.col(n).eqNullSafe(F.col(f"__{n}"))
        on = eq if on is None else on & eq
    out = candidates.join(c, on, "left").drop(*[f"__{n}" for n in ["sql", *KEY_COLS]])
    return out.withColumn("is_hit", F.coalesce(F.col("hist_cnt") >= F.col("counts"), F.lit(False)))


# Fixed value: the lookup text of the reference (its table name is the
# placeholder for the registered history DataFrame).
LOOKUP_SQL = ("SELECT count(*) AS counts FROM {history} WHERE uid = ? AND cid = ? AND type = ? "
              "AND start_time >= ? AND end_time <= ? GROUP BY uid, cid")


def positional_to_named(sql: str) -> tuple[str, list[str]]:
    """Replace each ``?`` marker outside quotes by ``:__pN``.

    PySpark 4.1.2 binds more than four positional arguments in a scrambled
    order (``SELECT ?, ?, ?, ?, ?`` returns them permuted), so positional
    arguments are passed by name instead; the binding order stays that of
    the markers in the text.
    """
    out, names, quote = [], [], None
    for ch in sql:
        if quote:
            quote = None if ch == quote else quote
            out.append(ch)
        elif ch in "'\"`":
            quote = ch
            out.append(ch)
        elif ch == "?":
            names.append(f"__p{len(names)}")
            out.append(":" + names[-1])
        else:
            out.append(ch)
    return "".join(out), names


def lookup_count(spark: SparkSession, history: DataFrame, params: Sequence,
                 sql: str = LOOKUP_SQL) -> DataFrame:
    """One parameterised lookup (E4): positional ``?`` markers bound in the
    reference's order uid, cid, type, start, end.  Returns the query's rows
    (at most one per (uid, cid)); callers read ``counts`` of the first row,
    0 when there is none."""
    text, names = positional_to_named(sql)
    if len(names) != len(params):
        raise ValueError(f"{len(names)} markers, {len(params)} parameters")
    return spark.sql(text, args=dict(zip(names, params)), history=history)
