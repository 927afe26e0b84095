"""Events × rule versions in force at the event's time (E1, E2), through an index
of the rules.

"The rules present when the event arrives" is an interval relation,
``valid_from <= ts < valid_to``, narrowed by each rule's condition.  Both become
equi-keys, so that an event meets only rules it may well satisfy:

* **time tiles**: a version's validity, cut to the time span of the events, is
  covered by at most ``BASE`` + 1 tiles of one width, the largest power of
  ``BASE`` seconds that its length reaches;
* **postings**: a version is filed under the literals that its condition wants
  uid, cid or type to equal (the first of these columns that it names), a
  version without such a wish under one empty key;
* **count tiles**: under the exact count it wants, or the powers of four that its
  bounds on cnt span; without an upper bound and with a small lower one, under
  all counts at once.

The kinds of keys that occur (posting column, width, way of counting) are a
table of at most a few dozen rows; an event is looked up under one key of each.
The exact condition is tested on the rows that meet.  Index rows are written
first, so Spark knows their size and broadcasts them or shuffles both sides by
the key; a popular event type is spread over its time tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .rules import versions_at

BASE = 16           # widths of time tiles: its powers, in seconds
ID_BASE = 16        # widths of id blocks: its powers
_MANY = 16          # lower bounds of cnt from which counts are tiled
_TOP = 20           # the last count tile: 4**20 and all above
KEYS = ["__shape", "__key", "__time", "__count"]


def seconds(ts: Column) -> Column:
    """Whole seconds of a timestamp without time zone since 1970; rising with it."""
    return (F.unix_date(ts.cast("date")).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
            + F.second(ts).cast("long"))


def event_span(events: DataFrame, ts: str = "ts") -> tuple | None:
    """First and last time of the events; None without any."""
    row = events.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    return None if row["lo"] is None else (row["lo"], row["hi"])


def _literal(when) -> Column:
    return F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")


def with_time_tiles(versions: DataFrame, span: tuple) -> DataFrame:
    """``versions`` in force at some time of ``span``, a row for each of their
    time tiles: ``__level`` (power of ``BASE``) and ``__time``."""
    lo, hi = (_literal(x) for x in span)
    first = seconds(F.greatest("valid_from", lo))
    last = seconds(F.least(F.coalesce("valid_to", hi), hi))
    met = (F.col("valid_from") <= hi) & (F.col("valid_to").isNull() | (F.col("valid_to") > lo)) & (first <= last)
    level = F.floor(F.log(float(BASE), (F.col("__last") - F.col("__first") + 1).cast("double"))).cast("int")
    width = F.pow(F.lit(BASE), F.col("__level")).cast("long")
    tile = lambda c: F.floor(F.col(c) / width).cast("long")
    return (versions.where(met).withColumns({"__first": first, "__last": last}).withColumn("__level", level)
            .withColumn("__time", F.explode(F.sequence(tile("__first"), tile("__last")))).drop("__first", "__last"))


def rules_in_force(moments: DataFrame, versions: DataFrame, ts: str = "ts") -> DataFrame:
    """The listing of the rules at given moments (D3, A11): each row of ``moments``
    with every version in force at its ``ts``.  A moment looks its versions up by
    time tile, so what is read follows the listing, not the length of the log."""
    span = event_span(moments, ts)
    if span is None:
        return moments.join(versions, F.lit(False))
    tiled = staged(with_time_tiles(versions, span), "version-tiles")
    levels = sorted(r[0] for r in tiled.select("__level").distinct().collect())   # at most 10
    if not levels:
        return moments.join(versions, F.lit(False))
    e = _with_times(moments, levels, ts)
    on = [F.col("__t.level") == F.col("__level"), F.col("__t.tile") == F.col("__time"), versions_at(F.col(ts))]
    return e.join(tiled, on).drop("__t", "__level", "__time")


def _with_times(events: DataFrame, levels: list[int], ts: str) -> DataFrame:
    """``events``, a row for each width of time tiles, with its tile (``__t``)."""
    times = F.array(*[F.struct(F.lit(n).alias("level"), F.floor(F.col("__second") / F.lit(BASE ** n)).cast("long").alias("tile"))
                      for n in levels])
    return events.withColumn("__second", seconds(F.col(ts))).withColumn("__t", F.explode(times)).drop("__second")


def _count_tile(cnt: Column) -> Column:
    return F.when(cnt < 1, -1).when(cnt >= 1, F.least(F.lit(_TOP), F.floor(F.log2(cnt) / 2))).cast("long")


def rule_index(versions: DataFrame, span: tuple) -> DataFrame:
    """Index rows of ``versions``, which carry the columns of
    ``conditions.posting_columns``: one for each key a version is found by."""
    lo, hi = F.col("__lo"), F.col("__hi")
    way = (F.when(lo == hi, "exact").when(hi.isNotNull() | (lo >= _MANY), "tiles").otherwise("all"))
    counts = (F.when(F.col("__way") == "exact", F.array(lo))
              .when(F.col("__way") == "tiles", F.sequence(F.coalesce(_count_tile(lo), F.lit(-1).cast("long")),
                                                          F.coalesce(_count_tile(hi), F.lit(_TOP).cast("long"))))
              .otherwise(F.array(F.lit(0).cast("long"))))
    possible = lo.isNull() | hi.isNull() | (lo <= hi)
    return staged(
        with_time_tiles(versions.where(possible), span).withColumn("__way", way)
        .withColumn("__key", F.explode("__keys")).withColumn("__count", F.explode(counts))
        .withColumn("__shape", F.concat_ws("/", "__kind", "__level", "__way")).drop("__keys"), "rule-index")


def lookup_keys(events: DataFrame, index: DataFrame, ts: str = "ts") -> DataFrame:
    """``events``, a row for each key that some index row has the like of."""
    # kinds of keys: at most 4 columns x 10 widths x 3 ways of counting
    shapes = sorted((r["__kind"], r["__level"], r["__way"])
                    for r in index.select("__kind", "__level", "__way").distinct().collect())
    at = events.withColumn("__second", seconds(F.col(ts)))
    if not shapes:
        return at.limit(0).withColumns({"__shape": F.lit(""), "__key": F.lit(""), "__time": F.lit(0).cast("long"),
                                        "__count": F.lit(0).cast("long")}).drop("__second")
    keys = []
    for kind, level, way in shapes:
        count = {"exact": F.col("cnt"), "tiles": _count_tile(F.col("cnt")), "all": F.lit(0).cast("long")}[way]
        keys.append(F.struct(
            F.lit(f"{kind}/{level}/{way}").alias("__shape"),
            (F.col(kind) if kind else F.lit("")).alias("__key"),
            F.floor(F.col("__second") / F.lit(BASE ** level)).cast("long").alias("__time"),
            count.cast("long").alias("__count")))
    return at.select(*events.columns, F.explode(F.array(*keys)).alias("__k")).select(*events.columns, "__k.*")


def join_index(events: DataFrame, index: DataFrame, condition: Column, ts: str = "ts") -> DataFrame:
    """Events with the versions in force that they satisfy, each once."""
    e, v = lookup_keys(events, index, ts).alias("e"), index.drop("__kind", "__level", "__way").alias("v")
    on = [F.col(f"e.{k}") == F.col(f"v.{k}") for k in KEYS]
    for test in (versions_at(F.col(ts)), condition):
        on.append(test)
    return e.join(v, on).drop(*KEYS)


def join_from_id(events: DataFrame, versions: DataFrame, first: str, span: tuple, ts: str = "ts") -> DataFrame:
    """Events with the versions in force whose id is ``first`` (a column of the
    events) or larger.  Ids from ``first`` on are a few blocks: the rest of each
    block of ``ID_BASE`` times its size, and the blocks behind it."""
    tiled = staged(with_time_tiles(versions.where("id IS NOT NULL"), span), "version-tiles")
    levels = sorted(r[0] for r in tiled.select("__level").distinct().collect())   # at most 10
    ends = tiled.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    if not levels:
        return events.join(versions, F.lit(False))
    least, span_ids = ends["lo"], ends["hi"] - ends["lo"]
    depth = 1
    while ID_BASE ** depth <= span_ids:
        depth += 1
    block = lambda rank, k: F.floor(rank / F.lit(ID_BASE ** k)).cast("long")
    rank = F.col("id").cast("long") - least
    filed = tiled.withColumn("__block", F.explode(F.array(*[
        F.struct(F.lit(k).alias("size"), block(rank, k).alias("at")) for k in range(1, depth + 1)])))
    start = F.greatest(F.col(first).cast("long") - least, F.lit(0).cast("long"))
    sized = lambda k: lambda b: F.struct(F.lit(k).alias("size"), b.alias("at"))
    wanted = []
    for k in range(1, depth + 1):
        own = block(start, k)
        after = own if k == 1 else own + 1   # a smaller size has what is left of the own block
        last = (block(start, k + 1) + 1) * ID_BASE - 1 if k < depth else block(F.lit(span_ids), k)
        run = F.when(after <= last, F.sequence(after, last)).otherwise(F.array().cast("array<bigint>"))
        wanted.append(F.transform(run, sized(k)))
    e = _with_times(events, levels, ts).withColumn("__b", F.explode(F.concat(*wanted)))
    on = [F.col("__t.level") == F.col("__level"), F.col("__t.tile") == F.col("__time"),
          F.col("__b.size") == F.col("__block.size"), F.col("__b.at") == F.col("__block.at"),
          F.col("id") >= F.col(first), versions_at(F.col(ts))]
    return e.join(filed, on).drop("__t", "__b", "__block", "__level", "__time")
