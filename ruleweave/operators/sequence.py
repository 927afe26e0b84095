"""Order-dependent per-key operators that stay balanced under hot keys.

A plain ``Window.partitionBy(key).orderBy(seq)`` puts every row of a key into
one task; a key holding a third of all rows then decides the job's run time
and memory, and AQE cannot split a window partition.  Here there is one plan
for every size of the input:

1. rows are counted per key (map-side combine).  Keys with more than
   ``block_size`` rows are *heavy*; there are at most rows / ``block_size`` of
   them, which bounds the broadcast that marks their rows;
2. the rows of a heavy key are cut into blocks of the arrival order
   (``seq div block_size``), all other keys have the one block 0, and the final
   window runs over (key, block): the data is shuffled once;
3. one *marker* row per (heavy key, block) carries what the earlier blocks hold
   and seeds its block.  Light keys have no markers.

The result is exactly that of the plain window.  Null keys form their own
group, as in a window.  Without keys (a running total over everything), all
rows are cut into blocks and the carried sums are built from dyadic ranges of
blocks, so that no task sees all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# About a million rows per (key, block): a window partition that sorts in
# memory on any executor.
DEFAULT_BLOCK_SIZE = 1 << 20

_BLK, _MARK, _CARRY, _HEAVY = "__blk", "__marker", "__carry", "__heavy"
_LEVELS = 44   # dyadic levels: block ids below 2**44


def _block(order_col: str, block_size: int) -> Column:
    # integer division: monotone in the order column, exact for any long
    return F.expr(f"CAST(`{order_col}` AS BIGINT) div {int(block_size)}")


def _with_blocks(df: DataFrame, keys: list[str], block_col: str, block_size: int) -> DataFrame:
    """``df`` with the block of each row and whether its key is heavy."""
    block = _block(block_col, block_size)
    if not keys:
        return df.withColumn(_BLK, block).withColumn(_HEAVY, F.lit(True))
    heavy = (df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
             .agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block_size))
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        on = same if on is None else on & same
    marked = df.join(F.broadcast(heavy), on, "left").withColumn(_HEAVY, F.col("__n").isNotNull())
    return (marked.drop("__n", *[f"__k{i}" for i in range(len(keys))])
            .withColumn(_BLK, F.when(F.col(_HEAVY), block).otherwise(F.lit(0).cast("long"))))


def _carried_total(per_block: DataFrame) -> DataFrame:
    """(blk, carry) with the sum of ``__s`` over all smaller blocks, for blocks
    of one sequence: the blocks below b are one dyadic range for each bit of b."""
    levels = F.sequence(F.lit(0), F.lit(_LEVELS - 1))
    ranges = (per_block.select("__s", F.col(_BLK), F.explode(levels).alias("level"))
              .select("level", F.expr(f"shiftright({_BLK}, level)").alias("at"), "__s")
              .groupBy("level", "at").agg(F.sum("__s").alias("__sum")))
    needed = (per_block.select(_BLK, F.explode(levels).alias("level"))
              .where(F.expr(f"shiftright({_BLK}, level) & 1") == 1)
              .select(_BLK, "level", (F.expr(f"shiftright({_BLK}, level)") - 1).alias("at")))
    before = (needed.join(ranges, ["level", "at"]).groupBy(_BLK).agg(F.sum("__sum").alias(_CARRY)))
    return per_block.select(_BLK).join(before, _BLK, "left").select(
        _BLK, F.coalesce(_CARRY, F.lit(0)).cast("long").alias(_CARRY))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str,
                value: Column | None = None, block_col: str | None = None,
                block_size: int = DEFAULT_BLOCK_SIZE, keep_block: str | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over rows of the same key up to and
    including this one in ``order``.  ``value`` defaults to 1 (running count).

    ``block_col`` (default: the first ``order`` column) must be a non-null
    integer that is non-decreasing in ``order``.  ``keys`` may be empty (one
    global running sum, still spread over blocks).  ``keep_block`` names an
    output column for the block id: the result is hash-partitioned on
    ``keys + [keep_block]``, and a later per-row window or aggregate that
    groups by those columns plus a unique row key needs no new shuffle.
    """
    keys, order = list(keys), list(order)
    val = F.lit(1).cast("long") if value is None else value.cast("long")
    data = _with_blocks(df, keys, block_col or order[0], block_size).withColumn("__val", val)

    per_block = data.where(F.col(_HEAVY)).groupBy(*keys, _BLK).agg(F.sum("__val").alias("__s"))
    if keys:
        before = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
        carried = per_block.select(
            *keys, _BLK, F.coalesce(F.sum("__s").over(before), F.lit(0)).cast("long").alias(_CARRY))
    else:
        carried = _carried_total(per_block)
    markers = carried.withColumn(_MARK, F.lit(0))

    rows = data.withColumn(_CARRY, F.col("__val")).withColumn(_MARK, F.lit(1)).drop("__val", _HEAVY)
    both = rows.unionByName(markers, allowMissingColumns=True)
    w = (Window.partitionBy(*keys, _BLK).orderBy(_MARK, *order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    result = (both.withColumn(out, F.sum(_CARRY).over(w))
              .where(F.col(_MARK) == 1)
              .drop(_MARK, _CARRY))
    return result.withColumnRenamed(_BLK, keep_block) if keep_block else result.drop(_BLK)


def running_count(df: DataFrame, keys: Sequence[str], order: str = "seq", out: str = "cnt",
                  block_size: int = DEFAULT_BLOCK_SIZE, keep_block: str | None = None) -> DataFrame:
    """Running count per key in arrival order, the current row included."""
    return running_sum(df, keys, [order], out, block_size=block_size, keep_block=keep_block)


def neighbor(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
             out: str, direction: str, block_col: str | None = None,
             block_size: int = DEFAULT_BLOCK_SIZE) -> DataFrame:
    """Add struct column ``out`` holding ``values`` of the previous
    (``direction='prev'``) or next (``'next'``) row of the same key in
    ``order``; null when there is none.  Same block scheme as ``running_sum``.
    """
    if direction not in ("prev", "next"):
        raise ValueError("direction must be 'prev' or 'next'")
    keys, order, values = list(keys), list(order), list(values)
    data = (_with_blocks(df, keys, block_col or order[0], block_size)
            .withColumn(_CARRY, F.struct(*[F.col(v) for v in values]))
            .withColumn("__ord", F.struct(*[F.col(o) for o in order])))

    over_blocks = Window.partitionBy(*keys).orderBy(_BLK)
    if direction == "prev":
        edge = F.max_by(_CARRY, "__ord")          # last row of each block
        across = F.lag("__edge").over(over_blocks)
        data_mark, marker_mark = 1, 0             # marker sorts first
    else:
        edge = F.min_by(_CARRY, "__ord")          # first row of each block
        across = F.lead("__edge").over(over_blocks)
        data_mark, marker_mark = 0, 1             # marker sorts last
    markers = (data.where(F.col(_HEAVY)).groupBy(*keys, _BLK).agg(edge.alias("__edge"))
               .select(*keys, _BLK, across.alias(_CARRY), F.lit(marker_mark).alias(_MARK)))

    rows = data.drop("__ord", _HEAVY).withColumn(_MARK, F.lit(data_mark))
    both = rows.unionByName(markers, allowMissingColumns=True)
    w = Window.partitionBy(*keys, _BLK).orderBy(_MARK, *order)
    step = F.lag if direction == "prev" else F.lead
    return (both.withColumn(out, step(_CARRY).over(w))
            .where(F.col(_MARK) == data_mark)
            .drop(_BLK, _MARK, _CARRY))
