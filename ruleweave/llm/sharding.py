"""Minimax contiguous sharding (law ``bytes``), in DataFrame functions only.

Documents with equal texts form an atomic group.  Groups are ordered by the
SHA-256 of their text, and shards are contiguous runs of that order.  The
capacity of the largest shard is the smallest that a greedy fill can meet, and
it is found by binary search.  The driver never sees more than a bounded
number of sums at once: groups are summed by the leading bits of their key,
and only the key ranges in which a cut can fall are split further, level by
level, down to single groups if need be.  The result is the exact minimax
partition of the groups.

* The text is read once, into a slim table (id, size, crc, key).
* Sums per key range have map-side combine, also for a text that is a third of
  all rows.
* Shards are assigned by comparing a key with the cut keys: no join.
* Slots: a row number within (shard, bucket), buckets by hash of the row, plus
  the rows of the earlier buckets.  No window holds a whole shard.

Edge cases: a null text has size 1 and is a group apart from the empty text;
rows repeated as a whole are counted each; a null ``doc_id`` is sharded by its
text like any other; an empty table gives an empty result; with fewer groups
than shards, the last shards stay empty; a group larger than a fair share
decides the capacity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table

SHARDS = 8
LEVEL_DIGITS = 2     # hexadecimal digits of the key by which a range is split
SLOT_BUCKETS = 1024  # per shard; a parameter of the layout, not of the data
_KEY_DIGITS = 64

# An item is (key prefix, bytes, whether it holds several groups).
Item = tuple[str, int, bool]


def greedy_cuts(items: list[Item], capacity: int, shards: int, loose: bool = False) -> list[tuple[int, int]] | None:
    """(item, bytes before the cut) of each cut of a greedy fill; None when
    ``shards`` shards of ``capacity`` don't hold the items.  ``loose``: ranges
    of several groups may be cut anywhere, so what is not feasible loosely is
    not feasible for the groups in them either."""
    cuts, room, at = [], capacity, 0
    for i, (_, size, several) in enumerate(items):
        rest = size
        while rest > room:
            if loose and several:
                rest, at = rest - room, at + room
            elif rest > capacity:
                return None
            cuts.append((i, at))
            room = capacity
            if len(cuts) == shards:
                return None
        room -= rest
        at += rest
    return cuts


def smallest_capacity(items: list[Item], shards: int, loose: bool = False) -> int:
    """Binary search of the smallest capacity that the greedy fill meets."""
    total = sum(size for _, size, _ in items)
    lo, hi = -(-total // shards), total
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy_cuts(items, mid, shards, loose) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def _undecided(items: list[Item], low: int, high: int, shards: int) -> list[int]:
    """Ranges of several groups in which a cut can fall for a capacity from
    ``low`` to ``high``: cut j lies at most where the loose fill by ``high``
    ends, and at least where a fill by ``low`` ends that stops before each
    range it can't take whole."""
    starts = [0]
    for _, size, _ in items:
        starts.append(starts[-1] + size)
    most = [at for _, at in greedy_cuts(items, high, shards, True) or []]
    least, x, i = [], 0, 0
    for _ in most:
        while i < len(items) and starts[i + 1] <= x + low:
            i += 1
        x = max(x, starts[i])
        least.append(x)
    spans = list(zip(least, most, strict=True))
    return [k for k, (_, _, several) in enumerate(items)
            if several and any(starts[k] < hi and starts[k + 1] > lo for lo, hi in spans)]


def minimax_cuts(groups: DataFrame, shards: int = SHARDS, digits: int = LEVEL_DIGITS) -> list[str]:
    """Least key of each shard but the first, for ``groups`` (key, weight; one
    row per key).  The driver gets at most about 16**digits sums for each of a
    few dozen undecided ranges."""
    def sums(df: DataFrame, n: int) -> list[Item]:
        got = (df.groupBy(F.substring("key", 1, n).alias("p"))
               .agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).collect())
        return [(r["p"], int(r["w"]), r["n"] > 1) for r in got]

    items = sorted(sums(groups, digits))
    while True:
        low, high = smallest_capacity(items, shards, True), smallest_capacity(items, shards)
        split = set(_undecided(items, low, high, shards)) if low < high else set()
        if not split:
            return [items[i][0] for i, _ in greedy_cuts(items, high, shards) or []]
        by_length: dict[int, list[str]] = {}
        for i in split:
            by_length.setdefault(len(items[i][0]), []).append(items[i][0])
        finer = [x for n, ps in sorted(by_length.items())
                 for x in sums(groups.where(F.substring("key", 1, n).isin(ps)),
                               min(n + digits, _KEY_DIGITS))]
        items = sorted([x for i, x in enumerate(items) if i not in split] + finer)


def minimax_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.col(text_col).cast("string")
    rows = staged(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("0" * _KEY_DIGITS)).alias("key")), "shard-rows")
    groups = staged(rows.groupBy("key").agg(F.sum("size").alias("weight")), "shard-groups")
    shard = F.lit(0)
    for j, first in enumerate(minimax_cuts(groups, shards), 1):
        shard = F.when(F.col("key") >= first, j).otherwise(shard)
    dealt = rows.withColumn("shard", shard.cast("int")).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SLOT_BUCKETS)).cast("int"))
    before = (dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(
                  Window.partitionBy("shard").orderBy("bucket")
                  .rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).drop("n"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "key"))
    # at most shards * SLOT_BUCKETS rows are broadcast
    return (dealt.withColumn("nth", nth).join(F.broadcast(before), ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


def op5_minimax_shards(spark, sf_dir):
    return minimax_shards(table(spark, sf_dir, "documents"))
