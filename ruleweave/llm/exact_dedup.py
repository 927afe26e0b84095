"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive blocks of bytes of their normalised text
(white space deleted): a first block, then blocks that grow geometrically.
After each block a group is either a singleton (its document is unique), or
ended (no bytes are left: all its documents are equal), or goes on to the next
block.  Equality is decided on the bytes alone; no digest takes part (the
sha256 column is only reported).

* Before any shuffle, the equal texts of one Arrow batch are collapsed by the
  same recursion, so a text that is a third of all rows leaves each batch as
  one record.
* A block is counted with map-side combine (``groupBy(group, block)``), and
  records follow their group by a join, which AQE splits when it is skewed;
  no task needs a whole group.
* Only records of groups with two or more members go on, so the text moved
  shrinks with each block; survivors are written to the shared folder.

Edge cases: a null text counts as empty, and all empty texts form one group; a
null ``doc_id`` loses ties; rows repeated as a whole are separate documents, of
which exactly one stays; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, byte_slices, claim, map_arrow, staged

FIRST_BLOCK = 64     # bytes of the first block
GROWTH = 16          # each next block ends at this multiple of the last end
LAST_END = 1 << 18   # from here on, the rest of the text is one block

_SCHEMA = ("rid long, doc_id long, n_chars long, rep long, text_sha256 string, "
           "norm binary, n long, best struct<short:long, no_id:boolean, id:long, rid:long>")


def _radix(texts: list[bytes], rows: list[int], start: int, width: int) -> Iterator[list[int]]:
    """Groups of equal texts among ``rows``, which agree up to byte ``start``."""
    todo = [(rows, start, width)]
    while todo:
        rows, start, width = todo.pop()
        if len(rows) == 1:
            yield rows
            continue
        parts = defaultdict(list)
        for r in rows:
            parts[texts[r][start:start + width]].append(r)
        for block, members in parts.items():
            if len(block) < width:
                yield members
            else:
                todo.append((members, start + width, width * GROWTH))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("exact_dedup", lambda: None)
    for whole in batches:
        for b in byte_slices(whole, "text", 16 << 20):
            texts = [x or "" for x in b.column("text").to_pylist()]
            rid, ids = b.column("rid").to_pylist(), b.column("doc_id").to_pylist()
            norm = [x.encode().translate(None, SPACE_BYTES) for x in texts]
            n = len(texts)
            rep, head, count, best = [0] * n, [None] * n, [0] * n, [None] * n
            for group in _radix(norm, list(range(n)), 0, FIRST_BLOCK):
                key = lambda i: (-len(texts[i]), ids[i] is None, ids[i] or 0, rid[i])
                top = min(group, key=key)
                for i in group:
                    rep[i] = rid[top]
                head[top], count[top] = norm[top], len(group)
                best[top] = {"short": -len(texts[top]), "no_id": ids[top] is None,
                             "id": ids[top], "rid": rid[top]}
            yield pa.RecordBatch.from_arrays([
                pa.array(rid, pa.int64()), pa.array(ids, pa.int64()),
                pa.array(map(len, texts), pa.int64()), pa.array(rep, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in norm], pa.string()),
                pa.array(head, pa.binary()), pa.array(count, pa.int64()),
                pa.array(best, pa.struct([("short", pa.int64()), ("no_id", pa.bool_()),
                                          ("id", pa.int64()), ("rid", pa.int64())])),
            ], names=["rid", "doc_id", "n_chars", "rep", "text_sha256", "norm", "n", "best"])


def _blocks() -> list[tuple[int, int | None]]:
    out, start, end = [], 0, FIRST_BLOCK
    while start < LAST_END:
        out.append((start, end - start))
        start, end = end, end * GROWTH
    return [*out, (start, None)]


def msd_groups(records: DataFrame) -> DataFrame:
    """(rep, gid) of each record (``rep``, ``norm``) that shares its whole text
    with another record; records of unique texts are left out."""
    active = records.select("rep", "norm", F.lit(0).cast("long").alias("gid"))
    done = None
    for start, width in _blocks():
        block = (F.expr(f"substring(norm, {start + 1}, {width})") if width
                 else F.expr(f"substring(norm, {start + 1})"))
        keyed = active.withColumn("block", block)
        groups = (keyed.groupBy("gid", "block")
                  .agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("next"))
                  .where("members > 1"))
        open_ = F.lit(False) if width is None else F.octet_length("block") == width
        both = keyed.join(groups, ["gid", "block"]).select(
            "rep", F.col("next").alias("gid"), open_.alias("open"),
            F.when(open_, F.col("norm")).alias("norm"))
        both = staged(both, "msd-block")
        ended = both.where("NOT open").select("rep", "gid")
        done = ended if done is None else done.unionByName(ended)
        active = both.where("open").select("rep", "norm", "gid")
        if width is None or active.isEmpty():
            return done
    return done


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256, and rid (``row_col``, or a number of its own for each row)."""
    rows = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("rid"),
                       F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    records = staged(map_arrow(rows, _collapse, _SCHEMA), "msd-records")
    reps = records.where("norm IS NOT NULL")
    gids = msd_groups(reps.select("rep", "norm"))
    # every record of a local group takes the id of the global one, if any
    named = (reps.select("rep", "n", "best").join(gids, "rep", "left")
             .withColumn("gid", F.coalesce("gid", "rep")))
    groups = named.groupBy("gid").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    where = named.select("rep", "gid").join(groups, "gid").drop("gid")
    return (records.select("rid", "doc_id", "rep", "text_sha256").join(where, "rep")
            .select("doc_id", F.col("best.id").alias("keep_id"), "group_size",
                    (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256", "rid"))


def op9_exact_dedup(spark, sf_dir):
    from .common import table
    return exact_dedup(table(spark, sf_dir, "documents")).drop("rid")


ORACLE = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT *, row_number() OVER g AS rn, first_value(doc_id) OVER g AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
  WINDOW g AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
