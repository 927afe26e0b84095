"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..session import ship_package, staged

__all__ = ["staged", "table", "numbered", "small", "ship_package", "map_arrow", "byte_slices", "claim", "n_words"]

# The white space of every contract, as a Java character class
# and as the characters themselves.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE_CHARS.encode()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _is_file_scan(docs: DataFrame) -> bool:
    """Whether a row of ``docs`` is a row of one file: columns of one relation."""
    try:
        node = docs._jdf.queryExecution().analyzed()
    except Exception:  # Spark Connect has no plan at hand
        return False
    while node.nodeName() in ("Project", "SubqueryAlias") and node.deterministic():
        if node.nodeName() == "Project" and "(" in node.simpleString(10_000):
            return False   # more than columns, such as a generator
        node = node.children().apply(0)
    return node.nodeName() == "LogicalRelation"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a row number that is the same in every pass over it.

    Numbers of ``monotonically_increasing_id`` follow the splits, and these follow
    the cores that are registered when a job starts; so rows of a Parquet table are
    numbered by file and place in the file, and any other rows (of a view, filter or
    union, say) are written once, whole: give such an operator a table where that
    counts."""
    free = "_" * (1 + max(map(len, docs.columns)))   # names longer than any that is there
    path_, index_, file_ = f"{free}path", f"{free}index", f"{free}file"
    try:
        if _is_file_scan(docs):
            meta = docs.metadataColumn("_metadata")
            path, row = meta.getField("file_path").alias(path_), meta.getField("row_index").alias(index_)
            files = sorted(r[0] for r in docs.select(path).distinct().collect())
            nth = docs.sparkSession.createDataFrame(list(enumerate(files)), f"{file_} long, {path_} string")
            return (docs.select("*", path, row).join(F.broadcast(nth), path_)
                    .select(*(F.col(f"`{c}`") for c in docs.columns),
                            (F.shiftleft(file_, 36) + F.col(index_)).alias(name)))
    except AnalysisException:
        pass   # files without row numbers
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "numbered-rows")


SMALL_ROWS = 1 << 20   # of a set that may be broadcast: tens of MB


def small(rows: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``rows``, a written table of a few short columns, to be broadcast if a
    count shows that there are at most ``limit`` of them; else it is joined by a
    shuffle, whatever Spark takes its size for."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows.hint("merge")


BATCH_ROWS = 2_000   # documents in an Arrow batch, at most
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, func, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers, and batches that
    suit rows of whole documents: Spark's 10,000 rows would be held several times
    over, in the executor's direct memory and in the worker."""
    spark = df.sparkSession
    ship_package(spark)
    if not 0 < int(spark.conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(func, schema)


def byte_slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with about ``limit`` bytes of ``column``
    (one row at least): bounds the memory of what is computed per slice."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


_claims: dict = {}


def claim(owner: str, release) -> None:
    """Called when a task of ``owner`` starts: what other operators remember in
    this worker process is released (``release`` does it for this one later)."""
    for other, drop in list(_claims.items()):
        if other != owner:
            drop()
            del _claims[other]
    _claims[owner] = release
    pa.default_memory_pool().release_unused()   # buffers of earlier tasks
    _trim()


def _trim() -> None:
    """Gives freed memory back to the system, which the GNU allocator otherwise keeps."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):   # another allocator or system
        pass


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")
