"""Spark session helpers.

The library never creates a session behind the caller's back: every operator
takes DataFrames and returns DataFrames.  ``get_session`` is for scripts,
benchmarks and tests; on a cluster the job's own session is used as is.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that every job of this library relies on.  AQE gives runtime
# coalescing of small shuffle partitions, broadcast conversion of sort-merge
# joins whose measured side is small, and splitting of skewed join partitions.
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even when that costs a shuffle after it
    # (the history count is partially aggregated before that shuffle)
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # transformWithState (streaming running count) needs RocksDB state.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ruleweave", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("RULEWEAVE_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Runtime SQL settings the skew handling relies on; applied to any session
# the library's jobs run in (they can be changed on a live session).
RUNTIME_CONF = {k: v for k, v in _DEFAULT_CONF.items()
                if k.startswith("spark.sql.adaptive.")}


def configure_runtime(spark: SparkSession) -> None:
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the deployment (a shared file system); it
    is read from the session and never replaced.  A local session without it,
    as in tests, gets a scratch folder; a cluster without it is an error, since
    a machine's own folder isn't seen by the others.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's spark.checkpoint.dir applies
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        configured = sc._ruleweave_scratch = tempfile.mkdtemp(prefix="ruleweave-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return configured


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that they
    can import it wherever the driver started."""
    sc = spark.sparkContext
    if getattr(sc, "_ruleweave_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="ruleweave-code-"), "ruleweave_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(path)
    sc._ruleweave_shipped = True


_scratch: list[str] | None = None   # folders of the scratch block that is open


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it
    back: cuts the lineage like ``checkpoint()``, but compressed, with column
    pruning and with a size that Spark's planner knows."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scratch is not None:
        _scratch.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """What is ``staged`` inside the block is deleted at its end (a streaming job
    would otherwise leave folders with each micro-batch)."""
    global _scratch
    before, _scratch = _scratch, []
    try:
        yield
    finally:
        paths, _scratch = _scratch, before
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
