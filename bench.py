"""Benchmark: seconds per query at one scale factor.

Runs every registered query on ``$BENCH_SF_DIR`` (default sf0.1) with
``local[$BENCH_CPUS]``; each query is executed in full through the ``noop``
sink (no driver collect), once as warm-up and then ``$BENCH_REPEAT`` times
(default 3); the median is reported, and printed on stderr as soon as it is
known.  A run that takes longer than ``$BENCH_LIMIT`` seconds (default 120) is
cancelled, and its query reported as failed.  With ``BENCH_STREAMS=1`` (default)
the streaming jobs S1 and S3 are also timed (events/s, field ``streams``).
Prints ONE JSON line on stdout.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import threading
import time


def bench_streams(spark, sf_dir: str) -> dict:
    """Events/s of S1 (running count) and S3 (offers, demo rules loaded
    ahead), the events table cut into four files by arrival order."""
    import tempfile

    from pyspark.sql import functions as F

    from ruleweave.schemas import CDC_LINE
    from ruleweave.sources.cdc import demo_rule_lines
    from ruleweave.sources.events import events_from_table
    from ruleweave.streaming.jobs import start_counts, start_offers, start_rule_changes

    run = tempfile.mkdtemp(prefix="ruleweave-bench-", dir="/tmp")
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = src.count()
    (src.withColumn("part", (F.col("event_id") * 4 / F.lit(max(n, 1))).cast("int"))
     .write.partitionBy("part").parquet(f"{run}/in"))

    def stream():
        raw = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1)
        return events_from_table(raw.parquet(f"{run}/in/*"))

    out = {}
    t0 = time.perf_counter()
    start_counts(stream(), f"{run}/s1", f"{run}/s1-ckpt").awaitTermination()
    out["s1_events_per_sec"] = round(n / (time.perf_counter() - t0), 1)
    demo_rule_lines(spark).coalesce(1).write.json(f"{run}/cdc")
    start_rule_changes(spark.readStream.schema(CDC_LINE).json(f"{run}/cdc"), f"{run}/rules",
                       f"{run}/rules-ckpt").awaitTermination()
    t0 = time.perf_counter()
    start_offers(stream(), f"{run}/rules", f"{run}/s3", checkpoint=f"{run}/s3-ckpt").awaitTermination()
    out["s3_events_per_sec"] = round(n / (time.perf_counter() - t0), 1)
    return out


class _Limit:
    """Cancels the jobs of a block that runs longer than ``limit`` seconds."""

    def __init__(self, spark, name: str, limit: float):
        self.sc, self.name, self.limit, self.over = spark.sparkContext, name, limit, False

    def _cancel(self) -> None:
        self.over = True
        self.sc.cancelJobGroup(self.name)
        if time.perf_counter() - self.since < 2 * self.limit:   # jobs that begin meanwhile
            self.timer = threading.Timer(1, self._cancel)
            self.timer.daemon = True
            self.timer.start()

    def __enter__(self):
        self.sc.setJobGroup(self.name, self.name, interruptOnCancel=True)
        self.since = time.perf_counter()
        self.timer = threading.Timer(self.limit, self._cancel)
        self.timer.daemon = True
        self.timer.start()
        return self

    def __exit__(self, kind, error, trace):
        self.timer.cancel()
        self.sc.setLocalProperty("spark.jobGroup.id", None)
        if self.over:
            raise TimeoutError(f"{self.name} took longer than {self.limit:g} s") from error


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    limit = float(os.environ.get("BENCH_LIMIT", "120"))
    only = set(filter(None, os.environ.get("BENCH_QUERIES", "").split(",")))

    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from ruleweave.plans.queries import QUERIES
    from ruleweave.session import get_session

    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus),
                        app_name="ruleweave-bench")
    times = {}
    for name, build in QUERIES.items():
        if only and name not in only:
            continue
        runs = []
        try:
            for i in range(repeat + 1):
                t0 = time.perf_counter()
                with _Limit(spark, name, limit):
                    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
                if i:  # first run is the warm-up
                    runs.append(time.perf_counter() - t0)
            times[name] = round(statistics.median(runs), 3)
            print(f"{name} {times[name]}", file=sys.stderr, flush=True)
        except Exception as exc:  # report the others; a failed query shows as null
            print(f"{name} failed: {type(exc).__name__}: {str(exc)[:300]}", file=sys.stderr, flush=True)
            times[name] = None
    streams = {}
    if os.environ.get("BENCH_STREAMS", "1") == "1":
        try:
            streams = bench_streams(spark, sf_dir)
        except Exception as exc:  # the query metric must still be reported
            streams = {"error": type(exc).__name__}
    failed = sorted(n for n, t in times.items() if t is None) + ["streams"] * ("error" in streams)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        # no total when a query or a stream failed: leaving it out would look like a gain
        "value": None if failed else round(sum(times.values()), 3),
        "failed": failed,
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
        "repeat": repeat,
        "streams": streams,
    }))
    spark.stop()
    if failed:
        sys.exit(1)


if __name__ == "__main__":
    main()
