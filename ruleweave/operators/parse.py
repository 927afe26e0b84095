"""Event-line parsing (B1, B2, G9): ``value`` → ``uid, cid, type``.

Row-local built-in expressions only (no Python UDF, no shuffle).  Two modes
for malformed records (fewer than three fields by the reference's split
rule): ``quarantine`` returns them as a side table, ``fail`` raises in the
task like the reference job does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lines import field, invalid_reason, is_valid_line


def parse_lines(lines: DataFrame, mode: str = "quarantine", keep: tuple = ("seq",)
                ) -> tuple[DataFrame, DataFrame | None]:
    """``lines(seq, value)`` → ``(events(seq, uid, cid, type), malformed)``.

    Extra columns named in ``keep`` (e.g. ``seq``, ``ts``) are carried over.
    """
    value = F.col("value")
    keep_cols = [c for c in keep if c in lines.columns]
    parsed = [field(value, 0).alias("uid"), field(value, 1).alias("cid"),
              field(value, 2).alias("type")]
    if mode == "fail":
        checked = lines.withColumn(
            "value", F.when(is_valid_line(value), value)
            .otherwise(F.raise_error(F.concat(F.lit("malformed event record: "),
                                              F.coalesce(value, F.lit("<null>"))))))
        return checked.select(*keep_cols, *parsed), None
    if mode != "quarantine":
        raise ValueError("mode must be 'quarantine' or 'fail'")
    good = lines.where(is_valid_line(value)).select(*keep_cols, *parsed)
    bad = lines.where(~is_valid_line(value)).select(*keep_cols, value,
                                                     invalid_reason(value).alias("reason"))
    return good, bad
