"""Column expressions for ``uid,cid,type`` text records (B1, B2).

The reference splits on ``,`` with Java's ``String.split``, which drops
trailing empty tokens, and reads tokens 0..2; a record with fewer than three
tokens fails.  A record therefore is valid iff it has two commas and some
non-comma character after the second one.  Spark's ``split`` keeps trailing
empty tokens, so the token count alone cannot decide validity.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: validity pattern equivalent to "Java split(',') yields >= 3 tokens".
VALID_LINE_PATTERN = r"(?s)^[^,]*,[^,]*,.*[^,]"


def is_valid_line(value: Column) -> Column:
    return F.coalesce(value.rlike(VALID_LINE_PATTERN), F.lit(False))


def field(value: Column, i: int) -> Column:
    """0-based token ``i`` of the record (null when missing, never an error)."""
    return F.get(F.split(value, ","), i)


def invalid_reason(value: Column) -> Column:
    parts = F.size(F.split(value, ","))
    return (F.when(value.isNull(), F.lit("null_record"))
            .when(parts < 3, F.lit("too_few_fields"))
            .otherwise(F.lit("empty_trailing_fields")))
