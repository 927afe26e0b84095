"""Column expressions for rule-table change records.

A record is ``{"type": op, "data": [rule, ...]}``.  The reference keeps only
``INSERT``/``UPDATE`` records (case-sensitive; a physical ``DELETE`` is
ignored), emits each element of ``data`` in order, and swallows any exception:
elements before the first bad one are kept, the bad one and the rest of the
record are lost.  A record that is not a JSON object, or whose ``data`` is not
an array, is lost as a whole.  An element with a null status can be parsed but
not applied: it alone is quarantined, and later elements stay.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CDC_ENVELOPE

# Operation types that carry rule rows, and statuses that
# insert or replace a rule (any other non-null status removes it).
KEPT_OPS = ("INSERT", "UPDATE")
UPSERT_STATUSES = (1, 2)


def envelope(value: Column) -> Column:
    return F.from_json(value, CDC_ENVELOPE)


def as_int(text: Column) -> Column:
    return text.try_cast("int")


def element_is_bad(x: Column) -> Column:
    """An element that the reference could not turn into a rule: not an object,
    id missing or not an integer, status or counts not an integer."""
    return (x.isNull()
            | as_int(x["id"]).isNull()
            | (x["status"].isNotNull() & as_int(x["status"]).isNull())
            | (x["counts"].isNotNull() & as_int(x["counts"]).isNull()))


def element_has_no_status(x: Column) -> Column:
    return x["status"].isNull()


def first_bad_position(data: Column) -> Column:
    """1-based position of the first bad element, 0 when all are good."""
    return F.array_position(F.transform(data, element_is_bad), True)


def kept_elements(data: Column, first_bad: Column | None = None) -> Column:
    """Prefix of ``data`` before the first bad element (X11)."""
    p = first_bad_position(data) if first_bad is None else first_bad
    return F.when(p == 0, data).otherwise(F.slice(data, F.lit(1), p - 1))


def action_of(status: Column) -> Column:
    return (F.when(status.isin(*UPSERT_STATUSES), F.lit("UPSERT"))
            .when(status.isNotNull(), F.lit("REMOVE")))
