"""Error strings and their human labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error code → label, tested in this order (first hit wins).
ERROR_LABELS = (
    ("403", "forbidden"),
    ("404", "not found"),
    ("429", "rate limited"),
    ("500", "server error"),
    ("503", "service unavailable"),
    ("timeout", "timed out"),
    ("fetch_failed", "connection failed"),
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def page_error(success, message, status) -> Column:
    """P6: '' on success; else message or 'unknown_error', plus ':status' when non-zero."""
    msg = F.coalesce(F.nullif(_col(message), F.lit("")), F.lit("unknown_error"))
    st = F.coalesce(_col(status), F.lit(0))
    suffix = F.when(st != 0, F.concat(F.lit(":"), st.cast("string"))).otherwise(F.lit(""))
    return F.when(_col(success), F.lit("")).otherwise(F.concat(msg, suffix))


def error_label(error) -> Column:
    """Case-insensitive substring test in fixed order; else the error itself."""
    e = _col(error)
    low = F.lower(e)
    out = e
    for code, label in reversed(ERROR_LABELS):
        out = F.when(low.contains(code), F.lit(label)).otherwise(out)
    return out
