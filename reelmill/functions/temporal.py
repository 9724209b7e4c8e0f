from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnLike, as_col


def from_unix(seconds: ColumnLike) -> Column:
    """Epoch seconds to a timestamp (``from_unixtime`` would give a string)."""
    return F.timestamp_seconds(as_col(seconds))


def date_part(unit: str, ts: ColumnLike) -> Column:
    return F.date_part(F.lit(unit), as_col(ts)).cast("bigint")


def iso_dow(ts: ColumnLike) -> Column:
    """Monday 1 to Sunday 7."""
    return (F.weekday(as_col(ts)) + 1).cast("bigint")


def whole_days(start: ColumnLike, end: ColumnLike) -> Column:
    """Complete 24-hour periods between two instants (not midnights crossed)."""
    return F.timestamp_diff("DAY", as_col(start), as_col(end))
