from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round2, stddev_from_moments
from ..functions.text import ColumnLike, as_col


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def distinct_by(df: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    """``distinct_by(df, ["k"], users="user_id")``: exact distinct counts per key.

    One column costs a shuffle of the distinct (key, value) pairs, which spreads a
    hot key over all tasks, then a shuffle of one partial count per key and task.
    """
    return df.groupBy(*keys).agg(
        *[F.count_distinct(F.col(c)).alias(name) for name, c in columns.items()]
    )


def avg2(c: ColumnLike) -> Column:
    return round2(F.avg(as_col(c)))


def stddev2(c: ColumnLike) -> Column:
    """Sample standard deviation; a single value has none (NULL)."""
    return round2(F.stddev_samp(as_col(c)))


def count_when(condition: Column) -> Column:
    """Rows where the condition holds; 0, never NULL, when there are none."""
    return F.count_if(condition)


def moments(value: ColumnLike, weight: ColumnLike | None = None) -> list[Column]:
    """Mergeable state for count, mean and deviation: columns n, s and ss."""
    v = as_col(value)
    w = F.lit(1) if weight is None else as_col(weight)
    return [F.sum(w).alias("n"), F.sum(v * w).alias("s"), F.sum(v * v * w).alias("ss")]


def merged_moments() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("n", "s", "ss")]


def mean_of_moments() -> Column:
    return round2(F.col("s") / F.nullif(F.col("n"), F.lit(0)))


def stddev_of_moments() -> Column:
    return round2(stddev_from_moments("n", "s", "ss"))


def value_counts(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], *extra: Column
) -> DataFrame:
    """Collapse rows to one per (keys, values) with their count ``n``.

    Runs as partial aggregation before the shuffle, so a hot key reaches the
    reducers as a handful of rows per task instead of all of its rows.
    """
    return df.groupBy(*keys, *values).agg(F.count("*").alias("n"), *extra)


def with_cumulative(counts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``cum`` (running sum of n in value order) and ``total`` per key."""
    per_key = Window.partitionBy(*keys)
    running = per_key.orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return counts.withColumn("cum", F.sum("n").over(running)).withColumn(
        "total", F.sum("n").over(per_key)
    )


def percentile_of_counts(value: ColumnLike, p: float) -> Column:
    """Discrete percentile, exact: the least value whose cumulative share reaches p.

    An aggregate over rows from :func:`with_cumulative`.
    """
    reached = F.col("cum") >= F.ceil(F.lit(p) * F.col("total"))
    return F.min(F.when(reached, as_col(value)))


def percentile_of_bins(total: ColumnLike, bins: Mapping[int, str], p: float) -> Column:
    """Discrete percentile, exact, from a column of counts per value, values ascending.

    What ``total`` counts besides the bins are nulls, which come first and are no value.
    """
    rank = F.ceil(F.lit(p) * as_col(total))
    upto = as_col(total) - sum((F.col(c) for c in bins.values()), F.lit(0))
    found = []
    for value, c in bins.items():
        upto = upto + F.col(c)
        found.append(F.when((F.col(c) > 0) & (upto >= rank), F.lit(value)))
    return F.coalesce(*found).cast("bigint")


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, **points: float
) -> DataFrame:
    """Exact discrete percentiles per key, for columns with few distinct values.

    A key's distinct values are ordered in one task: the 46 a rating can have, or the
    hours of a day.  :func:`.selection.select_percentiles` is for any other column.
    """
    counts = with_cumulative(value_counts(df, keys, [value]), keys, [value])
    return counts.groupBy(*keys).agg(
        *[percentile_of_counts(value, p).alias(name) for name, p in points.items()]
    )


def literal_rows(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """A one-column relation of the given strings, local to the plan."""
    quoted = ", ".join("('" + v.replace("'", "''") + "')" for v in values)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {quoted} AS t({column})")


def with_all_labels(stats: DataFrame, label: str, labels: Sequence[str]) -> DataFrame:
    """One row per label, also where the grouping found nothing.

    ``stats`` has one row per label at most, so what is broadcast is no longer than
    ``labels``.
    """
    known = stats.where(F.col(label).isin(list(labels)))
    return literal_rows(stats, label, labels).join(F.broadcast(known), label, "left")
