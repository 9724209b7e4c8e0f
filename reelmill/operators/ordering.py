from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_desc(df: DataFrame, column: str, *ties: str) -> DataFrame:
    return df.orderBy(F.col(column).desc(), *ties)


def top_k(df: DataFrame, column: str, k: int, *ties: str) -> DataFrame:
    """Sort descending and keep k: every task keeps its own k first."""
    return sort_desc(df, column, *ties).limit(k)


def limit_stable(df: DataFrame, n: int, *order: str) -> DataFrame:
    """n rows, the same ones on every run as long as ``order`` is a key."""
    return df.orderBy(*order).limit(n)


def rank_top(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """Best n rows per group with their rank.

    The filter on the row number makes Spark prune each group to n rows per task
    before the shuffle (WindowGroupLimit), so a hot group stays small.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).where(F.col(rank) <= n)


def running_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str
) -> DataFrame:
    """``row_number`` over (keys, order) without sorting a whole key in one task.

    ``bucket`` must not decrease along ``order``.  Rows are numbered inside each
    bucket and shifted by the row count of the key's earlier buckets.
    """
    parts = [*keys, "_bucket"]
    bucketed = df.withColumn("_bucket", bucket)
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        bucketed.groupBy(*parts)
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    within = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
    return (
        bucketed.withColumn("_within", within)
        .join(offsets, parts)
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_bucket", "_before", "_within")
    )
