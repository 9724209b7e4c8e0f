from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_inner(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """No hint: Spark broadcasts a side it has measured as small and otherwise
    sort-merges, splitting skewed partitions at run time."""
    return left.join(right, on, "inner")


def join_left(base: DataFrame, *aggregates: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left-join relations that hold one row per key onto ``base``."""
    return reduce(lambda df, agg: df.join(agg, on, "left"), aggregates, base)


def anti(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``left`` with no equal key in ``right``; a NULL key equals nothing."""
    keys = [on] if isinstance(on, str) else list(on)
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def relationships(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-null foreign key has no parent."""
    parents = parent.select(F.col(pk).alias(fk)).distinct()
    return child.where(F.col(fk).isNotNull()).join(parents, fk, "left_anti")
