from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import select_percentiles


def jdbc_options(
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a relational scan, split by key range so executors read in parallel.

    The bounds only shape the ranges; rows outside them are read too.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if partition_column is None:
        return options
    if bounds is None:
        raise ValueError("a partitioned scan needs the key's lower and upper bound")
    low, high = bounds
    return options | {
        "partitionColumn": partition_column,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(partitions),
    }


def equi_depth_predicates(keys: DataFrame, column: str, parts: int) -> list[str]:
    """Conditions that cut a table into ``parts`` ranges of about as many rows each.

    ``keys`` has the table's numeric key column, or a sample of it: a column of an earlier
    load, or a query for keys only.  Bounds are its quantiles, so a range of keys that
    holds most rows is cut as finely as its rows ask for; a single key cannot be cut, and
    ranges that would be empty are left out.  Every row, NULL keys too, meets exactly one
    condition, also rows outside of what ``keys`` knew.
    """
    points = {f"b{k}": k / parts for k in range(1, parts)}
    if not points:
        return ["1 = 1"]
    numbered = keys.select(F.lit(1).alias("all"), F.col(column).alias("v"))
    found = select_percentiles(numbered, ["all"], "v", **points).first()
    bounds = sorted({found[p] for p in points}) if found else []
    if not bounds:
        return ["1 = 1"]
    edges = [f"{column} < {bounds[0]} OR {column} IS NULL"]
    edges += [f"{column} >= {a} AND {column} < {b}" for a, b in zip(bounds, bounds[1:], strict=False)]
    return [*edges, f"{column} >= {bounds[-1]}"]


def read_jdbc_ranges(
    spark: SparkSession,
    url: str,
    table: str,
    predicates: list[str],
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Scan a relational table, a task for each of the given conditions."""
    return spark.read.jdbc(url, table, predicates=predicates, properties=dict(properties or {}))


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    properties: Mapping[str, str] | None = None,
    **split,
) -> DataFrame:
    """Scan a relational table.  Credentials come in ``properties``, from the caller."""
    return (
        spark.read.format("jdbc")
        .options(**jdbc_options(url, table, **split), **(properties or {}))
        .load()
    )
