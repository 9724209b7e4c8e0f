"""Exact percentiles and top lists by counting, for any number of values of a key.

The rank that a percentile or a list asks for is narrowed down range by range: a key's values
between two bounds are counted by which of ``BINS`` equal parts they lie in, and the
part that holds the rank is the next range, cut to the values that are really there.
A round costs a scan and, after partial aggregation, ``BINS`` counts per task and open
percentile; values are never sorted or gathered, so a hot key is spread over all tasks.
It ends when a range holds a single value, or so few rows that they can be listed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..session import stage
from .quality import QualityError

#: Parts of a range that are counted, and rows of a range that are listed instead.
BINS, FEW = 1024, 1000
#: Rounds after which a column is given up on; each divides the span of a range by BINS.
ROUNDS = 120


def _part(value: Column, low: Column, high: Column, whole: bool) -> Column:
    """Which part of [low, high] a value lies in: never falls as the value grows.

    The lowest value is in part 0 and the highest in the last one, whatever rounding,
    infinities and NaN (greater than all numbers) make of those between.
    """
    if whole:
        over, span = value.cast("decimal(38,0)") - low, high.cast("decimal(38,0)") - low
        share = over.cast("double") / span.cast("double")
    else:
        half = value.cast("double") / 2 - low.cast("double") / 2
        share = F.try_divide(half, high.cast("double") / 2 - low.cast("double") / 2)
    inner = F.floor(F.nanvl(F.coalesce(share, F.lit(0.5)), F.lit(0.5)) * BINS)
    inner = F.least(F.greatest(inner, F.lit(1)), F.lit(BINS - 2)).cast("int")
    return F.when(value == low, 0).when(value == high, BINS - 1).otherwise(inner)


def select_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, *, few: int = FEW, **points: float
) -> DataFrame:
    """Discrete percentiles per key, exact: the least value whose cumulative share reaches p.

    ``select_percentiles(df, ["k"], "v", p50=0.5)``: keys and a column per point.  NULL is
    no value, NaN the greatest; a key without values has no row; NULL keys are a key.
    Give it stored rows: they are scanned once a round.
    """
    ranks = {n: F.greatest(F.ceil(F.lit(float(p)) * F.col("n")), F.lit(1)) for n, p in points.items()}
    return select_ranks(df, keys, value, ranks, few=few)


def select_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, Column],
    *,
    per_key: str | None = None,
    few: int = FEW,
) -> DataFrame:
    """The values at given ranks of each key's values in ascending order, the first is 1.

    ``ranks`` are named expressions over ``n``, the number of the key's values, and
    ``given``, what the column ``per_key`` says in all rows of the key.  A rank beyond
    ``n`` has no value.
    """
    whole = isinstance(df.schema[value].dataType, IntegralType)
    key_names = [f"k{k}" for k in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(
        *[F.col(k).alias(n) for k, n in zip(keys, key_names, strict=True)],
        F.col(value).alias("v"),
        (F.col(per_key) if per_key else F.lit(None)).alias("given"),
    )
    named = [F.struct(F.lit(n).alias("point"), r.cast("long").alias("rank")) for n, r in ranks.items()]
    first = (
        rows.groupBy(*key_names)
        .agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"), F.max("given").alias("given"))
        .withColumn("x", F.explode(F.array(*named)))
        .select(*key_names, "x.point", "low", "high", "n", "x.rank")
    )
    state = stage(first, "ranges")
    one = F.expr("low <=> high") & (F.col("rank") <= F.col("n"))
    done = [state.where(one).select(*key_names, "point", F.col("low").alias("found"))]
    # Kept for keys whose ranks have no value.
    every = state.select(*key_names).distinct()
    for _ in range(ROUNDS):
        # A range with few rows is listed, any other is counted once more.
        done.append(_listed(rows, state.where((F.col("n") <= few) & ~F.expr("low <=> high")), key_names))
        wide = state.where((F.col("n") > few) & ~F.expr("low <=> high") & (F.col("rank") <= F.col("n")))
        if wide.isEmpty():
            break
        state = stage(_narrowed(rows, wide, key_names, whole), "ranges")
        done.append(state.where(one).select(*key_names, "point", F.col("low").alias("found")))
    else:
        raise QualityError(f"values of {value} lie too close together to be told apart")
    none = every.select(*key_names, F.lit("").alias("point"), F.lit(None).cast(df.schema[value].dataType).alias("found"))
    found = stage(reduce(DataFrame.unionByName, [none, *done]), "selected")
    out = found.groupBy(*key_names).agg(
        *[F.max(F.when(F.col("point") == n, F.struct("found"))).getField("found").alias(n) for n in ranks]
    )
    return out.withColumnsRenamed(dict(zip(key_names, keys, strict=True)))


def top_per_group(
    df: DataFrame, by: Sequence[str], value: str, tie: str, n: int, rank: str = "rank"
) -> DataFrame:
    """The n rows of greatest ``value`` in each group, with their rank; for any n.

    Rows of equal value go by ``tie``, smallest first, which is unique in a group; both
    are numeric and present, NaN is greatest.  The n-th value, and among the rows that
    have it the last tie that still belongs, are found by counting, so that of a hot
    group only its n rows are ever put in order.  Give it stored rows.
    """
    at = F.greatest(F.col("n") - n + 1, F.lit(1))
    limit = select_ranks(df, by, value, {"__limit": at})
    limits = [F.col(c).alias(f"__{c}") for c in by]
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    marked = df.join(limit.select(*limits, "__limit"), same).where(F.col(value) >= F.col("__limit"))
    marked = stage(marked, "candidates").drop(*[f"__{c}" for c in by])
    level = F.expr(f"`{value}` <=> __limit")
    above = marked.groupBy(*by).agg(F.count_if(~level).alias("__above"))
    # How many rows at the limit still belong depends on the group.
    at_limit = marked.where(level).join(
        above.select(*limits, "__above"), same
    ).withColumn("__left", n - F.col("__above")).drop(*[f"__{c}" for c in by])
    at_limit = stage(at_limit.select(*by, tie, "__left"), "ties")
    at = F.least("given", "n")
    last = select_ranks(at_limit, by, tie, {"__last": at}, per_key="__left")
    kept = (
        marked.join(last.select(*limits, "__last"), same)
        .where(~level | (F.col(tie) <= F.col("__last")))
        .select(*df.columns)
    )
    # Now at most n rows a group.
    order = Window.partitionBy(*by).orderBy(F.col(value).desc(), tie)
    return kept.withColumn(rank, F.row_number().over(order).cast("bigint"))


def _within(rows: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows inside the ranges of their key, once for each; keys compare like in a grouping."""
    given = ranges.select(*[F.col(k).alias(f"r_{k}") for k in keys], "point", "low", "high", "rank")
    same = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    inside = F.col("v").between(F.col("low"), F.col("high"))
    return rows.join(given, reduce(and_, [*same, inside]))


def _listed(rows: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The value at the rank among the rows of short ranges."""
    short = _within(rows, ranges, keys).groupBy(*keys, "point", "rank", "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys, "point").orderBy("v")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        short.withColumn("upto", upto)
        .where(F.col("upto") >= F.col("rank"))
        .groupBy(*keys, "point")
        .agg(F.min("v").alias("found"))
    )


def _narrowed(rows: DataFrame, ranges: DataFrame, keys: Sequence[str], whole: bool) -> DataFrame:
    """Of each range the part that holds its rank, as the next range."""
    counts = (
        _within(rows, ranges, keys)
        .withColumn("part", _part(F.col("v"), F.col("low"), F.col("high"), whole))
        .groupBy(*keys, "point", "rank", "part")
        .agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    )
    # At most BINS rows per range.
    order = Window.partitionBy(*keys, "point").orderBy("part")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        counts.withColumn("before", upto - F.col("n"))
        .where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("n")))
        .select(*keys, "point", "low", "high", "n", (F.col("rank") - F.col("before")).alias("rank"))
    )
