"""Metric series: label matching, instant vectors, aggregation over labels, rates.

Samples are rows (metric, labels, ts, value); a series is a metric with its label
set, where an empty label is the same as an absent one.  Evaluation times lie on
the multiples of ``step`` since the epoch, and a look-back of L seconds at time t
covers the samples in (t - L, t].

Nothing here sorts or gathers the samples of a whole series: they are first collapsed
to one row per series and time bucket.  What is then ordered per series has at most
one row per evaluation time, however many samples the series has.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import float_divide
from ..functions.text import ColumnLike, as_col

MICROS = 1_000_000


def label(name: str) -> Column:
    """A label's value; absent reads as empty."""
    return F.coalesce(F.col("labels")[name], F.lit(""))


def canonical(labels: ColumnLike = "labels") -> Column:
    """The label set as a sorted array, usable as a grouping and join key."""
    given = as_col(labels)
    filled = F.map_filter(given, lambda _, v: v != "")
    # The filter is interpreted per entry, so only maps that need it go through it.
    has_empty = F.array_contains(F.map_values(given), "")
    return F.sort_array(F.map_entries(F.when(has_empty, filled).otherwise(given)))


def match_labels(
    samples: DataFrame,
    metric: str | None = None,
    *,
    eq: Mapping[str, str] | None = None,
    ne: Mapping[str, str] | None = None,
    regex: Mapping[str, str] | None = None,
) -> DataFrame:
    """Series whose labels equal, differ from, or wholly match the given values."""
    tests = [] if metric is None else [F.col("metric") == metric]
    tests += [label(k) == v for k, v in (eq or {}).items()]
    tests += [label(k) != v for k, v in (ne or {}).items()]
    tests += [label(k).rlike(f"^(?:{p})$") for k, p in (regex or {}).items()]
    for test in tests:
        samples = samples.where(test)
    return samples


def selection_regex(values: Iterable[str] | None, all_values: str = ".*") -> str:
    """The pattern of a multi-select variable: any chosen value, or all of them."""
    return all_values if values is None else "|".join(re.escape(v) for v in values)


def time_range(df: DataFrame, start: ColumnLike, end: ColumnLike, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts).between(as_col(start), as_col(end)))


def label_values(samples: DataFrame, name: str, metric: str | None = None) -> DataFrame:
    """Distinct non-empty values of a label, sorted."""
    return (
        match_labels(samples, metric, ne={name: ""})
        .select(label(name).alias(name))
        .distinct()
        .orderBy(name)
    )


def legend(df: DataFrame, template: str, name: str = "legend") -> DataFrame:
    """Fill ``{{column}}`` places of a template from each row."""
    pieces = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    parts = [
        F.col(piece).cast("string") if i % 2 else F.lit(piece)
        for i, piece in enumerate(pieces)
        if piece
    ]
    return df.withColumn(name, F.concat(*parts) if parts else F.lit(""))


# Grouping keys of a series.  The hash adds nothing to them but sorts fast.
SERIES = ["series_hash", "metric", "series"]


def _keyed(samples: DataFrame) -> DataFrame:
    return samples.select(
        "metric", canonical().alias("series"), F.unix_micros("ts").alias("us"), "value"
    ).withColumn("series_hash", F.xxhash64("metric", "series"))


def _floor_to(us: Column, width: int) -> Column:
    return us - F.pmod(us, F.lit(width))


def _ceil_to(us: Column, width: int) -> Column:
    return us + F.pmod(-us, F.lit(width))


def _carried(states: DataFrame, keys: Sequence[str], width: int, reach: Column) -> DataFrame:
    """Repeat each state at the following multiples of ``width`` (column ``at``), as
    far as it reaches or until the series has its next state (column ``own``)."""
    following = F.lead("own").over(Window.partitionBy(*keys).orderBy("own")) - width
    return states.withColumn("until", F.least(following, reach)).withColumn(
        "at", F.explode(F.sequence("own", "until", F.lit(width)))
    )


def instant_vector(samples: DataFrame, step: int, lookback: int) -> DataFrame:
    """Per series and evaluation time the latest sample in the look-back.

    A series has one sample per instant; output is (metric, labels, t, value).
    """
    return instant_states(_keyed(samples), SERIES, step, lookback).select(
        "metric", F.map_from_entries("series").alias("labels"), "t", "value"
    )


def instant_states(points: DataFrame, keys: Sequence[str], step: int, lookback: int) -> DataFrame:
    """The instant vector of points (``keys`` of a series, us, value): keys, t, value."""
    step_us, back_us = step * MICROS, lookback * MICROS
    us = F.col("us")
    # The latest sample between two evaluation times, by partial aggregation; of the
    # times from there on it is seen at those before the next such sample.
    newest = points.groupBy(_ceil_to(us, step_us).alias("own"), *keys).agg(
        F.max_by("value", "us").alias("value"), F.max("us").alias("us")
    )
    last_seen = _floor_to(us + back_us - 1, step_us)
    return _carried(newest.where(last_seen >= F.col("own")), keys, step_us, last_seen).select(
        *keys, F.timestamp_micros("at").alias("t"), "value"
    )


def greatest(value: ColumnLike) -> Column:
    """The greatest number; NaN only where there is nothing else, though it sorts last."""
    value = as_col(value)
    return F.coalesce(F.max(F.when(~F.isnan(value), value)), F.max(value))


def _by_labels(by: Sequence[str]) -> list[Column]:
    return [label(k).alias(k) for k in by]


def vec_sum(vector: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return vector.groupBy("t", *_by_labels(by)).agg(F.sum("value").alias("value"))


def vec_max(vector: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return vector.groupBy("t", *_by_labels(by)).agg(greatest("value").alias("value"))


def vector_ratio(num: DataFrame, den: DataFrame, on: Sequence[str]) -> DataFrame:
    """One-to-one match of two vectors on their key columns, then num / den.

    Both sides must be unique per key.  They are stacked and matched by one
    grouping, which needs one shuffle for the two of them and no sort.
    """
    both = num.select(*on, F.col("value").alias("num"), F.lit(None).cast("double").alias("den"))
    both = both.unionByName(
        den.select(*on, F.lit(None).cast("double").alias("num"), F.col("value").alias("den"))
    )
    return (
        both.groupBy(*on)
        .agg(F.max("num").alias("num"), F.max("den").alias("den"))
        .where(F.col("num").isNotNull() & F.col("den").isNotNull())
        .select(*on, float_divide("num", "den").alias("value"))
    )


def ratio_by(num: DataFrame, den: DataFrame, by: Sequence[str]) -> DataFrame:
    """sum by (labels) of one vector over that of another."""
    return vector_ratio(vec_sum(num, by), vec_sum(den, by), ["t", *by])


def ratio_series(num: DataFrame, den: DataFrame) -> DataFrame:
    """Ratio of two vectors series by series, matched on the whole label set."""
    keyed = [v.select("t", canonical().alias("series"), "value") for v in (num, den)]
    return vector_ratio(*keyed, ["t", "series"]).select(
        "t", F.map_from_entries("series").alias("labels"), "value"
    )


def reduce_series(vector: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Last and greatest value over time, per label combination.

    NULL is no value, and NaN counts only where a series has nothing else.
    """
    present = vector.where(F.col("value").isNotNull())
    number = F.when(~F.isnan("value"), F.col("value"))
    last = F.max_by(number, F.when(number.isNotNull(), F.col("t")))
    return present.groupBy(*by).agg(
        F.coalesce(last, F.max_by("value", "t")).alias("last_value"),
        greatest("value").alias("max_value"),
    )


# --- rate ---------------------------------------------------------------------

# What a stretch of a counter is reduced to; sorts by time.
STATE = ["first_us", "last_us", "first_v", "last_v", "n", "resets"]


def point_state(us: Column, value: Column) -> Column:
    """A single sample as a state."""
    zero, one = F.lit(0.0), F.lit(1).cast("bigint")
    parts = [us, us, value, value, one, zero]
    return F.struct(*[p.alias(name) for p, name in zip(parts, STATE, strict=True)])


def bucket_width(range_s: int, step: int, resolution: int) -> int:
    """The widest bucket up to ``resolution`` that ranges and steps consist of."""
    return math.gcd(math.gcd(range_s, step), resolution)


def fold_states(states: Column) -> Column:
    """Merge a time-ordered array of bucket states into one.

    A counter that starts a bucket below where the previous one ended was reset in
    between; what it had reached then counts towards the increase.
    """

    def merge(acc: Column, s: Column) -> Column:
        reset = F.when(s["first_v"] < acc["last_v"], acc["last_v"]).otherwise(0.0)
        return F.struct(
            acc["first_us"].alias("first_us"),
            s["last_us"].alias("last_us"),
            acc["first_v"].alias("first_v"),
            s["last_v"].alias("last_v"),
            (acc["n"] + s["n"]).alias("n"),
            (acc["resets"] + s["resets"] + reset).alias("resets"),
        )

    rest = F.slice(states, 2, F.greatest(F.size(states) - 1, F.lit(0)))
    return F.aggregate(rest, states[0], merge)


def rate_of(state: Column, start_us: Column, end_us: Column, extrapolate: bool) -> Column:
    """Per-second increase over (start, end] from a merged state of >= 2 samples.

    Extrapolated, the increase is stretched towards both ends of the range: by the
    gap to the end if that is under 1.1 mean sample distances, else by half of one,
    and at the start never past the point where the counter would have been zero.
    """
    increase = state["last_v"] - state["first_v"] + state["resets"]
    seconds = (end_us - start_us) / MICROS
    if not extrapolate:
        return increase / seconds
    sampled = (state["last_us"] - state["first_us"]) / MICROS
    mean_gap = sampled / (state["n"] - 1)

    def stretch(gap: Column) -> Column:
        return F.when(gap >= mean_gap * 1.1, mean_gap / 2).otherwise(gap)

    before = stretch((state["first_us"] - start_us) / MICROS)
    from_zero = F.when(
        (increase > 0) & (state["first_v"] >= 0), sampled * (state["first_v"] / increase)
    )
    before = F.least(before, from_zero)
    after = stretch((end_us - state["last_us"]) / MICROS)
    return increase * ((sampled + before + after) / sampled) / seconds


def rate(
    samples: DataFrame,
    range_s: int,
    step: int,
    *,
    extrapolate: bool = True,
    resolution: int = 60,
) -> DataFrame:
    """Reset-aware counter rate per series over (t - range, t] at every step.

    Samples are ordered only inside buckets of at most ``resolution`` seconds.  The
    bucket states are folded into strides, the longest stretches that all ranges
    consist of, and a range is a sliding window over the strides of its series.
    """
    return rate_states(
        _keyed(samples), SERIES, range_s, step, extrapolate=extrapolate, resolution=resolution
    ).select("metric", F.map_from_entries("series").alias("labels"), "t", "value")


def rate_states(
    points: DataFrame,
    keys: Sequence[str],
    range_s: int,
    step: int,
    *,
    extrapolate: bool = True,
    resolution: int = 60,
) -> DataFrame:
    """The rate of points (``keys`` of a series, us, value): keys, t, value."""
    stride = math.gcd(range_s, step) * MICROS
    width = bucket_width(range_s, step, resolution) * MICROS
    step_us, range_us = step * MICROS, range_s * MICROS
    us = F.col("us")

    per_bucket = Window.partitionBy("bucket", *keys).orderBy("us")
    before = F.lag("value").over(per_bucket)
    # A bucket is named by its upper end: it holds the samples in (bucket - width, bucket].
    states = (
        points.withColumn("bucket", _ceil_to(us, width))
        .withColumn("dropped", F.when(F.col("value") < before, before).otherwise(0.0))
        .groupBy("bucket", *keys)
        .agg(
            F.min("us").alias("first_us"),
            F.max("us").alias("last_us"),
            F.min_by("value", "us").alias("first_v"),
            F.max_by("value", "us").alias("last_v"),
            F.count("*").alias("n"),
            F.sum("dropped").alias("resets"),
        )
        .withColumnRenamed("bucket", "own")
    )
    if width < stride:
        # At most stride / width states each.
        folded = fold_states(F.sort_array(F.collect_list(F.struct(*STATE))))
        states = (
            states.groupBy(_ceil_to(F.col("own"), stride).alias("own"), *keys)
            .agg(folded.alias("state"))
            .select(*keys, "own", "state.*")
        )
    per_series = Window.partitionBy(*keys).orderBy("own")
    ended = F.lag("last_v").over(per_series)
    states = states.withColumn("drop", F.when(F.col("first_v") < ended, ended).otherwise(0.0))
    # A range also ends where nothing was sampled, up to a range after the last state.
    strides = _carried(states, keys, stride, F.col("own") - stride + range_us)
    is_own = F.col("at") == F.col("own")
    strides = strides.select(
        *keys, "at", *[F.when(is_own, F.col(c)).alias(c) for c in [*STATE, "drop"]]
    )
    ranges = Window.partitionBy(*keys).orderBy("at").rangeBetween(stride - range_us, 0)
    # The drop before the first stride of a range lies outside of it.
    dropped = F.sum(F.col("resets") + F.col("drop")).over(ranges)
    dropped_before = F.first("drop", ignorenulls=True).over(ranges)
    parts = {
        "first_us": F.min("first_us"),
        "last_us": F.max("last_us"),
        "first_v": F.first("first_v", ignorenulls=True),
        "last_v": F.last("last_v", ignorenulls=True),
        "n": F.sum("n"),
    }
    at = F.col("at")
    return (
        strides.select(
            *keys,
            "at",
            F.struct(
                *[agg.over(ranges).alias(name) for name, agg in parts.items()],
                (dropped - dropped_before).alias("resets"),
            ).alias("state"),
        )
        .where((F.pmod(at, F.lit(step_us)) == 0) & (F.col("state.n") >= 2))
        .select(
            *keys,
            F.timestamp_micros("at").alias("t"),
            rate_of(F.col("state"), at - range_us, at, extrapolate).alias("value"),
        )
    )
