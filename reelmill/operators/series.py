"""Metric series as a dictionary and points.

The dictionary has a row per series: id, metric, labels.  Points are (id, ts, value): a
long instead of a map of labels in every sample.  Label conditions, regexes and groups
of labels are worked out once per series, on the dictionary; what then touches the
points is a join on the id and groupings by longs.  How the dictionary is joined, copied
to all tasks or shuffled, is left to Spark, which knows its written size.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import (
    canonical,
    greatest,
    instant_states,
    label,
    match_labels,
    rate_states,
    vector_ratio,
)
from .quality import QualityError


def series_id() -> Column:
    """A series' number: a hash of its metric and labels."""
    return F.xxhash64("metric", canonical())


@dataclass(frozen=True)
class _Named:
    """Rows by series id, and the dictionary they are read with."""

    dictionary: DataFrame
    rows: DataFrame

    def matching(
        self,
        metric: str | None = None,
        *,
        eq: Mapping[str, str] | None = None,
        ne: Mapping[str, str] | None = None,
        regex: Mapping[str, str] | None = None,
    ):
        """The series that meet the conditions, which are looked at once per series."""
        found = match_labels(self.dictionary, metric, eq=eq, ne=ne, regex=regex)
        return type(self)(found, self.rows.join(found.select("id"), "id", "left_semi"))

    def flat(self) -> DataFrame:
        """Rows with metric and labels instead of ids."""
        named = self.rows.join(self.dictionary, "id")
        return named.select("metric", "labels", *[c for c in self.rows.columns if c != "id"])

    def label_values(self, name: str) -> DataFrame:
        """Distinct non-empty values of a label, sorted; reads the dictionary only."""
        found = match_labels(self.dictionary, ne={name: ""}).select(label(name).alias(name))
        return found.distinct().orderBy(name)


class Vector(_Named):
    """Values (id, t, value) of series at evaluation times."""

    def _grouped(self, by: Sequence[str], value: Column) -> DataFrame:
        if not by:
            return self.rows.groupBy("t").agg(value.alias("value"))
        # A group of labels goes by the smallest id in it: one long, and exact.
        labelled = self.dictionary.select("id", *[label(k).alias(k) for k in by])
        groups = labelled.groupBy(*by).agg(F.min("id").alias("group"))
        group_of = labelled.join(groups, list(by)).select("id", "group")
        totals = self.rows.join(group_of, "id").groupBy("t", "group").agg(value.alias("value"))
        return totals.join(groups, "group").select("t", *by, "value")

    def sum(self, by: Sequence[str] = ()) -> DataFrame:
        return self._grouped(by, F.sum("value"))

    def max(self, by: Sequence[str] = ()) -> DataFrame:
        return self._grouped(by, greatest("value"))

    def ratio_series(self, other: Vector) -> DataFrame:
        """Series by series ratio to another vector's, matched on the whole label set."""
        keyed = [
            v.rows.join(v.dictionary.select("id", canonical().alias("series")), "id").select(
                "t", F.xxhash64("series").alias("h"), "series", "value"
            )
            for v in (self, other)
        ]
        return vector_ratio(*keyed, ["t", "h", "series"]).select(
            "t", F.map_from_entries("series").alias("labels"), "value"
        )


class Series(_Named):
    """Samples (id, ts, value) of series."""

    def instant(self, step: int, lookback: int) -> Vector:
        """Per series and evaluation time the latest sample in the look-back."""
        points = self.rows.select("id", F.unix_micros("ts").alias("us"), "value")
        return Vector(self.dictionary, instant_states(points, ["id"], step, lookback))

    def rate(
        self, range_s: int, step: int, *, extrapolate: bool = True, resolution: int = 60
    ) -> Vector:
        """Reset-aware counter rate over (t - range, t] at every step."""
        points = self.rows.select("id", F.unix_micros("ts").alias("us"), "value")
        rates = rate_states(points, ["id"], range_s, step, extrapolate=extrapolate, resolution=resolution)
        return Vector(self.dictionary, rates)


def split_series(
    samples: DataFrame, keep: Callable[[DataFrame, str], DataFrame], name: str = "series"
) -> Series:
    """Samples (metric, labels, ts, value) as a dictionary and points, both written by ``keep``.

    An empty label is the same as an absent one.  A dictionary in which two series have
    one number is refused.
    """
    numbered = samples.select(
        series_id().alias("id"), "metric", canonical().alias("series"), "ts", "value"
    )
    points = keep(numbered.select("id", "ts", "value"), f"{name}_points")
    # Partial aggregation leaves a row per series and task before the shuffle.
    listed = numbered.groupBy("id", "metric", "series").agg(F.count("*").alias("n_points"))
    dictionary = keep(
        listed.select("id", "metric", F.map_from_entries("series").alias("labels"), "n_points"),
        f"{name}_dictionary",
    )
    if not dictionary.groupBy("id").count().where("count > 1").isEmpty():
        raise QualityError("two series have one number")
    return Series(dictionary.drop("n_points"), points)
