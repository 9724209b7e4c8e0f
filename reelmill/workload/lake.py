"""Written layers over one folder of given tables.

Silver and gold are stored tables in this design, so a gold query scans stored
silver instead of deriving it again for each of its branches.  A layer is written
once per session to the shared folder, when a query first asks for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.series import Series, Vector, split_series
from ..plans import gold, silver, staging
from ..plans.serving import GOLD_KEYS
from ..session import configure, stage
from . import adapters

# Samples of a series are hours apart in the given events, so the queries look back
# a day every six hours where a dashboard would look back minutes.
STEP, LOOKBACK = 6 * 3600, 24 * 3600

_lakes: dict[tuple[str, str], "Lake"] = {}


class Lake:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir
        self._stored: dict[str, DataFrame] = {}
        self._series: dict[str, Series] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Lake:
        key = (f"{spark.sparkContext.applicationId}/{id(spark)}", sf_dir)
        if key not in _lakes:
            _lakes[key] = cls(spark, sf_dir)
        return _lakes[key]

    def given(self, name: str) -> DataFrame:
        return adapters.given(self.spark, self.sf_dir, name)

    def bronze(self, name: str) -> DataFrame:
        return adapters.bronze(self.spark, self.sf_dir, name)

    def staging(self, name: str) -> DataFrame:
        return getattr(staging, f"stg_{name}")(self.bronze(name))

    def silver(self, name: str) -> DataFrame:
        """The silver model, lazily, straight from the given tables."""
        return getattr(silver, f"silver_{name}")(self.staging(name))

    def gold(self, name: str) -> DataFrame:
        """The gold model, lazily, over stored silver."""
        s = self.stored
        if name == "movie_analytics":
            return gold.movie_analytics(s("movies"), s("ratings"), s("tags"))
        if name == "user_behavior":
            return gold.user_behavior(s("ratings"), s("tags"))
        if name == "genre_analytics":
            return gold.genre_analytics(s("movies"), s("ratings"))
        if name == "temporal_trends":
            return gold.temporal_trends(s("ratings"))
        if name == "movie_recommendations":
            return gold.recommendations(s("movie_analytics"))
        if name == "external_links":
            return gold.external_links(s("links"), s("movies"), s("ratings"))
        raise KeyError(name)

    def stored(self, name: str) -> DataFrame:
        if name not in self._stored:
            if name == "samples":
                df = adapters.samples(self.given("events"))
            elif name == "panel_samples":
                df = adapters.panel_samples(self.given("events"))
            elif name == "panel_vector":
                df = self.series("panel_samples").instant(STEP, LOOKBACK).rows
            elif name.startswith("bronze_"):
                df = self.bronze(name.removeprefix("bronze_"))
            elif name in ("movies", "ratings", "tags", "links"):
                df = self.silver(name)
            else:
                keys = GOLD_KEYS[f"gold_{name}"]
                df = self.gold(name).repartitionByRange(*keys).sortWithinPartitions(*keys)
            self._stored[name] = stage(df, name, codec="zstd")
        return self._stored[name]

    def series(self, name: str) -> Series:
        """Stored samples as a stored dictionary of series and points."""
        if name not in self._series:
            self._series[name] = split_series(self.stored(name), stage, name)
        return self._series[name]

    def panel_vector(self) -> Vector:
        return Vector(self.series("panel_samples").dictionary, self.stored("panel_vector"))
