"""The whole build: bronze files to stored silver and gold tables, checked."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import Watch, enforce, not_null, unique
from ..schemas import BRONZE
from ..sources.catalog import (
    Version,
    drop_old_versions,
    ensure_database,
    publish,
    register_external,
    schema_for,
    write_version,
)
from . import gold, silver, staging
from .serving import GOLD_KEYS

BRONZE_ORDER = ("movies", "ratings", "tags", "links")

# Columns that must be present, and unique where said so, per model.
REQUIRED: dict[str, tuple[list[str], list[str]]] = {
    "stg_movies": (["movie_id"], ["movie_id"]),
    "stg_ratings": (["user_id", "movie_id", "rating"], []),
    "stg_tags": (["user_id", "movie_id", "tag"], []),
    "stg_links": (["movie_id"], ["movie_id"]),
    "silver_movies": (["movie_id"], ["movie_id"]),
    "silver_ratings": (["user_id", "movie_id", "rating"], []),
    "silver_tags": (["user_id", "movie_id", "tag_normalized"], []),
    "silver_links": (["movie_id"], ["movie_id"]),
    "gold_movie_analytics": (["movie_id"], ["movie_id"]),
    "gold_user_behavior": (["user_id"], ["user_id"]),
    "gold_genre_analytics": (["genre"], ["genre"]),
    "gold_temporal_trends": (["trend_type", "period"], []),
    "gold_movie_recommendations": (["source_movie_id", "recommended_movie_id"], []),
    "gold_external_links": (["movie_id"], ["movie_id"]),
}


def key_checks(model: str, df: DataFrame) -> dict[str, DataFrame]:
    """Of a model's checks those that need its rows side by side."""
    return {f"{model}.{c}.unique": unique(df, c) for c in REQUIRED[model][1]}


def model_checks(model: str, df: DataFrame) -> dict[str, DataFrame]:
    """All checks of a model as queries of their own, for tables already written."""
    return {f"{model}.not_null": not_null(df, REQUIRED[model][0])} | key_checks(model, df)


def stamped(df: DataFrame, run_ts: datetime | None) -> DataFrame:
    """Add ``processed_at``: the run's time, the same for every row."""
    at: Column = F.current_timestamp() if run_ts is None else F.lit(run_ts)
    return df.withColumn("processed_at", at.cast("timestamp"))


def run_build(
    spark: SparkSession,
    bronze_root: str | None,
    warehouse: str,
    *,
    bronze_db: str = "bronze",
    layers: Mapping[str, str | None] | None = None,
    default_db: str = "default",
    run_ts: datetime | None = None,
) -> dict[str, DataFrame]:
    """Build every table and return them by model name.

    Bronze is read from files under ``bronze_root``, or from the tables of ``bronze_db``
    if that is None.  NULLs and rows, of staging too, are counted by the very jobs that
    write the tables; only uniqueness is looked up in what was written.  A table is
    checked before it is published, all of silver before any of it; a violation stops
    the run and leaves the earlier tables in place.  The version before the published
    one is kept for queries that still read it.
    """
    layers = {"silver": "silver", "gold": "gold"} | dict(layers or {})
    db = {layer: schema_for(name, default_db) for layer, name in layers.items()}
    for name in (bronze_db, *db.values()):
        if name != default_db:
            ensure_database(spark, name, f"{warehouse}/{name}")
    built: dict[str, DataFrame] = {}

    def write(layer: str, model: str, df: DataFrame, check) -> Version:
        keys = GOLD_KEYS.get(model)
        # Files with ranges of keys of their own: a lookup opens those it needs.
        ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
        required = REQUIRED[model][0]
        return write_version(
            stamped(ordered, run_ts), db[layer], model, root=warehouse, required=required, check=check
        )

    def shown(layer: str, version: Version) -> DataFrame:
        built[version.name] = publish(version)
        drop_old_versions(spark, db[layer], version.name, keep=1)
        return built[version.name].drop("processed_at")

    def silver_version(name: str) -> Version:
        if bronze_root is None:
            raw = spark.table(f"`{bronze_db}`.`{name}`").select(*BRONZE[name].names)
        else:
            raw = register_external(spark, bronze_db, name, f"{bronze_root}/{name}", BRONZE[name])
        staged, stored = f"stg_{name}", f"silver_{name}"
        watch = Watch(staged, REQUIRED[staged][0])
        # Silver keeps the rows of staging that have a key, so one look-up does for both.
        model = getattr(silver, stored)(watch.on(getattr(staging, staged)(raw)))

        def check(written: DataFrame) -> None:
            named = {n: v for m in (staged, stored) for n, v in key_checks(m, written).items()}
            enforce(named, watch)

        return write("silver", stored, model, check)

    versions: list[Version] = []
    try:
        for name in BRONZE_ORDER:
            versions.append(silver_version(name))
    except Exception:
        for version in versions:
            version.discard()
        raise
    movies, ratings, tags, links = (shown("silver", v) for v in versions)

    def gold_table(model: str, df: DataFrame) -> DataFrame:
        return shown("gold", write("gold", model, df, lambda w: enforce(key_checks(model, w))))

    analytics = gold_table("gold_movie_analytics", gold.movie_analytics(movies, ratings, tags))
    gold_table("gold_user_behavior", gold.user_behavior(ratings, tags))
    gold_table("gold_genre_analytics", gold.genre_analytics(movies, ratings))
    gold_table("gold_temporal_trends", gold.temporal_trends(ratings))
    gold_table("gold_external_links", gold.external_links(links, movies, ratings))
    gold_table("gold_movie_recommendations", gold.recommendations(analytics))
    return built
