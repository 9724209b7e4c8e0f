"""Reads over gold tables.  Parameters are typed columns and numbers, never SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import limit_stable, sort_desc, top_k
from ..sources.catalog import query_table

GOLD = "gold"

# The key columns of each gold table: ties and plain limits follow them.
GOLD_KEYS = {
    "gold_movie_analytics": ["movie_id"],
    "gold_user_behavior": ["user_id"],
    "gold_genre_analytics": ["genre"],
    "gold_temporal_trends": ["trend_type", "period"],
    "gold_movie_recommendations": ["source_movie_id", "recommendation_rank"],
    "gold_external_links": ["movie_id"],
}


class NotFound(LookupError):
    pass


def top_movies(analytics: DataFrame, limit: int = 20) -> DataFrame:
    return top_k(analytics, "total_ratings", limit, "movie_id")


def movie(analytics: DataFrame, movie_id: int) -> DataFrame:
    """No rows when the movie is unknown; :func:`one` turns that into an error."""
    return analytics.where(F.col("movie_id") == movie_id)


def one(df: DataFrame):
    found = df.take(1)
    if not found:
        raise NotFound("no such row")
    return found[0]


def genres(stats: DataFrame) -> DataFrame:
    return sort_desc(stats, "avg_rating", "genre")


def recommend(
    recommendations: DataFrame, source_movie_id: int | None = None, limit: int = 10
) -> DataFrame:
    """Recommendations for one movie, or any.  The table has no user column, so the
    parameter names the movie they start from."""
    if source_movie_id is not None:
        recommendations = recommendations.where(F.col("source_movie_id") == source_movie_id)
    return limit_stable(recommendations, limit, *GOLD_KEYS["gold_movie_recommendations"])


def trends(df: DataFrame, trend_type: str | None = None, limit: int = 24) -> DataFrame:
    """Latest periods as strings sort; without ``trend_type`` the grains are mixed."""
    if trend_type is not None:
        df = df.where(F.col("trend_type") == trend_type)
    return top_k(df, "period", limit, "trend_type")


def top_users(behavior: DataFrame, limit: int = 20) -> DataFrame:
    return top_k(behavior, "total_ratings", limit, "user_id")


def adhoc(spark: SparkSession, table: str, limit: int = 10, db: str = GOLD) -> DataFrame:
    """All columns of a gold table, a few rows in key order."""
    if table not in GOLD_KEYS:
        raise NotFound(f"no gold table {table!r}")
    return query_table(spark, db, table, order=GOLD_KEYS[table], limit=limit)
