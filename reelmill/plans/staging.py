"""Bronze to staging: names, trimming, required keys.  Never stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_ws


def stg_movies(bronze: DataFrame) -> DataFrame:
    return bronze.dropna(subset=["movieid"]).select(
        F.col("movieid").alias("movie_id"),
        trim_ws("title").alias("title"),
        trim_ws("genres").alias("genres"),
    )


def stg_ratings(bronze: DataFrame) -> DataFrame:
    return bronze.dropna(subset=["userid", "movieid", "rating"]).select(
        F.col("userid").alias("user_id"),
        F.col("movieid").alias("movie_id"),
        "rating",
        F.col("timestamp").alias("rating_timestamp"),
    )


def stg_tags(bronze: DataFrame) -> DataFrame:
    return bronze.dropna(subset=["userid", "movieid", "tag"]).select(
        F.col("userid").alias("user_id"),
        F.col("movieid").alias("movie_id"),
        trim_ws("tag").alias("tag"),
        F.col("timestamp").alias("tag_timestamp"),
    )


def stg_links(bronze: DataFrame) -> DataFrame:
    return bronze.dropna(subset=["movieid"]).withColumnsRenamed(
        {"movieid": "movie_id", "imdbid": "imdb_id", "tmdbid": "tmdb_id"}
    )
