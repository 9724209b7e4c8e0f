"""Staging to silver: typed, enriched, row by row.  No shuffle in any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import GENRE_FLAGS, rating_category, sentiment, tag_category
from ..functions.numeric import decade
from ..functions.temporal import date_part, from_unix, iso_dow
from ..functions.text import (
    cardinality,
    contains_sub,
    pad_left,
    regexp_group,
    split_literal,
    trim_ws,
)

# Where the year stands in a title, and the two link prefixes.
YEAR_AT_END = r"\((\d{4})\)$"
YEAR_SUFFIX = r"\s*\(\d{4}\)$"
IMDB_URL = "https://www.imdb.com/title/tt"
TMDB_URL = "https://www.themoviedb.org/movie/"

LOWEST_RATING, HIGHEST_RATING = 0.5, 5.0


def silver_movies(stg: DataFrame) -> DataFrame:
    with_year = stg.withColumn(
        "release_year", regexp_group("title", YEAR_AT_END).try_cast("int")
    )
    flags = [contains_sub("genres", g).alias(flag) for g, flag in GENRE_FLAGS.items()]
    return with_year.select(
        "movie_id",
        "title",
        "release_year",
        trim_ws(F.regexp_replace("title", YEAR_SUFFIX, "")).alias("title_clean"),
        "genres",
        cardinality(split_literal("genres", "|")).alias("genres_count"),
        *flags,
        decade("release_year").alias("decade"),
    )


def silver_ratings(stg: DataFrame) -> DataFrame:
    at = F.col("rating_datetime")
    return (
        stg.withColumn("rating", F.col("rating").cast("double"))
        .where(F.col("rating").between(LOWEST_RATING, HIGHEST_RATING))
        .withColumn("rating_datetime", from_unix(F.col("rating_timestamp").cast("bigint")))
        .select(
            "user_id",
            "movie_id",
            "rating",
            "rating_timestamp",
            "rating_datetime",
            *[F.date_trunc(u, at).alias(f"rating_{n}")
              for u, n in (("day", "date"), ("month", "month"), ("year", "year"))],
            date_part("year", at).alias("year"),
            date_part("month", at).alias("month"),
            iso_dow(at).alias("day_of_week"),
            date_part("hour", at).alias("hour_of_day"),
            rating_category("rating").alias("rating_category"),
        )
    )


def silver_tags(stg: DataFrame) -> DataFrame:
    at = F.col("tag_datetime")
    return (
        stg.withColumn("tag_normalized", F.lower(trim_ws("tag")))
        .where(F.col("tag_normalized") != "")
        .withColumn("tag_datetime", from_unix(F.col("tag_timestamp").try_cast("bigint")))
        .select(
            "user_id",
            "movie_id",
            "tag_normalized",
            F.col("tag").alias("tag_original"),
            "tag_timestamp",
            "tag_datetime",
            F.date_trunc("month", at).alias("tag_month"),
            date_part("year", at).alias("year"),
            sentiment("tag_normalized").alias("sentiment"),
            tag_category("tag_normalized").alias("tag_category"),
            F.length("tag").cast("bigint").alias("tag_length"),
        )
    )


def silver_links(stg: DataFrame) -> DataFrame:
    """A missing id gives a missing URL: ``concat`` hands NULL on."""
    return stg.select(
        "movie_id",
        "imdb_id",
        "tmdb_id",
        F.concat(F.lit(IMDB_URL), pad_left("imdb_id", 7)).alias("imdb_url"),
        F.concat(F.lit(TMDB_URL), F.col("tmdb_id").cast("string")).alias("tmdb_url"),
    )
