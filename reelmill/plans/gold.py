"""Silver to gold.

Ratings are the big table.  Each product first collapses them by partial
aggregation to a few rows per key and task, so a key that holds a third of all
ratings costs its reducer no more than any other; distinct counts go through the
distinct pairs, which spread over all tasks.  Users are the exception: a user's ratings
are shuffled as they are, to a few places (:func:`user_profile`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from ..functions import labels
from ..functions.labels import GENRE_FLAGS, SIMILARITY_FLAGS
from ..functions.numeric import popularity, round2, safe_ratio
from ..functions.temporal import whole_days
from ..functions.text import pad_left
from ..operators.aggregates import (
    avg2,
    count_when,
    distinct_by,
    mean_of_moments,
    merged_moments,
    moments,
    percentile_of_bins,
    percentile_of_counts,
    stddev_of_moments,
    value_counts,
    with_all_labels,
    with_cumulative,
)
from ..operators.joins import join_left
from ..operators.sets import pad_to
from ..operators.similarity import best_matches

# Which candidates may be recommended, and how alike they must be.
MIN_AVG_RATING, MIN_RATINGS, MIN_FLAG_MATCHES = 3.5, 10, 3

# Places that a user's ratings are dealt to, and the hours a rating can have.
SHARES, HOURS = 4, range(24)

BANDS = [name for _, name in labels.RATING_BANDS] + [labels.LOWEST_BAND]


def band_column(band: str) -> str:
    return f"ratings_{band.lower()}"


def band_sums(weight: str = "n") -> list:
    """Ratings per band, from rows that stand for ``weight`` ratings each."""
    band = labels.rating_category("rating")
    return [
        F.sum(F.when(band == b, F.col(weight)).otherwise(0)).alias(band_column(b))
        for b in BANDS
    ]


def rating_profile(ratings: DataFrame, key: str, ordered: list[str]) -> DataFrame:
    """Count, spread, bands, first and last rating per key, plus the median of
    ``ordered[0]``, all from the counts per (key, *ordered).

    A rating has one decimal (46 values in range) and a day 24 hours, so a key keeps
    at most 46 or 1104 of those counts, however many ratings it has.
    """
    counts = value_counts(
        ratings, [key], ordered,
        F.min("rating_datetime").alias("first_at"),
        F.max("rating_datetime").alias("last_at"),
    )
    return (
        with_cumulative(counts, [key], ordered)
        .groupBy(key)
        .agg(
            *moments("rating", "n"),
            *band_sums(),
            F.min("first_at").alias("first_at"),
            F.max("last_at").alias("last_at"),
            percentile_of_counts(ordered[0], 0.5).alias("median"),
        )
        .select(
            key,
            F.col("n").alias("total_ratings"),
            mean_of_moments().alias("avg_rating"),
            stddev_of_moments().alias("stddev_rating"),
            *map(band_column, BANDS),
            "first_at",
            "last_at",
            whole_days("first_at", "last_at").alias("days_active"),
            "median",
        )
    )


def movie_analytics(movies: DataFrame, ratings: DataFrame, tags: DataFrame) -> DataFrame:
    """One row per movie, rated or not."""
    rated = rating_profile(ratings, "movie_id", ["rating"])
    raters = distinct_by(ratings, ["movie_id"], total_users="user_id")
    tagged = tags.groupBy("movie_id").agg(
        F.count("*").alias("total_tags"),
        F.count_distinct("tag_normalized").alias("unique_tags"),
        count_when(F.col("sentiment") == "Positivo").alias("tags_positivas"),
        count_when(F.col("sentiment") == "Negativo").alias("tags_negativas"),
    )

    def or_zero(name: str):
        return F.coalesce(F.col(name), F.lit(0)).alias(name)

    return join_left(movies, rated, raters, tagged, on="movie_id").select(
        "movie_id",
        F.col("title_clean").alias("title"),
        "release_year",
        "decade",
        "genres",
        "genres_count",
        *SIMILARITY_FLAGS,
        or_zero("total_users"),
        or_zero("total_ratings"),
        "avg_rating",
        "stddev_rating",
        F.col("median").alias("rating_median"),
        *map(band_column, BANDS),
        F.col("first_at").alias("first_rating_date"),
        F.col("last_at").alias("last_rating_date"),
        "days_active",
        *map(or_zero, ["total_tags", "unique_tags", "tags_positivas", "tags_negativas"]),
        popularity("avg_rating", "total_ratings", "total_tags").alias("popularity_score"),
        labels.quality_tier("avg_rating", "total_ratings").alias("quality_tier"),
        labels.engagement_level("total_ratings").alias("engagement_level"),
    )


def user_profile(ratings: DataFrame) -> DataFrame:
    """Count, spread, bands, first and last rating, median hour and movies per user.

    Most users have a few ratings, which no partial aggregate collapses, so ratings are
    shuffled once, narrow, to ``SHARES`` places per user by their movie: a pair of user
    and movie lies in one place, so its first row there stands for the pair, and a user's
    places add up.  A missing hour counts as earlier than all others.
    """
    rows = ratings.select(
        "user_id",
        "movie_id",
        "rating",
        "hour_of_day",
        "rating_datetime",
        F.pmod(F.hash("movie_id"), F.lit(SHARES)).alias("share"),
    ).repartition("user_id", "share")
    by_movie = Window.partitionBy("user_id", "share").orderBy("movie_id")
    first_of_movie = F.col("movie_id").isNotNull() & ~F.col("movie_id").eqNullSafe(
        F.lag("movie_id").over(by_movie)
    )
    hours = [f"hour_{h}" for h in HOURS]
    places = (
        rows.withColumn("new_movie", first_of_movie)
        .withColumn("n", F.lit(1))
        .groupBy("user_id", "share")
        .agg(
            *moments("rating"),
            *band_sums(),
            F.min("rating_datetime").alias("first_at"),
            F.max("rating_datetime").alias("last_at"),
            count_when(F.col("new_movie")).alias("movies_rated"),
            *[count_when(F.col("hour_of_day") == h).alias(n) for h, n in zip(HOURS, hours, strict=True)],
        )
    )
    counts = ["movies_rated", *map(band_column, BANDS), *hours]
    users = places.groupBy("user_id").agg(
        *merged_moments(),
        *[F.sum(c).alias(c) for c in counts],
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
    )
    return users.select(
        "user_id",
        F.col("n").alias("total_ratings"),
        mean_of_moments().alias("avg_rating"),
        stddev_of_moments().alias("stddev_rating"),
        *map(band_column, BANDS),
        "first_at",
        "last_at",
        whole_days("first_at", "last_at").alias("days_active"),
        percentile_of_bins("n", dict(zip(HOURS, hours, strict=True)), 0.5).alias("median"),
        F.when(F.col("user_id").isNotNull(), F.col("movies_rated")).alias("movies_rated"),
    )


def user_behavior(ratings: DataFrame, tags: DataFrame) -> DataFrame:
    """One row per user who rated; users who only tagged have none."""
    tagged = tags.groupBy("user_id").agg(
        F.count("*").alias("total_tags"),
        F.count_distinct("movie_id").alias("movies_tagged"),
        F.count_distinct("tag_normalized").alias("unique_tags"),
    )
    tag_counts = ["total_tags", "movies_tagged", "unique_tags"]
    return join_left(user_profile(ratings), tagged, on="user_id").select(
        "user_id",
        "total_ratings",
        "movies_rated",
        "avg_rating",
        "stddev_rating",
        *map(band_column, BANDS),
        F.col("first_at").alias("first_rating"),
        F.col("last_at").alias("last_rating"),
        "days_active",
        F.col("median").alias("typical_hour"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in tag_counts],
        labels.user_segment("total_ratings").alias("user_segment"),
        labels.rating_style("avg_rating").alias("rating_style"),
        labels.rating_consistency("stddev_rating").alias("rating_consistency"),
    )


def users_per_genre(movies: DataFrame, ratings: DataFrame) -> DataFrame:
    """Distinct raters per genre.

    A user's genres are OR-ed into one bit mask, so the shuffle carries one row per
    user and task instead of the distinct (genre, user) pairs.
    """
    flags = list(GENRE_FLAGS.values())
    mask = sum(
        (F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0)
    )
    masks = movies.select("movie_id", mask.alias("mask")).where("mask <> 0")
    per_user = (
        ratings.select("user_id", "movie_id")
        .join(masks, "movie_id")
        .groupBy("user_id")
        .agg(F.bit_or("mask").alias("mask"))
    )
    genres = list(GENRE_FLAGS)
    return per_user.agg(
        *[
            count_when(F.col("mask").bitwiseAND(1 << i) != 0).alias(g)
            for i, g in enumerate(genres)
        ]
    ).unpivot([], [F.col(f"`{g}`") for g in genres], "genre", "total_users")


def genre_analytics(movies: DataFrame, ratings: DataFrame) -> DataFrame:
    """Nine rows always; a movie counts under each of its genres."""
    per_movie = ratings.groupBy("movie_id").agg(*moments("rating"))
    movie_genres = movies.select(
        "movie_id",
        F.explode(
            F.array_compact(
                F.array(*[F.when(F.col(f), F.lit(g)) for g, f in GENRE_FLAGS.items()])
            )
        ).alias("genre"),
    )
    stats = (
        movie_genres.join(per_movie, "movie_id")
        .groupBy("genre")
        .agg(*merged_moments(), F.count_distinct("movie_id").alias("total_movies"))
        .join(F.broadcast(users_per_genre(movies, ratings)), "genre")
    )
    total, movies_n, users_n = (
        F.coalesce(F.col(c), F.lit(0)) for c in ("n", "total_movies", "total_users")
    )
    return (
        with_all_labels(stats, "genre", list(GENRE_FLAGS))
        .select(
            "genre",
            total.alias("total_ratings"),
            movies_n.alias("total_movies"),
            users_n.alias("total_users"),
            mean_of_moments().alias("avg_rating"),
            stddev_of_moments().alias("stddev_rating"),
            round2(safe_ratio(total, movies_n)).alias("avg_ratings_per_movie"),
            round2(safe_ratio(total, users_n)).alias("avg_ratings_per_user"),
        )
        .orderBy(F.col("total_ratings").desc(), "genre")
    )


TRENDS = StructType(
    [
        StructField("trend_type", StringType()),
        StructField("period", StringType()),
        StructField("total_ratings", LongType()),
        StructField("active_users", LongType()),
        StructField("movies_rated", LongType()),
        StructField("avg_rating", DoubleType()),
        *[StructField(band_column(b), LongType()) for b in BANDS],
        StructField("hour_or_day", LongType()),
    ]
)


def temporal_trends(ratings: DataFrame) -> DataFrame:
    """Monthly, hourly and weekday rows from one scan.

    Each task sends on a few hundred partial rows, one per month and band, hour and
    weekday it saw, whatever the number of ratings.
    """
    cell = ["year", "month", "hour_of_day", "day_of_week"]
    year, month, hour, day, band = (F.col(c) for c in [*cell, "rating_category"])
    parts = ratings.groupingSets(
        [[year, month, band], [hour], [day]], *cell, "rating_category"
    ).agg(
        F.grouping_id().alias("grain"),
        F.count("*").alias("n"),
        F.sum("rating").alias("s"),
    )
    # grouping_id has a bit per key that a grain leaves out, in key order.
    monthly, hourly, weekday = 0b00110, 0b11011, 0b11101
    grains = parts.groupBy("grain", *cell).agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        *[F.sum(F.when(band == b, F.col("n")).otherwise(0)).alias(band_column(b)) for b in BANDS],
    )
    active = distinct_by(
        ratings, ["year", "month"], active_users="user_id", movies_rated="movie_id"
    )
    is_monthly = F.col("grain") == monthly
    rolled = (
        grains.where(~is_monthly | F.col("year").isNotNull())
        .join(active.withColumn("grain", F.lit(monthly)), ["year", "month", "grain"], "left")
        .withColumn("hour_or_day", F.coalesce("hour_of_day", "day_of_week"))
        .select(
            F.when(is_monthly, "monthly")
            .when(F.col("grain") == hourly, "hourly")
            .when(F.col("grain") == weekday, "day_of_week")
            .alias("trend_type"),
            F.when(
                is_monthly,
                F.concat(F.col("year").cast("string"), F.lit("-"), pad_left("month", 2)),
            )
            .otherwise(F.col("hour_or_day").cast("string"))
            .alias("period"),
            F.col("n").alias("total_ratings"),
            "active_users",
            "movies_rated",
            mean_of_moments().alias("avg_rating"),
            *[F.when(is_monthly, F.col(band_column(b))).alias(band_column(b)) for b in BANDS],
            "hour_or_day",
        )
    )
    return pad_to(rolled, TRENDS)


def recommendations(analytics: DataFrame, k: int = 10) -> DataFrame:
    """Top-k titles of the same decade per movie, by agreeing genre flags.

    Needs ``movie_id`` unique in ``analytics``, which the build checks.
    """
    payload = ["title", "avg_rating", "total_ratings", "popularity_score", "genres"]
    eligible = analytics.where(
        (F.col("avg_rating") >= MIN_AVG_RATING) & (F.col("total_ratings") >= MIN_RATINGS)
    )
    matched = best_matches(
        analytics.select("movie_id", "title", "genres", "decade", *SIMILARITY_FLAGS),
        eligible,
        key="movie_id",
        block="decade",
        flags=SIMILARITY_FLAGS,
        popularity="popularity_score",
        payload=payload,
        min_score=MIN_FLAG_MATCHES,
        k=k,
    )
    pick = F.col("match.candidate")
    return matched.select(
        F.col("movie_id").alias("source_movie_id"),
        F.col("title").alias("source_title"),
        pick["movie_id"].alias("recommended_movie_id"),
        pick["title"].alias("recommended_title"),
        pick["avg_rating"].alias("recommended_avg_rating"),
        pick["total_ratings"].alias("recommended_total_ratings"),
        pick["popularity_score"].alias("recommended_popularity"),
        F.col("genres").alias("source_genres"),
        pick["genres"].alias("recommended_genres"),
        F.lit("genre_similarity").alias("recommendation_type"),
        F.col("match.score").alias("genre_match_score"),
        F.col("rank").alias("recommendation_rank"),
    )


def external_links(links: DataFrame, movies: DataFrame, ratings: DataFrame) -> DataFrame:
    """Links of known movies, with how complete they are."""
    stats = ratings.groupBy("movie_id").agg(
        F.count("*").alias("total_ratings"), avg2("rating").alias("avg_rating")
    )
    named = movies.select(
        "movie_id", F.col("title_clean").alias("title"), "release_year", "genres"
    )
    return links.join(named, "movie_id").join(stats, "movie_id", "left").select(
        "movie_id",
        "title",
        "release_year",
        "genres",
        "imdb_id",
        "tmdb_id",
        "imdb_url",
        "tmdb_url",
        F.col("imdb_id").isNotNull().alias("has_imdb"),
        F.col("tmdb_id").isNotNull().alias("has_tmdb"),
        labels.link_status("imdb_id", "tmdb_id").alias("link_status"),
        F.coalesce(F.col("total_ratings"), F.lit(0)).alias("total_ratings"),
        "avg_rating",
    )
