"""One query per operator, over the whole given tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions import labels, numeric, temporal, text
from ..operators import aggregates as agg
from ..operators import joins, metrics, ordering, quality, selection, sets, similarity
from ..operators.series import Vector
from ..plans import gold, panels, serving, silver
from ..schemas import BRONZE, SAMPLES, SOURCE_KEYS
from ..session import scratch_path
from ..sources import catalog, files, merge, records
from ..sources.registry import Registry
from ..streaming.rate import drain, rate_stream, read_sample_files
from .lake import LOOKBACK, STEP, Lake

Query = Callable[[Lake], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(Lake.of(spark, sf_dir))

    return {name: bind(fn) for name, fn in QUERIES.items()}


def fresh(name: str) -> str:
    """A database or folder name not used before."""
    return f"{name}_{uuid.uuid4().hex[:10]}"


# --- sources and sinks ----------------------------------------------------------


def landed(lake: Lake, *names: str) -> str:
    """Ingest bronze tables into a new folder and return it."""
    root = scratch_path(lake.spark, "landing")
    files.ingest_full_refresh({n: lake.bronze(n) for n in names}, root)
    return root


BRONZE_NAMES = ["movies", "ratings", "links", "tags"]


def _all_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables stacked under their names; a column that a table lacks is NULL."""
    named = [df.withColumn("dataset", F.lit(n)) for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


@query
def src_bronze_scan(lake: Lake) -> DataFrame:
    root = landed(lake, *BRONZE_NAMES)
    return _all_rows({n: files.read_bronze(lake.spark, root, n) for n in BRONZE_NAMES})


@query
def src_register_external(lake: Lake) -> DataFrame:
    """All four streams registered, landed again, and registered again."""
    root, db = landed(lake, *BRONZE_NAMES), fresh("ext")
    catalog.ensure_database(lake.spark, db, scratch_path(lake.spark, db))

    def register() -> dict[str, DataFrame]:
        return {
            n: catalog.register_external(lake.spark, db, n, f"{root}/{n}", BRONZE[n])
            for n in BRONZE_NAMES
        }

    register()["links"].count()
    files.ingest_full_refresh({n: lake.bronze(n) for n in BRONZE_NAMES}, root)
    return _all_rows(register())


@query
def src_full_refresh(lake: Lake) -> DataFrame:
    """All four streams in one call, twice; what is read is what was published last."""
    db, root = fresh("bronze"), scratch_path(lake.spark, "bronze")
    catalog.ensure_database(lake.spark, db, f"{root}/{db}")
    tables = {n: lake.bronze(n) for n in BRONZE_NAMES}
    for _ in range(2):
        files.ingest_tables(lake.spark, tables, db, root, required={"movies": ["movieid"]})
    return _all_rows({n: lake.spark.table(f"{db}.{n}") for n in BRONZE_NAMES})


@query
def src_json_arrays(lake: Lake) -> DataFrame:
    """Files of one JSON array each, dated by their names: orders by their year.

    An array is split into as many files as a date needs, so none grows with the data.
    """
    orders = lake.given("orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_totalprice").alias("amount"),
        F.concat(F.year("o_orderdate").cast("string"), F.lit("-01-01")).alias("ds"),
    )
    root = scratch_path(lake.spark, "arrays")
    files.land_json_arrays(orders, root, "quotes", per_file=1000)
    return files.read_json_arrays(lake.spark, f"{root}/*.json", orders.drop("ds").schema)


@query
def src_csv_load(lake: Lake) -> DataFrame:
    path = scratch_path(lake.spark, "csv")
    (
        lake.bronze("movies")
        .write.option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return files.read_csv_typed(lake.spark, path, BRONZE["movies"])


@query
def src_insert_ignore(lake: Lake) -> DataFrame:
    """Catalogue entries from links, then from ratings for movies not listed yet."""
    listed = lake.bronze("links").select("movieid", F.lit("listed").alias("origin"))
    seen = lake.bronze("ratings").select(
        "movieid", F.concat(F.lit("seen at "), F.col("timestamp").cast("string")).alias("origin"), "timestamp"
    )
    return merge.insert_ignore(listed, seen, ["movieid"], ["timestamp"])


def _lowered_tags(lake: Lake) -> DataFrame:
    return lake.bronze("tags").withColumn("tag", F.lower("tag"))


@query
def src_insert_if_absent(lake: Lake) -> DataFrame:
    return merge.insert_if_absent(
        lake.bronze("tags"), _lowered_tags(lake), ["userid", "movieid", "tag", "timestamp"]
    )


@query
def src_append(lake: Lake) -> DataFrame:
    return merge.append(lake.bronze("tags"), _lowered_tags(lake))


@query
def src_values(lake: Lake) -> DataFrame:
    """Literal genre rows, each with the movies that list it."""
    movies = lake.stored("movies")
    listed = movies.select(F.explode(text.split_literal("genres", "|")).alias("genre"))
    return agg.with_all_labels(
        agg.count_by(listed, "genre", name="movies"), "genre", list(labels.GENRE_FLAGS)
    )


@query
def src_json_snapshot(lake: Lake) -> DataFrame:
    """Two dates landed, the first of them again: its documents are replaced."""
    quote = StructType(
        [
            StructField("id", LongType()),
            StructField("name", StringType()),
            StructField("amount", DoubleType()),
        ]
    )
    customers = lake.given("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("amount"),
    )
    parts = lake.given("part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("amount"),
    )
    root = scratch_path(lake.spark, "quotes")
    files.land_json_snapshot(parts, root, "2024-01-01")
    files.land_json_snapshot(parts, root, "2024-01-02")
    files.land_json_snapshot(customers, root, "2024-01-01")
    return files.read_json_snapshots(lake.spark, root, quote)


@query
def src_materialize(lake: Lake) -> DataFrame:
    """A table replaced by a query that reads it, with another schema."""
    db = fresh("mat")
    root = scratch_path(lake.spark, db)
    catalog.ensure_database(lake.spark, db, root)
    first = catalog.materialize(lake.staging("movies"), db, "movies", root=root)
    again = catalog.materialize(first, db, "movies", root=root)
    return catalog.materialize(
        again.withColumn("title_length", F.length("title").cast("bigint")),
        db, "movies", root=root,
    )


@query
def src_registry(lake: Lake) -> DataFrame:
    """Columns of the bronze datasets with their rows and filled values."""
    names = ["movies", "ratings", "links", "tags"]
    manifest = {
        "entries": [
            {"dataPath": n, "structureFormat": "parquet", "isPartitioned": False} for n in names
        ]
    }
    registry = Registry.from_manifest(json.dumps(manifest))
    return registry.profile(lake.spark, landed(lake, *names))


@query
def src_json_records(lake: Lake) -> DataFrame:
    """Links as JSON; the margin over 3 is not a number where the average is below."""
    rows = lake.gold("external_links").select(
        "movie_id", "title", "release_year", "imdb_url", "has_imdb", "avg_rating",
        F.sqrt(F.col("avg_rating") - 3).alias("margin"),
    )
    return records.to_records(rows.withColumn("margin", F.signum("margin")))


@query
def src_insert_select(lake: Lake) -> DataFrame:
    db = fresh("ins")
    root = scratch_path(lake.spark, db)
    catalog.ensure_database(lake.spark, db, root)
    catalog.register_external(lake.spark, db, "movies", f"{root}/movies", BRONZE["movies"])
    return catalog.insert_into(lake.bronze("movies"), db, "movies")


# --- projections, filters, predicates -------------------------------------------


@query
def prj_rename(lake: Lake) -> DataFrame:
    return lake.bronze("links").withColumnsRenamed(
        {"movieid": "movie_id", "imdbid": "imdb_id", "tmdbid": "tmdb_id"}
    )


@query
def prj_star(lake: Lake) -> DataFrame:
    return lake.bronze("movies").select(
        "*", F.length("title").cast("bigint").alias("title_length")
    )


@query
def prj_literal(lake: Lake) -> DataFrame:
    return agg.count_by(lake.stored("ratings"), "hour_of_day").withColumn(
        "trend_type", F.lit("hourly")
    )


@query
def prj_typed_null(lake: Lake) -> DataFrame:
    counts = agg.count_by(lake.stored("ratings"), "day_of_week", name="total_ratings")
    shape = StructType(
        [
            StructField("day_of_week", LongType()),
            StructField("total_ratings", LongType()),
            StructField("active_users", LongType()),
        ]
    )
    return sets.pad_to(counts, shape)


@query
def prj_prune(lake: Lake) -> DataFrame:
    """Aggregates that the last select leaves out are never computed."""
    stats = lake.stored("ratings").groupBy("movie_id").agg(
        F.count("*").alias("total_ratings"),
        F.min("rating").alias("min_rating"),
        F.max("rating").alias("max_rating"),
        F.stddev("rating").alias("spread"),
    )
    return stats.select("movie_id", "total_ratings")


@query
def prj_legend(lake: Lake) -> DataFrame:
    sums = _vector(lake, "click").sum(["dag_id"])
    return metrics.legend(sums, "média {{dag_id}}").select("t", "legend", "value")


@query
def flt_not_null(lake: Lake) -> DataFrame:
    return lake.bronze("ratings").dropna(subset=["userid", "movieid", "rating"])


@query
def flt_between(lake: Lake) -> DataFrame:
    low, high = silver.LOWEST_RATING, silver.HIGHEST_RATING
    return lake.staging("ratings").where(F.col("rating").between(low, high))


@query
def flt_not_equal(lake: Lake) -> DataFrame:
    return lake.staging("tags").where(text.trim_ws("tag") != "")


@query
def flt_flag(lake: Lake) -> DataFrame:
    return lake.stored("movies").where("is_action").select("movie_id", "title_clean")


@query
def flt_threshold(lake: Lake) -> DataFrame:
    return (
        lake.stored("movie_analytics")
        .where(
            (F.col("avg_rating") >= gold.MIN_AVG_RATING)
            & (F.col("total_ratings") >= gold.MIN_RATINGS)
        )
        .select("movie_id", "avg_rating", "total_ratings")
    )


@query
def topn_per_group(lake: Lake) -> DataFrame:
    return ordering.rank_top(
        lake.stored("movie_analytics").select("decade", "movie_id", "popularity_score"),
        ["decade"],
        [F.col("popularity_score").desc(), F.col("movie_id")],
        10,
    )


@query
def topn_per_group_any(lake: Lake) -> DataFrame:
    """The 1,500 dearest order lines per return flag: more than Spark cuts groups to."""
    lines = lake.given("lineitem").select(
        "l_returnflag", "l_extendedprice", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line")
    )
    return selection.top_per_group(lines, ["l_returnflag"], "l_extendedprice", "line", 1500)


@query
def prd_like(lake: Lake) -> DataFrame:
    tag = F.lower("tag")
    return lake.bronze("tags").where(text.contains_any(tag, ["love", "great", "best"]))


@query
def prd_null_logic(lake: Lake) -> DataFrame:
    """NULL on either side compares as unknown and falls to the else branch."""
    same = F.when(F.col("imdb_id") == F.col("tmdb_id").cast("string"), 1).otherwise(0)
    differ = F.when(F.col("imdb_id") != F.col("tmdb_id"), 1).otherwise(0)
    return lake.stored("links").select(
        "movie_id", same.alias("is_same"), differ.alias("is_different")
    )


# --- joins ------------------------------------------------------------------------


@query
def jn_inner(lake: Lake) -> DataFrame:
    movies = lake.stored("movies").select("movie_id", "title_clean")
    ratings = lake.stored("ratings").select("user_id", "movie_id", "rating", "rating_timestamp")
    return joins.join_inner(ratings, movies, "movie_id")


@query
def jn_left_agg(lake: Lake) -> DataFrame:
    return joins.join_left(
        lake.stored("movies").select("movie_id", "title_clean"),
        agg.count_by(lake.stored("ratings"), "movie_id", name="total_ratings"),
        agg.count_by(lake.stored("tags"), "movie_id", name="total_tags"),
        on="movie_id",
    )


@query
def jn_self_theta(lake: Lake) -> DataFrame:
    analytics = lake.stored("movie_analytics")
    eligible = analytics.where(
        (F.col("avg_rating") >= gold.MIN_AVG_RATING)
        & (F.col("total_ratings") >= gold.MIN_RATINGS)
    )
    return similarity.match_counts(
        analytics, eligible, key="movie_id", block="decade",
        flags=labels.SIMILARITY_FLAGS, min_score=gold.MIN_FLAG_MATCHES,
    )


@query
def jn_anti(lake: Lake) -> DataFrame:
    return joins.anti(lake.stored("movies"), lake.stored("links"), "movie_id").select(
        "movie_id", "title_clean"
    )


# --- aggregation ------------------------------------------------------------------


@query
def agg_count(lake: Lake) -> DataFrame:
    return agg.count_by(lake.stored("ratings"), "movie_id")


@query
def agg_count_distinct(lake: Lake) -> DataFrame:
    return agg.distinct_by(
        lake.stored("ratings"), ["year", "month"],
        active_users="user_id", movies_rated="movie_id",
    )


@query
def agg_avg(lake: Lake) -> DataFrame:
    return lake.stored("ratings").groupBy("movie_id").agg(agg.avg2("rating").alias("avg_rating"))


@query
def agg_stddev(lake: Lake) -> DataFrame:
    """From sums, which are exact for ratings; a running variance ends a last digit off."""
    sums = lake.stored("ratings").groupBy("movie_id").agg(*agg.moments("rating"))
    return sums.select("movie_id", agg.stddev_of_moments().alias("spread"))


@query
def agg_minmax(lake: Lake) -> DataFrame:
    return lake.stored("ratings").groupBy("user_id").agg(
        F.min("rating").alias("min_rating"), F.max("rating").alias("max_rating")
    )


@query
def agg_minmax_ts(lake: Lake) -> DataFrame:
    return lake.stored("ratings").groupBy("user_id").agg(
        F.min("rating_datetime").alias("first_rating"),
        F.max("rating_datetime").alias("last_rating"),
    )


@query
def agg_percentile(lake: Lake) -> DataFrame:
    return agg.percentiles(
        lake.stored("ratings"), ["movie_id"], "rating", p25=0.25, p50=0.5, p75=0.75
    )


@query
def agg_percentile_any(lake: Lake) -> DataFrame:
    """Percentiles of prices, nearly all distinct, over keys that hold a third of all rows."""
    return selection.select_percentiles(
        lake.given("lineitem"), ["l_returnflag"], "l_extendedprice", p05=0.05, p50=0.5, p99=0.99
    )


@query
def agg_typical_hour(lake: Lake) -> DataFrame:
    return agg.percentiles(lake.stored("ratings"), ["user_id"], "hour_of_day", typical_hour=0.5)


@query
def agg_cond_sum(lake: Lake) -> DataFrame:
    category = F.col("rating_category")
    return lake.stored("ratings").groupBy("user_id").agg(
        *[agg.count_when(category == b).alias(gold.band_column(b)) for b in gold.BANDS]
    )


@query
def agg_days_active(lake: Lake) -> DataFrame:
    at = "rating_datetime"
    return lake.stored("ratings").groupBy("movie_id").agg(
        temporal.whole_days(F.min(at), F.max(at)).alias("days_active")
    )


@query
def agg_multi_key(lake: Lake) -> DataFrame:
    return lake.stored("ratings").groupBy("rating_month", "year", "month").agg(
        F.count("*").alias("total_ratings"), agg.avg2("rating").alias("avg_rating")
    )


@query
def agg_global_empty(lake: Lake) -> DataFrame:
    """Movies and years per genre; a genre nobody has keeps its row."""
    movies = lake.stored("movies")
    flagged = movies.select(
        "release_year",
        F.explode(
            F.array_compact(
                F.array(*[F.when(F.col(f), g) for g, f in labels.GENRE_FLAGS.items()])
            )
        ).alias("genre"),
    )
    stats = flagged.groupBy("genre").agg(
        F.count("*").alias("movies"), agg.avg2("release_year").alias("mean_year")
    )
    return agg.with_all_labels(stats, "genre", list(labels.GENRE_FLAGS)).select(
        "genre", F.coalesce("movies", F.lit(0)).alias("movies"), "mean_year"
    )


@query
def agg_ratio(lake: Lake) -> DataFrame:
    """Tags per rating; movies without ratings have no ratio."""
    return lake.stored("movie_analytics").select(
        "movie_id",
        numeric.round2(numeric.safe_ratio("total_tags", "total_ratings")).alias("tags_per_rating"),
    )


@query
def agg_grouping_sets(lake: Lake) -> DataFrame:
    """Calendar grains in one pass over cells of the calendar."""
    keys = ["month", "hour_of_day", "day_of_week"]
    cells = agg.count_by(lake.stored("ratings"), *keys)
    return cells.groupingSets([[F.col(k)] for k in keys], *keys).agg(
        F.grouping_id().cast("bigint").alias("grain"), F.sum("n").alias("total_ratings")
    )


# --- windows, order, sets ---------------------------------------------------------


@query
def win_row_number(lake: Lake) -> DataFrame:
    return ordering.rank_top(
        lake.stored("movie_analytics").select("quality_tier", "movie_id", "total_ratings"),
        ["quality_tier"],
        [F.col("total_ratings").desc(), F.col("movie_id")],
        5,
        "place",
    )


@query
def ord_sort(lake: Lake) -> DataFrame:
    return ordering.sort_desc(
        lake.stored("movie_analytics").select("movie_id", "total_ratings"),
        "total_ratings", "movie_id",
    )


@query
def ord_topk(lake: Lake) -> DataFrame:
    return ordering.top_k(
        lake.stored("movie_analytics").select("movie_id", "popularity_score"),
        "popularity_score", 20, "movie_id",
    )


@query
def set_union_all(lake: Lake) -> DataFrame:
    """The same aggregate of two tables, stacked."""
    return sets.union_all(
        *[
            agg.count_by(lake.stored(n), "year").withColumn("origin", F.lit(n))
            for n in ("ratings", "tags")
        ]
    )


@query
def set_union_padded(lake: Lake) -> DataFrame:
    shape = StructType(
        [
            StructField("grain", StringType()),
            StructField("value", LongType()),
            StructField("total", LongType()),
            StructField("users", LongType()),
        ]
    )
    ratings = lake.stored("ratings")
    hours = agg.count_by(ratings, "hour_of_day", name="total").withColumnRenamed(
        "hour_of_day", "value"
    )
    months = (
        agg.count_by(ratings, "month", name="total")
        .join(agg.distinct_by(ratings, ["month"], users="user_id"), "month")
        .withColumnRenamed("month", "value")
    )
    return sets.union_padded(
        shape, months.withColumn("grain", F.lit("month")), hours.withColumn("grain", F.lit("hour"))
    )


# --- scalar functions -------------------------------------------------------------


def scalar(
    name: str,
    source: Callable[[Lake], DataFrame],
    keys: list[str],
    columns: Callable[[], dict[str, Column]],
) -> None:
    """Register a projection of the keys and some computed columns."""
    QUERIES[name] = lambda lake: source(lake).select(
        *keys, *[c.alias(n) for n, c in columns().items()]
    )


def from_bronze(name: str) -> Callable[[Lake], DataFrame]:
    return lambda lake: lake.bronze(name)


def from_given(name: str) -> Callable[[Lake], DataFrame]:
    return lambda lake: lake.given(name)


def from_stored(name: str) -> Callable[[Lake], DataFrame]:
    return lambda lake: lake.stored(name)


MOVIE, TAG, LINK = ["movieid"], ["userid", "movieid", "timestamp"], ["movieid"]
RATING = ["userid", "movieid", "timestamp", "rating"]
LINE = ["l_orderkey", "l_linenumber", "l_partkey"]


def rated_at() -> Column:
    return temporal.from_unix("timestamp")


def title_year() -> Column:
    return text.regexp_group("title", r"\((\d{4})\)")


scalar("fn_trim", from_bronze("movies"), MOVIE, lambda: dict(title=text.trim_ws("title")))
scalar("fn_lower", from_bronze("tags"), TAG, lambda: dict(tag=F.lower("tag")))
scalar("fn_length", from_bronze("tags"), TAG, lambda: dict(
    tag_length=F.length("tag").cast("bigint"),
))
scalar("fn_concat", from_bronze("links"), LINK, lambda: dict(
    both=F.concat(F.lit("tt"), "imdbid", F.lit("-"), "tmdbid"),
))
scalar("fn_concat_op", from_given("orders"), ["o_orderkey"], lambda: dict(
    both=F.concat("o_orderstatus", F.lit("/"), "o_orderpriority"),
))
scalar("fn_lpad", from_bronze("links"), LINK, lambda: dict(padded=text.pad_left("imdbid", 7)))
scalar("fn_cardinality", from_bronze("movies"), MOVIE, lambda: dict(
    genres_count=text.cardinality(text.split_literal("genres", "|")),
))
scalar("fn_strpos", from_bronze("movies"), MOVIE, lambda: dict(
    is_drama=text.contains_sub("genres", "Drama"),
))
scalar("fn_regexp_extract", from_bronze("movies"), MOVIE, lambda: dict(year=title_year()))
scalar("fn_regexp_replace", from_bronze("movies"), MOVIE, lambda: dict(
    title=F.regexp_replace("title", r"\s*\(\d{4}\)", ""),
))
scalar("fn_cast", from_bronze("links"), LINK, lambda: dict(
    tmdb=F.col("tmdbid").cast("bigint"),
    imdb=F.col("imdbid").cast("double"), movie=F.col("movieid").cast("string"),
))
scalar("fn_try_cast", from_given("part"), ["p_partkey"], lambda: dict(
    kind=F.col("p_type").try_cast("int"),
    brand=F.substring("p_brand", 7, 4).try_cast("int"),
))
scalar("fn_from_unixtime", from_bronze("ratings"), RATING, lambda: dict(rated_at=rated_at()))
scalar("fn_date_trunc", from_bronze("ratings"), RATING, lambda: dict(
    day=F.date_trunc("day", rated_at()),
    month=F.date_trunc("month", rated_at()), year=F.date_trunc("year", rated_at()),
))
scalar("fn_date_parts", from_bronze("ratings"), RATING, lambda: dict(
    year=temporal.date_part("year", rated_at()),
    month=temporal.date_part("month", rated_at()), hour=temporal.date_part("hour", rated_at()),
))
scalar("fn_iso_dow", from_bronze("ratings"), RATING, lambda: dict(
    day_of_week=temporal.iso_dow(rated_at()),
))
scalar("fn_date_diff", from_bronze("ratings"), RATING, lambda: dict(
    days=temporal.whole_days(rated_at(), F.lit("2002-01-01 12:00:00").cast("timestamp")),
))
scalar("fn_decade", from_bronze("movies"), MOVIE, lambda: dict(
    decade=numeric.decade(title_year().try_cast("int")),
))
scalar("fn_round", from_given("lineitem"), LINE, lambda: dict(
    rounded=numeric.round2(F.col("l_extendedprice") * F.col("l_tax")),
))
scalar("fn_ln", from_given("lineitem"), LINE, lambda: dict(
    ln=F.round(F.ln(F.col("l_quantity") + 1), 6),
))
scalar("fn_least", from_given("lineitem"), LINE, lambda: dict(
    capped=F.least(F.col("l_extendedprice"), F.lit(30000.0)),
))
scalar("fn_coalesce", from_bronze("links"), LINK, lambda: dict(
    any_id=F.coalesce("imdbid", "tmdbid", F.lit("none")),
))
scalar("fn_nullif", from_given("lineitem"), LINE, lambda: dict(
    ratio=F.col("l_tax") / F.nullif(F.col("l_discount"), F.lit(0.0)),
))
scalar("fn_arith", from_given("lineitem"), LINE, lambda: dict(
    charge=F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")),
    shifted=F.col("l_partkey") + F.col("l_linenumber") * 2 - 1,
))
scalar("fn_rating_category", from_bronze("ratings"), RATING, lambda: dict(
    category=labels.rating_category("rating"),
))
scalar("fn_sentiment", from_bronze("tags"), TAG, lambda: dict(
    sentiment=labels.sentiment(F.lower("tag")),
))
scalar("fn_tag_category", from_bronze("tags"), TAG, lambda: dict(
    tag_category=labels.tag_category(F.lower("tag")),
))
scalar("fn_link_status", from_bronze("links"), LINK, lambda: dict(
    link_status=labels.link_status("imdbid", "tmdbid"),
))
scalar("fn_tiers", from_stored("user_behavior"), ["user_id"], lambda: dict(
    segment=labels.user_segment("total_ratings"), style=labels.rating_style("avg_rating"),
    consistency=labels.rating_consistency("stddev_rating"),
    tier=labels.quality_tier("avg_rating", "total_ratings"),
    engagement=labels.engagement_level("total_ratings"),
))
scalar("fn_popularity", from_stored("user_behavior"), ["user_id"], lambda: dict(
    score=numeric.popularity("avg_rating", "total_ratings", F.nullif("total_tags", F.lit(0))),
))


@query
def fn_split(lake: Lake) -> DataFrame:
    parts = lake.bronze("movies").select(
        "movieid", F.posexplode(text.split_literal("genres", "|")).alias("pos", "genre")
    )
    return parts.withColumn("pos", F.col("pos").cast("bigint"))


@query
def fn_flag_similarity(lake: Lake) -> DataFrame:
    """Each movie against the one with the next id."""
    sig = labels.flag_signature(labels.SIMILARITY_FLAGS)
    signed = lake.stored("movies").select("movie_id", sig.alias("sig"))
    nxt = signed.select((F.col("movie_id") - 1).alias("movie_id"), F.col("sig").alias("next_sig"))
    return signed.join(nxt, "movie_id").select(
        "movie_id", labels.flag_similarity("sig", "next_sig").alias("score")
    )


# --- models -------------------------------------------------------------------------


def _register_models() -> None:
    for name in ("movies", "ratings", "tags", "links"):
        QUERIES[f"stg_{name}"] = lambda lake, n=name: lake.staging(n)
        QUERIES[f"silver_{name}"] = lambda lake, n=name: lake.silver(n)
    for table in serving.GOLD_KEYS:
        QUERIES[table] = lambda lake, n=table.removeprefix("gold_"): lake.gold(n)


_register_models()


# --- serving ------------------------------------------------------------------------


@query
def srv_top_movies(lake: Lake) -> DataFrame:
    return serving.top_movies(lake.stored("movie_analytics"))


@query
def srv_movie_by_id(lake: Lake) -> DataFrame:
    return serving.movie(lake.stored("movie_analytics"), 42)


@query
def srv_genres(lake: Lake) -> DataFrame:
    return serving.genres(lake.stored("genre_analytics"))


@query
def srv_recommendations(lake: Lake) -> DataFrame:
    return serving.recommend(lake.stored("movie_recommendations"), source_movie_id=42)


@query
def srv_trends(lake: Lake) -> DataFrame:
    return serving.trends(lake.stored("temporal_trends"))


@query
def srv_top_users(lake: Lake) -> DataFrame:
    return serving.top_users(lake.stored("user_behavior"))


@query
def srv_adhoc(lake: Lake) -> DataFrame:
    """Ten rows of a published gold table, found through the catalog."""
    db = fresh("gold")
    root = scratch_path(lake.spark, db)
    catalog.ensure_database(lake.spark, db, root)
    catalog.materialize(lake.stored("external_links"), db, "gold_external_links", root=root)
    return serving.adhoc(lake.spark, "gold_external_links", db=db)


# --- data quality -------------------------------------------------------------------


@query
def dq_not_null(lake: Lake) -> DataFrame:
    return quality.not_null(lake.bronze("ratings"), ["userid", "movieid", "rating"])


@query
def dq_unique(lake: Lake) -> DataFrame:
    return quality.unique(lake.bronze("ratings"), ["userid", "movieid"])


@query
def dq_relationships(lake: Lake) -> DataFrame:
    return joins.relationships(
        lake.stored("links"), "movie_id", lake.stored("movies"), "movie_id"
    )


@query
def dq_reconcile(lake: Lake) -> DataFrame:
    """Bronze against silver: the tables that filters made smaller."""
    names = ["movies", "ratings", "tags", "links"]
    return quality.reconcile(
        {n: lake.stored(f"bronze_{n}") for n in names}, {n: lake.stored(n) for n in names}
    )


@query
def dq_constraints(lake: Lake) -> DataFrame:
    """Source constraints on landed ratings; each check scans the columns it needs."""
    return quality.check_constraints(
        lake.stored("bronze_ratings"),
        pk=SOURCE_KEYS["ratings"],
        fks={"movieid": (lake.stored("bronze_movies"), "movieid")},
        required=["rating"],
    )


# --- metric series ------------------------------------------------------------------


def _flat(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(
        *columns, metrics.label("dag_id").alias("dag_id"), metrics.label("task_id").alias("task_id")
    )


def _vector(lake: Lake, metric: str) -> Vector:
    return lake.series("samples").matching(metric).instant(STEP, LOOKBACK)


@query
def met_instant(lake: Lake) -> DataFrame:
    vector = metrics.instant_vector(lake.stored("samples"), STEP, LOOKBACK)
    return _flat(vector, "metric", "t", "value")


@query
def met_label_match(lake: Lake) -> DataFrame:
    """Conditions are looked at once per series, in the dictionary."""
    found = lake.series("samples").matching(
        "click", ne={"dag_id": ""}, eq={"task_id": ""},
        regex={"dag_id": metrics.selection_regex(["dag_0", "dag_3"])},
    )
    return _flat(found.flat(), "metric", "ts", "value")


@query
def met_range(lake: Lake) -> DataFrame:
    window = metrics.time_range(
        lake.stored("samples"),
        F.lit("2024-01-10 00:00:00").cast("timestamp"),
        F.lit("2024-01-20 12:00:00").cast("timestamp"),
    )
    return _flat(window, "metric", "ts", "value")


@query
def met_label_values(lake: Lake) -> DataFrame:
    return lake.series("samples").matching("purchase").label_values("dag_id")


@query
def met_sum(lake: Lake) -> DataFrame:
    return _vector(lake, "view").sum()


@query
def met_max(lake: Lake) -> DataFrame:
    return _vector(lake, "view").max()


@query
def met_sum_by(lake: Lake) -> DataFrame:
    return _vector(lake, "purchase").sum(["dag_id"])


@query
def met_max_by(lake: Lake) -> DataFrame:
    return _vector(lake, "error").max(["task_id"])


@query
def met_reduce(lake: Lake) -> DataFrame:
    return metrics.reduce_series(_vector(lake, "signup").sum(["dag_id"]), ["dag_id"])


@query
def met_ratio_by(lake: Lake) -> DataFrame:
    clicks, views = (_vector(lake, m).sum(["dag_id"]) for m in ("click", "view"))
    return metrics.vector_ratio(clicks, views, ["t", "dag_id"])


@query
def met_ratio_max(lake: Lake) -> DataFrame:
    """Series by series ratio, then the greatest at each time.

    Counters start over at zero, so there are infinities and 0/0 among the ratios.
    """
    return metrics.vec_max(_vector(lake, "click").ratio_series(_vector(lake, "view")))


@query
def met_rate(lake: Lake) -> DataFrame:
    rates = metrics.rate(lake.stored("samples"), LOOKBACK, STEP, extrapolate=False)
    return _flat(rates, "metric", "t", "value")


@query
def met_rate_extrapolated(lake: Lake) -> DataFrame:
    """The same over the dictionary of series, stretched to the ends of the range."""
    rates = lake.series("samples").rate(LOOKBACK, STEP).flat()
    return _flat(rates, "metric", "t", "value")


@query
def met_dashboard(lake: Lake) -> DataFrame:
    return panels.run_dashboard(
        lake.series("panel_samples"), lake.panel_vector(),
        step=STEP, rate_range=LOOKBACK, dag_ids=["dag_0", "dag_2", "dag_5"],
    )


@query
def str_rate(lake: Lake) -> DataFrame:
    """The rate as a stream over files of samples, up to the last closed range.

    Samples arrive in order of time, in five steps; each step is a micro-batch or more.
    """
    incoming = scratch_path(lake.spark, "incoming")
    out = scratch_path(lake.spark, "rates")
    samples = lake.stored("samples")
    at = F.unix_micros("ts")
    bounds = samples.select(F.percentile_approx(at, [0.2, 0.4, 0.6, 0.8])).first()[0] or []
    edges = [None, *bounds, None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = samples if low is None else samples.where(at >= low)
        part = part if high is None else part.where(at < high)
        part.coalesce(4).write.mode("append").parquet(incoming)
    stream = read_sample_files(lake.spark, incoming, SAMPLES, files_per_batch=4)
    rates = rate_stream(stream, LOOKBACK, STEP, extrapolate=False)
    drain(rates, out, scratch_path(lake.spark, "stream-state"))
    return _flat(lake.spark.read.schema(rates.schema).parquet(out), "metric", "t", "value")
