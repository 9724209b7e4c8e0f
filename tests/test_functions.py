import math

import pytest
from pyspark.sql import functions as F

from reelmill.functions import labels, numeric, temporal, text
from reelmill.plans import silver, staging


def values(spark, expr, *inputs, kind="string"):
    df = spark.createDataFrame([(i,) for i in inputs], f"x {kind}")
    return [r[0] for r in df.select(expr).collect()]


def test_trim_takes_all_whitespace_but_not_no_break_space(spark):
    got = values(spark, text.trim_ws("x"), "\t Heat (1995) \n", " a　", " b", None)
    assert got == ["Heat (1995)", "a", " b", None]


def test_split_is_literal(spark):
    assert values(spark, text.split_literal("x", "|"), "A|B", "", None) == [["A", "B"], [""], None]
    counts = text.cardinality(text.split_literal("x", "|"))
    assert values(spark, counts, "A|B", "", None) == [2, 1, None]


def test_regexp_group_without_match_is_null(spark):
    assert values(spark, text.regexp_group("x", r"\((\d{4})\)$"), "a (1999)", "a") == ["1999", None]


def test_pad_left_cuts_long_input(spark):
    assert values(spark, text.pad_left("x", 7), "123", "12345678") == ["0000123", "1234567"]


def test_round2_follows_binary_value(spark):
    got = values(spark, numeric.round2("x"), 1.005, 3.125, -3.125, None, kind="double")
    assert got == [1.0, 3.13, -3.13, None]


def test_float_divide(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0)], "a double, b double")
    got = [r[0] for r in df.select(numeric.float_divide("a", "b")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 0.25


def test_safe_ratio_by_zero_is_null(spark):
    assert values(spark, numeric.safe_ratio("x", F.lit(0)), 3, kind="int") == [None]


def test_decade(spark):
    assert values(spark, numeric.decade("x"), 1995, 2000, None, kind="int") == [1990, 2000, None]


def test_popularity_of_unrated_untagged(spark):
    nothing = F.lit(None).cast("bigint")
    score = numeric.popularity(nothing.cast("double"), nothing, nothing)
    assert values(spark, score, 1, kind="int") == [round(0.6 * math.log(2), 2)]


def test_stddev_from_moments(spark):
    df = spark.createDataFrame(
        [(1, 3.0, 9.0), (2, 5.0, 13.0), (3, 9.0, 27.0), (0, None, None)],
        "n bigint, s double, ss double",
    )
    got = [r[0] for r in df.select(numeric.stddev_from_moments("n", "s", "ss")).collect()]
    assert got[0] is None and got[3] is None and got[2] == 0.0
    assert got[1] == pytest.approx(math.sqrt(0.5))


def test_calendar(spark):
    sunday = 964915200  # 2000-07-30 00:00:00 UTC
    at = temporal.from_unix("x")
    assert values(spark, temporal.iso_dow(at), sunday, kind="bigint") == [7]
    assert values(spark, temporal.date_part("hour", at), sunday + 3 * 3600, kind="bigint") == [3]


def test_whole_days_are_24_hours(spark):
    df = spark.sql(
        "SELECT TIMESTAMP'2020-01-01 23:00:00' a, TIMESTAMP'2020-01-02 01:00:00' b,"
        " TIMESTAMP'2020-01-02 23:00:00' c"
    )
    assert df.select(temporal.whole_days("a", "b"), temporal.whole_days("a", "c")).first()[:] == (0, 1)


def test_first_matching_rule_wins(spark):
    assert values(spark, labels.sentiment("x"), "love bad", "badge", "plain") == [
        "Positivo", "Negativo", "Neutro"]
    assert values(spark, labels.tag_category("x"), "love bad", "funny fight", "x") == [
        "Romance", "Humor", "Outros"]


def test_bands(spark):
    got = values(spark, labels.rating_category("x"), 4.5, 4.49, 2.5, 2.4, None, kind="double")
    assert got == ["Excelente", "Bom", "Regular", "Ruim", "Ruim"]
    assert values(spark, labels.rating_consistency("x"), None, 1.5, kind="double") == [
        "Consistente", "Polarizado"]


def test_link_status(spark):
    df = spark.createDataFrame([("1", "2"), ("1", None), (None, "2"), (None, None)], "a string, b string")
    got = [r[0] for r in df.select(labels.link_status("a", "b")).collect()]
    assert got == ["Complete", "Partial", "Partial", "Missing"]


def test_flag_similarity_counts_known_equal_flags(spark):
    df = spark.createDataFrame(
        [(True, False, None), (True, True, None), (None, None, None)],
        "f boolean, g boolean, h boolean",
    ).select(labels.flag_signature(["f", "g", "h"]).alias("s"))
    a, b, c = (r[0] for r in df.collect())
    pair = spark.createDataFrame([(a, a), (a, b), (a, c), (c, c)], "a int, b int")
    assert [r[0] for r in pair.select(labels.flag_similarity("a", "b")).collect()] == [2, 1, 0, 0]


def test_silver_movies_edges(spark):
    bronze = spark.createDataFrame(
        [
            (1, "\t Heat (1995) \n", "Action|Crime|Thriller"),
            (2, "Babylon 5", "Dramatic"),
            (3, "Empty", ""),
            (4, "None (2001)", None),
            (None, "lost", "Drama"),
        ],
        "movieid bigint, title string, genres string",
    )
    got = {r["movie_id"]: r for r in silver.silver_movies(staging.stg_movies(bronze)).collect()}
    assert set(got) == {1, 2, 3, 4}
    heat = got[1]
    assert (heat["title"], heat["title_clean"], heat["release_year"], heat["decade"]) == (
        "Heat (1995)", "Heat", 1995, 1990)
    assert heat["is_action"] and heat["is_thriller"] and not heat["is_drama"]
    assert (got[2]["release_year"], got[2]["decade"], got[2]["title_clean"]) == (None, None, "Babylon 5")
    assert got[2]["is_drama"] is True  # a substring is enough
    assert (got[3]["genres_count"], got[3]["is_drama"]) == (1, False)
    assert (got[4]["genres_count"], got[4]["is_drama"]) == (None, None)


def test_silver_ratings_range_is_inclusive(spark):
    bronze = spark.createDataFrame(
        [(1, 1, r, 0) for r in (0.5, 5.0, 0.49, 5.01)] + [(None, 1, 3.0, 0), (1, 1, None, 0)],
        "userid bigint, movieid bigint, rating double, timestamp bigint",
    )
    got = silver.silver_ratings(staging.stg_ratings(bronze)).collect()
    assert sorted(r["rating"] for r in got) == [0.5, 5.0]


def test_silver_links_and_tags(spark):
    links = spark.createDataFrame(
        [(1, "114709", "862"), (2, None, None)], "movieid bigint, imdbid string, tmdbid string"
    )
    first, second = silver.silver_links(staging.stg_links(links)).orderBy("movie_id").collect()
    assert first["imdb_url"].endswith("tt0114709") and first["tmdb_url"].endswith("/862")
    assert second["imdb_url"] is None and second["tmdb_url"] is None
    tags = spark.createDataFrame(
        [(1, 1, "  \t ", 0), (1, 1, " Great PLOT\n", 0), (1, 1, None, 0)],
        "userid bigint, movieid bigint, tag string, timestamp bigint",
    )
    (only,) = silver.silver_tags(staging.stg_tags(tags)).collect()
    assert (only["tag_normalized"], only["tag_original"], only["tag_length"]) == (
        "great plot", "Great PLOT", 10)
    assert (only["sentiment"], only["tag_category"]) == ("Positivo", "Enredo")
