from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reelmill.operators.quality import QualityError, not_null
from reelmill.plans import gold, serving, silver, staging
from reelmill.plans.build import REQUIRED, run_build
from reelmill.schemas import BRONZE
from reelmill.session import scratch_path
from reelmill.sources import catalog, files

DAY = 86400


def silver_of(spark, name, data):
    bronze = spark.createDataFrame(data, BRONZE[name])
    return getattr(silver, f"silver_{name}")(getattr(staging, f"stg_{name}")(bronze))


@pytest.fixture
def layers(spark):
    movies = [(1, "Heat (1995)", "Action|Crime"), (2, "Quiet (1996)", "Drama"), (3, "None", None)]
    ratings = [
        (10, 1, 4.0, 23 * 3600), (10, 1, 2.0, DAY + 3600), (11, 1, 5.0, 40 * DAY),
        (12, 2, 3.0, 5 * 3600), (12, 99, 1.0, 6 * 3600),
    ]
    tags = [(10, 1, "Great plot", 0), (10, 1, "great PLOT ", 5), (77, 2, "bad", 9)]
    return {
        n: silver_of(spark, n, d) for n, d in (("movies", movies), ("ratings", ratings), ("tags", tags))
    }


def test_movie_analytics_edges(layers):
    got = {
        r["movie_id"]: r
        for r in gold.movie_analytics(layers["movies"], layers["ratings"], layers["tags"]).collect()
    }
    assert set(got) == {1, 2, 3}
    heat, quiet, none = got[1], got[2], got[3]
    assert (heat["total_users"], heat["total_ratings"], heat["avg_rating"]) == (2, 3, 3.67)
    assert (heat["rating_median"], heat["stddev_rating"], heat["days_active"]) == (4.0, 1.53, 39)
    assert (heat["ratings_excelente"], heat["ratings_bom"], heat["ratings_ruim"]) == (1, 1, 1)
    assert (heat["total_tags"], heat["unique_tags"], heat["tags_positivas"]) == (2, 1, 2)
    assert (quiet["stddev_rating"], quiet["days_active"], quiet["tags_negativas"]) == (None, 0, 1)
    assert (none["total_users"], none["total_ratings"], none["avg_rating"]) == (0, 0, None)
    assert none["ratings_bom"] is None and none["first_rating_date"] is None
    assert (none["popularity_score"], none["quality_tier"], none["engagement_level"]) == (
        0.42, "Pouco Avaliado", "Muito Baixo")


def test_user_behavior_edges(layers):
    got = {r["user_id"]: r for r in gold.user_behavior(layers["ratings"], layers["tags"]).collect()}
    assert set(got) == {10, 11, 12}  # the user who only tagged has no row
    assert (got[10]["days_active"], got[10]["typical_hour"]) == (0, 1)  # 23:00 to 01:00
    assert (got[11]["stddev_rating"], got[11]["rating_consistency"]) == (None, "Consistente")
    assert (got[12]["movies_rated"], got[12]["total_tags"]) == (2, 0)
    assert (got[10]["movies_tagged"], got[10]["unique_tags"]) == (1, 1)


def test_genre_analytics_has_nine_rows(layers):
    got = {r["genre"]: r for r in gold.genre_analytics(layers["movies"], layers["ratings"]).collect()}
    assert len(got) == 9
    action, empty = got["Action"], got["Documentary"]
    assert (action["total_ratings"], action["total_movies"], action["total_users"]) == (3, 1, 2)
    assert (action["avg_ratings_per_movie"], action["avg_ratings_per_user"]) == (3.0, 1.5)
    assert (empty["total_ratings"], empty["avg_rating"], empty["avg_ratings_per_user"]) == (0, None, None)


def test_trends(layers):
    got = {(r["trend_type"], r["period"]): r for r in gold.temporal_trends(layers["ratings"]).collect()}
    assert got["monthly", "1970-01"]["total_ratings"] == 4
    assert got["monthly", "1970-02"]["active_users"] == 1
    assert got["hourly", "1"]["hour_or_day"] == 1 and got["hourly", "1"]["active_users"] is None
    assert got["day_of_week", "4"]["total_ratings"] == 3  # 1970-01-01 was a Thursday
    assert got["hourly", "1"]["ratings_bom"] is None


def test_trends_without_a_time(spark):
    ratings = silver_of(spark, "ratings", [(1, 1, 3.0, None), (1, 1, 3.0, 0)])
    got = [(r["trend_type"], r["period"], r["total_ratings"]) for r in gold.temporal_trends(ratings).collect()]
    assert sorted(got, key=repr) == sorted(
        [("monthly", "1970-01", 1), ("hourly", "0", 1), ("hourly", None, 1),
         ("day_of_week", "4", 1), ("day_of_week", None, 1)], key=repr)


def test_external_links(spark, layers):
    links = silver_of(spark, "links", [(1, "5", None), (2, None, None), (50, "1", "1")])
    got = {
        r["movie_id"]: r
        for r in gold.external_links(links, layers["movies"], layers["ratings"]).collect()
    }
    assert set(got) == {1, 2}
    assert (got[1]["link_status"], got[1]["has_imdb"], got[1]["total_ratings"]) == ("Partial", True, 3)
    assert (got[2]["link_status"], got[2]["tmdb_url"]) == ("Missing", None)


def seed(spark, root, ratings_user=10):
    movies = [(i, f"Film {i} ({1990 + i % 3})", "Action|Drama" if i % 2 else "Comedy") for i in range(30)]
    ratings = [(u, m, 2.5 + (m % 6) / 2, 1000 * u + m) for m in range(30) for u in range(12)]
    tags = [(1, m, "great twist", m) for m in range(5)]
    links = [(m, str(m), None) for m in range(30)]
    frames = {"movies": movies, "ratings": ratings, "tags": tags, "links": links}
    return files.ingest_full_refresh(
        {n: spark.createDataFrame(d, BRONZE[n]) for n, d in frames.items()}, root
    )


def test_build_twice_gives_the_same_tables(spark, rows):
    root = scratch_path(spark, "build")
    seed(spark, f"{root}/bronze_files")
    dbs = {"silver": "b1_silver", "gold": "b1_gold"}
    run = lambda: run_build(
        spark, f"{root}/bronze_files", root, bronze_db="b1_bronze", layers=dbs,
        run_ts=datetime(2026, 1, 1),
    )
    first = {n: rows(df) for n, df in run().items()}
    second = {n: rows(df) for n, df in run().items()}
    assert first == second and len(first) == 10
    assert all(first.values())
    stamped = spark.table("b1_gold.gold_genre_analytics")
    assert stamped.select("processed_at").distinct().count() == 1

    analytics = spark.table("b1_gold.gold_movie_analytics")
    top = serving.top_movies(analytics, 3).collect()
    assert [r["movie_id"] for r in top] == [0, 1, 2]
    assert serving.one(serving.movie(analytics, 4))["title"] == "Film 4"
    with pytest.raises(serving.NotFound):
        serving.one(serving.movie(analytics, 4000))
    with pytest.raises(serving.NotFound):
        serving.adhoc(spark, "gold_secret; DROP", db="b1_gold")
    recs = spark.table("b1_gold.gold_movie_recommendations")
    some = serving.recommend(recs, source_movie_id=3, limit=4).collect()
    assert [r["recommendation_rank"] for r in some] == [1, 2, 3, 4]
    trends = spark.table("b1_gold.gold_temporal_trends")
    assert {r["trend_type"] for r in serving.trends(trends, "hourly").collect()} == {"hourly"}
    assert serving.adhoc(spark, "gold_user_behavior", db="b1_gold").count() == 10


def rated(spark, data):
    at = F.col("rating_datetime")
    return spark.createDataFrame(
        data, "user_id long, movie_id long, rating double, rating_datetime timestamp"
    ).withColumn("hour_of_day", F.hour(at).cast("bigint"))


def test_user_behavior_equals_a_plain_count(spark, layers):
    data = [(1, 7 * k % 90, (k * k % 10 + 1) / 2, datetime(2020, 1, 1 + k % 28, k * 5 % 24)) for k in range(600)]
    data += [(2, None, 3.0, None), (2, 4, 3.0, None), (2, 4, 4.0, datetime(2020, 1, 1, 9))]
    data += [(3, 1, 2.0, None), (4, k := 5, 2.5, datetime(2020, 1, 1, 23)), (4, k, 2.5, datetime(2020, 1, 2, 0))]
    got = {r["user_id"]: r for r in gold.user_behavior(rated(spark, data), layers["tags"]).collect()}
    assert set(got) == {1, 2, 3, 4}
    for user, row in got.items():
        mine = [d for d in data if d[0] == user]
        assert row["total_ratings"] == len(mine)
        assert row["movies_rated"] == len({d[1] for d in mine} - {None})
        # Missing hours come first; what the half of the ratings reaches is an hour there is.
        hours = sorted(d[3].hour if d[3] else -1 for d in mine)
        reached = [h for h in hours[(len(hours) + 1) // 2 - 1 :] if h >= 0]
        assert row["typical_hour"] == (reached[0] if reached else None)
        assert row["avg_rating"] == pytest.approx(sum(d[2] for d in mine) / len(mine), abs=0.006)
        assert row["ratings_excelente"] == sum(d[2] >= 4.5 for d in mine)
        times = [d[3] for d in mine if d[3]]
        assert (row["first_rating"], row["last_rating"]) == ((min(times), max(times)) if times else (None, None))


def test_user_behavior_shuffles_ratings_once(spark, layers):
    data = [(k % 50, k, 3.0, datetime(2020, 1, 1, k % 24)) for k in range(500)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = gold.user_behavior(rated(spark, data), layers["tags"].limit(0))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(user_id" in x]
    assert sum("hour_of_day" in x or "movie_id" in x or "share" in x for x in dealt) == 1


def test_broken_data_stops_the_build(spark, rows):
    root = scratch_path(spark, "build")
    seed(spark, f"{root}/bronze_files")
    dbs = {"silver": "b2_silver", "gold": "b2_gold"}
    build = lambda: run_build(
        spark, f"{root}/bronze_files", root, bronze_db="b2_bronze", layers=dbs
    )
    build()
    before = rows(spark.table("b2_gold.gold_movie_analytics"))
    twice = spark.createDataFrame([(1, "A", "Drama"), (1, "B", "Drama")], BRONZE["movies"])
    files.ingest_full_refresh({"movies": twice}, f"{root}/bronze_files")
    with pytest.raises(QualityError, match="movie_id.unique"):
        build()
    assert rows(spark.table("b2_gold.gold_movie_analytics")) == before


def executions(spark, action):
    """Plans of what Spark ran during ``action``."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    action()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    listed = store.executionsList(before, 10_000)
    return [listed.apply(k).physicalPlanDescription() for k in range(listed.size())]


def test_build_starts_no_scan_for_nulls_or_rows(spark):
    root = scratch_path(spark, "build")
    seed(spark, f"{root}/bronze_files")
    plans = executions(
        spark,
        lambda: run_build(
            spark, f"{root}/bronze_files", root, bronze_db="b5_bronze",
            layers={"silver": "b5_silver", "gold": "b5_gold"},
        ),
    )
    written = [p for p in plans if "InsertIntoHadoopFsRelationCommand" in p]
    assert len(written) == 10 and all("CollectMetrics" in p for p in written)
    scans = [p for p in plans if "Scan parquet" in p and p not in written]
    # One look for repeated keys per table that has keys: six of the ten.
    keyed = [m for m in REQUIRED if REQUIRED[m][1] and not m.startswith("stg_")]
    assert 0 < len(scans) <= len(keyed) and all("copies" in p for p in scans)
    assert not any("isnull(" in p.lower() for p in scans)


@pytest.mark.parametrize("name", ["ratings", "links"])
def test_a_null_in_staging_stops_the_build_before_anything_is_published(spark, rows, name, monkeypatch):
    root = scratch_path(spark, "build")
    seed(spark, f"{root}/bronze_files")
    dbs = {"silver": f"b6_{name}_silver", "gold": f"b6_{name}_gold"}
    build = lambda: run_build(
        spark, f"{root}/bronze_files", root, bronze_db=f"b6_{name}_bronze", layers=dbs
    )
    build()
    tables = {n: catalog.table_location(spark, dbs["silver"], f"silver_{n}") for n in ("movies", name)}
    strict = getattr(staging, f"stg_{name}")
    nulled = lambda raw: strict(raw).withColumn("movie_id", F.expr("nullif(movie_id, 3)"))
    monkeypatch.setattr(staging, f"stg_{name}", nulled)
    with pytest.raises(QualityError, match=rf"stg_{name}.not_null\(movie_id\)|silver_{name}.not_null\(movie_id\)"):
        build()
    for n, location in tables.items():
        assert catalog.table_location(spark, dbs["silver"], f"silver_{n}") == location


def test_build_from_ingested_tables(spark, rows):
    root = scratch_path(spark, "build")
    catalog.ensure_database(spark, "b7_bronze", f"{root}/b7_bronze")
    paths = seed(spark, f"{root}/bronze_files")
    landed = {n: spark.read.schema(BRONZE[n]).parquet(p) for n, p in paths.items()}
    files.ingest_tables(spark, landed, "b7_bronze", root)
    by_table = run_build(
        spark, None, root, bronze_db="b7_bronze", layers={"silver": "b7_silver", "gold": "b7_gold"},
        run_ts=datetime(2026, 1, 1),
    )
    by_path = run_build(
        spark, f"{root}/bronze_files", root, bronze_db="b8_bronze",
        layers={"silver": "b8_silver", "gold": "b8_gold"}, run_ts=datetime(2026, 1, 1),
    )
    assert {n: rows(df) for n, df in by_table.items()} == {n: rows(df) for n, df in by_path.items()}


def test_point_lookup_reaches_the_scan(spark, layers):
    path = scratch_path(spark, "lookup")
    layers["movies"].write.parquet(path)
    found = spark.read.parquet(path).where(F.col("movie_id") == 2).select("title")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(movie_id,2)" in plan and "ReadSchema: struct<movie_id:bigint,title:string>" in plan


def test_build_sees_what_was_landed_again(spark):
    root = scratch_path(spark, "build")
    dbs = {"silver": "b3_silver", "gold": "b3_gold"}
    build = lambda: run_build(
        spark, f"{root}/bronze_files", root, bronze_db="b3_bronze", layers=dbs
    )
    seed(spark, f"{root}/bronze_files")
    assert build()["gold_movie_analytics"].count() == 30
    more = spark.createDataFrame([(i, f"Film {i}", "Drama") for i in range(40)], BRONZE["movies"])
    files.ingest_full_refresh({"movies": more}, f"{root}/bronze_files")
    assert build()["gold_movie_analytics"].count() == 40


def test_gold_files_have_key_ranges_of_their_own(spark):
    """A lookup by key opens one file, whatever joins made the table."""
    root = scratch_path(spark, "build")
    seed(spark, f"{root}/bronze_files")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        table = run_build(
            spark, f"{root}/bronze_files", root, bronze_db="b4_bronze",
            layers={"silver": "b4_silver", "gold": "b4_gold"},
        )["gold_movie_analytics"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    ranges = sorted(
        (r["low"], r["high"])
        for r in table.groupBy(F.input_file_name())
        .agg(F.min("movie_id").alias("low"), F.max("movie_id").alias("high"))
        .collect()
    )
    assert len(ranges) > 3
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))


def test_null_test_reaches_the_scan(spark):
    path = scratch_path(spark, "nulls")
    spark.createDataFrame([(1, None), (2, 3)], "a int, b int").write.parquet(path)
    found = not_null(spark.read.parquet(path), ["a", "b"])
    assert [(r["a"], r["failed"]) for r in found.collect()] == [(1, "b")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(a),IsNull(b))]" in plan


def test_the_extract_of_a_snapshot_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)
    source = spark.range(0, 10, 1, 1)
    counted = spark.createDataFrame(source.rdd.map(lambda r: (seen.add(1), (r[0],))[1]), "id long")
    root = scratch_path(spark, "snapshot")
    files.land_json_snapshot(counted, root, "2024-01-01")
    assert seen.value == 10
    with pytest.raises(QualityError, match="empty"):
        files.land_json_snapshot(source.where("id < 0"), root, "2024-01-01")
    assert files.read_json_snapshots(spark, root, source.schema).count() == 10
