import json
from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reelmill.operators.quality import QualityError, Watch, reconcile
from reelmill.schemas import BRONZE, SOURCE
from reelmill.session import scratch_path
from reelmill.sources import catalog, files, jdbc, merge, records
from reelmill.sources.registry import Registry

LINKS = [(1, 500001, 71), (2, 500002, None)]


def local(path: str) -> Path:
    return Path(path.removeprefix("file:"))


def test_full_refresh_widens_types_and_leaves_no_duplicates(spark, rows):
    root = scratch_path(spark, "ingest")
    source = spark.createDataFrame(LINKS, SOURCE["links"])
    for _ in range(2):
        paths = files.ingest_full_refresh({"links": source}, root)
    got = files.read_bronze(spark, root, "links")
    assert got.schema == BRONZE["links"]
    assert rows(got) == [(1, "500001", "71"), (2, "500002", None)]
    assert all(p.name.endswith(".snappy.parquet") for p in local(paths["links"]).glob("*.parquet"))


def test_csv_is_typed_and_strict(spark, rows):
    root = local(scratch_path(spark, "csv"))
    root.mkdir(parents=True)
    (root / "good.csv").write_text('movieid,title,genres\n1,"Seven, again",A|B\n2,"say ""hi""",\n')
    (root / "bad.csv").write_text("movieid,title,genres\nx,y,z\n")
    got = files.read_csv_typed(spark, str(root / "good.csv"), BRONZE["movies"])
    assert rows(got) == [(1, "Seven, again", "A|B"), (2, 'say "hi"', None)]
    with pytest.raises((PySparkException, Py4JJavaError), match="(?i)malformed"):
        files.read_csv_typed(spark, str(root / "bad.csv"), BRONZE["movies"]).collect()


def test_json_snapshots_replace_their_own_date_only(spark, rows):
    root = scratch_path(spark, "json")
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "bid double")
    files.land_json_snapshot(frame(1.0, 2.0), root, "2026-01-01")
    files.land_json_snapshot(frame(3.0), root, "2026-01-02")
    files.land_json_snapshot(frame(4.0, None), root, "2026-01-01")
    schema = frame(1.0).schema
    assert rows(files.read_json_snapshots(spark, root, schema)) == [
        (3.0, "2026-01-02"), (4.0, "2026-01-01"), (None, "2026-01-01")]
    assert rows(files.read_json_snapshots(spark, root, schema, "2026-01-02")) == [(3.0, "2026-01-02")]
    with pytest.raises(QualityError):
        files.land_json_snapshot(frame(), root, "2026-01-03")


def test_json_array_files(spark, rows):
    root = local(scratch_path(spark, "arrays"))
    root.mkdir(parents=True)
    (root / "quotes_2026-01-05.json").write_text(json.dumps([{"bid": "5.1"}, {"bid": "5.2"}], indent=1))
    got = files.read_json_arrays(spark, str(root))
    assert rows(got) == [("5.1", "2026-01-05"), ("5.2", "2026-01-05")]


def test_equi_depth_ranges_take_every_row_once(spark):
    """Half of the rows have keys among a thousandth of the span."""
    ids = [k * 1000 for k in range(500)] + [250_000 + k for k in range(1500)] + [77] * 400 + [None] * 3
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(4)
    ranges = jdbc.equi_depth_predicates(df, "id", 8)
    rows = [df.where(p).count() for p in ranges]
    assert sum(rows) == len(ids) and 5 <= len(ranges) <= 8
    assert max(rows) <= 2 * len(ids) / 8  # even cuts between the bounds put 1,600 in one range
    beyond = spark.createDataFrame([(-5,), (10**9,), (None,)], "id long")
    assert [sum(beyond.where(p).count() for p in ranges)] == [3]
    assert jdbc.equi_depth_predicates(df.limit(0), "id", 8) == ["1 = 1"]
    assert jdbc.equi_depth_predicates(df.where("id = 77"), "id", 4) == ["id < 77 OR id IS NULL", "id >= 77"]


def test_jdbc_options():
    whole = jdbc.jdbc_options("jdbc:x", "t")
    assert whole == {"url": "jdbc:x", "dbtable": "t", "fetchsize": "10000"}
    split = jdbc.jdbc_options("jdbc:x", "t", partition_column="id", bounds=(1, 9), partitions=4)
    assert (split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("1", "9", "4")
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x", "t", partition_column="id")


def test_insert_ignore_keeps_existing_and_first(spark, rows):
    target = spark.createDataFrame([(1, "old")], "k int, v string")
    batch = spark.createDataFrame(
        [(1, "new", 0), (2, "second", 2), (2, "first", 1), (3, "x", 5)], "k int, v string, o int"
    )
    assert rows(merge.insert_ignore(target, batch, ["k"], ["o"])) == [
        (1, "old"), (2, "first"), (3, "x")]


def test_insert_if_absent_keeps_batch_copies(spark, rows):
    target = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    batch = spark.createDataFrame([(1, "a"), (3, "c"), (3, "c"), (2, None)], "k int, v string")
    assert rows(merge.insert_if_absent(target, batch, ["k", "v"])) == [
        (1, "a"), (2, None), (2, None), (3, "c"), (3, "c")]
    assert merge.append(target, batch).count() == 6


def test_records_write_nan_as_null(spark):
    df = spark.createDataFrame([(1, 1.5), (2, float("nan")), (3, None)], "a int, b double")
    assert [json.loads(r[0]) for r in records.to_records(df).collect()] == [
        {"a": 1, "b": 1.5}, {"a": 2, "b": None}, {"a": 3, "b": None}]


def test_schema_routing():
    assert catalog.schema_for(None, "main") == "main"
    assert catalog.schema_for(" gold ", "main") == "gold"


def test_catalog_round_trip(spark, rows):
    root = scratch_path(spark, "wh")
    catalog.ensure_database(spark, "cat_a", f"{root}/cat_a")
    catalog.ensure_database(spark, "cat_a", f"{root}/cat_a")
    first = catalog.materialize(spark.range(3).toDF("x"), "cat_a", "t", root=root)
    again = catalog.materialize(first.where("x > 0"), "cat_a", "t", root=root)
    assert rows(again) == [(1,), (2,)] and rows(spark.table("cat_a.t")) == [(1,), (2,)]
    wider = catalog.materialize(again.selectExpr("x", "'q' AS y"), "cat_a", "t", root=root)
    assert rows(wider) == [(1, "q"), (2, "q")]
    assert catalog.drop_old_versions(spark, "cat_a", "t", keep=1) == 1
    assert catalog.drop_old_versions(spark, "cat_a", "t") == 1
    assert rows(spark.table("cat_a.t")) == [(1, "q"), (2, "q")]
    more = catalog.insert_into(spark.sql("SELECT 'z' AS y, 9L AS x"), "cat_a", "t")
    assert rows(more) == [(1, "q"), (2, "q"), (9, "z")]
    assert rows(catalog.list_tables(spark, "cat_a")) == [("cat_a", "t")]
    found = catalog.query_table(spark, "cat_a", "t", order=["x"], limit=2)
    assert [r["x"] for r in found.collect()] == [1, 2]


def test_failed_check_keeps_the_old_table(spark, rows):
    root = scratch_path(spark, "wh")
    catalog.ensure_database(spark, "cat_b", f"{root}/cat_b")
    catalog.materialize(spark.range(2).toDF("x"), "cat_b", "t", root=root)

    def refuse(df):
        raise QualityError(f"{df.count()} rows")

    with pytest.raises(QualityError, match="5 rows"):
        catalog.materialize(spark.range(5).toDF("x"), "cat_b", "t", root=root, check=refuse)
    assert rows(spark.table("cat_b.t")) == [(0,), (1,)]


def test_refused_runs_cost_no_version(spark, rows):
    """Good, refused, good: the good one before stays for whoever reads it."""
    root = scratch_path(spark, "wh")
    catalog.ensure_database(spark, "cat_c", f"{root}/cat_c")

    def publish(df, check=None):
        table = catalog.materialize(df.toDF("x"), "cat_c", "t", root=root, check=check)
        catalog.drop_old_versions(spark, "cat_c", "t", keep=1)
        return table

    def refuse(df):
        raise QualityError("no")

    publish(spark.range(2))
    reader = spark.read.parquet(catalog.table_location(spark, "cat_c", "t"))
    with pytest.raises(QualityError):
        publish(spark.range(5), refuse)
    spark.range(7).toDF("x").write.parquet(f"{root}/cat_c/t/v-left-behind")
    publish(spark.range(3))
    assert rows(reader) == [(0,), (1,)] and rows(spark.table("cat_c.t")) == [(0,), (1,), (2,)]
    folders = sorted(p.name for p in local(f"{root}/cat_c/t").glob("v-*"))
    assert folders == sorted(catalog.published_versions(spark, "cat_c", "t"))
    wider = publish(spark.range(3).selectExpr("id", "'q' AS y").drop("y"))
    assert rows(wider) == [(0,), (1,), (2,)]


def test_other_columns_replace_a_table(spark, rows):
    root = scratch_path(spark, "wh")
    catalog.ensure_database(spark, "cat_d", f"{root}/cat_d")
    catalog.materialize(spark.range(2).toDF("x"), "cat_d", "t", root=root)
    spark.range(1).write.parquet(f"{root}/left")  # what a run that broke off may leave
    spark.sql(f"CREATE TABLE cat_d.t__next (id LONG) USING parquet LOCATION '{root}/left'")
    got = catalog.materialize(spark.sql("SELECT 'a' AS y"), "cat_d", "t", root=root)
    assert rows(got) == [("a",)] and got.columns == ["y"]
    assert rows(catalog.list_tables(spark, "cat_d")) == [("cat_d", "t")]
    assert len(catalog.published_versions(spark, "cat_d", "t")) == 2


def test_landing_again_is_seen_and_a_failed_one_changes_nothing(spark, rows):
    root = scratch_path(spark, "ingest")
    catalog.ensure_database(spark, "cat_e", f"{root}/db")
    source = spark.createDataFrame(LINKS, SOURCE["links"])

    def land(df):
        files.ingest_full_refresh({"links": df}, root)
        return catalog.register_external(spark, "cat_e", "links", f"{root}/links", BRONZE["links"])

    assert land(source).count() == 2
    assert land(source.where("movieid = 1")).count() == 1
    broken = source.withColumn("movieid", F.raise_error(F.lit("source is gone")).cast("int"))
    with pytest.raises(Exception, match="source is gone"):
        land(broken)
    again = catalog.register_external(spark, "cat_e", "links", f"{root}/links", BRONZE["links"])
    assert rows(again) == [(1, "500001", "71")]
    # A table may be landed from its own files.
    assert land(files.read_bronze(spark, root, "links")).count() == 1


def test_json_arrays_are_bounded(spark, rows):
    root = scratch_path(spark, "arrays")
    df = spark.range(25).selectExpr("id", "if(id < 20, '2024-01-01', '2024-01-02') AS ds")
    files.land_json_arrays(df, root, "q", per_file=8)
    names = [p.name for p in local(root).glob("*.json")]
    assert len(names) > 2 and {n[-15:-5] for n in names} == {"2024-01-01", "2024-01-02"}
    got = files.read_json_arrays(spark, f"{root}/*.json", df.drop("ds").schema)
    assert rows(got) == rows(df)


def test_json_arrays_of_equal_rows_are_bounded(spark):
    root = scratch_path(spark, "arrays")
    df = spark.range(64).selectExpr("'same' AS x", "'2024-01-01' AS ds")
    files.land_json_arrays(df, root, "q", per_file=8)
    sizes = [len(json.loads(p.read_text())) for p in local(root).glob("*.json")]
    assert sum(sizes) == 64 and len(sizes) > 4 and max(sizes) < 24


def test_json_arrays_refuse_rows_without_a_date(spark):
    root = scratch_path(spark, "arrays")
    df = spark.createDataFrame([(1, "2024-01-01"), (2, None)], "id int, ds string")
    with pytest.raises(QualityError, match="q has rows without a date"):
        files.land_json_arrays(df, root, "q", per_file=8)
    assert not local(root).exists()
    files.land_json_arrays(df.limit(0), root, "q", per_file=8)
    assert not list(local(root).glob("*.json"))


def test_rows_and_nulls_are_counted_while_written(spark):
    path = scratch_path(spark, "watched")
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a int, b string")
    watch = Watch("t", ["a", "b"], least_rows=4)
    watch.on(df.repartition(2)).write.parquet(path)
    assert watch.rows == 3
    assert watch.failed() == ["t.not_null(a,b)", "t has 3 rows only"]
    with pytest.raises(QualityError, match=r"failed: t has 3 rows only, t.not_null\(a,b\)"):
        watch.enforce()
    for empty in (df.where("a > 5"), df.limit(0)):
        none = Watch("t", ["a"], least_rows=1)
        none.on(empty).write.parquet(scratch_path(spark, "watched"))
        assert none.rows == 0 and none.failed() == ["t is empty"]


def test_tables_are_ingested_together_and_published_by_location(spark, rows):
    root = scratch_path(spark, "ingest")
    catalog.ensure_database(spark, "ing", f"{root}/ing")
    good = spark.createDataFrame(LINKS, SOURCE["links"])
    movies = spark.createDataFrame([(1, "A", "Drama")], BRONZE["movies"])
    needs = {"movies": ["movieid"], "links": ["movieid"]}
    load = lambda **t: files.ingest_tables(spark, t, "ing", root, required=needs)
    assert load(links=good, movies=movies) == {"links": 2, "movies": 1}
    before = catalog.table_location(spark, "ing", "links")
    reader = spark.table("ing.links")

    broken = spark.createDataFrame([(None, "B", "Drama")], BRONZE["movies"])
    with pytest.raises(QualityError, match=r"movies.not_null\(movieid\)"):
        load(links=good.limit(1), movies=broken)
    assert catalog.table_location(spark, "ing", "links") == before
    assert len(list(local(f"{root}/ing/links").iterdir())) == 1  # no folder stays behind
    assert spark.table("ing.movies").collect() == movies.collect()

    # A source may read what it replaces, and readers of the last version go on.
    load(links=spark.table("ing.links").where("movieid = 1"))
    assert catalog.table_location(spark, "ing", "links") != before
    assert rows(reader) == [(1, "500001", "71"), (2, "500002", None)]
    assert spark.table("ing.links").count() == 1
    assert catalog.published_rows(spark, "ing", "links") == 1
    diff = reconcile({"links": 2, "movies": movies}, {"links": 1, "movies": 1}, spark)
    assert rows(diff) == [("links", 2, 1, 1)]
    assert rows(reconcile({"a": 1, "b": 2}, {"a": 1}, spark)) == [("b", 2, None, 2)]


def test_a_merge_shuffles_only_keys_the_batch_may_have(spark):
    path = scratch_path(spark, "merge")
    spark.range(200_000).selectExpr("id AS k", "'old' AS v").write.parquet(path)
    target = spark.read.parquet(path)
    batch = spark.createDataFrame([(k, "new") for k in [5, 5, 199_999, 300_000, 300_001, 300_001, None]], "k long, v string")
    near = merge.possibly_in(target, ["k"], batch)
    assert {5, 199_999} <= {r["k"] for r in near.collect()} and near.count() < 20
    added = merge.new_by_key(target, batch, ["k"], ["v"])
    assert sorted(((r["k"], r["v"]) for r in added.collect()), key=repr) == [(300_000, "new"), (300_001, "new"), (None, "new")]
    assert merge.key_filter(batch.limit(0), ["k"]).count() == 0
    assert merge.new_by_key(target.limit(0), batch, ["k"], ["v"]).count() == 5
    short = batch.withColumn("k", F.col("k").cast("int"))  # another type, another hash
    assert merge.new_by_key(target, short, ["k"], ["v"]).count() == 3


def test_filter_bits_of_all_words_are_found(spark):
    """Every key of the batch gets through, whichever bit of a long is its own."""
    batch = spark.range(5000).selectExpr("id * 7919 AS k", "cast(id % 3 AS string) AS s")
    near = merge.possibly_in(batch, ["k", "s"], batch)
    assert near.count() == 5000 and near.exceptAll(batch).count() == 0


def test_registry(spark, rows):
    root = scratch_path(spark, "reg")
    files.ingest_full_refresh({"links": spark.createDataFrame(LINKS, SOURCE["links"])}, f"{root}/ds")
    manifest = {"entries": [{"dataPath": "ds/links", "structureFormat": "parquet", "isPartitioned": False}]}
    registry = Registry.from_manifest(json.dumps(manifest))
    assert rows(registry.describe(spark, root)) == [
        ("links", "imdbid", "string", 2), ("links", "movieid", "bigint", 1),
        ("links", "tmdbid", "string", 3)]
    filled = {r["column"]: (r["n_rows"], r["non_null"]) for r in registry.profile(spark, root).collect()}
    assert filled == {"movieid": (2, 2), "imdbid": (2, 2), "tmdbid": (2, 1)}
