import math
import random
from statistics import median_low

import pytest
from pyspark.sql import functions as F

from reelmill.functions.labels import SIMILARITY_FLAGS
from reelmill.operators import aggregates, joins, ordering, quality, selection, sets, similarity


def test_percentiles_are_exact_and_discrete(spark):
    rng = random.Random(3)
    groups = {k: [rng.randint(1, 10) / 2 for _ in range(rng.randint(1, 40))] for k in range(60)}
    df = spark.createDataFrame(
        [(k, v) for k, vs in groups.items() for v in vs], "k int, v double"
    )
    got = {
        r["k"]: (r["q"], r["h"], r["t"])
        for r in aggregates.percentiles(df, ["k"], "v", q=0.25, h=0.5, t=0.75).collect()
    }
    for k, vs in groups.items():
        ranked = sorted(vs)
        at = lambda p: ranked[max(1, -(-len(vs) * p // 100)) - 1]
        assert got[k] == (at(25), median_low(vs), at(75))


def plain_percentile(values, p):
    order = sorted(values, key=lambda v: (math.isnan(v), v))
    return order[max(1, math.ceil(p * len(order))) - 1]


@pytest.mark.parametrize("few", [1, 30])
def test_percentiles_of_any_column_by_counting_ranges(spark, few):
    rng = random.Random(8)
    inf, nan = float("inf"), float("nan")
    groups = {
        "hot": [rng.gauss(0, 1) * 10 ** rng.randint(-12, 12) for _ in range(3000)],
        "same": [4.5] * 500,
        "ties": [float(rng.randrange(3)) for _ in range(500)],
        "odd": [inf, -inf, nan, 1e308, -1e308, 5e-324, 0.0, 1.0] * 5,
        "one": [7.0],
        None: [rng.random() for _ in range(200)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    points = {"low": 0.0, "q": 0.1, "h": 0.5, "top": 0.999, "all": 1.0}
    got = {r["k"]: r for r in selection.select_percentiles(df, ["k"], "v", few=few, **points).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, p in points.items():
            assert repr(got[k][name]) == repr(plain_percentile(vs, p)), (k, name)


def test_percentiles_of_longs_that_no_double_tells_apart(spark):
    top = 2**63 - 1
    values = [top - k for k in range(300)] + [-top - 1 + k for k in range(300)] + [0] * 7
    df = spark.createDataFrame([(1, v) for v in values], "k int, v long").repartition(3)
    got = selection.select_percentiles(df, ["k"], "v", few=1, a=0.1, b=0.5, c=0.9).first()
    assert tuple(got) == (1, *[sorted(values)[math.ceil(p * len(values)) - 1] for p in (0.1, 0.5, 0.9)])
    assert selection.select_percentiles(df.limit(0), ["k"], "v", a=0.1).collect() == []


@pytest.mark.parametrize("n", [1, 7, 1200])
def test_top_lists_of_any_length(spark, n):
    """Groups with many equal values, with fewer rows than asked for, and a NULL group."""
    rng = random.Random(13)
    rows = [("hot", float(rng.randrange(40)), k, "x") for k in range(4000)]
    rows += [("level", 2.5, 10_000 + k, "x") for k in range(2000)]
    rows += [("few", rng.random(), 20_000 + k, "x") for k in range(5)]
    rows += [(None, float("nan") if k < 3 else rng.random(), 30_000 + k, "x") for k in range(1500)]
    df = spark.createDataFrame(rows, "g string, v double, id long, rank_of string").repartition(6)
    got = selection.top_per_group(df, ["g"], "v", "id", n)
    assert got.columns == ["g", "v", "id", "rank_of", "rank"]
    want = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (not math.isnan(r[1]), -r[1] if r[1] == r[1] else 0, r[2]))
        want += [(g, r[2], k + 1) for k, r in enumerate(own[:n])]
    assert sorted(((r["g"], r["id"], r["rank"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_no_key_is_ordered_as_a_whole(spark):
    """What is put in order has a row per part of a range, however many values there are."""
    df = spark.range(50_000).selectExpr("1 AS k", "id * 0.37 AS v")
    ranges = spark.createDataFrame([(1, "p", 0.0, 18499.63, 50_000, 25_000)], "k0 int, point string, low double, high double, n long, rank long")
    rows = df.select(F.col("k").alias("k0"), "v", F.lit(None).alias("given"))
    narrow = selection._narrowed(rows, ranges, ["k0"], False)
    (r,) = narrow.collect()
    assert r["low"] <= 24_999 * 0.37 <= r["high"] and r["n"] <= 50_000 // (selection.BINS - 4)


def test_moments_match_the_direct_aggregates(spark):
    rng = random.Random(5)
    df = spark.createDataFrame(
        [(rng.randint(0, 20), rng.randint(1, 10) / 2) for _ in range(800)] + [(99, 3.0)],
        "k int, v double",
    )
    direct = df.groupBy("k").agg(
        F.count("*").alias("n"), aggregates.avg2("v").alias("avg"),
        aggregates.stddev2("v").alias("sd"),
    )
    counts = aggregates.value_counts(df, ["k"], ["v"])
    merged = counts.groupBy("k").agg(*aggregates.moments("v", "n")).select(
        "k", "n", aggregates.mean_of_moments().alias("avg"),
        aggregates.stddev_of_moments().alias("sd"),
    )
    assert {r["k"]: r[1:] for r in direct.collect()} == {r["k"]: r[1:] for r in merged.collect()}


def test_labels_without_rows_are_kept(spark, rows):
    stats = spark.createDataFrame([("a", 3)], "label string, n int")
    kept = aggregates.with_all_labels(stats, "label", ["a", "it's"])
    assert set(rows(kept)) == {("a", 3), ("it's", None)}


def test_running_number_equals_row_number(spark):
    rng = random.Random(7)
    df = spark.createDataFrame(
        [(rng.choice("aab"), rng.randint(0, 50), i) for i in range(500)], "k string, at int, id int"
    )
    got = ordering.running_number(df, ["k"], ["at", "id"], F.floor(F.col("at") / 7), "n")
    expected = {}
    for key in "ab":
        ordered = sorted((r["at"], r["id"]) for r in df.collect() if r["k"] == key)
        expected |= {row_id: i for i, (_, row_id) in enumerate(ordered, start=1)}
    assert {r["id"]: r["n"] for r in got.collect()} == expected


def test_rank_top_prunes_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    top = ordering.rank_top(df, ["k"], [F.col("id").desc()], 2)
    assert sorted((r["k"], r["id"], r["rank"]) for r in top.collect()) == [
        (0, 996, 2), (0, 999, 1), (1, 994, 2), (1, 997, 1), (2, 995, 2), (2, 998, 1)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "Final" in plan and "WindowGroupLimit" in plan


def items_frame(spark, rng, n):
    flags = lambda: [rng.choice([True, False]) for _ in SIMILARITY_FLAGS]
    data = []
    for i in range(n):
        known = rng.random() > 0.1
        data.append(
            (i, rng.choice([None, 1980, 1990, 1990]), rng.randint(0, 4) / 2, rng.random() < 0.7,
             *(flags() if known else [None] * len(SIMILARITY_FLAGS)))
        )
    schema = "id int, decade int, pop double, liked boolean, " + ", ".join(
        f"{f} boolean" for f in SIMILARITY_FLAGS
    )
    return data, spark.createDataFrame(data, schema)


def all_pairs(data):
    for a in data:
        for b in data:
            if a[0] != b[0] and a[1] is not None and a[1] == b[1] and b[3]:
                score = sum(x is not None and x == y for x, y in zip(a[4:], b[4:], strict=True))
                if score >= 3:
                    yield a[0], b[0], score, b[2]


@pytest.mark.parametrize("seed,n", [(1, 60), (2, 25), (3, 120), (4, 3)])
def test_best_matches_equal_all_pairs(spark, seed, n):
    data, df = items_frame(spark, random.Random(seed), n)
    got = similarity.best_matches(
        df, df.where("liked"), key="id", block="decade", flags=SIMILARITY_FLAGS,
        popularity="pop", payload=["pop"], min_score=3, k=4,
    )
    expected = {}
    for source, other, score, pop in all_pairs(data):
        expected.setdefault(source, []).append((-score, -pop, other))
    want = {
        (source, rank, other, -score)
        for source, found in expected.items()
        for rank, (score, _, other) in enumerate(sorted(found)[:4], start=1)
    }
    assert {
        (r["id"], r["rank"], r["match"]["candidate"]["id"], r["match"]["score"])
        for r in got.collect()
    } == want


@pytest.mark.parametrize("seed,n", [(5, 80), (6, 10)])
def test_match_counts_equal_all_pairs(spark, seed, n):
    data, df = items_frame(spark, random.Random(seed), n)
    got = similarity.match_counts(
        df, df.where("liked"), key="id", block="decade", flags=SIMILARITY_FLAGS, min_score=3
    )
    want = {}
    for source, _, score, _ in all_pairs(data):
        want[source, score] = want.get((source, score), 0) + 1
    assert {(r["id"], r["score"]): r["n"] for r in got.collect()} == want


def test_anti_and_relationships(spark, rows):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(2,), (2,), (None,)], "k int")
    assert rows(joins.anti(left, right, "k")) == [(1,), (None,)]
    assert rows(joins.relationships(left, "k", right, "k")) == [(1,)]


def test_union_padded_types(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([("q",)], "y string")
    schema = spark.createDataFrame([], "x bigint, y string").schema
    got = sets.union_padded(schema, a, b)
    assert got.schema.simpleString() == "struct<x:bigint,y:string>"
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, None), (None, "q")]


def test_quality_checks(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "k int, v string")
    assert [r["failed"] for r in quality.not_null(df, ["k", "v"]).collect()] == ["k", "k"]
    assert rows(quality.unique(df, "k")) == [(1, 2)]
    parent = spark.createDataFrame([("a",), ("c",)], "name string")
    found = quality.check_constraints(
        df, pk=["k"], fks={"v": (parent, "name")}, required=["v"], unique_sets=[["v"]]
    )
    assert rows(found.select("kind", "columns", "violations")) == [
        ("foreign_key", "v", 2), ("not_null", "k", 2), ("primary_key", "k", 1)]


def test_reconcile_reports_differences_and_missing_tables(spark, rows):
    one, two = spark.range(1).toDF("x"), spark.range(2).toDF("x")
    diff = quality.reconcile({"same": one, "less": two, "gone": one}, {"same": one, "less": one, "new": two})
    assert rows(diff) == [("gone", 1, None, 1), ("less", 2, 1, 1), ("new", None, 2, -2)]


def test_gates_raise(spark):
    empty = spark.createDataFrame([], "x int")
    with pytest.raises(quality.QualityError):
        quality.require_rows(empty)
    quality.enforce({"fine": empty})
    with pytest.raises(quality.QualityError, match="broken"):
        quality.enforce({"fine": empty, "broken": spark.range(1)})
