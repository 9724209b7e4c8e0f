import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from reelmill.operators import metrics
from reelmill.operators.series import split_series
from reelmill.plans import panels
from reelmill.schemas import SAMPLES
from reelmill.session import scratch_path
from reelmill.streaming.rate import (
    LateSamples,
    drain,
    late_rows,
    rate_stream,
    read_sample_files,
)

START = datetime(2026, 1, 1, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def frame(spark, points):
    """Points are (metric, labels, seconds, value)."""
    return spark.createDataFrame([(m, lab, at(s), float(v)) for m, lab, s, v in points], SAMPLES)


def seconds(t: datetime) -> float:
    return (t.replace(tzinfo=timezone.utc) - START).total_seconds()


def random_points(rng, n=400, span=1800):
    used, points = set(), []
    for _ in range(n):
        series = rng.choice([("m", {"a": "1"}), ("m", {"a": "2"}), ("m", {}), ("k", {"a": "1"})])
        s = round(rng.uniform(0, span), 1) if rng.random() < 0.7 else 30 * rng.randint(0, span // 30)
        key = (series[0], str(series[1]), s)
        if key not in used:
            used.add(key)
            points.append((*series, s, rng.randint(0, 40)))
    return points


def by_series(points):
    series = defaultdict(list)
    for metric, labels, s, v in points:
        series[metric, labels.get("a", "")].append((s, float(v)))
    return {k: sorted(v) for k, v in series.items()}


def plain_rate(window, start, end, extrapolate):
    if len(window) < 2:
        return None
    values = [v for _, v in window]
    increase = values[-1] - values[0] + sum(p for p, v in zip(values, values[1:]) if v < p)
    if not extrapolate:
        return increase / (end - start)
    sampled = window[-1][0] - window[0][0]
    gap = sampled / (len(window) - 1)
    before, after = window[0][0] - start, end - window[-1][0]
    if before >= gap * 1.1:
        before = gap / 2
    if increase > 0 and values[0] >= 0:
        before = min(before, sampled * (values[0] / increase))
    if after >= gap * 1.1:
        after = gap / 2
    return increase * (sampled + before + after) / sampled / (end - start)


def result(df):
    return {
        (r["metric"], r["labels"].get("a", ""), seconds(r["t"])): r["value"] for r in df.collect()
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_instant_vector_equals_plain_lookup(spark, seed):
    points = random_points(random.Random(seed), 150)
    got = result(metrics.instant_vector(frame(spark, points), 30, 300))
    want = {}
    for (metric, a), samples in by_series(points).items():
        for t in range(0, 1800 + 300 + 30, 30):
            seen = [v for s, v in samples if t - 300 < s <= t]
            if seen:
                want[metric, a, float(t)] = seen[-1]
    assert got == want


@pytest.mark.parametrize("extrapolate", [False, True])
@pytest.mark.parametrize("range_s,step,resolution", [(300, 30, 60), (300, 60, 20), (90, 60, 60)])
def test_rate_equals_plain_scan(spark, range_s, step, resolution, extrapolate):
    points = random_points(random.Random(range_s + step))
    got = result(
        metrics.rate(frame(spark, points), range_s, step, extrapolate=extrapolate, resolution=resolution)
    )
    want = {}
    for (metric, a), samples in by_series(points).items():
        for t in range(0, 1800 + range_s + step, step):
            window = [(s, v) for s, v in samples if t - range_s < s <= t]
            value = plain_rate(window, t - range_s, t, extrapolate)
            if value is not None:
                want[metric, a, float(t)] = value
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)


def test_rate_by_hand(spark):
    # Every 30 s, one reset: 10 20 30 5 15 -> increase 15 - 10 + 30 = 35 over 120 s.
    points = [("m", {}, 30 * i + 15, v) for i, v in enumerate([10, 20, 30, 5, 15])]
    got = result(metrics.rate(frame(spark, points), 150, 150, extrapolate=False))
    assert got["m", "", 150.0] == pytest.approx(35 / 150)
    stretched = result(metrics.rate(frame(spark, points), 150, 150))
    assert stretched["m", "", 150.0] == pytest.approx(35 * (120 + 15 + 15) / 120 / 150)


def test_one_sample_has_no_rate(spark):
    assert metrics.rate(frame(spark, [("m", {}, 10, 1)]), 300, 30).count() == 0


def test_matchers(spark):
    points = [("m", {"a": "1", "b": ""}, 0, 1), ("m", {"a": "12"}, 0, 2), ("m", {"b": "x"}, 0, 3)]
    df = frame(spark, points)
    values = lambda **k: sorted(r["value"] for r in metrics.match_labels(df, "m", **k).collect())
    assert values(ne={"a": ""}) == [1, 2]
    assert values(eq={"b": ""}) == [1, 2]  # absent and empty are the same
    assert values(regex={"a": "1"}) == [1]  # the whole value must match
    assert values(regex={"a": metrics.selection_regex(["1", "12"])}) == [1, 2]
    assert values(regex={"a": metrics.selection_regex(None)}) == [1, 2, 3]
    assert [r["a"] for r in metrics.label_values(df, "a").collect()] == ["1", "12"]


def test_vector_aggregates_and_ratios(spark):
    points = [
        ("s", {"d": "x", "k": "1"}, 0, 6), ("s", {"d": "x", "k": "2"}, 0, 4), ("s", {"d": "y"}, 0, 1),
        ("c", {"d": "x", "k": "1"}, 0, 2), ("c", {"d": "x", "k": "2"}, 0, 3), ("c", {"d": "y"}, 0, 0),
        ("c", {"d": "z"}, 0, 5),
    ]
    vector = metrics.instant_vector(frame(spark, points), 30, 30)
    num, den = (metrics.match_labels(vector, m) for m in "sc")
    assert {r["d"]: r["value"] for r in metrics.vec_sum(num, ["d"]).collect()} == {"x": 10, "y": 1}
    assert [r["value"] for r in metrics.vec_max(num).collect()] == [6]
    ratio = {r["d"]: r["value"] for r in metrics.ratio_by(num, den, ["d"]).collect()}
    assert ratio == {"x": 2.0, "y": float("inf")}
    series = metrics.ratio_series(num, den)
    assert sorted(r["value"] for r in series.collect()) == [pytest.approx(4 / 3), 3.0, float("inf")]


def test_reducers_and_legend(spark):
    df = spark.createDataFrame(
        [("x", 1, 5.0), ("x", 2, 3.0), ("x", 3, None)], "d string, t int, value double"
    )
    (r,) = metrics.reduce_series(df, ["d"]).collect()
    assert (r["last_value"], r["max_value"]) == (3.0, 5.0)
    texts = {r["legend"] for r in metrics.legend(df, "média {{d}}/{{ t }}!").collect()}
    assert texts == {"média x/1!", "média x/2!", "média x/3!"}
    assert {r["legend"] for r in metrics.legend(df, "").collect()} == {""}


def test_time_range_is_inclusive(spark):
    df = frame(spark, [("m", {}, s, s) for s in (0, 10, 20, 30)])
    got = metrics.time_range(df, F.lit(at(10)), F.lit(at(20)))
    assert sorted(r["value"] for r in got.collect()) == [10, 20]


def panel_points(rng):
    names = sorted({m for p in panels.PANELS for m in p.metrics})
    points = {}
    for _ in range(1500):
        labels = {
            "dag_id": rng.choice(["", "d1", "d2"]), "task_id": rng.choice(["", "t1"]),
            "operator": rng.choice(["", "o1"]), "executor": rng.choice(["", "e1"]),
            "quantile": rng.choice(["0.5", "0.9"]), "dag_file": rng.choice(["", "f"]),
        }
        point = (rng.choice(names), labels, 10 * rng.randint(0, 60), rng.randint(1, 50))
        points[point[0], str(labels), point[2]] = point
    return list(points.values())


@pytest.mark.parametrize("dag_ids", [None, ["d2"]])
def test_dashboard_equals_its_panels(spark, dag_ids):
    samples = frame(spark, panel_points(random.Random(11)))
    vector = metrics.instant_vector(samples, 30, 300).cache()
    together = defaultdict(list)
    for r in panels.run_dashboard(samples, dag_ids=dag_ids).collect():
        together[r["panel"]].append((r["legend"], r["t"], r["value"]))
    assert len(panels.PANELS) == len(together) == 24
    for panel in panels.PANELS:
        alone = panels.run_panel(panel, samples, vector, step=30, dag_ids=dag_ids)
        want = sorted((r["legend"], r["t"], r["value"]) for r in alone.collect())
        assert sorted(together[panel.name]) == want
    vector.unpersist()


def test_dictionary_of_series_gives_what_labels_give(spark, rows):
    """Matching, sums, maxima, ratios and rates by id against those by label maps."""
    rnd = random.Random(21)
    points = [
        (rnd.choice("mn"), {"a": rnd.choice(["1", "2", "12", ""]), "b": rnd.choice(["x", "y"])}, t, float(rnd.randrange(9)))
        for t in range(0, 900, 7)
    ]
    points += [("m", {}, 5, 1.0), ("m", {"a": ""}, 500, float("nan"))]
    samples = frame(spark, points)
    series = split_series(samples, lambda df, _: df)
    assert series.dictionary.count() == len({(m, *sorted((k, v) for k, v in ls.items() if v)) for m, ls, *_ in points})
    assert dict(series.rows.dtypes) == {"id": "bigint", "ts": "timestamp", "value": "double"}
    flat = lambda df: sorted(
        (r["metric"], tuple(sorted(r["labels"].items())), *[repr(x) for x in tuple(r)[2:]]) for r in df.collect()
    )
    empty_gone = samples.withColumn("labels", F.map_filter("labels", lambda _, v: v != ""))
    assert flat(series.flat()) == flat(empty_gone)
    for k in ({"eq": {"a": ""}}, {"ne": {"a": "1"}}, {"regex": {"a": "1|2"}}, {"eq": {"b": "x"}, "regex": {"a": ".*"}}):
        assert flat(series.matching("m", **k).flat()) == flat(metrics.match_labels(empty_gone, "m", **k))
    vector, labelled = series.instant(30, 300), metrics.instant_vector(samples, 30, 300)
    assert flat(vector.flat()) == flat(labelled)
    text = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    for by in ([], ["a"], ["a", "b"], ["absent"]):
        assert text(vector.sum(by)) == text(metrics.vec_sum(labelled, by))
        assert text(vector.max(by)) == text(metrics.vec_max(labelled, by))
    one, two = vector.matching("m"), vector.matching("n")
    slow = metrics.ratio_series(*[metrics.match_labels(labelled, m) for m in "mn"])
    assert text(metrics.vec_max(one.ratio_series(two))) == text(metrics.vec_max(slow))
    assert flat(series.rate(300, 30).flat()) == flat(metrics.rate(samples, 300, 30))
    assert rows(series.label_values("a")) == [("1",), ("12",), ("2",)]
    none = split_series(samples.limit(0), lambda df, _: df)
    assert none.instant(30, 300).sum(["a"]).collect() == []


def test_conditions_are_looked_at_once_per_series(spark):
    path = scratch_path(spark, "points")
    samples = frame(spark, [("m", {"a": str(k % 3)}, k, 1.0) for k in range(300)])
    series = split_series(samples, lambda df, n: (df.write.parquet(f"{path}/{n}"), spark.read.parquet(f"{path}/{n}"))[1])
    found = series.matching("m", regex={"a": "0|1"}).instant(30, 300)
    plan = found.sum(["a"])._jdf.queryExecution().optimizedPlan().toString()
    # No map is in the plan of the points, and no regex over them.
    points = [x for x in plan.splitlines() if "Relation [id" in x and ",ts#" in x]
    assert points and all("labels" not in x for x in points)
    lines = plan.splitlines()
    below = [lines[k + 1] for k, x in enumerate(lines) if "RLIKE" in x]
    assert below and all("Relation [id" in x and "n_points#" in x for x in below)


def test_dashboard_of_a_time_range(spark):
    samples = frame(spark, panel_points(random.Random(12)))
    whole = panels.run_dashboard(samples)
    part = panels.run_dashboard(samples, start=at(400), end=at(550))
    inside = whole.where(F.col("t").between(F.lit(at(400)), F.lit(at(550))))
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(part) == order(inside) != []


@pytest.mark.parametrize("batches", [1, 5])
def test_stream_equals_batch_on_closed_ranges(spark, batches):
    points = sorted(random_points(random.Random(4), 300), key=lambda p: p[2])
    path = scratch_path(spark, "stream-in")
    size = -(-len(points) // batches)
    for i in range(batches):
        frame(spark, points[i * size:(i + 1) * size]).coalesce(1).write.mode("append").parquet(path)
    out = scratch_path(spark, "stream-out")
    rates = rate_stream(
        read_sample_files(spark, path, SAMPLES, files_per_batch=1),
        300, 30, extrapolate=False,
    )
    drain(rates, out, scratch_path(spark, "stream-state"))
    got = result(spark.read.schema(rates.schema).parquet(out))
    batch = result(metrics.rate(frame(spark, points), 300, 30, extrapolate=False))
    closed = {k: v for k, v in batch.items() if k[2] <= points[-1][2] - 60}
    assert closed and got.keys() == closed.keys()
    assert all(got[k] == pytest.approx(closed[k]) for k in closed)


def feed(spark, points, batches):
    """Points in ``batches`` files, written one after the other."""
    path = scratch_path(spark, "stream-in")
    size = -(-len(points) // batches)
    for i in range(batches):
        part = frame(spark, points[i * size:(i + 1) * size])
        part.coalesce(1).write.mode("append").parquet(path)
    return read_sample_files(spark, path, SAMPLES, files_per_batch=1)


def test_files_out_of_order_are_no_silent_loss(spark):
    points = sorted(random_points(random.Random(5), 300), key=lambda p: p[2])
    points = points[len(points) // 2:] + points[:len(points) // 2]
    rates = rate_stream(feed(spark, points, 4), 300, 30, extrapolate=False)
    where = [scratch_path(spark, n) for n in ("out", "state", "out", "state")]
    with pytest.raises(LateSamples, match="rows came after"):
        drain(rates, *where[:2])
    query = drain(rates, *where[2:], late_ok=True)
    assert late_rows(query) > 0


def test_a_bucket_has_a_bound(spark):
    points = [("m", {}, s / 10, s) for s in range(3000)]
    rates = rate_stream(feed(spark, points, 2), 300, 30, most_samples=20)
    with pytest.raises(StreamingQueryException, match="more than 20 samples"):
        drain(rates, scratch_path(spark, "out"), scratch_path(spark, "state"))


NAN = float("nan")


def values_at(df):
    return {r["t"]: r["value"] for r in df.collect()}


def test_max_passes_over_nan_unless_there_is_nothing_else(spark):
    rows = [(1, NAN), (1, 4.0), (2, NAN), (2, NAN), (3, None), (3, -1.0), (4, float("inf")), (4, NAN)]
    df = spark.createDataFrame([(t, {}, v) for t, v in rows], "t int, labels map<string,string>, value double")
    got = values_at(metrics.vec_max(df))
    assert (got[1], got[3], got[4]) == (4.0, -1.0, float("inf")) and got[2] != got[2]
    keyed = df.select(F.lit("k").alias("k"), "t", "value")
    (r,) = metrics.reduce_series(keyed.where("t < 3"), ["k"]).collect()
    assert (r["last_value"], r["max_value"]) == (4.0, 4.0)
    (r,) = metrics.reduce_series(keyed.where("t = 2"), ["k"]).collect()
    assert r["last_value"] != r["last_value"] and r["max_value"] != r["max_value"]


@pytest.mark.parametrize(("counts", "want"), [((2.0, 0.0), 4.0), ((0.0, 0.0), NAN)])
def test_a_task_without_runs_blanks_no_panel(spark, counts, want):
    """8 / 2 beside 0 / 0, and nothing but 0 / 0."""
    points = []
    for task, n in zip("ab", counts):
        points.append((panels.RUN_DURATION[0], {"dag_id": task}, 10, 8.0 if n else 0.0))
        points.append((panels.RUN_DURATION[1], {"dag_id": task}, 10, n))
        points.append(("airflow_dagbag_size", {"dag_id": task}, 10, n if n else NAN))
    got = panels.run_dashboard(frame(spark, points)).collect()
    for name, value in (("run_mean", want), ("dags_loaded", 2.0 if counts[0] else NAN)):
        mine = [r["value"] for r in got if r["panel"] == name]
        assert mine and all(v == value or (v != v and value != value) for v in mine)
