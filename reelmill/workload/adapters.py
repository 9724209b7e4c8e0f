"""Bronze shapes derived from the given star-schema tables.

The ratings data the models are made for is not among the given tables, so each
bronze table is a fixed projection of one or two of them, with the odd values the
models must cope with: padding, missing ids, blank tags, out-of-range ratings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import running_number

# Genre by (modulus, remainders) of the part size, and the tag texts.
GENRE_RULES = [
    ("Action", 2, [0]), ("Comedy", 3, [0]), ("Drama", 5, [0, 1]), ("Thriller", 7, [0]),
    ("Romance", 11, [0]), ("Horror", 13, [0]), ("Sci-Fi", 4, [1]), ("Animation", 17, [0]),
    ("War", 6, [1]),
]
TAG_TEXTS = [
    "funny", "  Great acting ", "best movie ever", "BAD plot", "terrible", "love story",
    "action packed", "twist ending", "scary", "so bad it is great", "   ", "Robert De Niro",
    "worst fight", "romantic comedy", "Horror", "amazing plot twist",
]


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(c: str) -> Column:
    """The files hold timestamps without a zone; the session zone is UTC."""
    return F.unix_seconds(F.col(c).cast("timestamp"))


def movies(part: DataFrame) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    year = F.concat(F.lit(" ("), (key % 70 + 1950).cast("string"), F.lit(")"))
    title = F.concat("p_name", F.when(key % 11 == 0, "").otherwise(year))
    listed = F.concat_ws(
        "|", *[F.when((size % m).isin(r), name) for name, m, r in GENRE_RULES]
    )
    return part.select(
        key.alias("movieid"),
        F.when(key % 13 == 0, F.concat(F.lit("  "), title, F.lit(" ")))
        .otherwise(title)
        .alias("title"),
        F.when(key % 53 != 0, F.when(listed == "", "(no genres listed)").otherwise(listed))
        .alias("genres"),
    )


def ratings(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    okey, line, part, cust = map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "o_custkey"))
    movie = F.when(okey % 4 == 0, part % 10).when(okey % 4 == 1, part % 100).otherwise(part)
    # What the join shuffles is what the rating takes from a line, in small numbers.
    lines = lineitem.select(
        "l_orderkey",
        F.when(line == 1, 1).when(line == 2, 2).otherwise(0).alias("side"),
        movie.alias("movieid"),
        F.floor(F.col("l_quantity") / 10).alias("tenth"),
        (epoch("l_shipdate") + (okey * 7919 + line * 3571) % 86400).alias("timestamp"),
    )
    side, tenth = F.col("side"), F.col("tenth")
    user = F.when(side == 1, cust % 10).when(side == 2, cust % 50).otherwise(cust)
    # Some users like whatever they see; the others go by the movie.
    halves = F.when(user % 29 == 0, 8 + tenth % 3).otherwise(tenth + (F.col("movieid") * 5) % 7)
    joined = lines.join(orders.select("o_orderkey", "o_custkey"), okey == F.col("o_orderkey"))
    return joined.select(
        F.when(okey % 97 != 0, user).alias("userid"),
        "movieid",
        F.when(okey % 89 != 0, halves / 2.0).cast("double").alias("rating"),
        "timestamp",
    )


def tags(events: DataFrame) -> DataFrame:
    key = F.col("event_id")
    texts = F.array(*map(F.lit, TAG_TEXTS))
    return events.select(
        F.col("user_id").alias("userid"),
        (key % 200).alias("movieid"),
        F.when(key % 41 != 0, F.element_at(texts, (key % 16 + 1).cast("int"))).alias("tag"),
        epoch("ts").alias("timestamp"),
    )


def links(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    return part.select(
        (key + F.when(key % 101 == 0, 10_000_000).otherwise(0)).alias("movieid"),
        F.when(key % 9 != 0, (key * 901 + 100000).cast("string")).alias("imdbid"),
        F.when(key % 6 != 0, (key * 31 + 5).cast("string")).alias("tmdbid"),
    )


def samples(events: DataFrame) -> DataFrame:
    """Counters that restart at zero every 20 steps; an absent label is an empty one."""

    def label(prefix: str, m: int) -> Column:
        left = F.col("user_id") % m
        return F.when(left == m - 1, "").otherwise(F.concat(F.lit(prefix), left.cast("string")))

    named = events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("metric"),
        label("dag_", 7).alias("dag_id"),
        label("task_", 5).alias("task_id"),
    )
    counted = running_number(
        named, ["metric", "dag_id", "task_id"], ["ts", "event_id"],
        F.date_trunc("hour", F.col("ts")), "n",
    )
    labels = F.create_map(F.lit("dag_id"), "dag_id", F.lit("task_id"), "task_id")
    return counted.select(
        "metric",
        F.map_filter(labels, lambda _, v: v != "").alias("labels"),
        "ts",
        (F.col("n") % 20).cast("double").alias("value"),
    )


# Which dashboard metrics an event of each type reports.
PANEL_METRICS = {
    "signup": [
        "airflow_ti_running", "airflow_ti_queued", "airflow_dagbag_size",
        "airflow_executor_open_slots", "airflow_executor_running_tasks",
        "airflow_executor_queued_tasks",
    ],
    "click": ["airflow_task_duration_sum", "airflow_task_duration_count"],
    "view": [
        "airflow_task_duration", "airflow_operator_successes",
        "airflow_dagrun_duration_success", "airflow_dagrun_duration_success_sum",
        "airflow_dagrun_duration_success_count",
    ],
    "purchase": [
        "airflow_kubernetes_executor_pod_creation_status",
        "airflow_kubernetes_executor_pod_deletion_status",
        "airflow_scheduler_scheduler_loop_duration", "airflow_scheduler_heartbeat",
    ],
    "error": [
        "airflow_dag_processing_last_run_seconds_ago", "airflow_dag_processing_last_duration",
    ],
}
# Label, modulus of the user id, prefix; the last remainder leaves the label out.
PANEL_LABELS = [
    ("dag_id", 7, "dag_"), ("task_id", 5, "task_"), ("operator", 4, "op_"),
    ("executor", 3, "executor_"), ("dag_file", 6, "file_"),
]
QUANTILES = ["0.5", "0.9", "0.99"]


def panel_samples(events: DataFrame) -> DataFrame:
    """Dashboard metrics: each event reports the last digit of its value under a few names."""
    user = F.col("user_id")
    pairs = []
    for name, m, prefix in PANEL_LABELS:
        left = user % m
        pairs += [
            F.lit(name),
            F.when(left == m - 1, "").otherwise(F.concat(F.lit(prefix), left.cast("string"))),
        ]
    quantile = F.element_at(F.array(*map(F.lit, QUANTILES)), (user % 3 + 1).cast("int"))
    metrics = F
    for kind, names in PANEL_METRICS.items():
        metrics = metrics.when(F.col("event_type") == kind, F.array(*map(F.lit, names)))
    return events.select(
        F.explode(metrics).alias("metric"),
        F.map_filter(
            F.create_map(*pairs, F.lit("quantile"), quantile), lambda _, v: v != ""
        ).alias("labels"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.floor("value") % 10).cast("double").alias("value"),
    )


def bronze(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    def table(n: str) -> DataFrame:
        return given(spark, sf_dir, n)

    if name == "movies":
        return movies(table("part"))
    if name == "ratings":
        return ratings(table("lineitem"), table("orders"))
    if name == "tags":
        return tags(table("events"))
    if name == "links":
        return links(table("part"))
    raise KeyError(name)
