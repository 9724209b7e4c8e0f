"""SQL that states each query's result independently, for DuckDB.

``RELATIONS`` are named sub-selects over the given tables.  A query's SQL is its
last select; the relations it mentions, directly or not, go in front as CTEs.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .adapters import GENRE_RULES, PANEL_LABELS, PANEL_METRICS, QUANTILES, TAG_TEXTS
from .lake import LOOKBACK, STEP

GENRES = ["Action", "Comedy", "Drama", "Thriller", "Romance", "Horror", "Sci-Fi",
          "Animation", "Documentary"]
BANDS = ["excelente", "bom", "regular", "ruim"]


def listed(values, sep: str = ", ") -> str:
    return sep.join(values)


def flag(genre: str) -> str:
    return "is_" + genre.lower().replace("-", "")


def any_like(column: str, words: str) -> str:
    return "(" + listed([f"{column} LIKE '%{w}%'" for w in words.split()], " OR ") + ")"


def band_counts() -> str:
    return listed(
        [f"count(*) FILTER (rating_category = '{b.capitalize()}') AS ratings_{b}" for b in BANDS]
    )


def half_up(x: str) -> str:
    return f"round({x}, 2)"


TAG_LIST = "[" + listed([f"'{t}'" for t in TAG_TEXTS]) + "]"
GENRE_CASES = listed(
    [
        f"CASE WHEN p_size % {m} IN ({listed(map(str, left))}) THEN '{name}' END"
        for name, m, left in GENRE_RULES
    ]
)

# Ratings have one decimal, so tenfold sums are exact; a running variance ends a last
# digit off, which shows where the deviation lies on a rounding edge.
TENFOLD = "(rating * 10)::HUGEINT"
SPREAD = half_up(
    f"sqrt((count(*) * sum({TENFOLD} * {TENFOLD}) - sum({TENFOLD}) * sum({TENFOLD}))::DOUBLE"
    " / nullif(count(*) * (count(*) - 1), 0)) / 10"
)

# Thresholds, labels and keywords of the models' results.
CATEGORY = """CASE WHEN rating >= 4.5 THEN 'Excelente' WHEN rating >= 3.5 THEN 'Bom'
  WHEN rating >= 2.5 THEN 'Regular' ELSE 'Ruim' END"""


def sentiment_sql(tag: str) -> str:
    return f"""CASE WHEN {any_like(tag, 'love great best amazing excellent')} THEN 'Positivo'
  WHEN {any_like(tag, 'hate bad worst terrible awful')} THEN 'Negativo' ELSE 'Neutro' END"""


def tag_category_sql(tag: str) -> str:
    return f"""CASE WHEN {any_like(tag, 'funny comedy')} THEN 'Humor'
  WHEN {any_like(tag, 'action fight')} THEN 'Ação'
  WHEN {any_like(tag, 'romantic love')} THEN 'Romance'
  WHEN {any_like(tag, 'scary horror')} THEN 'Terror'
  WHEN {any_like(tag, 'twist plot')} THEN 'Enredo' ELSE 'Outros' END"""


QUALITY_TIER = """CASE WHEN avg_rating >= 4.0 AND total_ratings >= 100 THEN 'Blockbuster'
  WHEN avg_rating >= 3.5 AND total_ratings >= 50 THEN 'Popular'
  WHEN avg_rating >= 3.0 THEN 'Mediano'
  WHEN avg_rating < 3.0 AND total_ratings >= 20 THEN 'Impopular' ELSE 'Pouco Avaliado' END"""
ENGAGEMENT = """CASE WHEN total_ratings >= 1000 THEN 'Alto' WHEN total_ratings >= 100 THEN 'Médio'
  WHEN total_ratings >= 10 THEN 'Baixo' ELSE 'Muito Baixo' END"""
SEGMENT = """CASE WHEN total_ratings >= 500 THEN 'Power User' WHEN total_ratings >= 100
  THEN 'Active' WHEN total_ratings >= 20 THEN 'Regular' ELSE 'Casual' END"""
STYLE = """CASE WHEN avg_rating >= 4.0 THEN 'Generoso' WHEN avg_rating >= 3.0
  THEN 'Equilibrado' ELSE 'Crítico' END"""
CONSISTENCY = """CASE WHEN stddev_rating >= 1.5 THEN 'Polarizado' WHEN stddev_rating >= 1.0
  THEN 'Variado' ELSE 'Consistente' END"""


def score_sql(avg: str, ratings: str, tags: str) -> str:
    return half_up(
        f"coalesce({avg}, 0.0) * 0.4 + least(ln(coalesce({ratings}, 1) + 1), 10.0) * 0.3"
        f" + least(ln(coalesce({tags}, 1) + 1), 5.0) * 0.3"
    )


def trimmed(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


RELATIONS = {
    # bronze
    "b_movies": f"""
SELECT p_partkey AS movieid,
  CASE WHEN p_partkey % 13 = 0 THEN '  ' || titled || ' ' ELSE titled END AS title,
  CASE WHEN p_partkey % 53 <> 0
    THEN coalesce(nullif(concat_ws('|', {GENRE_CASES}), ''), '(no genres listed)') END AS genres
FROM (SELECT *, p_name || CASE WHEN p_partkey % 11 = 0 THEN ''
        ELSE ' (' || (1950 + p_partkey % 70) || ')' END AS titled FROM part)""",
    "b_ratings": """
SELECT CASE WHEN l_orderkey % 97 <> 0 THEN rater END AS userid, movieid,
  CASE WHEN l_orderkey % 89 <> 0 THEN (CASE WHEN rater % 29 = 0
    THEN 8 + floor(l_quantity / 10)::BIGINT % 3
    ELSE floor(l_quantity / 10) + (movieid * 5) % 7 END / 2.0)::DOUBLE END AS rating,
  floor(epoch(l_shipdate))::BIGINT + (l_orderkey * 7919 + l_linenumber * 3571) % 86400
    AS "timestamp"
FROM (SELECT l.*,
  CASE l_linenumber WHEN 1 THEN o_custkey % 10 WHEN 2 THEN o_custkey % 50
    ELSE o_custkey END AS rater,
  CASE l_orderkey % 4 WHEN 0 THEN l_partkey % 10 WHEN 1 THEN l_partkey % 100
    ELSE l_partkey END AS movieid
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)""",
    "b_tags": f"""
SELECT user_id AS userid, event_id % 200 AS movieid,
  CASE WHEN event_id % 41 <> 0 THEN list_extract({TAG_LIST}, event_id % 16 + 1) END AS tag,
  floor(epoch(ts))::BIGINT AS "timestamp" FROM events""",
    "b_links": """
SELECT p_partkey + CASE WHEN p_partkey % 101 = 0 THEN 10000000 ELSE 0 END AS movieid,
  CASE WHEN p_partkey % 9 <> 0 THEN (100000 + p_partkey * 901)::VARCHAR END AS imdbid,
  CASE WHEN p_partkey % 6 <> 0 THEN (p_partkey * 31 + 5)::VARCHAR END AS tmdbid FROM part""",
    # staging
    "t_movies": f"""
SELECT movieid AS movie_id, {trimmed('title')} AS title, {trimmed('genres')} AS genres
FROM b_movies WHERE movieid IS NOT NULL""",
    "t_ratings": """
SELECT userid AS user_id, movieid AS movie_id, rating, "timestamp" AS rating_timestamp
FROM b_ratings WHERE userid + movieid + rating IS NOT NULL""",
    "t_tags": f"""
SELECT userid AS user_id, movieid AS movie_id, {trimmed('tag')} AS tag,
  "timestamp" AS tag_timestamp
FROM b_tags WHERE tag IS NOT NULL AND userid + movieid IS NOT NULL""",
    "t_links": """
SELECT movieid AS movie_id, imdbid AS imdb_id, tmdbid AS tmdb_id FROM b_links
WHERE movieid IS NOT NULL""",
    # silver
    "s_movies": rf"""
SELECT movie_id, title, release_year,
  {trimmed(r"regexp_replace(title, '\s*\(\d{4}\)$', '')")} AS title_clean, genres,
  len(string_split(genres, '|'))::BIGINT AS genres_count,
  {listed([f"instr(genres, '{g}') > 0 AS {flag(g)}" for g in GENRES])},
  (release_year - release_year % 10)::INTEGER AS decade
FROM (SELECT *, TRY_CAST(nullif(regexp_extract(title, '\((\d{{4}})\)$', 1), '') AS INTEGER)
  AS release_year FROM t_movies)""",
    "s_ratings": f"""
SELECT user_id, movie_id, rating, rating_timestamp, dt AS rating_datetime,
  date_trunc('day', dt)::TIMESTAMP AS rating_date,
  date_trunc('month', dt)::TIMESTAMP AS rating_month,
  date_trunc('year', dt)::TIMESTAMP AS rating_year,
  year(dt)::BIGINT AS year, month(dt)::BIGINT AS month,
  isodow(dt)::BIGINT AS day_of_week, hour(dt)::BIGINT AS hour_of_day,
  {CATEGORY} AS rating_category
FROM (SELECT *, make_timestamp(rating_timestamp * 1000000) AS dt FROM t_ratings)
WHERE rating >= 0.5 AND rating <= 5.0""",
    "s_tags": f"""
SELECT user_id, movie_id, low AS tag_normalized, tag AS tag_original, tag_timestamp,
  dt AS tag_datetime, date_trunc('month', dt)::TIMESTAMP AS tag_month, year(dt)::BIGINT AS year,
  {sentiment_sql('low')} AS sentiment, {tag_category_sql('low')} AS tag_category,
  length(tag)::BIGINT AS tag_length
FROM (SELECT *, lower(tag) AS low, make_timestamp(tag_timestamp * 1000000) AS dt FROM t_tags)
WHERE low <> ''""",
    "s_links": """
SELECT movie_id, imdb_id, tmdb_id,
  'https://www.imdb.com/title/tt' || lpad(imdb_id, 7, '0') AS imdb_url,
  'https://www.themoviedb.org/movie/' || tmdb_id AS tmdb_url FROM t_links""",
    # gold
    "movie_ratings": f"""
SELECT movie_id, count(DISTINCT user_id) AS total_users, count(*) AS total_ratings,
  {half_up('avg(rating)')} AS avg_rating, {SPREAD} AS stddev_rating,
  quantile_disc(rating, 0.5) AS rating_median, {band_counts()},
  min(rating_datetime) AS first_rating_date, max(rating_datetime) AS last_rating_date
FROM s_ratings GROUP BY movie_id""",
    "movie_tags": """
SELECT movie_id, count(*) AS total_tags, count(DISTINCT tag_normalized) AS unique_tags,
  count(*) FILTER (sentiment = 'Positivo') AS tags_positivas,
  count(*) FILTER (sentiment = 'Negativo') AS tags_negativas
FROM s_tags GROUP BY movie_id""",
    "g_movie_analytics": f"""
SELECT movie_id, title_clean AS title, release_year, decade, genres, genres_count,
  {listed([flag(g) for g in GENRES[:7]])},
  coalesce(r.total_users, 0) AS total_users, coalesce(r.total_ratings, 0) AS total_ratings,
  avg_rating, stddev_rating, rating_median, {listed([f"ratings_{b}" for b in BANDS])},
  first_rating_date, last_rating_date,
  date_sub('day', first_rating_date, last_rating_date) AS days_active,
  coalesce(t.total_tags, 0) AS total_tags, coalesce(t.unique_tags, 0) AS unique_tags,
  coalesce(t.tags_positivas, 0) AS tags_positivas,
  coalesce(t.tags_negativas, 0) AS tags_negativas,
  {score_sql('avg_rating', 'r.total_ratings', 't.total_tags')} AS popularity_score,
  {QUALITY_TIER.replace('total_ratings', 'r.total_ratings')} AS quality_tier,
  {ENGAGEMENT.replace('total_ratings', 'r.total_ratings')} AS engagement_level
FROM s_movies LEFT JOIN movie_ratings r USING (movie_id) LEFT JOIN movie_tags t USING (movie_id)""",
    "g_user_behavior": f"""
SELECT user_id, total_ratings, movies_rated, avg_rating, stddev_rating,
  {listed([f"ratings_{b}" for b in BANDS])}, first_rating, last_rating,
  date_sub('day', first_rating, last_rating) AS days_active, typical_hour,
  coalesce(total_tags, 0) AS total_tags, coalesce(movies_tagged, 0) AS movies_tagged,
  coalesce(unique_tags, 0) AS unique_tags, {SEGMENT} AS user_segment, {STYLE} AS rating_style,
  {CONSISTENCY} AS rating_consistency
FROM (SELECT user_id, count(*) AS total_ratings, count(DISTINCT movie_id) AS movies_rated,
    {half_up('avg(rating)')} AS avg_rating, {SPREAD} AS stddev_rating,
    {band_counts()}, min(rating_datetime) AS first_rating, max(rating_datetime) AS last_rating,
    quantile_disc(hour_of_day, 0.5) AS typical_hour
  FROM s_ratings GROUP BY user_id)
LEFT JOIN (SELECT user_id, count(*) AS total_tags, count(DISTINCT movie_id) AS movies_tagged,
    count(DISTINCT tag_normalized) AS unique_tags FROM s_tags GROUP BY user_id) USING (user_id)""",
    "genre_names": "SELECT unnest([" + listed([f"'{g}'" for g in GENRES]) + "]) AS genre",
    "movie_genres": listed(
        [f"SELECT movie_id, release_year, '{g}' AS genre FROM s_movies WHERE {flag(g)}"
         for g in GENRES], " UNION ALL "
    ),
    "g_genre_analytics": f"""
SELECT genre, total_ratings, total_movies, total_users, avg_rating, stddev_rating,
  {half_up('total_ratings / nullif(total_movies, 0)')} AS avg_ratings_per_movie,
  {half_up('total_ratings / nullif(total_users, 0)')} AS avg_ratings_per_user
FROM (SELECT genre, count(rating) AS total_ratings,
    count(DISTINCT CASE WHEN rating IS NOT NULL THEN g.movie_id END) AS total_movies,
    count(DISTINCT user_id) AS total_users, {half_up('avg(rating)')} AS avg_rating,
    {SPREAD} AS stddev_rating
  FROM genre_names LEFT JOIN movie_genres g USING (genre)
  LEFT JOIN s_ratings USING (movie_id) GROUP BY genre)""",
    "g_temporal_trends": f"""
SELECT 'monthly' AS trend_type, strftime(rating_month, '%Y-%m') AS period,
  count(*) AS total_ratings, count(DISTINCT user_id) AS active_users,
  count(DISTINCT movie_id) AS movies_rated, {half_up('avg(rating)')} AS avg_rating,
  {band_counts()}, NULL::BIGINT AS hour_or_day
FROM s_ratings WHERE rating_month IS NOT NULL GROUP BY rating_month
UNION ALL BY NAME
SELECT grain AS trend_type, cell::VARCHAR AS period, count(*) AS total_ratings,
  {half_up('avg(rating)')} AS avg_rating, cell AS hour_or_day
FROM (SELECT rating, unnest(['hourly', 'day_of_week']) AS grain,
  unnest([hour_of_day, day_of_week]) AS cell FROM s_ratings) GROUP BY grain, cell""",
    "liked": """
SELECT * FROM g_movie_analytics WHERE avg_rating >= 3.5 AND total_ratings >= 10""",
    "pairs": f"""
SELECT a.movie_id AS source_movie_id, a.title AS source_title,
  b.movie_id AS recommended_movie_id, b.title AS recommended_title,
  b.avg_rating AS recommended_avg_rating, b.total_ratings AS recommended_total_ratings,
  b.popularity_score AS recommended_popularity, a.genres AS source_genres,
  b.genres AS recommended_genres,
  ({listed([f"coalesce((a.{flag(g)} = b.{flag(g)})::INTEGER, 0)" for g in GENRES[:7]], ' + ')})
    AS genre_match_score
FROM g_movie_analytics a JOIN liked b ON a.decade = b.decade AND a.movie_id <> b.movie_id""",
    "g_movie_recommendations": """
SELECT *, 'genre_similarity' AS recommendation_type, row_number() OVER (
    PARTITION BY source_movie_id
    ORDER BY genre_match_score DESC, recommended_popularity DESC, recommended_movie_id
  ) AS recommendation_rank
FROM pairs WHERE genre_match_score >= 3 QUALIFY recommendation_rank <= 10""",
    "g_external_links": f"""
SELECT movie_id, title_clean AS title, release_year, genres, imdb_id, tmdb_id, imdb_url, tmdb_url,
  imdb_id IS NOT NULL AS has_imdb, tmdb_id IS NOT NULL AS has_tmdb,
  CASE count_ids WHEN 2 THEN 'Complete' WHEN 1 THEN 'Partial' ELSE 'Missing' END AS link_status,
  coalesce(total_ratings, 0) AS total_ratings, avg_rating
FROM (SELECT *, (imdb_id IS NOT NULL)::INT + (tmdb_id IS NOT NULL)::INT AS count_ids FROM s_links)
JOIN s_movies USING (movie_id)
LEFT JOIN (SELECT movie_id, count(*) AS total_ratings, {half_up('avg(rating)')} AS avg_rating
  FROM s_ratings GROUP BY movie_id) USING (movie_id)""",
    # metric series
    "samples": """
SELECT metric, dag_id, task_id, ts, (row_number() OVER (
    PARTITION BY metric, dag_id, task_id ORDER BY ts, event_id) % 20)::DOUBLE AS value
FROM (SELECT event_id, ts, event_type AS metric,
  CASE WHEN user_id % 7 < 6 THEN 'dag_' || user_id % 7 ELSE '' END AS dag_id,
  CASE WHEN user_id % 5 < 4 THEN 'task_' || user_id % 5 ELSE '' END AS task_id FROM events)""",
    "grid": f"""
SELECT unnest(generate_series(date_trunc('day', min(ts)), max(ts) + INTERVAL {LOOKBACK} SECOND,
  INTERVAL {STEP} SECOND)) AS t FROM events""",
    "vector": f"""
SELECT metric, dag_id, task_id, t, arg_max(value, ts) AS value
FROM grid JOIN samples ON ts <= t AND ts > t - INTERVAL {LOOKBACK} SECOND
GROUP BY metric, dag_id, task_id, t""",
    "windows": f"""
SELECT metric, dag_id, task_id, t, ts, value,
  lag(value) OVER (PARTITION BY metric, dag_id, task_id, t ORDER BY ts) AS prior
FROM grid JOIN samples ON ts <= t AND ts > t - INTERVAL {LOOKBACK} SECOND""",
    "increases": """
SELECT metric, dag_id, task_id, t, count(*) AS n, arg_min(value, ts) AS first_v,
  epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, epoch_us(t) AS t_us,
  arg_max(value, ts) - arg_min(value, ts)
    + sum(CASE WHEN value < prior THEN prior ELSE 0.0 END) AS increase
FROM windows GROUP BY metric, dag_id, task_id, t HAVING count(*) >= 2""",
}


def panel_label(name: str, m: int, prefix: str) -> str:
    return (
        f"CASE WHEN user_id % {m} < {m - 1} THEN '{prefix}' || user_id % {m} ELSE '' END AS {name}"
    )


PANEL_KEYS = [name for name, _, _ in PANEL_LABELS] + ["quantile"]
QUANTILE = f"list_extract([{listed([repr(q) for q in QUANTILES])}], user_id % 3 + 1) AS quantile"
METRIC_LISTS = listed(
    [f"WHEN '{k}' THEN [{listed([repr(m) for m in names])}]" for k, names in PANEL_METRICS.items()],
    " ",
)
RELATIONS |= {
    "p_samples": f"""
SELECT unnest(CASE event_type {METRIC_LISTS} END) AS metric,
  {listed([panel_label(*p) for p in PANEL_LABELS])}, {QUANTILE}, ts,
  (floor(value)::BIGINT % 10)::DOUBLE AS value FROM events""",
    "p_vector": f"""
SELECT metric, {listed(PANEL_KEYS)}, t, arg_max(value, ts) AS value
FROM grid JOIN p_samples ON ts <= t AND ts > t - INTERVAL {LOOKBACK} SECOND
GROUP BY ALL""",
    "p_windows": f"""
SELECT {listed(PANEL_KEYS)}, t, ts, value,
  lag(value) OVER (PARTITION BY {listed(PANEL_KEYS)}, t ORDER BY ts) AS prior
FROM grid JOIN p_samples ON ts <= t AND ts > t - INTERVAL {LOOKBACK} SECOND
WHERE metric = 'airflow_scheduler_heartbeat'""",
    "p_increases": f"""
SELECT {listed(PANEL_KEYS)}, t, count(*) AS n, arg_min(value, ts) AS first_v,
  epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, epoch_us(t) AS t_us,
  arg_max(value, ts) - arg_min(value, ts)
    + sum(CASE WHEN value < prior THEN prior ELSE 0.0 END) AS increase
FROM p_windows GROUP BY {listed(PANEL_KEYS)}, t HAVING count(*) >= 2""",
}


def stretched_rate(source: str, columns: str) -> str:
    """Extrapolated rate over rows of ``increases``."""
    return f"""
SELECT {columns}, increase * ((sampled + least(CASE WHEN before >= gap * 1.1 THEN gap / 2
    ELSE before END, CASE WHEN increase > 0 AND first_v >= 0
    THEN sampled * (first_v / increase) END)
  + CASE WHEN behind >= gap * 1.1 THEN gap / 2 ELSE behind END) / sampled) / {LOOKBACK} AS value
FROM (SELECT *, sampled / (n - 1) AS gap,
  (first_us - (t_us - {LOOKBACK * 1_000_000})) / 1000000 AS before,
  (t_us - last_us) / 1000000 AS behind
  FROM (SELECT *, (last_us - first_us) / 1000000 AS sampled FROM {source}))"""


IEEE_RATIO = """CASE WHEN den <> 0 THEN num / den WHEN num > 0 THEN 'infinity'::DOUBLE
  WHEN num < 0 THEN '-infinity'::DOUBLE ELSE 'nan'::DOUBLE END"""
# The greatest number; NaN only if there is nothing else.
GREATEST = "coalesce(max(value) FILTER (NOT isnan(value)), max(value))"


class Expected(NamedTuple):
    """A dashboard query, written down apart from the engine's own table."""

    name: str
    shape: str
    metrics: str
    where: str = "true"
    by: str = ""
    legend: str = ""


# The dashboard's queries.  $dag_id is the chosen list.
CHOSEN = "dag_id IN ($dag_id)"
EXPECTED = [
    Expected("running", "sum", "airflow_ti_running", "dag_id <> ''"),
    Expected("queued", "sum", "airflow_ti_queued", "dag_id <> ''"),
    Expected("free_slots", "max", "airflow_executor_open_slots", "executor = ''"),
    Expected("dags_loaded", "max", "airflow_dagbag_size"),
    Expected("tasks_done", "max", "airflow_task_duration_count", "dag_id = '' AND task_id = ''"),
    Expected("operator_successes", "max", "airflow_operator_successes", "operator = ''"),
    Expected("running_over_time", "sum", "airflow_ti_running", "dag_id <> ''", "", "rodando"),
    Expected("queued_over_time", "sum", "airflow_ti_queued", "dag_id <> ''", "", "na fila"),
    Expected("slots_open", "max", "airflow_executor_open_slots", "executor = ''", "", "livres"),
    Expected("slots_running", "max", "airflow_executor_running_tasks", "executor = ''", "",
             "rodando"),
    Expected("slots_queued", "max", "airflow_executor_queued_tasks", "executor = ''", "",
             "na fila"),
    Expected("mean_per_dag", "ratio", "airflow_task_duration_sum airflow_task_duration_count",
             f"dag_id <> '' AND {CHOSEN} AND task_id <> ''", "dag_id", "média {{dag_id}}"),
    Expected("p90_per_dag", "max", "airflow_task_duration",
             f"quantile = '0.9' AND dag_id <> '' AND {CHOSEN}", "dag_id", "p90 {{dag_id}}"),
    Expected("mean_per_task", "ratio", "airflow_task_duration_sum airflow_task_duration_count",
             f"{CHOSEN} AND task_id <> ''", "task_id", "{{task_id}}"),
    Expected("done_per_dag", "sum", "airflow_task_duration_count",
             f"dag_id <> '' AND {CHOSEN} AND task_id <> ''", "dag_id", "{{dag_id}}"),
    Expected("successes_per_operator", "sum", "airflow_operator_successes", "operator <> ''",
             "operator", "{{operator}}"),
    Expected("run_mean", "series_ratio",
             "airflow_dagrun_duration_success_sum airflow_dagrun_duration_success_count",
             "true", "", "média"),
    Expected("run_quantiles", "max", "airflow_dagrun_duration_success", "true", "quantile",
             "p{{quantile}}"),
    Expected("pods_created", "max", "airflow_kubernetes_executor_pod_creation_status", "true", "",
             "criações (acumulado)"),
    Expected("pods_removed", "max", "airflow_kubernetes_executor_pod_deletion_status", "true", "",
             "remoções (acumulado)"),
    Expected("scheduler_loop", "max", "airflow_scheduler_scheduler_loop_duration", "true",
             "quantile", "p{{quantile}}"),
    Expected("heartbeat", "rate", "airflow_scheduler_heartbeat", "true", "", "batimentos/s"),
    Expected("parse_lag", "max", "airflow_dag_processing_last_run_seconds_ago", "dag_file <> ''",
             "dag_file", "{{dag_file}}"),
    Expected("parse_duration", "max", "airflow_dag_processing_last_duration", "true", "quantile",
             "p{{quantile}}"),
]


def panel_sql(panel: Expected, dag_ids: list[str]) -> str:
    chosen = panel.where.replace("$dag_id", listed([repr(d) for d in dag_ids]))

    def one(metric: str, agg: str) -> str:
        by = f", {panel.by}" if panel.by else ""
        value = GREATEST if agg == "max" else "sum(value)"
        return (
            f"SELECT t{by}, {value} AS value FROM p_vector"
            f" WHERE metric = '{metric}' AND {chosen} GROUP BY t{by}"
        )

    if panel.shape == "rate":
        rows = stretched_rate("p_increases", "t")
    elif panel.shape == "series_ratio":
        keys = listed(["t", *PANEL_KEYS])
        num, den = panel.metrics.split()
        rows = f"""SELECT t, {GREATEST} AS value FROM (SELECT t, {IEEE_RATIO} AS value
FROM (SELECT t, x.value AS num, y.value AS den FROM (FROM p_vector WHERE metric = '{num}') x
JOIN (FROM p_vector WHERE metric = '{den}') y USING ({keys}))) GROUP BY t"""
    elif panel.shape == "ratio":
        num, den = (one(m, "sum") for m in panel.metrics.split())
        rows = f"""SELECT t, {panel.by}, {IEEE_RATIO} AS value FROM (
SELECT t, {panel.by}, x.value AS num, y.value AS den FROM ({num}) x JOIN ({den}) y
USING (t, {panel.by}))"""
    else:
        rows = one(panel.metrics, panel.shape)
    legend = f"'{panel.legend}'"
    if panel.by:
        legend = f"replace({legend}, '{{{{{panel.by}}}}}', {panel.by})"
    return f"SELECT '{panel.name}' AS panel, {legend} AS legend, t, value FROM ({rows})"


RATING_KEYS = 'userid, movieid, "timestamp", rating'
TAG_KEYS = 'userid, movieid, "timestamp"'
LINE_KEYS = "l_orderkey, l_linenumber, l_partkey"
RATED_AT = 'make_timestamp("timestamp" * 1000000)'
LOWERED = 'SELECT userid, movieid, lower(tag) AS tag, "timestamp" FROM b_tags'
YEAR = r"nullif(regexp_extract(title, '\((\d{4})\)', 1), '')"


def vector_sum(metric: str, by: str = "") -> str:
    extra = f", {by}" if by else ""
    return (
        f"SELECT t{extra}, sum(value) AS value FROM vector WHERE metric = '{metric}'"
        f" GROUP BY t{extra}"
    )


def filled(dataset: str, columns: str) -> str:
    rows = []
    for i, pair in enumerate(columns.split(), start=1):
        name, kind = pair.split(":")
        rows.append(
            f"SELECT '{dataset}' AS dataset, '{name}' AS \"column\", '{kind}' AS type,"
            f" {i} AS ordinal, count(*) AS n_rows, count(\"{name}\") AS non_null FROM b_{dataset}"
        )
    return listed(rows, " UNION ALL ")


# All four bronze tables, a column that a table lacks being NULL.
BRONZE_ROWS = " UNION ALL BY NAME ".join(
    f"SELECT '{n}' AS dataset, * FROM b_{n}" for n in ("movies", "ratings", "links", "tags")
)

SELECTS = {
    # sources and sinks
    "src_bronze_scan": BRONZE_ROWS,
    "src_register_external": BRONZE_ROWS,
    "src_full_refresh": BRONZE_ROWS,
    "src_csv_load": "FROM b_movies",
    "src_insert_ignore": """
SELECT movieid, 'listed' AS origin FROM b_links UNION ALL
SELECT movieid, 'seen at ' || min("timestamp") AS origin FROM b_ratings
WHERE movieid NOT IN (SELECT movieid FROM b_links) GROUP BY movieid""",
    "src_insert_if_absent": f"""
FROM b_tags UNION ALL
SELECT * FROM ({LOWERED}) n WHERE NOT EXISTS (SELECT 1 FROM b_tags o WHERE o.userid = n.userid
  AND o.movieid = n.movieid AND o.tag = n.tag AND o."timestamp" = n."timestamp")""",
    "src_append": f"FROM b_tags UNION ALL {LOWERED}",
    "src_values": """
SELECT genre, movies FROM genre_names LEFT JOIN (
  SELECT genre, count(*) AS movies
  FROM (SELECT unnest(string_split(genres, '|')) AS genre FROM s_movies) GROUP BY genre
) USING (genre)""",
    "src_json_snapshot": """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS amount, '2024-01-01' AS ds FROM customer
UNION ALL SELECT p_partkey, p_name, p_retailprice, '2024-01-02' FROM part""",
    "src_materialize": "SELECT *, length(title)::BIGINT AS title_length FROM t_movies",
    "src_registry": listed(
        [
            filled("movies", "movieid:bigint title:string genres:string"),
            filled("ratings", "userid:bigint movieid:bigint rating:double timestamp:bigint"),
            filled("links", "movieid:bigint imdbid:string tmdbid:string"),
            filled("tags", "userid:bigint movieid:bigint tag:string timestamp:bigint"),
        ],
        " UNION ALL ",
    ),
    "src_json_arrays": """
SELECT o_orderkey AS id, o_orderpriority AS name, o_totalprice AS amount,
  strftime(o_orderdate, '%Y') || '-01-01' AS ds FROM orders""",
    "src_json_records": """
SELECT to_json(r)::VARCHAR AS record FROM (
  SELECT movie_id, title, release_year, imdb_url, has_imdb, avg_rating,
    CASE WHEN avg_rating >= 3 THEN sign(avg_rating - 3)::DOUBLE END AS margin
  FROM g_external_links) r""",
    "src_insert_select": "FROM b_movies",
    # projections, filters, predicates
    "prj_rename": "SELECT movieid AS movie_id, imdbid AS imdb_id, tmdbid AS tmdb_id FROM b_links",
    "prj_star": "SELECT *, length(title) AS title_length FROM b_movies",
    "prj_literal": """
SELECT hour_of_day, count(*) AS n, 'hourly' AS trend_type FROM s_ratings GROUP BY hour_of_day""",
    "prj_typed_null": """
SELECT day_of_week, count(*) AS total_ratings, NULL::BIGINT AS active_users
FROM s_ratings GROUP BY day_of_week""",
    "prj_prune": "SELECT movie_id, count(*) AS total_ratings FROM s_ratings GROUP BY movie_id",
    "prj_legend": f"""
SELECT t, 'média ' || dag_id AS legend, value FROM ({vector_sum('click', 'dag_id')})""",
    "flt_not_null": "FROM b_ratings WHERE userid + movieid + rating IS NOT NULL",
    "flt_between": "FROM t_ratings WHERE rating >= 0.5 AND rating <= 5.0",
    "flt_not_equal": "FROM t_tags WHERE trim(tag) <> ''",
    "flt_flag": "SELECT movie_id, title_clean FROM s_movies WHERE is_action",
    "flt_threshold": "SELECT movie_id, avg_rating, total_ratings FROM liked",
    "topn_per_group": """
SELECT decade, movie_id, popularity_score, row_number() OVER (
  PARTITION BY decade ORDER BY popularity_score DESC, movie_id) AS rank
FROM g_movie_analytics QUALIFY rank <= 10""",
    "prd_like": f"FROM b_tags WHERE {any_like('lower(tag)', 'love great best')}",
    "prd_null_logic": """
SELECT movie_id, CASE WHEN imdb_id = tmdb_id THEN 1 ELSE 0 END AS is_same,
  CASE WHEN imdb_id <> tmdb_id THEN 1 ELSE 0 END AS is_different FROM s_links""",
    # joins
    "jn_inner": """
SELECT movie_id, user_id, rating, rating_timestamp, title_clean
FROM s_ratings JOIN s_movies USING (movie_id)""",
    "jn_left_agg": """
SELECT movie_id, title_clean, total_ratings, total_tags FROM s_movies
LEFT JOIN (SELECT movie_id, count(*) AS total_ratings FROM s_ratings GROUP BY 1) USING (movie_id)
LEFT JOIN (SELECT movie_id, count(*) AS total_tags FROM s_tags GROUP BY 1) USING (movie_id)""",
    "jn_self_theta": """
SELECT source_movie_id AS movie_id, genre_match_score AS score, count(*) AS n
FROM pairs WHERE genre_match_score >= 3 GROUP BY ALL""",
    "jn_anti": "SELECT movie_id, title_clean FROM s_movies ANTI JOIN s_links USING (movie_id)",
    # aggregation
    "agg_count": "SELECT movie_id, count(*) AS n FROM s_ratings GROUP BY movie_id",
    "agg_count_distinct": """
SELECT year, month, count(DISTINCT user_id) AS active_users,
  count(DISTINCT movie_id) AS movies_rated FROM s_ratings GROUP BY year, month""",
    "agg_avg": f"""
SELECT movie_id, {half_up('avg(rating)')} AS avg_rating FROM s_ratings GROUP BY movie_id""",
    "agg_stddev": f"""
SELECT movie_id, {SPREAD} AS spread FROM s_ratings GROUP BY movie_id""",
    "agg_minmax": """
SELECT user_id, min(rating) AS min_rating, max(rating) AS max_rating
FROM s_ratings GROUP BY user_id""",
    "agg_minmax_ts": """
SELECT user_id, min(rating_datetime) AS first_rating, max(rating_datetime) AS last_rating
FROM s_ratings GROUP BY user_id""",
    "agg_percentile": """
SELECT movie_id, quantile_disc(rating, 0.25) AS p25, quantile_disc(rating, 0.5) AS p50,
  quantile_disc(rating, 0.75) AS p75 FROM s_ratings GROUP BY movie_id""",
    "topn_per_group_any": """
SELECT l_returnflag, l_extendedprice, l_orderkey * 8 + l_linenumber AS line,
  row_number() OVER (PARTITION BY l_returnflag
    ORDER BY l_extendedprice DESC, l_orderkey * 8 + l_linenumber) AS rank
FROM lineitem QUALIFY rank <= 1500""",
    "agg_percentile_any": """
SELECT l_returnflag, quantile_disc(l_extendedprice, 0.05) AS p05,
  quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.99) AS p99
FROM lineitem GROUP BY l_returnflag""",
    "agg_typical_hour": """
SELECT user_id, quantile_disc(hour_of_day, 0.5) AS typical_hour FROM s_ratings GROUP BY user_id""",
    "agg_cond_sum": f"SELECT user_id, {band_counts()} FROM s_ratings GROUP BY user_id",
    "agg_days_active": """
SELECT movie_id, date_sub('day', min(rating_datetime), max(rating_datetime)) AS days_active
FROM s_ratings GROUP BY movie_id""",
    "agg_multi_key": f"""
SELECT rating_month, year, month, count(*) AS total_ratings,
  {half_up('avg(rating)')} AS avg_rating FROM s_ratings GROUP BY rating_month, year, month""",
    "agg_global_empty": f"""
SELECT genre, count(movie_id) AS movies, {half_up('avg(release_year)')} AS mean_year
FROM genre_names LEFT JOIN movie_genres USING (genre) GROUP BY genre""",
    "agg_ratio": f"""
SELECT movie_id, {half_up('total_tags / nullif(total_ratings, 0)')} AS tags_per_rating
FROM g_movie_analytics""",
    "agg_grouping_sets": """
SELECT month, hour_of_day, day_of_week, grouping(month, hour_of_day, day_of_week) AS grain,
  count(*) AS total_ratings
FROM s_ratings GROUP BY GROUPING SETS ((month), (hour_of_day), (day_of_week))""",
    # windows, order, sets
    "win_row_number": """
SELECT quality_tier, movie_id, total_ratings, row_number() OVER (
  PARTITION BY quality_tier ORDER BY total_ratings DESC, movie_id) AS place
FROM g_movie_analytics QUALIFY place <= 5""",
    "ord_sort": """
SELECT movie_id, total_ratings FROM g_movie_analytics ORDER BY total_ratings DESC, movie_id""",
    "ord_topk": """
SELECT movie_id, popularity_score FROM g_movie_analytics
ORDER BY popularity_score DESC, movie_id LIMIT 20""",
    "set_union_all": """
SELECT year, count(*) AS n, 'ratings' AS origin FROM s_ratings GROUP BY year UNION ALL
SELECT year, count(*) AS n, 'tags' AS origin FROM s_tags GROUP BY year""",
    "set_union_padded": """
SELECT 'month' AS grain, month AS value, count(*) AS total, count(DISTINCT user_id) AS users
FROM s_ratings GROUP BY month UNION ALL
SELECT 'hour', hour_of_day, count(*), NULL FROM s_ratings GROUP BY hour_of_day""",
    # scalar functions
    "fn_trim": f"SELECT movieid, {trimmed('title')} AS title FROM b_movies",
    "fn_lower": f"SELECT {TAG_KEYS}, lower(tag) AS tag FROM b_tags",
    "fn_length": f"SELECT {TAG_KEYS}, length(tag) AS tag_length FROM b_tags",
    "fn_concat": "SELECT movieid, 'tt' || imdbid || '-' || tmdbid AS both FROM b_links",
    "fn_concat_op": "SELECT o_orderkey, o_orderstatus || '/' || o_orderpriority AS both FROM orders",
    "fn_lpad": "SELECT movieid, lpad(imdbid, 7, '0') AS padded FROM b_links",
    "fn_split": """
SELECT movieid, generate_subscripts(string_split(genres, '|'), 1) - 1 AS pos,
  unnest(string_split(genres, '|')) AS genre FROM b_movies""",
    "fn_cardinality": """
SELECT movieid, len(string_split(genres, '|')) AS genres_count FROM b_movies""",
    "fn_strpos": "SELECT movieid, strpos(genres, 'Drama') > 0 AS is_drama FROM b_movies",
    "fn_regexp_extract": f"SELECT movieid, {YEAR} AS year FROM b_movies",
    "fn_regexp_replace": r"""
SELECT movieid, regexp_replace(title, '\s*\(\d{4}\)', '') AS title FROM b_movies""",
    "fn_cast": """
SELECT movieid, tmdbid::BIGINT AS tmdb, imdbid::DOUBLE AS imdb, movieid::VARCHAR AS movie
FROM b_links""",
    "fn_try_cast": """
SELECT p_partkey, TRY_CAST(p_type AS INTEGER) AS kind,
  TRY_CAST(string_split(p_brand, '#')[2] AS INTEGER) AS brand FROM part""",
    "fn_from_unixtime": f"SELECT {RATING_KEYS}, {RATED_AT} AS rated_at FROM b_ratings",
    "fn_date_trunc": f"""
SELECT {RATING_KEYS}, date_trunc('day', {RATED_AT})::TIMESTAMP AS day,
  date_trunc('month', {RATED_AT})::TIMESTAMP AS month,
  date_trunc('year', {RATED_AT})::TIMESTAMP AS year FROM b_ratings""",
    "fn_date_parts": f"""
SELECT {RATING_KEYS}, year({RATED_AT}) AS year, month({RATED_AT}) AS month,
  hour({RATED_AT}) AS hour FROM b_ratings""",
    "fn_iso_dow": f"SELECT {RATING_KEYS}, isodow({RATED_AT}) AS day_of_week FROM b_ratings",
    "fn_date_diff": f"""
SELECT {RATING_KEYS}, date_sub('day', {RATED_AT}, TIMESTAMP '2002-01-01 12:00:00') AS days
FROM b_ratings""",
    "fn_decade": f"""
SELECT movieid, ({YEAR}::INTEGER // 10 * 10)::INTEGER AS decade FROM b_movies""",
    "fn_round": f"SELECT {LINE_KEYS}, round(l_extendedprice * l_tax, 2) AS rounded FROM lineitem",
    "fn_ln": f"SELECT {LINE_KEYS}, round(ln(l_quantity + 1), 6) AS ln FROM lineitem",
    "fn_least": f"SELECT {LINE_KEYS}, least(l_extendedprice, 30000.0) AS capped FROM lineitem",
    "fn_coalesce": "SELECT movieid, coalesce(imdbid, tmdbid, 'none') AS any_id FROM b_links",
    "fn_nullif": f"SELECT {LINE_KEYS}, l_tax / nullif(l_discount, 0.0) AS ratio FROM lineitem",
    "fn_arith": f"""
SELECT {LINE_KEYS}, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge,
  l_partkey + l_linenumber * 2 - 1 AS shifted FROM lineitem""",
    "fn_rating_category": f"SELECT {RATING_KEYS}, {CATEGORY} AS category FROM b_ratings",
    "fn_sentiment": f"""
SELECT {TAG_KEYS}, {sentiment_sql('lower(tag)')} AS sentiment FROM b_tags""",
    "fn_tag_category": f"""
SELECT {TAG_KEYS}, {tag_category_sql('lower(tag)')} AS tag_category FROM b_tags""",
    "fn_link_status": """
SELECT movieid, CASE WHEN imdbid IS NULL AND tmdbid IS NULL THEN 'Missing'
  WHEN imdbid IS NULL OR tmdbid IS NULL THEN 'Partial' ELSE 'Complete' END AS link_status
FROM b_links""",
    "fn_tiers": f"""
SELECT user_id, {SEGMENT} AS segment, {STYLE} AS style, {CONSISTENCY} AS consistency,
  {QUALITY_TIER} AS tier, {ENGAGEMENT} AS engagement FROM g_user_behavior""",
    "fn_popularity": f"""
SELECT user_id, {score_sql('avg_rating', 'total_ratings', 'nullif(total_tags, 0)')} AS score
FROM g_user_behavior""",
    "fn_flag_similarity": f"""
SELECT a.movie_id, {listed(
        [f"CASE WHEN a.{flag(g)} = b.{flag(g)} THEN 1 ELSE 0 END" for g in GENRES[:7]], ' + '
    )} AS score
FROM s_movies a JOIN s_movies b ON b.movie_id = a.movie_id + 1""",
    # models
    **{f"stg_{n}": f"FROM t_{n}" for n in ("movies", "ratings", "tags", "links")},
    **{f"silver_{n}": f"FROM s_{n}" for n in ("movies", "ratings", "tags", "links")},
    **{
        f"gold_{n}": f"FROM g_{n}"
        for n in ("movie_analytics", "user_behavior", "genre_analytics", "temporal_trends",
                  "movie_recommendations", "external_links")
    },
    # serving
    "srv_top_movies": "FROM g_movie_analytics ORDER BY total_ratings DESC, movie_id LIMIT 20",
    "srv_movie_by_id": "FROM g_movie_analytics WHERE movie_id = 42",
    "srv_genres": "FROM g_genre_analytics ORDER BY avg_rating DESC NULLS LAST, genre",
    "srv_recommendations": """
FROM g_movie_recommendations WHERE source_movie_id = 42 ORDER BY recommendation_rank LIMIT 10""",
    "srv_trends": "FROM g_temporal_trends ORDER BY period DESC NULLS LAST, trend_type LIMIT 24",
    "srv_top_users": "FROM g_user_behavior ORDER BY total_ratings DESC, user_id LIMIT 20",
    "srv_adhoc": "FROM g_external_links ORDER BY movie_id LIMIT 10",
    # data quality
    "dq_not_null": """
SELECT *, concat_ws(',', CASE WHEN userid IS NULL THEN 'userid' END,
  CASE WHEN movieid IS NULL THEN 'movieid' END, CASE WHEN rating IS NULL THEN 'rating' END)
  AS failed
FROM b_ratings WHERE userid IS NULL OR movieid IS NULL OR rating IS NULL""",
    "dq_unique": """
SELECT userid, movieid, count(*) AS copies FROM b_ratings
WHERE userid IS NOT NULL AND movieid IS NOT NULL GROUP BY userid, movieid HAVING count(*) > 1""",
    "dq_relationships": """
FROM s_links WHERE movie_id NOT IN (SELECT movie_id FROM s_movies)""",
    "dq_reconcile": listed(
        [
            f"""SELECT '{n}' AS table_name, source_rows, target_rows,
  source_rows - target_rows AS diff
FROM (SELECT count(*) AS source_rows FROM b_{n}), (SELECT count(*) AS target_rows FROM s_{n})
WHERE source_rows <> target_rows"""
            for n in ("movies", "ratings", "tags", "links")
        ],
        " UNION ALL ",
    ),
    "dq_constraints": """
SELECT * FROM (
  SELECT 'primary_key' AS kind, 'userid,movieid,timestamp' AS columns, count(*) AS violations
  FROM (SELECT userid, movieid, "timestamp" FROM b_ratings
    WHERE userid IS NOT NULL AND movieid IS NOT NULL AND "timestamp" IS NOT NULL
    GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'foreign_key', 'movieid', count(*) FROM b_ratings
    WHERE movieid NOT IN (SELECT movieid FROM b_movies)
  UNION ALL SELECT 'not_null', 'userid', count(*) FROM b_ratings WHERE userid IS NULL
  UNION ALL SELECT 'not_null', 'movieid', count(*) FROM b_ratings WHERE movieid IS NULL
  UNION ALL SELECT 'not_null', 'timestamp', count(*) FROM b_ratings WHERE "timestamp" IS NULL
  UNION ALL SELECT 'not_null', 'rating', count(*) FROM b_ratings WHERE rating IS NULL
) WHERE violations > 0""",
    # metric series
    "met_instant": "FROM vector",
    "met_label_match": """
FROM samples WHERE metric = 'click' AND task_id = '' AND dag_id IN ('dag_0', 'dag_3')""",
    "met_range": """
FROM samples WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'
""",
    "met_label_values": """
SELECT DISTINCT dag_id FROM samples WHERE metric = 'purchase' AND dag_id <> '' ORDER BY dag_id""",
    "met_sum": vector_sum("view"),
    "met_max": "SELECT t, max(value) AS value FROM vector WHERE metric = 'view' GROUP BY t",
    "met_sum_by": vector_sum("purchase", "dag_id"),
    "met_max_by": """
SELECT t, task_id, max(value) AS value FROM vector WHERE metric = 'error' GROUP BY t, task_id""",
    "met_reduce": f"""
SELECT dag_id, arg_max(value, t) AS last_value, max(value) AS max_value
FROM ({vector_sum('signup', 'dag_id')}) GROUP BY dag_id""",
    "met_ratio_by": f"""
SELECT t, dag_id, {IEEE_RATIO} AS value FROM (SELECT t, dag_id, x.value AS num, y.value AS den
  FROM ({vector_sum('click', 'dag_id')}) x JOIN ({vector_sum('view', 'dag_id')}) y
  USING (t, dag_id))""",
    "met_ratio_max": f"""
SELECT t, {GREATEST} AS value FROM (SELECT t, {IEEE_RATIO} AS value FROM (
  SELECT t, x.value AS num, y.value AS den FROM (FROM vector WHERE metric = 'click') x
  JOIN (FROM vector WHERE metric = 'view') y USING (t, dag_id, task_id))) GROUP BY t""",
    "met_rate": f"""
SELECT metric, dag_id, task_id, t, increase / {LOOKBACK} AS value FROM increases""",
    "met_rate_extrapolated": stretched_rate("increases", "metric, dag_id, task_id, t"),
    "met_dashboard": listed(
        [panel_sql(p, ["dag_0", "dag_2", "dag_5"]) for p in EXPECTED], " UNION ALL "
    ),
    # Ranges are emitted once the watermark, a minute behind, has passed them.
    "str_rate": f"""
SELECT metric, dag_id, task_id, t, increase / {LOOKBACK} AS value FROM increases
WHERE t <= (SELECT max(ts) FROM samples) - INTERVAL 1 MINUTE""",
}


def needed(text: str) -> set[str]:
    return {name for name in RELATIONS if re.search(rf"\b{name}\b", text)}


def full_sql(select: str) -> str:
    names, todo = set(), needed(select)
    while todo:
        names |= todo
        todo = {d for n in todo for d in needed(RELATIONS[n])} - names
    ctes = [f"{n} AS ({body.strip()})" for n, body in RELATIONS.items() if n in names]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + select.strip()


def oracle_sql() -> dict[str, str]:
    return {name: full_sql(select) for name, select in SELECTS.items()}
