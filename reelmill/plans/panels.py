"""The monitoring dashboard as data: one entry per query, evaluated by shape."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import float_divide
from ..operators.metrics import (
    greatest,
    label,
    label_values,
    legend,
    match_labels,
    rate,
    ratio_by,
    ratio_series,
    selection_regex,
    vec_max,
    vec_sum,
)
from ..operators.series import Series, Vector, split_series
from ..operators.sets import union_all
from ..session import stage


@dataclass(frozen=True)
class Panel:
    name: str
    shape: str
    metrics: tuple[str, ...]
    by: str | None = None
    legend: str = ""
    present: tuple[str, ...] = ()
    absent: tuple[str, ...] = ()
    quantile: str | None = None
    selectable: bool = False  # narrowed by the dashboard's DAG variable


RATE_RANGE = 300
VARIABLE = ("airflow_task_duration", "dag_id")

# Metric names, label conditions and legends of the dashboard.
DURATION = ("airflow_task_duration_sum", "airflow_task_duration_count")
RUN_DURATION = ("airflow_dagrun_duration_success_sum", "airflow_dagrun_duration_success_count")
PANELS = [
    Panel("running", "sum", ("airflow_ti_running",), present=("dag_id",)),
    Panel("queued", "sum", ("airflow_ti_queued",), present=("dag_id",)),
    Panel("free_slots", "max", ("airflow_executor_open_slots",), absent=("executor",)),
    Panel("dags_loaded", "max", ("airflow_dagbag_size",)),
    Panel("tasks_done", "max", DURATION[1:], absent=("dag_id", "task_id")),
    Panel("operator_successes", "max", ("airflow_operator_successes",), absent=("operator",)),
    Panel("running_over_time", "sum", ("airflow_ti_running",), legend="rodando",
          present=("dag_id",)),
    Panel("queued_over_time", "sum", ("airflow_ti_queued",), legend="na fila",
          present=("dag_id",)),
    Panel("slots_open", "max", ("airflow_executor_open_slots",), legend="livres",
          absent=("executor",)),
    Panel("slots_running", "max", ("airflow_executor_running_tasks",), legend="rodando",
          absent=("executor",)),
    Panel("slots_queued", "max", ("airflow_executor_queued_tasks",), legend="na fila",
          absent=("executor",)),
    Panel("mean_per_dag", "ratio", DURATION, by="dag_id", legend="média {{dag_id}}",
          present=("dag_id", "task_id"), selectable=True),
    Panel("p90_per_dag", "max", ("airflow_task_duration",), by="dag_id",
          legend="p90 {{dag_id}}", present=("dag_id",), quantile="0.9", selectable=True),
    Panel("mean_per_task", "ratio", DURATION, by="task_id", legend="{{task_id}}",
          present=("task_id",), selectable=True),
    Panel("done_per_dag", "sum", DURATION[1:], by="dag_id", legend="{{dag_id}}",
          present=("dag_id", "task_id"), selectable=True),
    Panel("successes_per_operator", "sum", ("airflow_operator_successes",), by="operator",
          legend="{{operator}}", present=("operator",)),
    Panel("run_mean", "series_ratio", RUN_DURATION, legend="média"),
    Panel("run_quantiles", "max", ("airflow_dagrun_duration_success",), by="quantile",
          legend="p{{quantile}}"),
    Panel("pods_created", "max", ("airflow_kubernetes_executor_pod_creation_status",),
          legend="criações (acumulado)"),
    Panel("pods_removed", "max", ("airflow_kubernetes_executor_pod_deletion_status",),
          legend="remoções (acumulado)"),
    Panel("scheduler_loop", "max", ("airflow_scheduler_scheduler_loop_duration",),
          by="quantile", legend="p{{quantile}}"),
    Panel("heartbeat", "rate", ("airflow_scheduler_heartbeat",), legend="batimentos/s"),
    Panel("parse_lag", "max", ("airflow_dag_processing_last_run_seconds_ago",),
          by="dag_file", legend="{{dag_file}}", present=("dag_file",)),
    Panel("parse_duration", "max", ("airflow_dag_processing_last_duration",), by="quantile",
          legend="p{{quantile}}"),
]


def _matching(samples: DataFrame, panel: Panel, metric: str, dag_ids) -> DataFrame:
    equal = dict.fromkeys(panel.absent, "")
    if panel.quantile is not None:
        equal["quantile"] = panel.quantile
    return match_labels(
        samples,
        metric,
        eq=equal,
        ne=dict.fromkeys(panel.present, ""),
        regex={"dag_id": selection_regex(dag_ids)} if panel.selectable else None,
    )


def run_panel(
    panel: Panel,
    samples: DataFrame,
    vector: DataFrame,
    *,
    step: int,
    dag_ids: Iterable[str] | None = None,
    rate_range: int = RATE_RANGE,
) -> DataFrame:
    """One dashboard query as rows (panel, legend, t, value).

    ``vector`` is the instant vector of ``samples``, shared by the panels.
    """
    dag_ids = None if dag_ids is None else list(dag_ids)

    def vectors() -> list[DataFrame]:
        return [_matching(vector, panel, m, dag_ids) for m in panel.metrics]

    by = [panel.by] if panel.by else []
    shapes: dict[str, Callable[[], DataFrame]] = {
        "sum": lambda: vec_sum(*vectors(), by),
        "max": lambda: vec_max(*vectors(), by),
        "ratio": lambda: ratio_by(*vectors(), by),
        "series_ratio": lambda: vec_max(ratio_series(*vectors())),
        "rate": lambda: rate(
            _matching(samples, panel, panel.metrics[0], dag_ids), rate_range, step
        ),
    }
    rows = shapes[panel.shape]()
    return legend(rows, panel.legend).select(
        F.lit(panel.name).alias("panel"), "legend", "t", "value"
    )


GROUPED = ("sum", "max", "ratio")


def _conditions(panel: Panel, metric: str, dag_ids: list[str] | None) -> Column:
    test = F.col("metric") == metric
    for name in panel.present:
        test = test & (label(name) != "")
    for name in panel.absent:
        test = test & (label(name) == "")
    if panel.quantile is not None:
        test = test & (label("quantile") == panel.quantile)
    if panel.selectable and dag_ids is not None:
        test = test & label("dag_id").isin(dag_ids)
    return test


def _grouped_panels(
    vector: Vector, panels: list[Panel], dag_ids: list[str] | None
) -> DataFrame:
    """All sum, max and ratio panels from one scan and one shuffle of the vector.

    Which panels a series belongs to, and under which key, is settled once per series;
    a ratio has its numerator in slot 0 and its denominator in slot 1 of the same group.
    Values are grouped by time and number of the group.
    """
    entries = [
        F.when(
            _conditions(p, metric, dag_ids),
            F.struct(
                F.lit(p.name).alias("panel"),
                (label(p.by) if p.by else F.lit("")).alias("key"),
                F.lit(slot).alias("slot"),
            ),
        )
        for p in panels
        for slot, metric in enumerate(p.metrics)
    ]
    used = sorted({m for p in panels for m in p.metrics})
    placed = (
        vector.dictionary.where(F.col("metric").isin(used))
        .select("id", F.explode(F.array_compact(F.array(*entries))).alias("entry"))
        .select("id", "entry.*")
    )
    # A group's number: that of its panel, and the smallest series in it.
    numbers = F.create_map(*[F.lit(x) for k, p in enumerate(panels) for x in (p.name, k)])
    names = placed.groupBy("panel", "key").agg(F.min("id").alias("group"))
    names = names.withColumn("of", numbers[F.col("panel")])
    group_of = placed.join(names, ["panel", "key"]).select("id", "of", "group", "slot")
    in_slot = [F.when(F.col("slot") == i, F.col("value")) for i in (0, 1)]
    groups = (
        vector.rows.join(group_of, "id")
        .groupBy("t", "of", "group")
        .agg(
            F.sum(in_slot[0]).alias("total"),
            greatest(in_slot[0]).alias("greatest"),
            F.sum(in_slot[1]).alias("divisor"),
        )
        .join(names, ["of", "group"])
    )
    shape = {kind: [p.name for p in panels if p.shape == kind] for kind in GROUPED}
    is_ratio = F.col("panel").isin(shape["ratio"])
    value = (
        F.when(F.col("panel").isin(shape["max"]), F.col("greatest"))
        .when(is_ratio, float_divide("total", "divisor"))
        .otherwise(F.col("total"))
    )
    text = F
    for p in panels:
        before, _, after = p.legend.partition("{{" + (p.by or "") + "}}")
        filled = F.concat(F.lit(before), F.col("key"), F.lit(after)) if p.by else F.lit(p.legend)
        text = text.when(F.col("panel") == p.name, filled)
    matched = F.col("total").isNotNull() & (~is_ratio | F.col("divisor").isNotNull())
    return groups.where(matched).select(
        "panel", text.alias("legend"), "t", value.alias("value")
    )


def run_dashboard(
    samples: DataFrame | Series,
    vector: Vector | None = None,
    *,
    step: int = 30,
    lookback: int = 300,
    dag_ids: Iterable[str] | None = None,
    rate_range: int = RATE_RANGE,
    start: datetime | None = None,
    end: datetime | None = None,
    panels: list[Panel] = PANELS,
) -> DataFrame:
    """All panels, over the whole samples or from ``start`` to ``end``.

    Samples with labels are split into a dictionary of series and points first.  The
    panels share one instant vector: ``vector`` if given, else it is worked out and
    stored first.
    """
    used = sorted({m for p in panels for m in p.metrics})
    if isinstance(samples, DataFrame):
        samples = split_series(samples.where(F.col("metric").isin(used)), stage, "dashboard")
    else:
        samples = Series(samples.dictionary.where(F.col("metric").isin(used)), samples.rows)
    points = samples.rows
    if start is not None:
        reach = timedelta(seconds=max(lookback, rate_range))
        points = points.where(F.col("ts") > F.lit(start - reach))
    if end is not None:
        points = points.where(F.col("ts") <= F.lit(end))
    samples = Series(samples.dictionary, points)
    if vector is None:
        instant = samples.instant(step, lookback)
        vector = Vector(instant.dictionary, stage(instant.rows, "vector"))
    dag_ids = None if dag_ids is None else list(dag_ids)
    grouped = [p for p in panels if p.shape in GROUPED]
    single = [
        _single_panel(p, samples, vector, step, dag_ids, rate_range)
        for p in panels
        if p.shape not in GROUPED
    ]
    rows = union_all(_grouped_panels(vector, grouped, dag_ids), *single)
    if start is not None:
        rows = rows.where(F.col("t") >= F.lit(start))
    return rows if end is None else rows.where(F.col("t") <= F.lit(end))


def _single_panel(
    panel: Panel, samples: Series, vector: Vector, step: int, dag_ids, rate_range: int
) -> DataFrame:
    """A panel that is no plain grouping, over the dictionary of series."""
    given = samples if panel.shape == "rate" else vector
    own = [
        type(given)(found, given.rows.join(found.select("id"), "id", "left_semi"))
        for found in (_matching(given.dictionary, panel, m, dag_ids) for m in panel.metrics)
    ]
    if panel.shape == "rate":
        rows = own[0].rate(rate_range, step).flat()
    else:
        rows = vec_max(own[0].ratio_series(own[1]))
    return legend(rows, panel.legend).select(
        F.lit(panel.name).alias("panel"), "legend", "t", "value"
    )


def dag_choices(samples: DataFrame) -> DataFrame:
    """Values the dashboard's DAG variable offers."""
    metric, name = VARIABLE
    return label_values(samples, name, metric)
