"""Sliding-window counter rate over a stream of samples."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.metrics import (
    MICROS,
    bucket_width,
    canonical,
    fold_states,
    point_state,
    rate_of,
)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rate_stream(
    samples: DataFrame,
    range_s: int = 300,
    step: int = 30,
    *,
    delay: str = "1 minute",
    extrapolate: bool = True,
    resolution: int = 60,
    most_samples: int | None = None,
) -> DataFrame:
    """Rate per series over (t - range, t] at every step, emitted when t is closed.

    Two windowed aggregations in a row, as in the batch rate: samples are folded
    into buckets of at most ``resolution`` seconds, closed buckets into ranges.  State is
    the raw samples of the open buckets, plus range / resolution bucket states per series
    and open range.  A bucket may hold ``most_samples`` of a series, by default a hundred
    for each of its seconds, at some 60 bytes each; one with more stops the query, which
    then wants a shorter ``resolution``.

    Spark's windows hold their start and not their end; moving the event time back
    by one microsecond turns them into the (start, end] ranges wanted here.
    """
    width = bucket_width(range_s, step, resolution)
    most = 100 * width if most_samples is None else most_samples
    raw = F.collect_list("point")
    too_many = F.raise_error(F.lit(f"more than {most} samples of a series in {width} seconds"))
    bounded = F.when(F.size(raw) > most, too_many).otherwise(fold_states(F.sort_array(raw)))
    points = samples.select(
        "metric",
        canonical().alias("series"),
        point_state(F.unix_micros("ts"), F.col("value")).alias("point"),
        (F.col("ts") - F.expr("INTERVAL 1 MICROSECOND")).alias("moved"),
    ).withWatermark("moved", delay)
    buckets = (
        points.groupBy("metric", "series", F.window("moved", f"{width} seconds"))
        .agg(bounded.alias("state"))
        .select("metric", "series", "state", F.window_time("window").alias("closed"))
    )
    ranges = (
        buckets.groupBy(
            "metric", "series", F.window("closed", f"{range_s} seconds", f"{step} seconds")
        )
        .agg(fold_states(F.sort_array(F.collect_list("state"))).alias("state"))
        .where(F.col("state.n") >= 2)
    )
    end_us = F.unix_micros("window.end")
    return ranges.select(
        "metric",
        F.map_from_entries("series").alias("labels"),
        F.col("window.end").alias("t"),
        rate_of(F.col("state"), end_us - range_s * MICROS, end_us, extrapolate).alias("value"),
    )


def read_sample_files(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000
) -> DataFrame:
    """A stream over a folder that sample files are added to, oldest first.

    A micro-batch takes ``files_per_batch`` files.  Files must come in time order up to
    the delay of the rate's watermark; :func:`drain` raises where they did not.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


class LateSamples(RuntimeError):
    """Samples came after the watermark had closed their windows, and were dropped."""


def late_rows(query: StreamingQuery) -> int:
    """Rows the watermark dropped, over all micro-batches the query remembers."""
    return sum(
        state.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for state in progress.stateOperators
    )


#: Settings a drained query starts with: state off the heap, and the progress of every
#: micro-batch remembered, as late rows are counted from it.
DRAIN_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.numRecentProgressUpdates": "1000000",
}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def drain(df: DataFrame, out: str, checkpoint: str, late_ok: bool = False) -> StreamingQuery:
    """Process what is there now, append the closed windows to ``out`` and stop.

    Only windows that the watermark has passed are emitted: those still open when the
    files end stay in the state, and come out when a later run on the same checkpoint
    folder has seen later samples.  State is kept in RocksDB and in that folder.

    Rows that came too late are counted over all micro-batches.  If there are any,
    :class:`LateSamples` is raised, as what was written lacks them; with ``late_ok`` the
    caller reads the number from :func:`late_rows` instead.
    """
    with _settings(df.sparkSession, DRAIN_CONF):
        query = (
            df.writeStream.outputMode("append")
            .format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    late = late_rows(query)
    if late and not late_ok:
        raise LateSamples(f"{late} rows came after their windows were closed")
    return query
