from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.quality import QualityError, Watch
from ..schemas import BRONZE, conform
from ..session import stage
from .catalog import Version, drop_old_versions, publish, write_version


def read_bronze(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Schema-on-read scan of one bronze table; no inference pass over the files."""
    return spark.read.schema(BRONZE[name]).parquet(f"{root}/{name}")


def ingest_full_refresh(
    tables: Mapping[str, DataFrame],
    root: str,
    schemas: Mapping[str, StructType] = BRONZE,
) -> dict[str, str]:
    """Replace ``<root>/<table>/`` with each table's rows, typed as declared.

    Rows go to a folder beside the table's, which takes its place when they are
    complete: a rerun leaves no duplicates, a failed one the earlier files, and the
    source may read from the path it is written to.  For readers that use paths: between
    two renames a folder is not there.  :func:`ingest_tables` has no such moment.
    """
    paths = {}
    for name, df in tables.items():
        paths[name], fresh = f"{root}/{name}", f"{root}/_next-{name}-{uuid.uuid4().hex}"
        typed = conform(df, schemas[name]) if name in schemas else df
        typed.write.mode("errorifexists").option("compression", "snappy").parquet(fresh)
        replace_folder(typed.sparkSession, fresh, paths[name])
    return paths


def ingest_tables(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    db: str,
    root: str,
    schemas: Mapping[str, StructType] = BRONZE,
    required: Mapping[str, Sequence[str]] | None = None,
    least_rows: int = 0,
) -> dict[str, int]:
    """Replace catalog tables with each table's rows, typed as declared; rows by table.

    All tables are written and checked before the first is published, and publishing
    moves a location in the catalog: no folder is renamed, at no time a table is
    missing, and a failed load leaves every earlier table.  One earlier version is
    kept for queries that still read it.
    """
    versions: list[Version] = []
    try:
        for name, df in tables.items():
            typed = conform(df, schemas[name]) if name in schemas else df
            needs = (required or {}).get(name, ())
            versions.append(
                write_version(typed, db, name, root=root, required=needs, least_rows=least_rows)
            )
    except Exception:
        for version in versions:
            version.discard()
        raise
    for version in versions:
        publish(version)
        drop_old_versions(spark, db, version.name, keep=1)
    return {v.name: v.rows for v in versions}


def replace_folder(spark: SparkSession, fresh: str, place: str) -> None:
    """Put a complete folder in the place of another one, which is deleted.

    Should a run break off between the two renames, the old folder lies beside its place
    with ``-old`` at the end of its name, and the next run replaces what is missing.
    """
    path_type = spark._jvm.org.apache.hadoop.fs.Path
    new, old = path_type(fresh), path_type(place)
    aside = path_type(f"{fresh}-old")
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had_old = fs.exists(old)
    if had_old and not fs.rename(old, aside):
        raise OSError(f"cannot move {place} aside")
    if not fs.rename(new, old):
        if had_old:
            fs.rename(aside, old)
        raise OSError(f"cannot move {fresh} to {place}")
    fs.delete(aside, True)


def read_csv_typed(
    spark: SparkSession, path: str, schema: StructType, multi_line: bool = False
) -> DataFrame:
    """CSV with a header row and declared types; a malformed row fails the job.

    Files are split among tasks unless ``multi_line`` is set, which fields with
    line breaks inside quotes need: then one file is one task.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )


def land_json_snapshot(df: DataFrame, root: str, ds: str) -> None:
    """Land the documents of one logical date; a rerun replaces that date only.

    The extract is worked out once: it is written, counted meanwhile, and only then landed.
    """
    watch = Watch(f"snapshot {ds}", least_rows=1)
    written = stage(watch.on(df), "snapshot")
    watch.enforce()
    (
        written.withColumn("ds", F.lit(ds))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("ignoreNullFields", False)
        .partitionBy("ds")
        .json(root)
    )


def read_json_snapshots(
    spark: SparkSession, root: str, schema: StructType, ds: str | None = None
) -> DataFrame:
    """All landed dates, or one of them (then only its folder is read)."""
    declared = StructType(schema.fields).add("ds", "string")
    df = spark.read.schema(declared).json(root)
    return df if ds is None else df.where(F.col("ds") == ds)


def land_json_arrays(df: DataFrame, root: str, name: str, per_file: int) -> None:
    """Land rows as files ``<name>-<part>_<ds>.json`` that each hold one JSON array.

    A date has as many files as its rows need at about ``per_file`` each, so no array
    grows with the data, be all its rows equal.  Rows without a date have no file they
    could go to: they are refused before anything is landed.
    """
    values = F.struct(*[c for c in df.columns if c != "ds"])
    # The number of a row is kept with it, so that a task run again deals it alike.
    watch = Watch(f"{name}, by date", required=["ds"])
    dealt = stage(
        watch.on(
            df.select("ds", values.alias("row")).withColumn(
                "turn", F.xxhash64("row", F.monotonically_increasing_id())
            )
        ),
        "arrays",
    )
    if watch.failed():
        raise QualityError(f"{name} has rows without a date (ds)")
    counts = dealt.groupBy("ds").agg(F.ceil(F.count("*") / per_file).alias("files"))
    fresh = f"{root}/_arrays"
    (
        dealt.join(F.broadcast(counts), "ds")  # a row per date
        .groupBy("ds", F.pmod("turn", "files").alias("part"))
        .agg(F.to_json(F.collect_list("row")).alias("value"))
        .write.partitionBy("ds", "part")
        .text(fresh)
    )
    spark = df.sparkSession
    path_type = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_type(fresh).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(path_type(f"{fresh}/ds=*/part=*/part-*")):
        part, ds = status.getPath().getParent(), status.getPath().getParent().getParent()
        dated = f"{name}-{part.getName()[5:]}_{ds.getName()[3:]}.json"
        fs.rename(status.getPath(), path_type(f"{root}/{dated}"))
    fs.delete(path_type(fresh), True)


def read_json_arrays(
    spark: SparkSession, path: str, schema: StructType | None = None
) -> DataFrame:
    """Files that each hold one JSON array, with the date their name ends on."""
    reader = spark.read.option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    ds = F.regexp_extract(F.col("_metadata.file_name"), r"_(\d{4}-\d{2}-\d{2})\.json$", 1)
    return reader.json(path).withColumn("ds", ds)
