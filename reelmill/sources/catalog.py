"""Databases and tables in the session catalog."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.quality import Watch


def _quoted(*parts: str) -> str:
    return ".".join("`" + p.replace("`", "``") + "`" for p in parts)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def schema_for(custom: str | None, default: str) -> str:
    """Database of a layer: its own name used verbatim, else the default."""
    return default if custom is None else custom.strip()


def ensure_database(spark: SparkSession, db: str, location: str | None = None) -> None:
    where = f" LOCATION {_literal(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_quoted(db)}{where}")


def register_external(
    spark: SparkSession, db: str, name: str, path: str, schema: StructType
) -> DataFrame:
    """Register files as a table unless it exists already; nothing is copied.

    A table that exists is refreshed, so files landed again since are seen.
    """
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_quoted(db, name)} ({columns}) "
        f"USING parquet LOCATION {_literal(path)}"
    )
    spark.catalog.refreshTable(_quoted(db, name))
    return spark.table(_quoted(db, name))


VERSIONS, ROWS = "published.versions", "published.rows"


def _folder(spark: SparkSession, location: str):
    """A path and its file system, as the session sees them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _property(spark: SparkSession, db: str, name: str, key: str) -> str | None:
    rows = spark.sql(f"SHOW TBLPROPERTIES {_quoted(db, name)}").collect()
    return {r["key"]: r["value"] for r in rows}.get(key)


def published_rows(spark: SparkSession, db: str, name: str) -> int | None:
    """Rows a table had when it was published, counted as they were written."""
    found = _property(spark, db, name, ROWS)
    return None if found is None else int(found)


def published_versions(spark: SparkSession, db: str, name: str) -> list[str]:
    """Folder names of the versions a table was published in, oldest first."""
    listed = _property(spark, db, name, VERSIONS) or ""
    return [v for v in listed.split(",") if v]


@dataclass(frozen=True)
class Version:
    """Rows of a table in a folder of their own, complete but not yet published."""

    spark: SparkSession
    db: str
    name: str
    fmt: str
    schema: StructType
    location: str
    rows: int

    def load(self) -> DataFrame:
        return self.spark.read.format(self.fmt).schema(self.schema).load(self.location)

    def discard(self) -> None:
        path, fs = _folder(self.spark, self.location)
        fs.delete(path, True)


def write_version(
    df: DataFrame,
    db: str,
    name: str,
    *,
    root: str,
    fmt: str = "parquet",
    required: Sequence[str] = (),
    least_rows: int = 0,
    check: Callable[[DataFrame], None] | None = None,
) -> Version:
    """Write the rows of a table to a fresh folder, checked; readers do not see it yet.

    NULLs in ``required`` columns and rows are counted as they are written, ``check``
    gets the written rows.  If anything fails no folder stays behind.
    """
    watch = Watch(name, required, least_rows)
    watched = watch.on(df)
    version = Version(df.sparkSession, db, name, fmt, df.schema, f"{root}/{db}/{name}/v-{uuid.uuid4().hex}", 0)
    try:
        watched.write.format(fmt).mode("errorifexists").save(version.location)
        watch.enforce()
        if check is not None:
            check(version.load())
    except Exception:
        version.discard()
        raise
    return replace(version, rows=watch.rows)


def publish(version: Version) -> DataFrame:
    """Make a written version the table that readers find.

    With the same columns the new location is one change of the catalog.  With other
    columns the new table is made under a name of its own first, then the old one is
    dropped and the new one renamed; should a run break off between these two steps, the
    complete new table is there under ``<name>__next``.
    """
    spark, db, name, location = version.spark, version.db, version.name, version.location
    table = _quoted(db, name)
    exists = spark.catalog.tableExists(table)
    folder = location.rsplit("/", 1)[1]
    versions = ",".join([*(published_versions(spark, db, name) if exists else []), folder])
    noted = f"{_literal(VERSIONS)} = {_literal(versions)}, {_literal(ROWS)} = '{version.rows}'"
    if exists and spark.table(table).schema.simpleString() == version.schema.simpleString():
        spark.sql(f"ALTER TABLE {table} SET LOCATION {_literal(location)}")
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({noted})")
        spark.catalog.refreshTable(table)
        return spark.table(table)
    made = _quoted(db, f"{name}__next") if exists else table
    spark.sql(f"DROP TABLE IF EXISTS {_quoted(db, name + '__next')}")
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in version.schema)
    spark.sql(
        f"CREATE TABLE {made} ({columns}) USING {version.fmt} LOCATION {_literal(location)}"
        f" TBLPROPERTIES ({noted})"
    )
    if exists:
        spark.sql(f"DROP TABLE {table}")
        spark.sql(f"ALTER TABLE {made} RENAME TO {table}")
    return spark.table(table)


def materialize(df: DataFrame, db: str, name: str, *, root: str, **checks) -> DataFrame:
    """Create or replace a table from a query: :func:`write_version`, then :func:`publish`.

    A failed run or check leaves the old table as it was, and a query may read the
    table it replaces.  Old folders stay until :func:`drop_old_versions`.
    """
    return publish(write_version(df, db, name, root=root, **checks))


def table_location(spark: SparkSession, db: str, name: str) -> str:
    detail = spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(db, name)}")
    return detail.where(F.col("col_name") == "Location").first()["data_type"]


def drop_old_versions(spark: SparkSession, db: str, name: str, keep: int = 0) -> int:
    """Delete the folders a table was in before, but for the ``keep`` published last.

    What was never published, by a run that broke off, goes as well.  Whoever still
    reads a dropped folder fails, so keep one while readers may run.  No other run
    may write the same table meanwhile.
    """
    live, fs = _folder(spark, table_location(spark, db, name))
    before = [v for v in published_versions(spark, db, name) if v != live.getName()]
    kept = {live.getName(), *(before[-keep:] if keep else [])}
    old = [
        status.getPath()
        for status in fs.listStatus(live.getParent())
        if status.getPath().getName().startswith("v-") and status.getPath().getName() not in kept
    ]
    for path in old:
        fs.delete(path, True)
    return len(old)


def insert_into(df: DataFrame, db: str, name: str) -> DataFrame:
    """Append rows to an existing table, columns matched by name, and return it."""
    spark = df.sparkSession
    target = spark.table(_quoted(db, name))
    df.select(*target.columns).write.insertInto(_quoted(db, name))
    return spark.table(_quoted(db, name))


def list_tables(spark: SparkSession, db: str) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN {_quoted(db)}").select("namespace", "tableName")


def query_table(
    spark: SparkSession,
    db: str,
    name: str,
    where: Column | None = None,
    order: list | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Scan a table with a predicate, an order and a limit; found by exact name."""
    df = spark.table(_quoted(db, name))
    if where is not None:
        df = df.where(where)
    if order:
        df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)
