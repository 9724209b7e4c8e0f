"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Results depend on the first two; the others let Spark split skewed partitions
# and pick a broadcast from measured, not estimated, sizes.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_local_roots: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "reelmill") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call sites for error messages cost more than the column calls themselves.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
    )
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Only a local master may do without the setting: there driver and executors
    share one machine, so a temporary folder is visible to all of them.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="reelmill-")
    return _local_roots[app]


_scratch_roots: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other write uses.

    What an application has written under such paths is deleted when its driver ends.
    """
    app = spark.sparkContext.applicationId
    root = f"{shared_root(spark)}/reelmill/{app}"
    if root not in _scratch_roots:
        _scratch_roots.add(root)
        atexit.register(drop_scratch, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession, root: str) -> None:
    """Delete an application's scratch folder and the databases that lie in it."""
    _scratch_roots.discard(root)
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return  # without a session there is no file system to ask
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    inside = fs.makeQualified(path).toUri().getPath()
    for db in spark.catalog.listDatabases():
        if f"{inside}/" in (db.locationUri or ""):
            spark.sql(f"DROP DATABASE IF EXISTS `{db.name}` CASCADE")
    fs.delete(path, True)


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage like ``checkpoint()`` but keeps column pruning, filter
    pushdown and size statistics for whoever reads the result.  ``codec`` compresses
    the files, if not the session's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffles and broadcasts of queries that have ended.

    Spark drops them once the driver's garbage collection finds them unused, which may be
    as late as its heap is full.  Between the steps of a long job they would pile up, in
    the driver's memory and on disk.
    """
    gc.collect()
    spark._jvm.System.gc()
