"""Helpers the text operators share."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from operator import or_
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often body names it.

    A lambda variable is the only name inside one expression that the optimizer
    will not replace by its definition.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * (len(SPACES) - 1))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def all_of(df: DataFrame) -> list[Column]:
    """All columns by name, whatever characters the names have."""
    return [named(c) for c in df.columns]


def named(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def smallest_hashes(df: DataFrame, group: str, hash_col: str, most: int) -> dict:
    """For each value of ``group`` a hash below which it has at most ``most`` rows, if
    not for copies of a single hash.

    Rows are counted by the first bits of their hash, then by more bits of those in the
    range where the limit falls, until at least half of ``most`` is below it or all 64
    bits are told apart.  No group is sorted or gathered; each round is a scan with a few
    thousand counts per value.  Take rows with a hash *below* the one returned; None is
    above all of them.  ``group`` must have few values.
    """
    width, spread = 12, F.col(hash_col).bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    limits: dict = {}
    # Where the limit falls: bits known so far, their value, rows below.
    open_at = {r[0]: (0, 0, 0) for r in df.select(group).distinct().collect()}
    while open_at:
        bits = next(iter(open_at.values()))[0]
        step = min(width, 64 - bits)
        wanted = [
            F.col(group).eqNullSafe(F.lit(value))
            & (F.shiftrightunsigned(spread, 64 - bits) == known if bits else F.lit(True))
            for value, (_, known, _) in open_at.items()
        ]
        part = F.shiftrightunsigned(spread, 64 - bits - step).bitwiseAND((1 << step) - 1)
        counts: dict = {}
        found = df.where(reduce(or_, wanted)).groupBy(F.col(group).alias("g"), part.alias("p"))
        for value, p, n in found.agg(F.count("*").alias("n")).collect():
            counts.setdefault(value, {})[p] = n
        still = {}
        for value, (_, known, below) in open_at.items():
            ranges = counts.get(value, {})
            p, full = 0, 1 << step
            while p < full and below + ranges.get(p, 0) <= most:
                below += ranges.get(p, 0)
                p += 1
            if p == full and bits == 0:
                limits[value] = None
                continue
            at = (known << step) + p
            if below * 2 >= most or bits + step == 64:
                # The first hash that is not taken, back in signed order; of copies of one
                # hash that are more than ``most`` by themselves, the next one.
                first = (at << (64 - bits - step)) + (below * 2 < most)
                limits[value] = None if first >> 64 else first - (1 << 63)
            else:
                still[value] = (bits + step, at, below)
        open_at = still
    return limits


def held_out(id_col: str) -> Column:
    """Documents no model may learn from: a fifth, by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Rows of one long (with a little company) that a broadcast may hold: some 64 MB built.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else unmarked.

    Counting stops early, so this costs one cheap job.  Unmarked, the join shuffles
    both sides, whatever their size.  Give it written tables: it reads them twice.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: What Spark hands a Python worker at once.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}
_shipped: set[str] = set()


_worker_caches: list = []


def worker_cache(fn: Callable) -> Callable:
    """Keep what ``fn`` returns in the worker, until a task of another operator starts."""
    cached = lru_cache(maxsize=2)(fn)
    _worker_caches.append(cached)
    return cached


def map_arrow(df: DataFrame, fn: Callable, schema, keep: Callable | None = None) -> DataFrame:
    """``df.mapInArrow`` with this package sent along: executors need not have it.

    ``keep`` is the worker cache the function uses; others are emptied.

    Spark's own file server hands the archive out, so the driver may keep it anywhere.
    Batches are bounded in rows and bytes, and with them what a worker holds of texts.
    """
    for key, most in BATCH.items():
        df.sparkSession.conf.set(key, most)
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)

    kept = keep.__name__ if keep else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _leanly(fn, kept, batches)

    # Spark looks these columns up by name, in which a dot has a meaning.
    plain = [c if c.replace("_", "").isalnum() else f"__{k}" for k, c in enumerate(df.columns)]
    return df.toDF(*plain).mapInArrow(run, schema)


def _leanly(fn: Callable, kept: str, batches: Iterator) -> Iterator[pa.RecordBatch]:
    """Runs in a worker, on the caches of the modules that are loaded there."""
    for cached in _worker_caches:
        if cached.__name__ != kept:
            cached.cache_clear()
    try:
        yield from fn(batches)
    finally:
        if not kept:  # else the next task here has use for it
            _give_back()


def _give_back() -> None:
    """Return freed memory to the system: a worker may idle through many stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
