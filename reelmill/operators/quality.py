"""Data-quality checks.  Each returns the violations; no rows means it passed."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .joins import relationships
from .sets import union_all


class QualityError(RuntimeError):
    pass


class Watch:
    """Counts the rows of a table, and NULLs in required columns, while it is written.

    The counts come with the job that writes: no scan is started for them.  Watch what
    is written last, right before the write, so that a task that is run again after an
    executor was lost counts once.
    """

    def __init__(self, what: str, required: Sequence[str] = (), least_rows: int = 0):
        self.what, self.required, self.least_rows = what, list(required), least_rows
        self._seen = Observation(f"{what}-{uuid.uuid4().hex}")

    def on(self, df: DataFrame) -> DataFrame:
        """``df``, watched; use what is returned in one action."""
        nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{k}") for k, c in enumerate(self.required)]
        return df.observe(self._seen, F.count("*").alias("rows"), *nulls)

    @property
    def rows(self) -> int:
        """Rows written.  Waits for the write; ask after it has succeeded."""
        # A plan that Spark knows to be empty is not run, and nothing is seen of it.
        return self._seen.get.get("rows", 0)

    def failed(self) -> list[str]:
        """Names of the checks that what was written breaks."""
        seen = self._seen.get
        broken = [c for k, c in enumerate(self.required) if seen.get(f"null_{k}", 0) > 0]
        return [f"{self.what}.not_null({','.join(broken)})"] * bool(broken) + [
            f"{self.what} is empty" if not self.rows else f"{self.what} has {self.rows} rows only"
        ] * (self.rows < self.least_rows)

    def enforce(self) -> None:
        enforce({}, self)


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a NULL in any of ``columns``, and which ones those are."""
    if not columns:
        return df.limit(0).withColumn("failed", F.lit(""))
    any_null = reduce(or_, [F.col(c).isNull() for c in columns])  # a test the scan can prune by
    failed = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    return df.where(any_null).withColumn("failed", failed)


def unique(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once; NULL keys are not compared."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return (
        df.dropna(subset=keys)
        .groupBy(*keys)
        .agg(F.count("*").alias("copies"))
        .where(F.col("copies") > 1)
    )


def reconcile(
    source: Mapping[str, DataFrame | int],
    target: Mapping[str, DataFrame | int],
    spark: SparkSession | None = None,
) -> DataFrame:
    """Row counts per table on both sides, where they differ or a side is missing.

    A side may be a count that was taken while the table was written; then it is not
    scanned.  If all are counts, ``spark`` makes the result.
    """
    frames = [t for t in (*source.values(), *target.values()) if isinstance(t, DataFrame)]
    session = frames[0].sparkSession if frames else spark

    def counts(tables: Mapping[str, DataFrame | int], name: str) -> DataFrame:
        known = [(t, n) for t, n in tables.items() if not isinstance(n, DataFrame)]
        return union_all(
            session.createDataFrame(known, f"table_name string, {name} long"),
            *[
                df.agg(F.count("*").alias(name)).select(F.lit(t).alias("table_name"), name)
                for t, df in tables.items()
                if isinstance(df, DataFrame)
            ],
        )

    diff = F.coalesce("source_rows", F.lit(0)) - F.coalesce("target_rows", F.lit(0))
    return (
        counts(source, "source_rows")
        .join(counts(target, "target_rows"), "table_name", "full")
        .withColumn("diff", diff)
        .where(
            (F.col("diff") != 0) | F.col("source_rows").isNull() | F.col("target_rows").isNull()
        )
    )


def check_constraints(
    df: DataFrame,
    *,
    pk: Sequence[str] = (),
    fks: Mapping[str, tuple[DataFrame, str]] | None = None,
    required: Sequence[str] = (),
    unique_sets: Sequence[Sequence[str]] = (),
) -> DataFrame:
    """Source constraints re-checked on landed data: one row per broken constraint."""

    def broken(kind: str, columns: Sequence[str], violations: DataFrame) -> DataFrame:
        return violations.agg(F.count("*").alias("violations")).select(
            F.lit(kind).alias("kind"), F.lit(",".join(columns)).alias("columns"), "violations"
        )

    checks = []
    if pk:
        checks.append(broken("primary_key", pk, unique(df, pk)))
    checks += [broken("unique", cols, unique(df, cols)) for cols in unique_sets]
    for fk, (parent, parent_key) in (fks or {}).items():
        checks.append(broken("foreign_key", [fk], relationships(df, fk, parent, parent_key)))
    must_exist = sorted({*pk, *required})
    if must_exist:
        # One pass over the table for all NOT NULL columns.
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in must_exist])
        checks.append(
            nulls.unpivot([], must_exist, "columns", "violations").select(
                F.lit("not_null").alias("kind"), "columns", "violations"
            )
        )
    return union_all(*checks).where(F.col("violations") > 0)


def require_rows(df: DataFrame, what: str = "extract") -> DataFrame:
    """Refuse an empty extract; looks for one row, does not count.

    Give it written rows: whatever they come from is worked out for this look alone.
    """
    if df.isEmpty():
        raise QualityError(f"{what} is empty")
    return df


def enforce(checks: Mapping[str, DataFrame], *watches: Watch) -> None:
    """Raise if any check has a violation, naming all that do.

    One job looks for a violation of every check; watches need none.
    """
    failed = [name for w in watches for name in w.failed()]
    if checks:
        found = [v.limit(1).select(F.lit(name).alias("name")) for name, v in checks.items()]
        failed += [r["name"] for r in union_all(*found).collect()]
    if failed:
        raise QualityError("failed: " + ", ".join(sorted(failed)))
