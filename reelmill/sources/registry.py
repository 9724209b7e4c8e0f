"""Datasets by name, as listed in a JSON manifest."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import union_all


@dataclass(frozen=True)
class Dataset:
    name: str
    path: str
    fmt: str
    partitioned: bool


@dataclass(frozen=True)
class Registry:
    datasets: tuple[Dataset, ...]

    @classmethod
    def from_manifest(cls, text: str) -> Registry:
        return cls(
            tuple(
                Dataset(
                    name=entry["dataPath"].rstrip("/").rsplit("/", 1)[-1],
                    path=entry["dataPath"],
                    fmt=entry["structureFormat"],
                    partitioned=entry.get("isPartitioned", False),
                )
                for entry in json.loads(text)["entries"]
            )
        )

    def read(self, spark: SparkSession, root: str, name: str) -> DataFrame:
        (found,) = [d for d in self.datasets if d.name == name]
        return spark.read.format(found.fmt).load(f"{root}/{found.path}")

    def describe(self, spark: SparkSession, root: str) -> DataFrame:
        """Columns of every dataset; reads schemas only."""
        rows = [
            (d.name, f.name, f.dataType.simpleString(), i)
            for d in self.datasets
            for i, f in enumerate(self.read(spark, root, d.name).schema, start=1)
        ]
        return spark.createDataFrame(rows, "dataset string, column string, type string, ordinal int")

    def profile(self, spark: SparkSession, root: str) -> DataFrame:
        """The description with rows and non-null values, one pass per dataset."""
        counted = []
        for d in self.datasets:
            df = self.read(spark, root, d.name)
            values = df.agg(
                F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in df.columns]
            )
            counted.append(
                values.unpivot(["_rows"], df.columns, "column", "non_null").select(
                    F.lit(d.name).alias("dataset"), "column", F.col("_rows").alias("n_rows"),
                    "non_null",
                )
            )
        return self.describe(spark, root).join(
            F.broadcast(union_all(*counted)), ["dataset", "column"]
        )
