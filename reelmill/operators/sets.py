from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def pad_to(df: DataFrame, schema: StructType) -> DataFrame:
    """Project onto ``schema``; columns ``df`` lacks become typed NULLs."""
    return df.select(
        [
            (F.col(f.name) if f.name in df.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def union_padded(schema: StructType, *dfs: DataFrame) -> DataFrame:
    return union_all(*[pad_to(df, schema) for df in dfs])
