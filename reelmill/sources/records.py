from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        [
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f.name)
            for f in df.schema
        ]
    )


def to_records(df: DataFrame, name: str = "record") -> DataFrame:
    """One JSON object per row; NULL and NaN are both written as ``null``."""
    clean = nan_to_null(df)
    return clean.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name)
    )
