"""Declared schemas: what the relational source holds and what bronze stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


SOURCE = {
    "movies": _struct(movieid=IntegerType(), title=StringType(), genres=StringType()),
    "links": _struct(movieid=IntegerType(), imdbid=IntegerType(), tmdbid=IntegerType()),
    "ratings": _struct(
        userid=IntegerType(), movieid=IntegerType(), rating=DecimalType(2, 1), timestamp=LongType()
    ),
    "tags": _struct(
        userid=IntegerType(), movieid=IntegerType(), tag=StringType(), timestamp=LongType()
    ),
}

BRONZE = {
    "movies": _struct(movieid=LongType(), title=StringType(), genres=StringType()),
    "ratings": _struct(
        userid=LongType(), movieid=LongType(), rating=DoubleType(), timestamp=LongType()
    ),
    "links": _struct(movieid=LongType(), imdbid=StringType(), tmdbid=StringType()),
    "tags": _struct(
        userid=LongType(), movieid=LongType(), tag=StringType(), timestamp=LongType()
    ),
}

# Declared by the source database; checked again on landed data.
SOURCE_KEYS = {
    "movies": ["movieid"],
    "links": ["movieid"],
    "ratings": ["userid", "movieid", "timestamp"],
}

SAMPLES = _struct(
    metric=StringType(),
    labels=MapType(StringType(), StringType()),
    ts=TimestampType(),
    value=DoubleType(),
)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Project ``df`` onto ``schema`` with explicit casts (widening at ingest)."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
