"""Loads into keyed and unkeyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import rank_top


#: Bits of a key's hash that a filter tells apart: 2^26 bits in a million longs, some 40 MB
#: as a broadcast table, whatever the batch.
FILTER_BITS = 26


def key_filter(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of a batch as a bitmap: rows (word, mask), 2^(FILTER_BITS - 6) at most.

    Masks are OR-ed in tasks first, so a hot key is a bit like any other.
    """
    place = _place(keys)
    bit = F.expr("shiftleft(1L, place % 64)")
    known = batch.dropna(subset=list(keys)).select(place.alias("place"))
    words = known.select(F.expr("CAST(place DIV 64 AS INT)").alias("word"), bit.cast("long").alias("bit"))
    return words.groupBy("word").agg(F.bit_or("bit").alias("mask"))


def _place(keys: Sequence[str]) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - FILTER_BITS).cast("int")


def possibly_in(target: DataFrame, keys: Sequence[str], batch: DataFrame) -> DataFrame:
    """Keys of ``target`` that may be in ``batch``: all that are, few others.

    One scan of the target's key columns, no shuffle of it.  Keys that differ in type on
    the two sides have hashes that say nothing, and are all let through.
    """
    if any(target.schema[k].dataType != batch.schema[k].dataType for k in keys):
        return target.select(*keys)
    own = target.select(*keys).withColumn("place", _place(keys))
    word = F.expr("CAST(place DIV 64 AS INT)")
    hit = F.getbit(F.col("mask"), F.expr("place % 64")) == 1
    filtered = own.join(F.broadcast(key_filter(batch, keys)), word == F.col("word"))
    return filtered.where(hit).select(*keys)


def new_by_key(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], load_order: Sequence[str]
) -> DataFrame:
    """Batch rows an insert-or-ignore adds: key not in target, first row per key.

    Of the target only keys that a bitmap of the batch's keys lets through are shuffled;
    what they are compared with decides, so the filter costs and saves work, no more.
    """
    # Known keys go first: what is left to sort is new.
    unknown = batch.join(possibly_in(target, keys, batch), list(keys), "left_anti")
    return rank_top(unknown, keys, [F.col(c) for c in load_order], 1, "_copy").drop("_copy")


def insert_ignore(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], load_order: Sequence[str]
) -> DataFrame:
    """Existing rows win over the batch, earlier batch rows over later ones."""
    added = new_by_key(target, batch, keys, load_order)
    return target.unionByName(added.select(*target.columns))


def insert_if_absent(
    target: DataFrame, batch: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Add batch rows that match no target row on all columns; copies inside the
    batch all go in, and NULL matches nothing.  The target is filtered as above."""
    present = possibly_in(target, columns, batch).distinct()
    added = batch.join(present, list(columns), "left_anti")
    return target.unionByName(added.select(*target.columns))


def append(target: DataFrame, batch: DataFrame) -> DataFrame:
    return target.unionByName(batch)
