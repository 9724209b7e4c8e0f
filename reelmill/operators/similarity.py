"""Top-k similar items inside a block, without forming the pairs.

How well two items match depends only on their flag signatures, and there are
few of those.  So candidates are first reduced to the best ones per (block,
signature), matched once per pair of signatures, and the short list of each
(block, signature) is handed to all items that share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import flag_signature, flag_similarity
from .ordering import rank_top


def signed(items: DataFrame, block: str, flags: list[str]) -> DataFrame:
    """Items that belong to a block, with their packed flag signature."""
    return items.where(F.col(block).isNotNull()).withColumn("sig", flag_signature(flags))


def best_matches(
    items: DataFrame,
    candidates: DataFrame,
    *,
    key: str,
    block: str,
    flags: list[str],
    popularity: str,
    payload: list[str],
    min_score: int,
    k: int,
) -> DataFrame:
    """Per item the k best other candidates of its block.

    ``key`` must be unique.  Ordered by score, then popularity, then key.  Output:
    the item's columns, ``match`` (struct of key, payload and score) and ``rank``.
    Lists are cut at k + 1 because the item itself can take one place in them.
    """
    signed_items = signed(items, block, flags)
    by_popularity = [F.col(popularity).desc(), F.col(key)]

    shortlisted = rank_top(
        signed(candidates, block, flags).select(
            block, F.col("sig").alias("candidate_sig"), key, popularity,
            F.struct(key, *payload).alias("candidate"),
        ),
        [block, "candidate_sig"],
        by_popularity,
        k + 1,
        "_place",
    ).drop("_place")

    wanted = signed_items.select(block, "sig").distinct()
    scored = (
        wanted.join(shortlisted, block)
        .withColumn("score", flag_similarity("sig", "candidate_sig"))
        .where(F.col("score") >= min_score)
    )
    ranked = rank_top(
        scored, [block, "sig"], [F.col("score").desc(), *by_popularity], k + 1, "_place"
    )
    # At most k + 1 entries per list.
    lists = ranked.groupBy(block, "sig").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_place", "candidate", "score"))),
            lambda e: F.struct(e["candidate"].alias("candidate"), e["score"].alias("score")),
        ).alias("matches")
    )
    others = F.filter("matches", lambda m: m["candidate"][key] != F.col(key))
    return (
        signed_items.join(lists, [block, "sig"])
        .select(*items.columns, F.posexplode(F.slice(others, 1, k)).alias("pos", "match"))
        .withColumn("rank", (F.col("pos") + 1).cast("bigint"))
        .drop("pos")
    )


def match_counts(
    items: DataFrame,
    candidates: DataFrame,
    *,
    key: str,
    block: str,
    flags: list[str],
    min_score: int,
) -> DataFrame:
    """Per item and score, how many other candidates of its block match so well.

    Counts what a self join on the block with ``key <> key`` would list, from
    candidate counts per signature; the item's own pairing is taken off again.
    """
    per_sig = (
        signed(candidates, block, flags)
        .groupBy(block, F.col("sig").alias("candidate_sig"))
        .agg(F.count("*").alias("n"))
    )
    signed_items = signed(items, block, flags)
    per_pair = (
        signed_items.select(block, "sig").distinct()
        .join(per_sig, block)
        .withColumn("score", flag_similarity("sig", "candidate_sig"))
        .where(F.col("score") >= min_score)
        .groupBy(block, "sig", "score")
        .agg(F.sum("n").alias("n"))
    )
    eligible = candidates.select(key, F.lit(1).alias("is_candidate"))
    own = F.when(
        F.col("is_candidate").isNotNull() & (F.col("score") == flag_similarity("sig", "sig")), 1
    ).otherwise(0)
    return (
        signed_items.select(key, block, "sig")
        .join(eligible, key, "left")
        .join(per_pair, [block, "sig"])
        .select(key, "score", (F.col("n") - own).alias("n"))
        .where(F.col("n") > 0)
    )
