"""Benchmark decontamination: training words that lie in a window of a benchmark item.

An item's windows are its runs of ``width`` consecutive words (a shorter item is one
window).  An occurrence of a window of L words at any place holds exactly one run of
k words (k = L // 2, at least 1) that starts at a multiple of L - k + 1.  So a document
is scanned only at those places: the hash of the run there is looked up in a broadcast
hash table of the runs of all windows, and a hit is verified word by word against the
whole window.  That needs one lookup for every six words instead of one for each.

Everything is DataFrame code on built-in functions.  Windows have numbers, and the table
of runs carries these, not the items: which items have a window is joined to the hits
afterwards, so a window that very many items share is one row.  The table is broadcast if
its bytes are counted to be few; a larger benchmark is joined by shuffling.  Only hits
are ever shuffled, one row per document and place at most.

Defined results: null and empty texts have no words; null item texts no windows; equal
windows of several items count for each item and once for the words; items repeated
under one id count once; documents repeated under one id and text count once each; an
empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import broadcast_if_small, let, named

#: Bytes that the table of runs may have, as its rows are counted, to be broadcast.
BROADCAST_BYTES = 48 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII other than letters and digits separates words.
OTHER = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def item_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after A-Z became a-z."""
    plain = F.translate(
        F.coalesce(text, F.lit("")), UPPER + OTHER, UPPER.lower() + " " * len(OTHER)
    )
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _run_length(length: int) -> int:
    return max(1, length // 2)


def windows(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (item, window): every distinct window of every item."""
    words = items.select(
        F.col(id_col).cast("string").alias("item"), item_words(F.col(text_col)).alias("words")
    ).where(F.size("words") > 0)
    length = F.least(F.lit(width), F.size("words"))
    starts = F.sequence(F.lit(1), F.size("words") - length + 1)
    return words.select(
        "item",
        F.explode(F.transform(starts, lambda i: F.slice("words", i, length))).alias("window"),
    ).distinct()


def _runs(numbered: DataFrame) -> DataFrame:
    """Rows (run, length, ahead, window, number): the window's run after ``ahead`` words."""
    length = F.size("window")
    k = F.greatest(F.lit(1), F.floor(length / 2).cast("int"))
    return numbered.select(
        "window",
        "number",
        length.alias("length"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), length - k + 1),
                lambda i: F.xxhash64(F.slice("window", i, k)),
            )
        ).alias("ahead", "run"),
    )


def _run_bytes(numbered: DataFrame) -> int:
    """About what the runs of all windows take in memory."""
    words = F.size("window")
    each = 96 + 16 * words + F.octet_length(F.array_join("window", ""))
    return numbered.agg(F.sum((words - F.floor(words / 2) + 1) * each)).first()[0] or 0


def _places(words: Column, length: int) -> Column:
    """Where windows of one length are looked up: structs of place, run and nearby words."""
    k = _run_length(length)
    ahead = length - k

    def place(i: Column) -> Column:
        first = F.greatest(F.lit(1), i - ahead)
        return F.struct(
            F.lit(length).alias("length"),
            i.alias("at"),
            first.alias("first"),
            F.xxhash64(F.slice(words, i, F.lit(k))).alias("run"),
            F.slice(words, first, i + length - first).alias("near"),
        )

    # Too short a text ends the sequence before it begins: keep place 1, drop it below.
    last = F.greatest(F.lit(1), F.size(words) - (k - 1))
    return F.transform(F.sequence(F.lit(1), last, F.lit(ahead + 1)), place)


def hits(docs: DataFrame, numbered: DataFrame, text_col: str = "text") -> DataFrame:
    """Occurrences in ``docs`` of written windows (number, window).

    The columns of ``docs`` but the text, then start (words before it), length, number.
    """
    runs, found = _runs(numbered), numbered
    lengths = sorted(r[0] for r in found.select(F.size("window")).distinct().collect())
    kept = [c for c in docs.columns if c != text_col]
    if not lengths:
        return docs.limit(0).select(
            *kept, F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("number")
        )
    scanned = docs.select(
        *kept,
        F.explode(
            let(
                item_words(F.col(text_col)),
                lambda words: F.concat(*[_places(words, n) for n in lengths]),
            )
        ).alias("p"),
    ).alias("d")
    small = _run_bytes(numbered) <= BROADCAST_BYTES
    begin = F.col("p.at") - F.col("r.ahead")
    offset = F.greatest(F.lit(1), begin - F.col("p.first") + 1)
    return scanned.join(
        (F.broadcast(runs) if small else runs).alias("r"),
        (F.col("p.run") == F.col("r.run"))
        & (F.col("p.length") == F.col("r.length"))
        & (begin >= 1)
        & (F.slice("p.near", offset, F.col("r.length")) == F.col("r.window")),
    ).select(
        *[F.col(f"d.`{c}`") for c in kept],
        (begin - 1).alias("start"),
        F.col("r.length").alias("length"),
        F.col("r.number").alias("number"),
    )


def _covered(spans: Column) -> Column:
    """Words that a sorted array of structs (start, length) covers."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["end"], s["start"] + s["length"])
        return F.struct(
            (acc["n"] + end - F.least(end, F.greatest(acc["end"], s["start"]))).alias("n"),
            end.alias("end"),
        )

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def _key(text_col: str) -> Column:
    """With the id, tells rows apart, so that hits need not carry the text."""
    return F.xxhash64(F.coalesce(named(text_col), F.lit("")))


def hit_windows(
    docs: DataFrame, items: DataFrame, width: int, id_col: str, text_col: str, item_col: str, item_text_col: str
) -> tuple[DataFrame, DataFrame]:
    """Hits (id, key, start, length, number) and the items of windows (number, item), written."""
    keyed = docs.select(named(id_col).alias("id"), _key(text_col).alias("key"), named(text_col).alias("text"))
    found = stage(windows(items, width, item_col, item_text_col), "item_windows")
    distinct = found.select("window").distinct()
    # Written, so a window keeps its number.
    numbered = stage(distinct.withColumn("number", F.monotonically_increasing_id()), "windows")
    of_items = found.join(numbered, "window").select("number", "item")
    return stage(hits(keyed, numbered), "hits"), of_items


def hit_documents(hit: DataFrame, of_items: DataFrame) -> DataFrame:
    """Documents with a hit: id, key, spans of words (start, length), items as strings."""
    spans = hit.groupBy("id", "key").agg(
        F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans")
    )
    by_number = broadcast_if_small(stage(of_items, "window_items"))
    names = (
        hit.select("id", "key", "number")
        .distinct()
        .join(by_number, "number")
        .groupBy("id", "key")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    return spans.alias("s").join(names.alias("n"), _same("s", "n")).select("s.*", "n.items")


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.id").eqNullSafe(F.col(f"{right}.id")) & (
        F.col(f"{left}.key") == F.col(f"{right}.key")
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    width: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per document: id, n_words, n_hit, spans, items, contaminated."""
    hit, of_items = hit_windows(docs, items, width, id_col, text_col, item_col, item_text_col)
    found = hit_documents(hit, of_items)
    counted = docs.select(
        named(id_col).alias("id"),
        _key(text_col).alias("key"),
        F.size(item_words(named(text_col))).cast("long").alias("n_words"),
    )
    return (
        counted.alias("c")
        .join(found.alias("h"), _same("c", "h"), "left")
        .select(
            F.col("c.id").alias(id_col),
            "n_words",
            F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.col("spans").isNotNull().alias("contaminated"),
        )
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    width: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs``, all columns, without the documents that hold a window of an item."""
    found, _ = hit_windows(docs, items, width, id_col, text_col, item_col, item_text_col)
    hit = broadcast_if_small(stage(found.select("id", "key").distinct(), "hit_documents"))
    marked = docs.withColumns({"__hit_id": named(id_col), "__hit_key": _key(text_col)}).alias("d")
    same = F.col("d.__hit_id").eqNullSafe(F.col("h.id")) & (F.col("d.__hit_key") == F.col("h.key"))
    return marked.join(hit.alias("h"), same, "left_anti").drop("__hit_id", "__hit_key")
