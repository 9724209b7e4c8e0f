"""Language identification by rank-order profiles.

A profile is a language's most frequent letter n-grams (one to three letters, word
edges included) in order of frequency.  A document's own list is compared with every
profile by the out-of-place distance: for each of its n-grams, how many ranks apart
the two lists have it, or the length of a profile if the language lacks it.  The
nearest profile wins; the score is one minus the distance over its greatest value.

Profiles are fitted on at most ``per_language`` labelled documents of each language,
those with the smallest hash of their id.  Everything else covers all rows: whole
texts are counted, in blocks, so memory per task does not follow the longest text by
more than its code points.

Defined results: a text that is null, empty or without letters is ``und`` with score 0;
ties between n-grams go to the smaller code points and ties between languages to the
first name; repeated rows are predicted one by one; with nothing to learn from, all is
``und``; an empty table gives an empty one.  Columns named as a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import map_arrow, named

UNKNOWN = "und"
#: Letters of a text counted together.
BLOCK = 1 << 20
SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _code_points(text: str) -> np.ndarray:
    """Lower-cased letters, with one space for everything between words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, SPACE).astype(np.int64)
    points = np.concatenate([[SPACE], points, [SPACE]])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != SPACE) | (points[:-1] != SPACE)
    return points[keep]


def _merge(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(grams, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of one to three letters, packed 21 bits a letter, and counts."""
    points = _code_points(text)
    parts = []
    for first in range(0, len(points), BLOCK):
        p = points[first : first + BLOCK + 2]  # n-grams that begin in this block
        one = p[:BLOCK]
        two = (one[: len(p) - 1] << 21) | p[1 : BLOCK + 1]
        two = two[(p[: len(two)] != SPACE) | (p[1 : len(two) + 1] != SPACE)]
        three = (p[:-2] << 42) | (p[1:-1] << 21) | p[2:]
        three = three[p[1:-1] != SPACE]
        grams = np.concatenate([one[one != SPACE], two, three])
        parts.append(np.unique(grams, return_counts=True))
    if len(parts) == 1:
        return parts[0]
    return _merge(np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts]))


def _sample(labelled: DataFrame, id_col: str, lang_col: str, text_col: str, per_language: int,
            max_languages: int) -> DataFrame:
    """At most ``per_language`` documents a language: those with the smallest hash of the id.

    Hashes are ranked without texts; texts are then read against one hash a language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h")
    )
    by_hash = Window.partitionBy("lang").orderBy("h")
    limits = (
        rows.select("lang", "h")
        .withColumn("n", F.row_number().over(by_hash))
        .where(F.col("n") <= per_language)
        .groupBy("lang")
        .agg(F.max("h").alias("most"))
        .limit(max_languages + 1)
        .collect()
    )
    if len(limits) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    small = labelled.sparkSession.createDataFrame(limits, "lang string, most long")
    # An id that a third of all rows repeat is one document here: that of smallest text.
    return (
        rows.join(F.broadcast(small), "lang")
        .where(F.col("h") <= F.col("most"))
        .groupBy("lang", "h")
        .agg(F.min("text").alias("text"))
    )


def fit_profiles(
    labelled: DataFrame,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    text_col: str = "text",
    size: int = 300,
    per_language: int = 1000,
    max_languages: int = 1000,
) -> list[Row]:
    """The ``size`` most frequent n-grams of each language: rows (lang, gram, rank).

    At most ``max_languages * size`` rows, which every task gets a copy of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                counted = [count_grams(t) for t, x in zip(texts, langs, strict=True) if x == lang]
                grams, counts = _merge(
                    np.concatenate([g for g, _ in counted]), np.concatenate([n for _, n in counted])
                )
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(grams), "gram": grams, "n": counts})

    frequent = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    sample = _sample(labelled, id_col, lang_col, text_col, per_language, max_languages)
    return (
        map_arrow(sample.select("lang", "text"), run, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(frequent) - 1)
        .where(F.col("rank") < size)
        .select("lang", "gram", "rank")
        .orderBy("lang", "rank")
        .collect()
    )


class Profiles:
    """All profiles as one matrix of ranks: a row per language, a column per n-gram."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.size = max((r[2] for r in rows), default=-1) + 1
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        for lang, gram, rank in rows:
            self.ranks[self.langs.index(lang), np.searchsorted(self.grams, gram)] = rank

    def predict(self, text: str | None) -> tuple[str, float, int]:
        """Language, score, and how many distinct n-grams they come from."""
        grams, counts = count_grams(text or "")
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0, len(grams)
        grams = grams[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = 0
        at[self.grams[at] != grams] = len(self.grams)  # the last column: nowhere
        ranks = self.ranks[:, at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(grams))))
        distance = apart.sum(axis=1)
        best = int(np.argmin(distance))
        score = 1.0 - float(distance[best]) / (len(grams) * self.size)
        return self.langs[best], score, len(counts)


def identify(
    docs: DataFrame,
    profiles: list[Row],
    text_col: str = "text",
    names: tuple[str, str, str] = ("lang_pred", "score", "n_grams"),
) -> DataFrame:
    """``docs`` with language, score and number of distinct n-grams, under ``names``.

    Columns of ``docs`` that have one of these names give way; none but the text has a say.
    """
    kept = [c for c in docs.columns if c.lower() not in names]
    docs = docs.select(*[named(c) for c in kept])
    at = kept.index(text_col)
    rows = [tuple(r) for r in profiles]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(rows)
        for batch in batches:
            found = [model.predict(t) for t in batch.column(at).to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]],
                names=[*kept, *names],
            )

    kinds = (StringType(), DoubleType(), LongType())
    schema = StructType(
        [*docs.schema.fields, *[StructField(n, k) for n, k in zip(names, kinds, strict=True)]]
    )
    return map_arrow(docs, run, schema)
