"""A training corpus from raw documents: the stages, in order, and a run of them all.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``docs``.  ``run`` writes each stage's result as Parquet under the shared
folder and gives the next stage what it reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.llm.common import all_of, held_out, table
from reelmill.llm.decontaminate import decontaminate
from reelmill.llm.jaccard import one_of_each
from reelmill.llm.langid import UNKNOWN, fit_profiles, identify
from reelmill.llm.packing import pack
from reelmill.llm.queries import BYTE_BPE
from reelmill.llm.secrets import redact_secrets
from reelmill.llm.tokens import FEW_REMEMBERED
from reelmill.session import configure, stage

#: Below this score no profile fits a text, if it has so many distinct n-grams; the score
#: of a text of a few words says little (a name may share no n-gram with a profile).
LEAST_SCORE, LEAST_GRAMS = 0.3, 50
JUDGED = ("__lang_pred", "__lang_score", "__n_grams")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or like none of the known ones, go.

    Null texts and those without a letter have no language; short texts with letters
    stay whatever they score; repeated rows are judged one by one, ties between languages
    change nothing; without labelled documents to learn from, or without documents,
    nothing stays.
    """
    profiles = fit_profiles(docs.where(~held_out("doc_id")))
    pred, score, n_grams = (F.col(c) for c in JUDGED)
    known = identify(docs, profiles, names=JUDGED).where(
        (pred != UNKNOWN) & ((score >= LEAST_SCORE) | (n_grams < LEAST_GRAMS))
    )
    return known.select(*all_of(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link, directly or through others, the one of smallest id stays.

    Null texts, texts without words and rows without an id stay, all of them; copies of a
    row are one document; different texts under one id are documents of their own, of
    which the smaller hash of the text goes first; an empty table stays empty.
    """
    return one_of_each(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null texts and texts without words hold none and stay; each row goes by its own text,
    whatever its id; without benchmark items all documents stay.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay.

    Null and empty texts stay as they are; each row is scanned on its own; without
    findings of both labels the rules alone say what is a secret.
    """
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with a checksum of their ids.

    A null or empty text packs its end id alone; repeated rows are packed once each; ties
    between levels go to the fuller one; no documents give no pieces.
    """
    # Its workers have been through other stages: less is left for the encoder's memory.
    return pack(docs, BYTE_BPE, end_id=1, remembered=FEW_REMEMBERED).select(
        "doc_id",
        "start",
        "length",
        F.crc32("token_ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmarks),
    ("secret_scan", secrets),
    ("packing", packing),
]

# Models, components and a tokenizer: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
