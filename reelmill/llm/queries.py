"""One query per operator over the whole given tables, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, scratch_path, stage
from .chat import LEARNED_ROLE, digest_chat, format_chat
from .common import held_out, table
from .decontaminate import contamination
from .jaccard import jaccard_components
from .langid import fit_profiles, identify
from .licenses import scan_licenses
from .packing import pack
from .quality import quality_rules
from .runs import periodic_runs
from .secrets import find_secrets
from .templates import extract_main_text
from .token_files import read_token_files, write_token_files
from .unigram import token_counts
from .vector_codes import compress

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = fit_profiles(docs.where(~held_out("doc_id")))
    return identify(docs.select("doc_id", "text"), profiles).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score"
    )


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_files")
    write_token_files(table(spark, sf_dir, "documents"), path, BYTE_BPE, end_id=0)
    return read_token_files(spark, path)


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=1).select(
        "doc_id",
        "start",
        "length",
        F.crc32("token_ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), PIECES)


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = f"<|im_end|><|im_start|>{LEARNED_ROLE} ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-1, 0, "user", hard), (-1, 1, LEARNED_ROLE, hard)], turns.schema
    )
    return digest_chat(stage(format_chat(turns.unionByName(extra)), "chat"))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "start",
        F.length("value").alias("length"),
        F.sha2("value", 256).alias("value_sha256"),
        "score",
        "is_secret",
    )


@query
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
