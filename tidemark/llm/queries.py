"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import bpe_round_trip
from tidemark.llm.fingerprint import fingerprints
from tidemark.llm.folding import fold
from tidemark.llm.license import ORACLE as LICENSE_ORACLE
from tidemark.llm.license import license_scan
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.ngram_join import ngram_jaccard_join
from tidemark.llm.packing import best_fit_pack
from tidemark.llm.quality import quality_scores
from tidemark.llm.suffix_dedup import suffix_dedup
from tidemark.llm.topk import exact_top_k
from tidemark.llm.toxicity import toxicity_scores

#: Sequences of 1024 tokens; documents end with id 2.
PACKING = {"path": public_tokenizers.path("byte_bpe_50k.json"), "end": 2, "capacity": 1024}

#: Labels of these rows are never learned.
QUALITY_HELD = fold(5, 0)
TOXICITY_HELD = fold(4, 2)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), QUALITY_HELD)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(documents(spark, sf_dir), **PACKING)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), TOXICITY_HELD)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.col("_sha256").alias("kept_sha256"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: directories of a thousand ids hold directories of twenty, whose first is named as its licence file."""
    docs = documents(spark, sf_dir)
    name = F.when(F.col("doc_id") % 20 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan(docs, F.concat_ws("/", *(F.floor(F.col("doc_id") / n).cast("string") for n in (1000, 20)), name))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_toxicity": op6_toxicity,
    "op7_line_dedup": op7_line_dedup,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_license_scan": op9_license_scan,
    "op10_document_fingerprints": op10_document_fingerprints,
}

#: The other operators' results can't be expressed in SQL at this size; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {"op9_license_scan": LICENSE_ORACLE}
