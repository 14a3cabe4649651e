"""Corpus pipeline: each stage is one training-data operator whose decisions take effect.

Stages get and return the columns of documents, but for the last, which gives the packed pieces.
They tell rows apart by doc_id; rows that repeat in every column are one document. A document that
had words and that a stage leaves without any goes with them: line dedup empties most copies, as
every line of theirs stands in an earlier document; such a document is a copy, and is not kept as an
empty one. Documents that were without words from the start stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import free
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.ngram_join import ngram_jaccard_join
from tidemark.llm.packing import best_fit_pack
from tidemark.llm.queries import PACKING, TOXICITY_HELD
from tidemark.llm.suffix_dedup import NO_ID, suffix_dedup
from tidemark.llm.toxicity import toxicity_scores

#: What lines and words are parted by.
BLANK = "^[ \\t-\\r]*$"


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts to be toxic go."""
    scored = toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TOXICITY_HELD, whole=True)
    return scored.where("predicted = 0").select("row.*")


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier, equal or nearly so, go, and documents all of whose lines do."""
    lines, removed, sha = (free(docs.columns, x) for x in ("_lines", "_removed", "_sha256"))
    kept = line_dedup(docs, (lines, removed, sha)).where((F.col(removed) == 0) | ~F.col("text").rlike(BLANK))
    return counted(kept.select(*columns(docs)))


def keep_one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-equal documents the one with the smallest doc_id stays."""
    joined = ngram_jaccard_join(docs)
    gone = joined.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*columns(docs))


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat an earlier document's go, and documents left without words; a cut inside a character takes the whole character."""
    at, sha, kept = (free(docs.columns, x) for x in ("_at", "_sha", "_kept"))
    changed = suffix_dedup(docs, with_text=True).where("n_removed > 0").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(at), F.col("sha").alias(sha), F.col("kept").alias(kept)).dropDuplicates([at, sha])
    keyed = docs.withColumn(at, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256))
    cut = keyed.join(changed, [at, sha], "left").where(F.col(kept).isNull() | ~F.col(kept).rlike(BLANK))
    return counted(cut.withColumn("text", F.coalesce(kept, "text")).select(*columns(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    return best_fit_pack(docs, **PACKING)


def columns(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_lines),
    ("ngram_jaccard_join", keep_one_of_a_kind),
    ("suffix_array_dedup", remove_passages),
    ("best_fit_packing", pack),
]

#: No stage of this pipeline can be expressed in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
