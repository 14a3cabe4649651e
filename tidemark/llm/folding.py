"""Labels, folds and logistic helpers shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(parts: int, part: int) -> str:
    """SQL condition on doc_id: it is in this part of its folds."""
    return f"crc32(cast(doc_id as string)) % {parts} = {part}"


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held: str, most: int, most_bytes: int) -> DataFrame:
    """At most `most` labelled rows (doc_id, text, y) of `most_bytes` of text that aren't held out: those first in a hash of their id.

    An id counts once, with its largest label and its smallest text, however often it is repeated.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(~F.coalesce(F.expr(held), F.lit(False)) & F.col("y").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "doc_id")
    once = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return once.withColumn("upto", upto).where(F.col("upto") <= most_bytes).drop("upto")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
