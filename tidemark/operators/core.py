"""Bounded-round k-core on train-window target events, applied to the whole log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.settings import Settings
from tidemark.sources.readers import cut_lineage


def keep_frequent(log: DataFrame, key: str, least: int, s: Settings) -> DataFrame:
    """A1 + J1: rows of keys with at least `least` target events before the train cutoff."""
    if least <= 1:
        return log
    kept = log.where((F.col("event_type") == s.target) & (F.col("timestamp") < s.train_cut)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(key)
    return log.join(kept, key, "left_semi")


def k_core(log: DataFrame, s: Settings, rounds: int | None = None) -> DataFrame:
    """Items, then users on the reduced log, `rounds` times (not to a fixpoint); each round is materialised."""
    if s.min_user <= 1 and s.min_item <= 1:
        return log
    for _ in range(max(1, s.rounds if rounds is None else rounds)):
        log = cut_lineage(keep_frequent(keep_frequent(log, "product_id", s.min_item, s), "user_id", s.min_user, s))
    return log
