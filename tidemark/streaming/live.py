"""Ours (the batch engine has no streams): the clean log, daily counts, sessions and seen items as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.cleanse import brand, category, drop_missing_keys, known_behaviors
from tidemark.settings import Settings


def clean_stream(df: DataFrame, s: Settings, late: str = "1 day") -> DataFrame:
    """P1-P7 on a stream; repeats are dropped while their watermark lasts, the first to come stays."""
    df = known_behaviors(drop_missing_keys(df), s).withWatermark("event_time", late)
    df = df.dropDuplicatesWithinWatermark(["user_id", "product_id", "event_type", "event_time"])
    return df.select("user_id", "product_id", "event_type", "event_time", F.unix_timestamp("event_time").alias("timestamp"), category(s).alias("category"), brand(s).alias("brand"), "price")


def daily_counts(df: DataFrame, late: str = "1 day") -> DataFrame:
    """A8 by day."""
    return df.withWatermark("event_time", late).groupBy(F.window("event_time", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Events of a user without a pause of `gap`."""
    return df.withWatermark("event_time", late).groupBy(F.session_window("event_time", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def new_items(df: DataFrame, late: str = "1 day", keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """Incremental seen-item mask: (user_id, product_id) when first met; a user's state ends keep_ms of event time after its last use."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = set(state.get[0]) if state.exists else set()
        for part in parts:
            fresh = sorted({int(x) for x in part["product_id"]} - seen)
            seen.update(fresh)
            if fresh:
                yield pd.DataFrame({"user_id": [key[0]] * len(fresh), "product_id": fresh})
        state.update((sorted(seen),))
        state.setTimeoutTimestamp(max(0, state.getCurrentWatermarkMs()) + keep_ms)

    return df.withWatermark("event_time", late).groupBy("user_id").applyInPandasWithState(step, "user_id bigint, product_id bigint", "seen array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
