"""Seen-item masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train_mask(events: DataFrame, users: DataFrame, behaviors: tuple[str, ...]) -> DataFrame:
    """Long form: distinct (user_idx, item_idx) of the behaviours, for evaluation users."""
    if bad := set(behaviors) - {"view", "cart", "purchase"}:
        raise ValueError(f"unknown behaviours {sorted(bad)}")
    return events.where(F.col("behavior").isin(*behaviors)).join(users, "user_idx", "left_semi").select("user_idx", "item_idx").distinct()


def mask_arrays(mask: DataFrame, users: DataFrame) -> DataFrame:
    """Every evaluation user with the ascending items of the mask, none being an empty array."""
    seen = mask.groupBy("user_idx").agg(F.array_sort(F.collect_set("item_idx")).alias("items"))
    return users.join(seen, "user_idx", "left").select("user_idx", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def mean_length(arrays: DataFrame) -> DataFrame:
    """(users, mean_items): how many items a mask hides on average, users without any among them."""
    return arrays.agg(F.count("*").alias("users"), F.round(F.coalesce(F.avg(F.size("items")), F.lit(0.0)), 6).alias("mean_items"))
