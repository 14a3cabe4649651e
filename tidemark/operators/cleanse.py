"""Cleaning of the raw log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.settings import Settings


def drop_missing_keys(df: DataFrame) -> DataFrame:
    """P2"""
    return df.dropna(subset=["user_id", "product_id", "event_type", "event_time"])


def known_behaviors(df: DataFrame, s: Settings) -> DataFrame:
    """Exact, case-sensitive."""
    return df.where(F.col("event_type").isin(*s.behaviors))


def drop_repeats(df: DataFrame) -> DataFrame:
    """One row per (user, product, type, time); which one is fixed by a total order, nulls first."""
    order = [F.col(c).asc_nulls_first() for c in ("brand", "category_code", "price", "user_session") if c in df.columns]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy("user_id", "product_id", "event_type", "event_time").orderBy(*order))).where("_rn = 1").drop("_rn")


def epoch(df: DataFrame) -> DataFrame:
    """P5: floor seconds; rows without one are dropped."""
    return df.withColumn("timestamp", F.unix_timestamp("event_time")).where("timestamp IS NOT NULL")


def brand(s: Settings) -> Column:
    """P6"""
    value = F.lower(F.trim("brand"))
    return F.when(F.col("brand").isNull() | (value == ""), s.unknown_brand).otherwise(value)


def category(s: Settings) -> Column:
    """Top, second or full level of a dotted path."""
    parts = F.split("category_code", "[.]")
    value = {"top": F.get(parts, F.lit(0)), "second": F.concat_ws(".", F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit("general"))), "full": F.col("category_code")}[s.category_level]
    return F.when(F.col("category_code").isNull() | (F.col("category_code") == ""), s.unknown_category).otherwise(value)


def clean(df: DataFrame, s: Settings) -> DataFrame:
    """user_id, product_id, event_type, event_time, timestamp, category, brand, price[, user_session]."""
    df = epoch(drop_repeats(known_behaviors(drop_missing_keys(df), s)))
    session = [F.when(F.col("user_session").isNull() | (F.col("user_session") == ""), s.unknown_session).otherwise(F.col("user_session")).alias("user_session")] if "user_session" in df.columns else []
    return df.select("user_id", "product_id", "event_type", "event_time", "timestamp", category(s).alias("category"), brand(s).alias("brand"), "price", *session)


def behavior_id(s: Settings) -> Column:
    """A behaviour without an id is an error when the settings are read, not at run time."""
    out = None
    for name, i in s.behaviors.items():
        out = F.when(F.col("event_type") == name, i) if out is None else out.when(F.col("event_type") == name, i)
    return out.cast("int")
