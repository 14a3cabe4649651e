"""Temporal split, vocabularies and warm-start evaluation rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import dense_ids
from tidemark.settings import Settings


@dataclass(frozen=True)
class Split:
    """D3: lazy tables; nothing is on the driver."""

    labelled: DataFrame  # target events with part
    users: DataFrame  # user_id, user_idx
    items: DataFrame  # product_id, item_idx
    train: DataFrame  # user_idx, item_idx, timestamp
    held: DataFrame  # part, user_idx, item_idx, timestamp: warm rows before repeats are dropped
    positives: DataFrame  # part, user_idx, item_idx, timestamp: unique pairs, earliest
    candidates: DataFrame  # item_idx


def label(log: DataFrame, s: Settings) -> DataFrame:
    """Target events as train, val or test."""
    ts = F.col("timestamp")
    return log.where(F.col("event_type") == s.target).select("user_id", "product_id", "timestamp", F.when(ts < s.train_cut, "train").when(ts < s.val_cut, "val").otherwise("test").alias("part"))


def vocabularies(log: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """C4: (users, items), numbered; items of the train part, or of all parts if transductive."""
    labelled = label(log, s)
    train_raw = labelled.where("part = 'train'")
    return dense_ids(train_raw, "user_id", "user_idx"), dense_ids(labelled if s.transductive else train_raw, "product_id", "item_idx")


def split(log: DataFrame, s: Settings, known: tuple[DataFrame, DataFrame] | None = None) -> Split:
    """C2-C5; `known` vocabularies are not numbered again."""
    labelled = label(log, s)
    users, items = known or vocabularies(log, s)
    mapped = labelled.join(users, "user_id").join(items, "product_id").select("part", "user_idx", "item_idx", "timestamp")
    train = mapped.where("part = 'train'").drop("part")
    held = mapped.where("part <> 'train'")
    fresh = held.join(train.select("user_idx", "item_idx").distinct(), ["user_idx", "item_idx"], "left_anti") if s.drop_repeated else held
    positives = fresh.groupBy("part", "user_idx", "item_idx").agg(F.min("timestamp").alias("timestamp"))
    return Split(labelled, users, items, train, held, positives, items.select("item_idx"))


def ground_truth(sp: Split) -> DataFrame:
    """(part, user_idx, items ascending)."""
    return sp.positives.groupBy("part", "user_idx").agg(F.array_sort(F.collect_set("item_idx")).alias("items"))


def eval_users(sp: Split) -> DataFrame:
    """Users with a positive in val or test."""
    return sp.positives.select("user_idx").distinct()


def statistics(sp: Split) -> DataFrame:
    """Per part: rows, rows of cold users, rows of warm users on cold items, repeats of train pairs, kept rows, share."""
    marked = sp.labelled.join(sp.users, "user_id", "left").join(sp.items, "product_id", "left")
    pairs = sp.train.select("user_idx", "item_idx").distinct().withColumn("seen", F.lit(True))
    marked = marked.join(pairs, ["user_idx", "item_idx"], "left")
    cold_user = F.col("user_idx").isNull()
    cold_item = ~cold_user & F.col("item_idx").isNull()
    repeat = (F.col("part") != "train") & F.coalesce("seen", F.lit(False))
    out = marked.groupBy("part").agg(F.count("*").alias("n_rows"), F.count_if(cold_user).alias("cold_user_rows"), F.count_if(cold_item).alias("cold_item_rows"), F.count_if(repeat).alias("repeated_rows"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    kept = F.col("n_rows") - F.col("cold_user_rows") - F.col("cold_item_rows") - F.col("repeated_rows")
    return out.withColumn("kept_rows", kept).withColumn("kept_pct", F.format_string("%.1f%%", 100.0 * kept / F.greatest("n_rows", F.lit(1))))
