"""Data-quality report (Q1-Q13, J17, U8, A17): one row per check with its number of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.edges import node_counts
from tidemark.operators.masks import train_mask
from tidemark.operators.split import Split, eval_users, ground_truth
from tidemark.settings import Settings


def violations(name: str, rows: DataFrame, bad: Column | None = None) -> DataFrame:
    return rows.agg((F.count("*") if bad is None else F.count_if(bad)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def out_of_vocabulary(rows: DataFrame, sp: Split) -> DataFrame:
    return rows.join(sp.users, "user_idx", "left_anti").select("user_idx", "item_idx").unionByName(rows.join(sp.items, "item_idx", "left_anti").select("user_idx", "item_idx"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def report(sp: Split, events: DataFrame, meta: DataFrame, s: Settings, masks: tuple[DataFrame, DataFrame] | None = None, legacy: DataFrame | None = None, authority: DataFrame | None = None, truth: DataFrame | None = None) -> DataFrame:
    """Q12: all checks; every count is 0 on sound tables.

    Stored tables are checked where they are given: the primary and the seen-all mask, an older primary
    mask, the authoritative node counts (node_type, n) and the truth arrays (part, user_idx, items); else
    those that follow from the split.
    """
    users = eval_users(sp)
    truth = ground_truth(sp) if truth is None else truth
    primary, seen = masks or (train_mask(events, users, (s.target,)), train_mask(events, users, tuple(s.behaviors)))
    pairs = sp.positives.select("user_idx", "item_idx").distinct()
    ts = F.col("timestamp")
    flat = truth.select("part", "user_idx", F.explode("items").alias("item_idx"))
    rows = sp.positives.select("part", "user_idx", "item_idx")
    wanted = sp.items.select("item_idx")
    counts = node_counts(sp, meta)
    others = events.where(F.col("behavior") != s.target).join(users, "user_idx", "left_semi").agg(F.count("*").alias("others"))
    equal = difference(primary, seen).agg(F.count("*").alias("n")).crossJoin(F.broadcast(others)).select(((F.col("n") == 0) & (F.col("others") > 0)).cast("long").alias("violations"))
    older = difference(primary, primary if legacy is None else legacy).select("user_idx").distinct()
    checks = [
        violations("Q1_event_bounds", out_of_vocabulary(events, sp)),
        violations("Q2_behavior_ids", events, F.col("behavior_id").isNull() | ~F.col("behavior_id").isin(*s.behaviors.values())),
        violations("Q3_eval_bounds", out_of_vocabulary(rows, sp)),
        violations("Q4_train_eval_leak", pairs.join(sp.train.select("user_idx", "item_idx").distinct(), ["user_idx", "item_idx"])),
        violations("Q5_train_window", events, ts >= s.train_cut),
        violations("Q5_val_window", sp.positives.where("part = 'val'"), (ts < s.train_cut) | (ts >= s.val_cut)),
        violations("Q5_test_window", sp.positives.where("part = 'test'"), ts < s.val_cut),
        violations("Q6_truth_unique", rows.groupBy("part", "user_idx", "item_idx").count().where("count > 1")),
        violations("Q6_truth_equal", difference(flat, rows)),
        violations("Q7_positive_in_mask", pairs.join(primary, ["user_idx", "item_idx"])),
        violations("Q8_candidates", sp.candidates.join(wanted, "item_idx", "left_anti")),
        violations("Q8_candidates_lacking", wanted.join(sp.candidates, "item_idx", "left_anti")),
        violations("Q9_primary_in_seen", primary.join(seen, ["user_idx", "item_idx"], "left_anti")),
        equal.select(F.lit("Q9_primary_equals_seen").alias("check"), "violations"),
        violations("Q9_older_mask_differs", older),
        violations("Q10_one_structural_edge", meta.groupBy("item_idx").count().where("count <> 1")),
        violations("Q11_items_with_metadata", sp.items.join(meta, "item_idx", "left_anti")),
        violations("Q11_node_counts", difference(counts, counts if authority is None else authority).select("node_type").distinct()),
        violations("Q13_null_indices", sp.positives, F.col("user_idx").isNull() | F.col("item_idx").isNull()),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
