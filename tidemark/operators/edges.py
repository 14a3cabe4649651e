"""Train events, structural edges, metadata and the typed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import dense_ids, digest
from tidemark.operators.cleanse import behavior_id
from tidemark.operators.split import Split
from tidemark.settings import Settings


def train_events(log: DataFrame, sp: Split, s: Settings) -> DataFrame:
    """Every behaviour of known users and items before the train cutoff."""
    early = log.where(F.col("timestamp") < s.train_cut)
    session = ["user_session"] if "user_session" in log.columns else []
    return early.join(sp.users, "user_id").join(sp.items, "product_id").select("user_idx", "item_idx", F.col("event_type").alias("behavior"), behavior_id(s).alias("behavior_id"), "timestamp", *session)


def auxiliary(events: DataFrame, s: Settings) -> DataFrame:
    """The other behaviours; duplicates stay."""
    return events.where(F.col("behavior") != s.target).withColumnRenamed("behavior", "event_type").drop("behavior_id")


def product_mode(log: DataFrame, sp: Split, s: Settings, column: str) -> DataFrame:
    """Each product's most frequent value, ties to the smaller; sentinels count like others."""
    window = log.where(F.col("timestamp") < s.train_cut) if s.metadata_source == "train_only" else log
    counts = window.join(sp.items, "product_id").groupBy("item_idx", column).agg(F.count("*").alias("n"))
    return counts.groupBy("item_idx").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(column).alias("v"))).alias("best")).select("item_idx", F.col("best.v").alias(column))


def item_metadata(log: DataFrame, sp: Split, s: Settings) -> DataFrame:
    """One row per item; items without a value in the window get the sentinel."""
    out = sp.items.select("item_idx")
    for column, unknown in (("category", s.unknown_category), ("brand", s.unknown_brand)):
        out = out.join(product_mode(log, sp, s, column), "item_idx", "left").withColumn(column, F.coalesce(column, F.lit(unknown)))
    for column in ("category", "brand"):
        out = out.join(dense_ids(out, column, f"{column}_idx"), column)
    return out.select("item_idx", "category", "category_idx", "brand", "brand_idx", F.lit(s.metadata_source).alias("metadata_source"))


def typed_edges(events: DataFrame, meta: DataFrame) -> DataFrame:
    """src_type, rel, dst_type, src, dst, ts; five relations and their reverses."""
    forward = events.select(F.lit("user").alias("src_type"), F.col("behavior").alias("rel"), F.lit("product").alias("dst_type"), F.col("user_idx").alias("src"), F.col("item_idx").alias("dst"), F.col("timestamp").alias("ts"))
    for rel, kind in (("belongsTo", "category"), ("producedBy", "brand")):
        forward = forward.unionByName(meta.select(F.lit("product").alias("src_type"), F.lit(rel).alias("rel"), F.lit(kind).alias("dst_type"), F.col("item_idx").alias("src"), F.col(f"{kind}_idx").alias("dst"), F.lit(None).cast("long").alias("ts")))
    named = F.when(F.col("rel") == "belongsTo", "contains").when(F.col("rel") == "producedBy", "brands").otherwise(F.concat(F.lit("rev_"), F.col("rel")))
    return forward.unionByName(forward.select(F.col("dst_type").alias("src_type"), named.alias("rel"), F.col("src_type").alias("dst_type"), F.col("dst").alias("src"), F.col("src").alias("dst"), "ts"))


def node_counts(sp: Split, meta: DataFrame) -> DataFrame:
    """C12, D22, Q11"""
    kinds = {"user": sp.users.agg(F.count("*").alias("n")), "product": sp.items.agg(F.count("*").alias("n")), "category": meta.agg(F.count_distinct("category_idx").alias("n")), "brand": meta.agg(F.count_distinct("brand_idx").alias("n"))}
    out = None
    for kind, df in kinds.items():
        df = df.select(F.lit(kind).alias("node_type"), "n")
        out = df if out is None else out.unionByName(df)
    return out


def compressed_rows(edges: DataFrame, dedupe: bool = False) -> DataFrame:
    """Place of each edge in its source's row and the row's length; no pointer array is needed."""
    if dedupe:
        edges = edges.select("rel", "src", "dst").distinct().withColumn("ts", F.lit(None).cast("long"))
    w = Window.partitionBy("rel", "src")
    return edges.select("rel", "src", "dst", "ts", (F.row_number().over(w.orderBy(F.col("ts").asc_nulls_first(), "dst")) - 1).cast("long").alias("position"), F.count("*").over(w).alias("degree"))


def weighted_matrix(events: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(user, item) -> summed behaviour weight."""
    w = F.lit(0.0)
    for name, x in weights.items():
        w = F.when(F.col("behavior") == name, F.lit(float(x))).otherwise(w)
    return events.groupBy("user_idx", "item_idx").agg(F.sum(w).alias("weight"))


def density(matrix: DataFrame) -> DataFrame:
    """C17: filled share of the matrix in percent, and weights scaled by the largest."""
    return matrix.agg(F.count("*").alias("nnz"), F.count_distinct("user_idx").alias("users"), F.count_distinct("item_idx").alias("items"), F.max("weight").alias("max_weight"), F.sum("weight").alias("total")).select("nnz", "users", "items", F.round(100.0 * F.col("nnz") / (F.col("users") * F.col("items")), 6).alias("density_pct"), F.round(F.col("total") / F.col("nnz") / F.col("max_weight"), 6).alias("mean_scaled"))


def triplets(events: DataFrame, s: Settings, cap: int = 0, capped: str = "view") -> DataFrame:
    """(user, item, behavior_id, ts); at most `cap` rows of one behaviour, those first in hash order."""
    rows = events.select("user_idx", "item_idx", "behavior_id", "timestamp")
    if cap <= 0:
        return rows
    few = rows.where(F.col("behavior_id") == s.behaviors[capped]).orderBy(digest(s.seed, F.col("user_idx"), F.col("item_idx"), F.col("timestamp")), "user_idx", "item_idx", "timestamp").limit(cap)
    return rows.where(F.col("behavior_id") != s.behaviors[capped]).unionByName(few)


def minibatches(rows: DataFrame, s: Settings, size: int) -> DataFrame:
    """K7: shuffled batches of equal size, the short last one dropped.

    Rows are numbered within 4096 parts of their hash order and shifted by running counts, so no task
    holds all rows; only the parts' counts meet in one place.
    """
    keyed = rows.withColumn("_h", digest(s.seed, *[F.col(c) for c in rows.columns])).withColumn("_p", F.substring("_h", 1, 3))
    counts = keyed.groupBy("_p").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.select("_p", (F.sum("_n").over(w) - F.col("_n")).alias("_b"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_total"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", *rows.columns)) - 1
    numbered = keyed.withColumn("_i", place).join(before, "_p").withColumn("batch", F.floor((F.col("_i") + F.col("_b")) / size).cast("long"))
    return numbered.where(F.col("batch") < F.floor(F.col("_total") / size)).select(*rows.columns, "batch")
