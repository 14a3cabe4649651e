"""Profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def month_counts(log: DataFrame) -> DataFrame:
    """A8, E6"""
    return log.groupBy(F.date_format("event_time", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n"))


def month_pivot(log: DataFrame, behaviors: list[str]) -> DataFrame:
    """Fixed columns, zeros filled."""
    return log.groupBy(F.date_format("event_time", "yyyy-MM").alias("month")).pivot("event_type", behaviors).count().na.fill(0).orderBy("month")


def month_rollup(log: DataFrame) -> DataFrame:
    """Ours: A8 with subtotals."""
    return log.rollup(F.date_format("event_time", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n"))


def behavior_share(log: DataFrame) -> DataFrame:
    """E3"""
    counts = log.groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.select("event_type", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("pct"))


def totals(events: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """By behaviour: edges, mean per user, sparsity of the user-item matrix."""
    size = users.agg(F.count("*").alias("u")).crossJoin(items.agg(F.count("*").alias("i")))
    pairs = events.groupBy("behavior").agg(F.count("*").alias("edges"), F.count_distinct("user_idx", "item_idx").alias("pairs"))
    return pairs.crossJoin(F.broadcast(size)).select("behavior", "edges", "pairs", F.round(F.col("edges") / F.col("u"), 6).alias("per_user"), F.round(1.0 - F.col("pairs") / (F.col("u") * F.col("i")), 6).alias("sparsity"))


def degrees(events: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """A10: every node, zero for those without events."""
    return nodes.join(events.groupBy(key).agg(F.count("*").alias("degree")), key, "left").select(key, F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_summary(deg: DataFrame, kind: str) -> DataFrame:
    """Over nodes of positive degree; the median interpolates."""
    return deg.where("degree > 0").agg(F.count("*").alias("nodes"), F.round(F.avg("degree"), 6).alias("mean"), F.round(F.percentile("degree", 0.5), 6).alias("median"), F.max("degree").alias("max"), F.min("degree").alias("min")).select(F.lit(kind).alias("kind"), "nodes", "mean", "median", "max", "min")


def ccdf(deg: DataFrame) -> DataFrame:
    """P(X >= d) of each positive degree; the window runs over distinct degrees only."""
    counts = deg.where("degree > 0").groupBy("degree").agg(F.count("*").alias("n"))
    tail = F.sum("n").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("degree", F.round(tail / F.sum("n").over(Window.partitionBy()), 9).alias("p"))


def ccdf_points(points: DataFrame, most: int) -> DataFrame:
    """K8: of more than `most` points those nearest to `most` places evenly spaced on a logarithmic axis of their order.

    points are one row per distinct degree, which are numbered at once.
    """
    numbered = points.withColumn("place", F.row_number().over(Window.orderBy("degree")) - 1).withColumn("all", F.count("*").over(Window.partitionBy()))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.round(F.pow(F.lit(10.0), i * F.log10(F.greatest(F.col("all") - 1, F.lit(1)).cast("double")) / (most - 1))).cast("int"))
    return numbered.where((F.col("all") <= most) | F.array_contains(spaced, F.col("place").cast("int"))).select("degree", "p")


def summary(events: DataFrame, positives: DataFrame, users: DataFrame, items: DataFrame, meta: DataFrame, target: str) -> DataFrame:
    """(metric, value): nodes, edges (those of the target with the held-out pairs), sparsity, means a user, ratios, held-out pairs and users."""
    kinds = ["view", "cart", "purchase"]
    held = [F.count_if(F.col("part") == x).alias(f"{x}_pairs") for x in ("val", "test")] + [F.count_distinct(F.when(F.col("part") == x, F.col("user_idx"))).alias(f"{x}_users") for x in ("val", "test")]
    row = events.agg(*(F.count_if(F.col("behavior") == b).alias(b) for b in kinds))
    for other in (positives.agg(*held), users.agg(F.count("*").alias("users")), items.agg(F.count("*").alias("products")), meta.agg(F.count_distinct("category_idx").alias("categories"), F.count_distinct("brand_idx").alias("brands"), F.count("*").alias("edges_belongsTo"))):
        row = row.crossJoin(F.broadcast(other))
    row = row.withColumn(target, F.col(target) + F.col("val_pairs") + F.col("test_pairs"))
    every, pairs = sum((F.col(b) for b in kinds[1:]), F.col(kinds[0])), F.col("users") * F.col("products")
    values = {n: F.col(n) for n in ("users", "products", "categories", "brands")} | {"nodes": F.col("users") + F.col("products") + F.col("categories") + F.col("brands")}
    values |= {f"edges_{b}": F.col(b) for b in kinds} | {"edges_belongsTo": F.col("edges_belongsTo"), "edges_producedBy": F.col("edges_belongsTo"), "edges_behavior": every}
    values |= {f"sparsity_{b}": 1.0 - F.col(b) / pairs for b in kinds} | {f"per_user_{b}": F.col(b) / F.col("users") for b in kinds} | {"per_user": every / F.col("users"), "density": every / pairs}
    values |= {f"{b}_per_{target}": F.col(b) / F.col(target) for b in kinds if b != target} | {f"{x}_{y}": F.col(f"{x}_{y}") for x in ("val", "test") for y in ("pairs", "users")}
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.round(v.cast("double"), 6).alias("value")) for n, v in values.items()))).alias("r")).select("r.*")


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, n): rows of each step."""
    out = None
    for name, df in stages.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def bounds(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(name, column, least, most, nulls) of the index columns of each table, in one pass each."""
    out = None
    for name, (df, columns) in tables.items():
        made = df.agg(*(f(c).alias(f"{c}_{i}") for c in columns for i, f in enumerate((F.min, F.max, lambda c: F.count_if(F.col(c).isNull())))))
        rows = made.select(F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(c).alias("column"), F.col(f"{c}_0").cast("long").alias("least"), F.col(f"{c}_1").cast("long").alias("most"), F.col(f"{c}_2").alias("nulls")) for c in columns))).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def head_share(deg: DataFrame, shares: list[float]) -> DataFrame:
    """Share of events on the top x of items, from distinct degrees and their counts; a tie is split evenly."""
    counts = deg.groupBy("degree").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    runs = counts.select("degree", "n", F.sum("n").over(w).alias("upto"), F.sum("n").over(every).alias("items"), F.sum(F.col("n") * F.col("degree")).over(every).alias("mass"))
    runs = runs.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    taken = F.greatest(F.least(F.floor(F.col("share") * F.col("items")) - (F.col("upto") - F.col("n")), F.col("n")), F.lit(0))
    return runs.groupBy("share").agg(F.round(F.sum(taken * F.col("degree")) / F.max("mass"), 6).alias("events_share"))


def overlap(events: DataFrame, behaviors: list[str]) -> DataFrame:
    """Distinct pairs of two behaviours, and of both; one pass over distinct pairs."""
    flags = events.groupBy("user_idx", "item_idx").agg(*[F.max((F.col("behavior") == b).cast("int")).alias(b) for b in behaviors])
    combos = [(a, b) for i, a in enumerate(behaviors) for b in behaviors[i + 1 :]]
    sums = flags.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}") for a, b in combos], F.count("*").alias("all_pairs"))
    return sums
