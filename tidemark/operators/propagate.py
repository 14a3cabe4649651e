"""Graph propagation and temporal kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import delta_days, hash32, softplus, top_per_group


def normalized(pairs: DataFrame) -> DataFrame:
    """Weight 1 / sqrt(deg u * deg i) of each pair."""
    du = pairs.groupBy("user_idx").agg(F.count("*").alias("du"))
    di = pairs.groupBy("item_idx").agg(F.count("*").alias("di"))
    return pairs.join(du, "user_idx").join(di, "item_idx").select("user_idx", "item_idx", (1.0 / F.sqrt(F.col("du").cast("double") * F.col("di"))).alias("w"))


def start_vectors(pairs: DataFrame, dims: int, seed: str) -> DataFrame:
    """Hash-made vectors in long form: (kind, node, dim, x), x in [0, 1)."""
    nodes = pairs.select(F.lit("user").alias("kind"), F.col("user_idx").alias("node")).unionByName(pairs.select(F.lit("item").alias("kind"), F.col("item_idx").alias("node"))).distinct()
    grid = nodes.select("kind", "node", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim"))
    return grid.select("kind", "node", F.col("dim").cast("long").alias("dim"), (hash32(seed, F.col("kind"), F.col("node"), F.col("dim")) / 4294967296.0).alias("x"))


def propagate(pairs: DataFrame, vectors: DataFrame, layers: int) -> DataFrame:
    """x' = A x for `layers` layers; the mean of layers 0 to `layers`."""
    adj = normalized(pairs)
    both = adj.select(F.lit("user").alias("kind"), F.col("user_idx").alias("node"), F.col("item_idx").alias("from"), "w").unionByName(adj.select(F.lit("item").alias("kind"), F.col("item_idx").alias("node"), F.col("user_idx").alias("from"), "w"))
    total, layer = vectors, vectors
    for _ in range(layers):
        sent = layer.select(F.when(F.col("kind") == "user", "item").otherwise("user").alias("kind"), F.col("node").alias("from"), "dim", "x")
        layer = both.join(sent, ["kind", "from"]).groupBy("kind", "node", "dim").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        total = total.unionByName(layer)
    return total.groupBy("kind", "node", "dim").agg(F.round(F.sum("x") / (layers + 1), 6).alias("x"))


def neighbor_mean(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """G13 (aggregate part): mean of a user's item vectors."""
    items = vectors.where("kind = 'item'").select(F.col("node").alias("item_idx"), "dim", "x")
    return pairs.join(items, "item_idx").groupBy("user_idx", "dim").agg(F.round(F.avg("x"), 6).alias("x"))


def behavior_degrees(events: DataFrame, behaviors: list[str]) -> DataFrame:
    """Degree of each user by behaviour in cascade order, with ids from 1."""
    counts = [F.count_if(F.col("behavior") == b).alias(f"deg_{b}") for b in behaviors]
    return events.groupBy((F.col("user_idx") + 1).alias("user_id1")).agg(*counts)


def attention(events: DataFrame, ref: int, decay: dict[str, float]) -> DataFrame:
    """Softmax per (item, relation) of -softplus(rate) * log1p(days / 7), over edges strictly before ref (P13), and a sigmoid gate."""
    rate = F.lit(0.0)
    for b, x in decay.items():
        rate = F.when(F.col("behavior") == b, F.lit(x)).otherwise(rate)
    days = delta_days(F.lit(float(ref)), F.col("timestamp").cast("double"))
    edges = events.where(F.col("timestamp") < ref).select("user_idx", "item_idx", "behavior", "timestamp", (-softplus(rate) * F.log1p(days / 7.0)).alias("logit"))
    w = Window.partitionBy("item_idx", "behavior")
    edges = edges.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w)))
    return edges.select("user_idx", "item_idx", "behavior", "timestamp", F.round(F.col("e") / (F.sum("e").over(w) + 1e-12), 6).alias("alpha"), F.round(1.0 / (1.0 + F.exp(-F.col("logit"))), 6).alias("gate"))


def fourier(events: DataFrame, ref: int, raw: list[float]) -> DataFrame:
    """Cos and sin of softplus(raw) * log1p(days)."""
    z = F.log1p(delta_days(F.lit(float(ref)), F.col("timestamp").cast("double")))
    out = [c for i, r in enumerate(raw) for c in (F.round(F.cos(softplus(F.lit(r)) * z), 6).alias(f"cos{i}"), F.round(F.sin(softplus(F.lit(r)) * z), 6).alias(f"sin{i}"))]
    return events.select("user_idx", "item_idx", "timestamp", *out).distinct()


def decayed_popularity(events: DataFrame, ref: int, eta: dict[str, float], tau: float = 30.0) -> DataFrame:
    """log1p of the softplus-weighted sums of exp(-days / tau), by behaviour."""
    days = delta_days(F.lit(float(ref)), F.col("timestamp").cast("double"))
    total = F.lit(0.0)
    for b, x in eta.items():
        total = total + softplus(F.lit(x)) * F.sum(F.when(F.col("behavior") == b, F.exp(-days / tau)).otherwise(0.0))
    return events.where(F.col("timestamp") < ref).groupBy("item_idx").agg(F.round(F.log1p(total), 6).alias("score"))


def latest(events: DataFrame, length: int) -> DataFrame:
    """Each user's latest events; order: timestamp, behavior_id, item_idx."""
    return top_per_group(events, ["user_idx"], [F.desc("timestamp"), F.desc("behavior_id"), F.desc("item_idx")], length, "_r")


def last_events(events: DataFrame, length: int) -> DataFrame:
    """Each user's latest events, oldest first, as (item, behavior) strings."""
    late = latest(events, length)
    ordered = F.array_sort(F.collect_list(F.struct("timestamp", "behavior_id", "item_idx")))
    return late.groupBy("user_idx").agg(F.array_join(F.transform(ordered, lambda e: F.concat_ws(":", e["item_idx"].cast("string"), e["behavior_id"].cast("string"))), ",").alias("sequence"), F.count("*").alias("n"))


def recency(events: DataFrame, ref: int) -> DataFrame:
    """W10, G23 (features): log1p of the number of events and of the days since the last."""
    days = delta_days(F.lit(float(ref)), F.max("timestamp").cast("double"))
    return events.groupBy("user_idx").agg(F.round(F.log1p(F.count("*").cast("double")), 6).alias("log_events"), F.round(F.log1p(days), 6).alias("log_days"))
