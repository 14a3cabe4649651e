"""Losses as aggregates over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import dot, hash32, softplus


def pseudo_score(seed: str, *keys: str) -> Column:
    """A fixed score in [-2, 2) for a pair, standing for a model's."""
    return hash32(seed, *[F.col(k) for k in keys]) / 4294967296.0 * 4.0 - 2.0


def behavior_weights(events: DataFrame, target: str, power: float = 0.5, least: float = 0.05) -> DataFrame:
    """clip((N target / N behaviour) ** power, least, 1)."""
    counts = events.groupBy("behavior").agg(F.count("*").alias("n"))
    base = counts.where(F.col("behavior") == target).select(F.col("n").alias("nt"))
    return counts.crossJoin(F.broadcast(base)).select("behavior", "n", F.round(F.least(F.greatest(F.pow(F.col("nt") / F.col("n"), F.lit(power)), F.lit(least)), F.lit(1.0)), 6).alias("weight"))


def bpr(scored: DataFrame) -> DataFrame:
    """N3 by behaviour: rows (behavior, pos, neg) -> mean of softplus(neg - pos)."""
    return scored.groupBy("behavior").agg(F.avg(softplus(F.col("neg") - F.col("pos"))).alias("loss"))


def multi_task_bpr(scored: DataFrame, weights: DataFrame, n_behaviors: int = 3) -> DataFrame:
    """Weighted sum over behaviours that occur, times n_behaviors / their number."""
    joined = bpr(scored).join(weights, "behavior")
    return joined.agg(F.round(F.sum(F.col("weight") * F.col("loss")) * n_behaviors / F.count("*"), 6).alias("loss"))


def funnel(scores: DataFrame, pairs: list[tuple[str, str]], margin: float) -> DataFrame:
    """Scores (user, item, behaviour columns) -> mean over pairs of mean relu(weak - strong + margin) ** 2."""
    parts = [F.avg(F.pow(F.greatest(F.col(weak) - F.col(strong) + margin, F.lit(0.0)), F.lit(2.0))) for weak, strong in pairs]
    return scores.agg(F.round(sum(parts[1:], parts[0]) / len(parts), 6).alias("loss"))


def monotonic(rates: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rates (layer, behavior, raw) -> layer mean of softplus, then mean relu(strong - weak) ** 2."""
    mean = rates.groupBy().pivot("behavior", sorted({b for p in pairs for b in p})).agg(F.avg(softplus(F.col("raw"))))
    parts = [F.pow(F.greatest(F.col(strong) - F.col(weak), F.lit(0.0)), F.lit(2.0)) for weak, strong in pairs]
    return mean.select(F.round(sum(parts[1:], parts[0]) / len(parts), 6).alias("loss"))


def contrast_users(events: DataFrame, pairs: list[tuple[str, str, float]], least: int) -> DataFrame:
    """Users with both behaviours of a pair, for pairs with at least `least` such users."""
    out = None
    for weak, strong, weight in pairs:
        both = events.where(F.col("behavior") == weak).select("user_idx").distinct().join(events.where(F.col("behavior") == strong).select("user_idx").distinct(), "user_idx", "left_semi")
        part = both.agg(F.count("*").alias("users")).where(F.col("users") >= least).select(F.lit(weak).alias("weak"), F.lit(strong).alias("strong"), F.lit(weight).alias("weight"), "users")
        out = part if out is None else out.unionByName(part)
    return out


def info_nce(own: DataFrame, others: DataFrame, temperature: float) -> DataFrame:
    """Own (anchor, pos) and others (anchor, sim: its hard negatives) -> mean of -log softmax of the own row."""
    rows = others.join(own, "anchor").groupBy("anchor", "pos").agg(F.sum(F.exp(F.col("sim") / temperature)).alias("s"))
    p = F.exp(F.col("pos") / temperature)
    return rows.agg(F.round(F.avg(-F.log(p / (p + F.col("s")))), 6).alias("loss"))


def behavior_contrast(vectors: DataFrame, pairs: list[tuple[str, str, float]], hard: int, least: int, tau: float) -> DataFrame:
    """Vectors (batch, user_idx, behavior, h) -> (batch, weak, strong, users, loss).

    For each pair of behaviours: users of a batch with both; their normalised strong vectors against the
    weak ones of all of them, the own one being the positive; of the others the `hard` nearest count, or
    all where there are no more. Pairs with fewer than `least` users count nothing. Users meet only those
    of their batch, whose size is fixed, as in training. The loss is weighted by the pair's weight.
    """
    size = F.sqrt(dot(F.col("h"), F.col("h")))
    unit = vectors.withColumn("h", F.transform("h", lambda x: x / F.greatest(size, F.lit(1e-12))))
    out = None
    for weak, strong, weight in pairs:
        w, s = (unit.where(F.col("behavior") == b).select("batch", F.col("user_idx").alias(u), F.col("h").alias(h)) for b, u, h in ((weak, "other", "hw"), (strong, "user_idx", "hs")))
        both = s.join(w.select("batch", F.col("other").alias("user_idx")), ["batch", "user_idx"], "left_semi")
        common = w.join(both.select("batch", F.col("user_idx").alias("other")), ["batch", "other"], "left_semi")
        sims = both.join(common, "batch").select("batch", "user_idx", "other", (dot(F.col("hs"), F.col("hw")) / tau).alias("sim"))
        order = Window.partitionBy("batch", "user_idx").orderBy((F.col("user_idx") == F.col("other")).desc(), F.desc("sim"), F.asc("other"))
        near = sims.withColumn("place", F.row_number().over(order)).where(F.col("place") <= hard + 1)
        rows = near.groupBy("batch", "user_idx").agg(F.max(F.when(F.col("user_idx") == F.col("other"), F.col("sim"))).alias("own"), F.max("sim").alias("top"), F.collect_list("sim").alias("sims"))
        each = F.log(F.aggregate("sims", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("top")))) + F.col("top") - F.col("own")
        part = rows.groupBy("batch").agg(F.count("*").alias("users"), F.avg(each).alias("loss")).where(F.col("users") >= F.greatest(F.lit(least), F.lit(2)))
        part = part.select("batch", F.lit(weak).alias("weak"), F.lit(strong).alias("strong"), "users", F.round(F.col("loss") * weight, 6).alias("loss"))
        out = part if out is None else out.unionByName(part)
    return out


def weighted_mse(matrix: DataFrame, predicted: Column) -> DataFrame:
    """Mean of target * (predicted - target) ** 2."""
    t = F.col("weight")
    return matrix.agg(F.round(F.avg(t * F.pow(predicted - t, F.lit(2.0))), 6).alias("loss"))


def total(parts: dict[str, tuple[float, DataFrame]]) -> DataFrame:
    """Weighted sum of one-row losses; an absent one counts 0."""
    out = None
    for name, (weight, df) in parts.items():
        row = df.agg(F.coalesce(F.max("loss"), F.lit(0.0)).alias("loss")).select(F.lit(name).alias("term"), (F.col("loss") * weight).alias("loss"))
        out = row if out is None else out.unionByName(row)
    return out.agg(F.round(F.sum("loss"), 6).alias("loss"))


def cosine_warmup(df: DataFrame, step: Column, warmup: int, steps: int, peak: float, floor: float) -> DataFrame:
    """T5: linear warm-up, then cosine, never below floor."""
    done = (step - warmup) / F.lit(float(max(1, steps - warmup)))
    rate = F.when(step < warmup, F.lit(peak) * (step + 1) / float(warmup)).otherwise(F.lit(peak) * 0.5 * (1.0 + F.cos(F.lit(3.141592653589793) * F.least(done, F.lit(1.0)))))
    return df.select(step.alias("step"), F.round(F.greatest(rate, F.lit(floor)), 9).alias("rate"))
