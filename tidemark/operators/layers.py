"""The relational part of a graph layer, with its parameters as tables.

Vectors are arrays of doubles in one row per node: (kind, node, h). Edges carry src_type, rel, dst_type,
src, dst, origin (the behaviour that brought a structural edge in, or null) and ts. Parameters are of
fixed size, a few rows for each relation and behaviour, and are joined as literal tables.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import delta_days, dot, hash32, sigmoid, softplus

# Relations in the order of their parameters, behaviours with their numbers, buckets.
RELATIONS = ["view", "cart", "purchase", "rev_view", "rev_cart", "rev_purchase", "belongsTo", "contains", "producedBy", "brands"]
ORIGINS = {"view": 0, "cart": 1, "purchase": 2}
BUCKETS = ["view", "cart", "purchase", "struct"]
KINDS = ["user", "product", "category", "brand"]
MIX_START = [0.30, 0.50, 1.00, 0.40]
STRUCT = 3


def number(seed: str, *parts: object) -> float:
    """A fixed parameter in [-0.5, 0.5): it stands for a learned one, and is the same in every engine."""
    return round(int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16) / 4294967296.0 - 0.5, 6)


@dataclass(frozen=True)
class LayerParameters:
    """Numbers of one layer of width dims, with freqs time frequencies and factors of the given rank."""

    dims: int = 3
    freqs: int = 2
    rank: int = 2
    tau: float = 7.0
    seed: str = "layer"

    def vector(self, name: str, size: int, *at: object) -> list[float]:
        return [number(self.seed, name, *at, i) for i in range(size)]

    def matrix(self, name: str, rows: int, columns: int, *at: object) -> list[list[float]]:
        return [self.vector(name, columns, *at, i) for i in range(rows)]

    def weight(self, rho: int, beta: int) -> list[list[float]]:
        """W + A diag(z) B' of a relation and a behaviour."""
        w, a, b = (self.matrix(n, self.dims, c, rho) for n, c in (("W", self.dims), ("A", self.rank), ("B", self.rank)))
        z = self.vector("z", self.rank, beta)
        return [[w[i][j] + sum(a[i][r] * z[r] * b[j][r] for r in range(self.rank)) for j in range(self.dims)] for i in range(self.dims)]


def literal(values: list) -> Column:
    """An array, or an array of arrays, of doubles."""
    return F.array(*(literal(v) if isinstance(v, list) else F.lit(float(v)) for v in values))


def times(matrix: Column, h: Column) -> Column:
    """Matrix (array of rows) times vector."""
    return F.transform(matrix, lambda row: dot(row, h))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def summed(column: str, dims: int) -> Column:
    """Sum of arrays, one partial sum for each place."""
    return F.array(*(F.sum(F.col(column)[i]) for i in range(dims)))


def layer_norm(h: Column, dims: int) -> Column:
    mean = F.aggregate(h, F.lit(0.0), lambda s, x: s + x) / dims
    spread = F.sqrt(F.aggregate(h, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / dims + 1e-5)
    return F.transform(h, lambda x: (x - mean) / spread)


def softmax(scores: Column) -> Column:
    powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def node_vectors(nodes: DataFrame, dims: int, seed: str) -> DataFrame:
    """nodes (kind, node) -> (kind, node, h): hash-made vectors in [0, 1)."""
    return nodes.select("kind", "node", F.array(*(hash32(seed, F.col("kind"), F.col("node"), F.lit(i).cast("string")) / 4294967296.0 for i in range(dims))).alias("h"))


def relation_weights(spark: SparkSession, p: LayerParameters) -> DataFrame:
    """(rel, beta, row, col, w), one row per entry; beta 3 is a structural edge without origin."""
    rows = [(rel, beta, i, j, x) for k, rel in enumerate(RELATIONS) for beta in range(4) for i, line in enumerate(p.weight(k, beta)) for j, x in enumerate(line)]
    return spark.createDataFrame(rows, "rel string, beta int, row int, col int, w double")


def numbered(edges: DataFrame) -> DataFrame:
    """edges with beta: the behaviour's number, that of the origin of a structural edge, or STRUCT."""
    named = F.regexp_replace("rel", "^rev_", "")
    beta = F.lit(None).cast("int")
    for column in (F.col("origin"), named):
        for name, k in ORIGINS.items():
            beta = F.when(column == name, k).otherwise(beta)
    return edges.withColumn("beta", F.coalesce(beta, F.lit(STRUCT)))


def joined_parameters(spark: SparkSession, p: LayerParameters) -> DataFrame:
    """One row per (rel, beta): weight matrix, bias, gate bias and gate projection."""
    rows = []
    for k, rel in enumerate(RELATIONS):
        for beta in range(4):
            rows.append((rel, beta, p.weight(k, beta), number(p.seed, "b", k), number(p.seed, "c", k, beta), p.vector("r", 2 * p.freqs, k, beta), number(p.seed, "lambda", beta), number(p.seed, "mu", beta)))
    return F.broadcast(spark.createDataFrame(rows, "rel string, beta int, weight array<array<double>>, bias double, gate_bias double, gate_time array<double>, lambda double, mu double"))


def temporal_attention(edges: DataFrame, vectors: DataFrame, p: LayerParameters, ref: int) -> DataFrame:
    """Edges strictly before ref with alpha (softmax per destination and relation), gate and the message's weight.

    logit = q k / sqrt(d) + b + time bias - softplus(lambda) log1p(days / tau);
    gate = sigmoid(c + r phi - softplus(mu) log1p(days / tau)); phi are Fourier features of the days.
    """
    spark = edges.sparkSession
    early = numbered(edges.where(F.col("ts").isNull() | (F.col("ts") < ref)))
    ends = [vectors.select(F.col("kind").alias(f"{e}_type"), F.col("node").alias(e), F.col("h").alias(f"h_{e}")) for e in ("src", "dst")]
    rows = early.join(ends[0], ["src_type", "src"]).join(ends[1], ["dst_type", "dst"]).join(joined_parameters(spark, p), ["rel", "beta"])
    days = F.when(F.col("ts").isNull(), 0.0).otherwise(delta_days(F.lit(float(ref)), F.col("ts").cast("double")))
    omega = [softplus(F.lit(x)) for x in p.vector("omega", p.freqs)]
    phases = [F.log1p(days) * w for w in omega]
    phi = F.array(*(F.cos(x) for x in phases), *(F.sin(x) for x in phases))
    late = F.log1p(days / p.tau)
    rows = rows.withColumn("phi", phi).withColumn("late", late)
    query, key = (times(literal(p.matrix(n, p.dims, p.dims)), F.col(h)) for n, h in (("Wq", "h_dst"), ("Wk", "h_src")))
    logit = dot(query, key) / math.sqrt(p.dims) + F.col("bias") + dot(literal(p.vector("time", 2 * p.freqs)), F.col("phi")) - softplus(F.col("lambda")) * F.col("late")
    gate = sigmoid(F.col("gate_bias") + dot(F.col("gate_time"), F.col("phi")) - softplus(F.col("mu")) * F.col("late"))
    w = Window.partitionBy("rel", "dst_type", "dst")
    rows = rows.withColumn("logit", logit).withColumn("gate", gate)
    rows = rows.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w)))
    return rows.withColumn("alpha", F.col("e") / (F.sum("e").over(w) + 1e-12)).drop("e", "phi", "late")


def messages(edges: DataFrame, vectors: DataFrame, p: LayerParameters, ref: int) -> DataFrame:
    """(kind, node, bucket, m): sums of alpha * gate * W h over the edges into each node, by bucket."""
    rows = temporal_attention(edges, vectors, p, ref)
    sent = F.transform(times(F.col("weight"), F.col("h_src")), lambda x: x * F.col("alpha") * F.col("gate"))
    named = F.regexp_replace("rel", "^rev_", "")
    bucket = F.when(named.isin(*ORIGINS), named).otherwise("struct")
    return rows.select(F.col("dst_type").alias("kind"), F.col("dst").alias("node"), bucket.alias("bucket"), sent.alias("m")).groupBy("kind", "node", "bucket").agg(summed("m", p.dims).alias("m"))


def mix_buckets(found: DataFrame, vectors: DataFrame, p: LayerParameters) -> DataFrame:
    """(kind, node, h): elu of h plus the weighted, normalised messages of the buckets.

    Users weigh the buckets that occur for any user, the others all four. A node without a message in a
    bucket adds the norm of zeros, which is zero; kinds without any message keep their vectors.
    """
    present = found.select("kind", "bucket").distinct().groupBy("kind").agg(F.collect_set("bucket").alias("present"))
    start = literal(MIX_START)
    shares = F.transform(F.array(*(F.lit(b) for b in BUCKETS)), lambda b, i: F.when((F.col("kind") != "user") | F.array_contains("present", b), F.exp(start[i])).otherwise(0.0))
    kinds = F.broadcast(present.withColumn("shares", shares).withColumn("shares", F.transform("shares", lambda x: x / F.aggregate("shares", F.lit(0.0), lambda s, y: s + y))))
    place = F.array_position(F.array(*(F.lit(b) for b in BUCKETS)), F.col("bucket")).cast("int")
    weighted = found.join(kinds, "kind").withColumn("m", F.transform(layer_norm(F.col("m"), p.dims), lambda x: x * F.element_at("shares", place)))
    mixed = weighted.groupBy("kind", "node").agg(summed("m", p.dims).alias("m"))
    out = vectors.join(kinds.select("kind", F.lit(True).alias("met")), "kind", "left").join(mixed, ["kind", "node"], "left")
    total = F.when(F.col("m").isNull(), F.col("h")).otherwise(added(F.col("h"), F.col("m")))
    elu = F.transform(total, lambda x: F.when(x > 0, x).otherwise(F.exp(x) - 1.0))
    return out.select("kind", "node", F.when(F.col("met"), elu).otherwise(F.col("h")).alias("h"))


def intent(vectors: DataFrame, p: LayerParameters, size: int) -> DataFrame:
    """Users and products get softmax(x C' / sqrt(d)) C of their codebook added; other kinds stay."""
    out = F.col("h")
    for kind in ("user", "product"):
        book = p.matrix(f"intent_{kind}", size, p.dims)
        shares = softmax(F.transform(literal(book), lambda row: dot(row, F.col("h")) / math.sqrt(p.dims)))
        back = F.array(*(dot(shares, literal([row[i] for row in book])) for i in range(p.dims)))
        out = F.when(F.col("kind") == kind, added(F.col("h"), back)).otherwise(out)
    return vectors.select("kind", "node", out.alias("h"))


def mean_layers(pairs: DataFrame, vectors: DataFrame, p: LayerParameters) -> DataFrame:
    """Two layers of mean aggregation in both directions; (kind, node, h), kinds user and product.

    x' = Wm mean(neighbours) + b + Ws x; the first layer's is normed after relu, the second's normed
    and added to the start.
    """
    both = pairs.select(F.lit("user").alias("kind"), F.col("user_idx").alias("node"), F.col("item_idx").alias("other")).unionByName(pairs.select(F.lit("product").alias("kind"), F.col("item_idx").alias("node"), F.col("user_idx").alias("other")))
    h = vectors
    for layer in (1, 2):
        sent = h.select(F.when(F.col("kind") == "user", "product").otherwise("user").alias("kind"), F.col("node").alias("other"), F.col("h").alias("m"))
        mean = both.join(sent, ["kind", "other"]).groupBy("kind", "node").agg(F.array(*(F.avg(F.col("m")[i]) for i in range(p.dims))).alias("m"))
        made = added(added(times(literal(p.matrix("mean", p.dims, p.dims, layer)), F.col("m")), literal(p.vector("bias", p.dims, layer))), times(literal(p.matrix("self", p.dims, p.dims, layer)), F.col("h")))
        made = F.transform(made, lambda x: F.greatest(x, F.lit(0.0))) if layer == 1 else made
        h = h.join(mean, ["kind", "node"]).select("kind", "node", layer_norm(made, p.dims).alias("h"))
    return h.join(vectors.withColumnRenamed("h", "start"), ["kind", "node"]).select("kind", "node", added(F.col("h"), F.col("start")).alias("h"))


def fusion(pairs: DataFrame, users: DataFrame, items: DataFrame, p: LayerParameters) -> DataFrame:
    """(user_idx, item_idx, score): graph, sequence and popularity scores, weighed by the user's features.

    users: user_idx, uv, zv (vector of the latest events), log_events, log_days; items: item_idx, iv, bias,
    pop (decayed popularity). The weights are a softmax of two small layers over log_events, log_days and |uv|.
    """
    rows = pairs.join(users, "user_idx").join(items, "item_idx")
    feats = F.array("log_events", "log_days", F.sqrt(dot(F.col("uv"), F.col("uv"))))
    hidden = F.transform(added(times(literal(p.matrix("fuse1", 4, 3)), feats), literal(p.vector("fuse1_bias", 4))), lambda x: F.greatest(x, F.lit(0.0)))
    shares = softmax(added(times(literal(p.matrix("fuse2", 3, 4)), hidden), literal(p.vector("fuse2_bias", 3))))
    scores = F.array(dot(F.col("uv"), F.col("iv")) + F.col("bias"), dot(F.col("zv"), F.col("iv")), F.col("pop"))
    return rows.withColumn("shares", shares).select("user_idx", "item_idx", dot(F.col("shares"), scores).alias("score"))
