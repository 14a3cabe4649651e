"""Queries of the sampled subgraph and of the relational part of a graph layer, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import hash32
from tidemark.operators import edges, layers, propagate, sampling
from tidemark.plans.catalog import BATCH, DAYS, ETA, H1, H2, LENGTH, SEED, SP, T1, register
from tidemark.plans.pipeline import Pipeline
from tidemark.sources import readers

P = layers.LayerParameters()
INTENTS, NODES = 4, 1_000_000
DIMS = range(P.dims)


def sampled(p: Pipeline) -> DataFrame:
    """The subgraph of every user, each product a node of its own for each seed."""
    p = p.materialised()
    return readers.cut_lineage(sampling.subgraph_edges(edges.compressed_rows(p.behavior_edges), p.meta, p.split.users.select("user_idx"), H1, H2, SEED))


def layer_input(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, vectors): nodes are numbered seed * NODES + node; their vectors are those of the node."""
    one = lambda c: (F.col("seed") * NODES + F.col(c)).alias(c)
    numbered = rows.select("src_type", "rel", "dst_type", one("src"), one("dst"), "origin", "ts")
    ends = [rows.select(F.col(f"{e}_type").alias("kind"), F.col(e).alias("node"), (F.col("seed") * NODES + F.col(e)).alias("own")) for e in ("src", "dst")]
    nodes = ends[0].unionByName(ends[1]).distinct()
    vectors = nodes.join(layers.node_vectors(nodes.select("kind", "node").distinct(), P.dims, SEED), ["kind", "node"])
    return numbered, readers.cut_lineage(vectors.select("kind", F.col("own").alias("node"), "h"))


def places(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """An array as rounded columns column0, column1, ..."""
    return df.select(*keys, *(F.round(F.col(column)[i], 6).alias(f"{column}{i}") for i in DIMS))


def sql_places(column: str) -> str:
    return ", ".join(f"round({column}[{i + 1}], 6) AS {column}{i}" for i in DIMS)


def lists(values: list) -> str:
    """A list literal of doubles."""
    return json.dumps(values) + "::DOUBLE[]" + "[]" * (bool(values) and isinstance(values[0], list))


def mul(matrix: str, h: str) -> str:
    return f"list_transform({matrix}, lambda line: list_dot_product(line, {h}))"


def plus(a: str, b: str) -> str:
    return "[" + ", ".join(f"({a})[{i + 1}] + ({b})[{i + 1}]" for i in DIMS) + "]"


def norm(h: str) -> str:
    mean = f"list_avg({h})"
    return f"list_transform({h}, lambda x: (x - {mean}) / sqrt(list_avg(list_transform({h}, lambda y: (y - {mean}) * (y - {mean}))) + 1e-5))"


def hashed(kind: str, node: str) -> str:
    one = "('0x' || substr(md5(concat_ws('|', '{}', {}, {}, '{}')), 1, 8))::BIGINT / 4294967296.0"
    return "[" + ", ".join(one.format(SEED, kind, node, i) for i in DIMS) + "]::DOUBLE[]"


SUB = """,
one AS (SELECT src AS seed, 'user' AS src_type, rel, 'product' AS dst_type, src, dst, CAST(NULL AS VARCHAR) AS origin, ts FROM hop1
  UNION ALL SELECT src, 'product', rel2, CASE rel2 WHEN 'belongsTo' THEN 'category' ELSE 'brand' END, product, dst2, tag, ts FROM hop2),
sub AS MATERIALIZED (SELECT * FROM one UNION ALL
  SELECT seed, dst_type, CASE rel WHEN 'belongsTo' THEN 'contains' WHEN 'producedBy' THEN 'brands' ELSE 'rev_' || rel END, src_type, dst, src, origin, ts FROM one)"""
register("subgraph_edges", f"{SUB} SELECT seed, src_type, rel, dst_type, src, dst, origin, ts FROM sub")(sampled)

_rows = ", ".join(
    f"('{rel}', {beta}, {lists(P.weight(k, beta))}, {layers.number(P.seed, 'b', k)}::DOUBLE, {layers.number(P.seed, 'c', k, beta)}::DOUBLE,"
    f" {lists(P.vector('r', 2 * P.freqs, k, beta))}, {layers.number(P.seed, 'lambda', beta)}::DOUBLE, {layers.number(P.seed, 'mu', beta)}::DOUBLE)"
    for k, rel in enumerate(layers.RELATIONS)
    for beta in range(4)
)
_omega = P.vector("omega", P.freqs)
_days = f"(CASE WHEN ts IS NULL THEN 0 ELSE {DAYS} END)"
_phi = "[" + ", ".join(f"{f}(ln(1 + {_days}) * {SP(f'({w})::DOUBLE')})" for f in ("cos", "sin") for w in _omega) + "]"
LAYER = f"""ends AS (SELECT seed, src_type AS kind, src AS node FROM sub UNION SELECT seed, dst_type, dst FROM sub),
lv AS MATERIALIZED (SELECT kind, seed * {NODES} + node AS node, {hashed('kind', 'node')} AS h FROM ends),
lp(rel, beta, weight, bias, gate_bias, gate_time, lam, mu) AS (VALUES {_rows}),
le AS (SELECT src_type, rel, dst_type, seed * {NODES} + src AS src, seed * {NODES} + dst AS dst, origin, ts,
  CASE coalesce(origin, replace(rel, 'rev_', '')) WHEN 'view' THEN 0 WHEN 'cart' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS beta, ln(1 + {_days} / 7) AS late, {_phi} AS phi FROM sub WHERE ts IS NULL OR ts < {T1}),
la AS (SELECT le.*, lp.weight, s.h AS hs,
  list_dot_product({mul(lists(P.matrix('Wq', P.dims, P.dims)), 'd.h')}, {mul(lists(P.matrix('Wk', P.dims, P.dims)), 's.h')}) / sqrt({P.dims}) + bias
    + list_dot_product({lists(P.vector('time', 2 * P.freqs))}, phi) - {SP('lam')} * late AS logit,
  1 / (1 + exp(-(gate_bias + list_dot_product(gate_time, phi) - {SP('mu')} * late))) AS gate
  FROM le JOIN lp USING (rel, beta) JOIN lv s ON s.kind = src_type AND s.node = src JOIN lv d ON d.kind = dst_type AND d.node = dst),
lx AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY rel, dst_type, dst)) AS x FROM la),
lw AS MATERIALIZED (SELECT *, x / (sum(x) OVER (PARTITION BY rel, dst_type, dst) + 1e-12) AS alpha FROM lx)"""
ATTENTION = f"{SUB}, {LAYER}"
SUMS = f"""lm AS MATERIALIZED (SELECT kind, node, bucket, [{', '.join(f'sum(m[{i + 1}])' for i in DIMS)}] AS m FROM
  (SELECT dst_type AS kind, dst AS node, CASE WHEN replace(rel, 'rev_', '') IN ('view', 'cart', 'purchase') THEN replace(rel, 'rev_', '') ELSE 'struct' END AS bucket,
   list_transform({mul('weight', 'hs')}, lambda v: v * alpha * gate) AS m FROM lw) GROUP BY ALL)"""
_start = " ".join(f"WHEN '{b}' THEN {x}" for b, x in zip(layers.BUCKETS, layers.MIX_START, strict=True))
MESSAGES = f"{ATTENTION}, {SUMS}"
OUTPUT = f"""{LAYER}, {SUMS},
lb AS (SELECT kind, bucket, kind = 'user' AS some FROM (SELECT DISTINCT kind, bucket FROM lm)),
lt AS (SELECT k.kind, b.bucket, exp(CASE b.bucket {_start} END::DOUBLE) AS e, exists(SELECT 1 FROM lb WHERE lb.kind = k.kind AND lb.bucket = b.bucket) AS present
  FROM (SELECT DISTINCT kind FROM lb) k, (SELECT unnest({layers.BUCKETS}) AS bucket) b),
ls AS (SELECT kind, bucket, e / sum(CASE WHEN present OR kind <> 'user' THEN e END) OVER (PARTITION BY kind) AS share FROM lt),
lz AS (SELECT kind, node, [{', '.join(f'sum(m[{i + 1}])' for i in DIMS)}] AS m FROM (SELECT kind, node, list_transform({norm('m')}, lambda v: v * share) AS m FROM lm JOIN ls USING (kind, bucket)) GROUP BY ALL),
lh AS (SELECT kind, node, CASE WHEN kind IN (SELECT kind FROM lb) THEN list_transform(CASE WHEN m IS NULL THEN h ELSE {plus('h', 'm')} END, lambda v: CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END) ELSE h END AS h
  FROM lv LEFT JOIN lz USING (kind, node))"""
MIX = f"{SUB}, {OUTPUT}"


@register(
    "relation_weights",
    " SELECT * FROM (VALUES " + ", ".join(f"('{rel}', {beta}, {i}, {j}, round({x!r}::DOUBLE, 6))" for k, rel in enumerate(layers.RELATIONS) for beta in range(4) for i, line in enumerate(P.weight(k, beta)) for j, x in enumerate(line)) + ") AS t(rel, beta, \"row\", col, w)",
)
def relation_weights(p: Pipeline) -> DataFrame:
    """G15"""
    return layers.relation_weights(p.raw.sparkSession, P).withColumn("w", F.round("w", 6))


@register("layer_attention", f"{ATTENTION} SELECT rel, src, dst, origin, ts, beta, round(alpha, 6) AS alpha, round(gate, 6) AS gate FROM lw")
def layer_attention(p: Pipeline) -> DataFrame:
    """G17"""
    rows = layers.temporal_attention(*layer_input(sampled(p)), P, T1)
    return rows.select("rel", "src", "dst", "origin", "ts", "beta", F.round("alpha", 6).alias("alpha"), F.round("gate", 6).alias("gate"))


@register("layer_messages", f"{MESSAGES} SELECT kind, node, bucket, {sql_places('m')} FROM lm")
def layer_messages(p: Pipeline) -> DataFrame:
    """G18"""
    return places(layers.messages(*layer_input(sampled(p)), P, T1), "m", "kind", "node", "bucket")


@register("layer_output", f"{MIX} SELECT kind, node, {sql_places('h')} FROM lh")
def layer_output(p: Pipeline) -> DataFrame:
    """G18, G19"""
    rows, vectors = layer_input(sampled(p))
    return places(layers.mix_buckets(layers.messages(rows, vectors, P, T1), vectors, P), "h", "kind", "node")


PRODUCT_SUB = """pone AS (SELECT item_idx AS seed, 'belongsTo' AS rel, 'category' AS kind, category_idx AS dst FROM meta UNION ALL SELECT item_idx, 'producedBy', 'brand', brand_idx FROM meta),
sub AS MATERIALIZED (SELECT seed, 'product' AS src_type, rel, kind AS dst_type, seed AS src, dst, 'purchase' AS origin, CAST(NULL AS BIGINT) AS ts FROM pone
  UNION ALL SELECT seed, kind, CASE rel WHEN 'belongsTo' THEN 'contains' ELSE 'brands' END, 'product', dst, seed, 'purchase', NULL FROM pone)"""


@register(
    "embedding_export",
    f" SELECT kind, node // {NODES} AS node, {sql_places('h')} FROM (WITH {SUB.lstrip(',')}, {OUTPUT} SELECT * FROM lh) WHERE kind = 'user' "
    f"UNION ALL SELECT kind, node // {NODES}, {sql_places('h')} FROM (WITH {PRODUCT_SUB}, {OUTPUT} SELECT * FROM lh) WHERE kind = 'product'",
)
def embedding_export(p: Pipeline) -> DataFrame:
    """A vector of each user by its own subgraph and of each item by its structural one."""
    out = None
    for kind, rows in (("user", sampled(p)), ("product", sampling.product_edges(p.meta, p.split.items.select("item_idx"), H2))):
        found, vectors = layer_input(rows)
        made = layers.mix_buckets(layers.messages(found, vectors, P, T1), vectors, P).where(F.col("kind") == kind)
        made = places(made.withColumn("node", F.floor(F.col("node") / NODES)), "h", "kind", "node")
        out = made if out is None else out.unionByName(made)
    return out


def _attended(kind: str) -> str:
    book = P.matrix(f"intent_{kind}", INTENTS, P.dims)
    scores = f"list_transform({lists(book)}, lambda line: exp(list_dot_product(line, h) / sqrt({P.dims})))"
    columns = [[row[i] for row in book] for i in DIMS]
    return "[" + ", ".join(f"h[{i + 1}] + list_dot_product({scores}, {lists(c)}) / list_sum({scores})" for i, c in enumerate(columns)) + "]"


@register(
    "intent_codebook",
    f"{SUB}, ends AS (SELECT seed, src_type AS kind, src AS node FROM sub UNION SELECT seed, dst_type, dst FROM sub), lv AS (SELECT kind, seed * {NODES} + node "
    f"AS node, {hashed('kind', 'node')} AS h FROM ends), li AS (SELECT kind, node, CASE kind WHEN 'user' THEN {_attended('user')} "
    f"WHEN 'product' THEN {_attended('product')} ELSE h END AS h FROM lv) SELECT kind, node, {sql_places('h')} FROM li",
)
def intent_codebook(p: Pipeline) -> DataFrame:
    """G21"""
    return places(layers.intent(layer_input(sampled(p))[1], P, INTENTS), "h", "kind", "node")


def _layer(n: int, before: str) -> str:
    made = plus(plus(mul(lists(P.matrix("mean", P.dims, P.dims, n)), "mean"), lists(P.vector("bias", P.dims, n))), mul(lists(P.matrix("self", P.dims, P.dims, n)), "h"))
    made = f"list_transform({made}, lambda v: greatest(v, 0))" if n == 1 else made
    return f"""
sm{n} AS (SELECT b.kind, b.node, [{', '.join(f'avg(v.h[{i + 1}])' for i in DIMS)}] AS mean FROM both_pairs b JOIN {before} v ON v.kind <> b.kind AND v.node = b.other GROUP BY ALL),
sa{n} AS (SELECT kind, node, {made} AS h FROM {before} JOIN sm{n} USING (kind, node)),
sl{n} AS MATERIALIZED (SELECT kind, node, {norm('h')} AS h FROM sa{n})"""


@register("mean_layers", f""",
both_pairs AS MATERIALIZED (SELECT 'user' AS kind, user_idx AS node, item_idx AS other FROM pairs UNION ALL SELECT 'product', item_idx, user_idx FROM pairs),
s0 AS MATERIALIZED (SELECT kind, node, {hashed('kind', 'node')} AS h FROM (SELECT DISTINCT kind, node FROM both_pairs)),{_layer(1, 's0')},{_layer(2, 'sl1')}
SELECT kind, node, {', '.join(f'round(sl2.h[{i + 1}] + s0.h[{i + 1}], 6) AS h{i}' for i in DIMS)} FROM sl2 JOIN s0 USING (kind, node)""")
def mean_layers(p: Pipeline) -> DataFrame:
    """G13"""
    pairs = readers.cut_lineage(p.split.train.select("user_idx", "item_idx").distinct())
    nodes = pairs.select(F.lit("user").alias("kind"), F.col("user_idx").alias("node")).unionByName(pairs.select(F.lit("product").alias("kind"), F.col("item_idx").alias("node"))).distinct()
    return places(layers.mean_layers(pairs, layers.node_vectors(nodes, P.dims, SEED), P), "h", "kind", "node")


_hidden = "list_transform([{}], lambda v: greatest(v, 0))".format(", ".join(f"list_dot_product({lists(row)}, feats) + {b}" for row, b in zip(P.matrix("fuse1", 4, 3), P.vector("fuse1_bias", 4), strict=True)))
_shares = "[{}]".format(", ".join(f"exp(list_dot_product({lists(row)}, hidden) + {b})" for row, b in zip(P.matrix("fuse2", 3, 4), P.vector("fuse2_bias", 3), strict=True)))
_pop = "ln(1 + " + " + ".join(f"{SP(f'{x}::DOUBLE')} * sum(CASE WHEN behavior = '{b}' THEN exp(-{DAYS} / 30) ELSE 0 END)" for b, x in ETA.items()) + ")"


@register("fusion_score", f""",
late AS (SELECT user_idx, item_idx FROM ev QUALIFY row_number() OVER (PARTITION BY user_idx ORDER BY ts DESC, behavior_id DESC, item_idx DESC) <= {LENGTH}),
ivec AS (SELECT item_idx, {hashed("'product'", 'item_idx')} AS iv, ('0x' || substr(md5(concat_ws('|', 'bias', item_idx)), 1, 8))::BIGINT / 4294967296.0 AS bias FROM iv),
zv AS (SELECT user_idx, [{', '.join(f'avg(iv[{i + 1}])' for i in DIMS)}] AS zv FROM late JOIN ivec USING (item_idx) GROUP BY 1),
rec AS (SELECT user_idx, round(ln(1 + count(*)), 6) AS log_events, round(ln(1 + greatest(({T1} - max(ts)) / 86400.0::DOUBLE, 0)), 6) AS log_days FROM ev GROUP BY 1),
popd AS (SELECT item_idx, round({_pop}, 6) AS pop FROM ev WHERE ts < {T1} GROUP BY 1),
fu AS (SELECT user_idx, item_idx, {hashed("'user'", 'user_idx')} AS uv, zv, log_events, log_days, ivec.iv AS iv, bias, pop FROM (SELECT DISTINCT user_idx, item_idx FROM positives) JOIN zv USING (user_idx) JOIN rec USING (user_idx) JOIN ivec USING (item_idx) JOIN popd USING (item_idx)),
f1 AS (SELECT *, [log_events, log_days, sqrt(list_dot_product(uv, uv))] AS feats FROM fu), f2 AS (SELECT *, {_hidden} AS hidden FROM f1), f3 AS (SELECT *, {_shares} AS shares FROM f2)
SELECT user_idx, item_idx, round(list_dot_product(shares, [list_dot_product(uv, iv) + bias, list_dot_product(zv, iv), pop]) / list_sum(shares), 6) AS score FROM f3""")
def fusion_score(p: Pipeline) -> DataFrame:
    """The new purchases scored by three experts; the sequence's vector is the mean of its items."""
    p = p.materialised()
    items = layers.node_vectors(p.split.items.select(F.lit("product").alias("kind"), F.col("item_idx").alias("node")), P.dims, SEED).select(F.col("node").alias("item_idx"), F.col("h").alias("iv"))
    latest = propagate.latest(p.events, LENGTH).join(items, "item_idx")
    sequence = latest.groupBy("user_idx").agg(F.array(*(F.avg(F.col("iv")[i]) for i in DIMS)).alias("zv"))
    users = layers.node_vectors(p.split.users.select(F.lit("user").alias("kind"), F.col("user_idx").alias("node")), P.dims, SEED).select(F.col("node").alias("user_idx"), F.col("h").alias("uv"))
    users = users.join(sequence, "user_idx").join(propagate.recency(p.events, T1), "user_idx")
    items = items.withColumn("bias", hash32("bias", F.col("item_idx")) / 4294967296.0).join(propagate.decayed_popularity(p.events, T1, ETA).withColumnRenamed("score", "pop"), "item_idx")
    pairs = p.split.positives.select("user_idx", "item_idx").distinct()
    return layers.fusion(pairs, users, items, P).withColumn("score", F.round("score", 6))
