"""Queries of negatives, batches, evaluation, reports and checks, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import dot
from tidemark.operators import edges, layers, masks, objectives, profile, quality, ranking, sampling, split
from tidemark.plans.catalog import BATCH, BEHAVIORS, H1, KS, MBCL, SEED, S, T1, T2, _evaluation, list_hash, register, vectors
from tidemark.plans.layer_catalog import P, hashed
from tidemark.plans.pipeline import Pipeline
from tidemark.sources import readers

POWER, USERS, HARD, TAU = 0.75, 256, 8, 0.1


def popularity(p: Pipeline) -> DataFrame:
    return ranking.popularity(p.events, p.split.items)


def scorers(p: Pipeline) -> tuple[DataFrame, DataFrame]:
    """Hash-made vectors of users and items."""
    users = layers.node_vectors(p.split.users.select(F.lit("user").alias("kind"), F.col("user_idx").alias("node")), P.dims, SEED)
    items = layers.node_vectors(p.split.items.select(F.lit("product").alias("kind"), F.col("item_idx").alias("node")), P.dims, SEED)
    return users.select(F.col("node").alias("user_idx"), F.col("h").alias("uv")), items.select(F.col("node").alias("item_idx"), F.col("h").alias("iv"))


def _unseen(name: str, draws: str, n: int) -> str:
    """The first n unseen draws of each positive, filled up by popularity."""
    return f"""
{name}_all AS (SELECT user_idx, item_idx, neg, min(slot) AS slot FROM (SELECT * FROM {draws} UNION ALL SELECT user_idx, item_idx, neg, rank + (1 << 30) FROM asked JOIN unseen USING (user_idx)) WHERE neg <> item_idx GROUP BY ALL),
{name} AS MATERIALIZED (SELECT user_idx, item_idx, neg, row_number() OVER (PARTITION BY user_idx, item_idx ORDER BY slot, neg) AS pick FROM {name}_all a
  WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.user_idx = a.user_idx AND ev.item_idx = a.neg) QUALIFY pick <= {n})"""


def _uniform(n: int) -> str:
    return f"""
u_draws AS (SELECT user_idx, item_idx, {list_hash(SEED, 'user_idx', 'item_idx', 'slot')} % (SELECT count(*) FROM iv) AS neg, slot FROM asked, (SELECT unnest(range({n + 10})) AS slot)),{_unseen('u_neg', 'u_draws', n)}"""


ASKED = """,
asked AS MATERIALIZED (SELECT DISTINCT user_idx, item_idx FROM positives),
unseen AS MATERIALIZED (SELECT user_idx, item_idx AS neg, row_number() OVER (PARTITION BY user_idx ORDER BY n DESC, item_idx) AS rank FROM (SELECT DISTINCT user_idx FROM asked) q CROSS JOIN pop
  WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.user_idx = q.user_idx AND ev.item_idx = pop.item_idx)),"""
POPULAR = f"""
line0 AS (SELECT item_idx, round(1000.0 * pow(n + 1.0, {POWER}))::BIGINT AS mass FROM pop),
line AS MATERIALIZED (SELECT item_idx, sum(mass) OVER (ORDER BY item_idx)::BIGINT - mass AS low, sum(mass) OVER (ORDER BY item_idx)::BIGINT AS high FROM line0),
p_place AS (SELECT user_idx, item_idx, slot, ('0x' || substr(md5(concat_ws('|', '{SEED}', user_idx, item_idx, slot, 'popular')), 1, 15))::BIGINT % (SELECT max(high) FROM line) AS place FROM asked, (SELECT unnest(range(12)) AS slot)),
p_draws AS (SELECT p.user_idx, p.item_idx, line.item_idx AS neg, slot FROM p_place p JOIN line ON line.low <= place AND place < line.high),{_unseen('p_neg', 'p_draws', 2)}"""
HARDEST = f"""
h_rank AS (SELECT asked.user_idx, asked.item_idx, neg, list_dot_product({hashed("'user'", 'asked.user_idx')}, {hashed("'product'", 'neg')}) AS score FROM asked JOIN unseen USING (user_idx) WHERE neg <> asked.item_idx),
h_neg AS (SELECT user_idx, item_idx, neg, row_number() OVER (PARTITION BY user_idx, item_idx ORDER BY score DESC, neg) AS pick FROM h_rank QUALIFY pick <= 4)"""


@register("negatives_uniform", f"{ASKED}{_uniform(4)} SELECT user_idx, item_idx, neg, pick FROM u_neg")
def negatives_uniform(p: Pipeline) -> DataFrame:
    """N1"""
    p = p.materialised()
    return sampling.uniform_negatives(p.split.positives, p.events, popularity(p), 4, 10, SEED)


@register(
    "negatives_mixed",
    f"{ASKED}{_uniform(2)},{POPULAR},{HARDEST} " + " UNION ALL ".join(f"SELECT user_idx, item_idx, neg, '{k}' AS kind FROM {t}" for k, t in (("uniform", "u_neg"), ("popular", "p_neg"), ("hard", "h_neg"))),
)
def negatives_mixed(p: Pipeline) -> DataFrame:
    """N2"""
    p = p.materialised()
    return sampling.mixed_negatives(p.split.positives, p.events, popularity(p), *scorers(p), 8, SEED, POWER)


MINI = f""",
mini AS MATERIALIZED (SELECT user_idx, item_idx, behavior_id, ts, (rn - 1) // {BATCH} AS batch FROM (SELECT user_idx, item_idx, behavior_id, ts, row_number() OVER (ORDER BY md5(concat_ws('|', '{SEED}', user_idx, item_idx, behavior_id, ts)), user_idx, item_idx, behavior_id, ts) AS rn, count(*) OVER () AS c FROM ev) WHERE (rn - 1) // {BATCH} < c // {BATCH}),
here AS (SELECT DISTINCT batch, dst AS item_idx FROM (SELECT DISTINCT batch, user_idx FROM mini) JOIN hop1 ON src = user_idx)"""


def batches(p: Pipeline) -> tuple[DataFrame, DataFrame]:
    """(rows of each batch, those whose item is in the sampled subgraph of the batch's users)."""
    events = readers.cut_lineage(p.events)
    rows = readers.cut_lineage(edges.minibatches(edges.triplets(events, S), S, BATCH))
    first = sampling.without_replacement(edges.compressed_rows(events.select(F.col("behavior").alias("rel"), F.col("user_idx").alias("src"), F.col("item_idx").alias("dst"), F.col("timestamp").alias("ts"))), H1, SEED)
    nodes = rows.select("batch", F.col("user_idx").alias("src")).distinct().join(first.select("src", "dst").distinct(), "src").select("batch", F.lit("product").alias("node_type"), F.col("dst").alias("node"))
    return rows, sampling.found_in_subgraph(rows, nodes, ["batch"])


@register("batch_positives", f"{MINI} SELECT batch, user_idx, item_idx, behavior_id, ts AS timestamp FROM mini SEMI JOIN here USING (batch, item_idx)")
def batch_positives(p: Pipeline) -> DataFrame:
    """J14"""
    return batches(p)[1].select("batch", "user_idx", "item_idx", "behavior_id", "timestamp")


@register(
    "epoch_batches",
    f"{MINI}, f AS (SELECT batch, count(*) AS n FROM mini SEMI JOIN here USING (batch, item_idx) GROUP BY 1) SELECT batch, count(*) "
    "AS n_rows, count(DISTINCT user_idx) AS n_users, min(ts) AS ref_time, coalesce(max(f.n), 0) AS n_found FROM mini LEFT JOIN f USING (batch) "
    "GROUP BY batch",
)
def epoch_batches(p: Pipeline) -> DataFrame:
    """What each step of an epoch gets; ref_time is the batch's earliest time."""
    rows, found = batches(p)
    counts = found.groupBy("batch").agg(F.count("*").alias("n"))
    return rows.groupBy("batch").agg(F.count("*").alias("n_rows"), F.count_distinct("user_idx").alias("n_users"), F.min("timestamp").alias("ref_time")).join(counts, "batch", "left").select("batch", "n_rows", "n_users", "ref_time", F.coalesce("n", F.lit(0)).alias("n_found"))


@register(
    "eval_epoch",
    f", asked AS (SELECT user_idx FROM (SELECT DISTINCT user_idx FROM vtruth) ORDER BY md5(concat_ws('|', '{SEED}', user_idx)), user_idx LIMIT 50), etop AS (SELECT * FROM vtop SEMI JOIN asked USING (user_idx)), etruth AS (SELECT * FROM vtruth SEMI JOIN asked USING (user_idx))," + _evaluation("etop", "etruth"),
)
def eval_epoch(p: Pipeline) -> DataFrame:
    """M8"""
    users, items, mask, truth = vectors(p)
    return ranking.eval_epoch(users, items, truth, mask, KS, SEED, 50)


@register(
    "info_nce",
    ", r AS (SELECT user_idx, score, row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, item_idx) AS rank FROM sims "
    "WHERE user_idx <> item_idx QUALIFY rank <= 16), s AS (SELECT user_idx, sum(exp(score / 0.2)) AS s FROM r GROUP BY 1) SELECT round(avg(-ln(exp(score / "
    "0.2) / (exp(score / 0.2) + s))), 6) AS loss FROM s JOIN (SELECT user_idx, score FROM sims WHERE user_idx = item_idx) USING (user_idx)",
)
def info_nce(p: Pipeline) -> DataFrame:
    """Each vector against its 16 nearest others."""
    users, items, mask, _ = vectors(p)
    others = ranking.score_vectors(users, items, mask, 16).select(F.col("user_idx").alias("anchor"), F.col("score").alias("sim"))
    return objectives.info_nce(users.select(F.col("user_idx").alias("anchor"), dot(F.col("uv"), F.col("uv")).alias("pos")), others, 0.2)


@register("behavior_contrast", f""",
z0 AS (SELECT DISTINCT user_idx, behavior FROM ev), z1 AS (SELECT user_idx // {USERS} AS batch, user_idx, behavior, {hashed('behavior', 'user_idx')} AS h FROM z0),
z AS MATERIALIZED (SELECT batch, user_idx, behavior, list_transform(h, lambda x: x / sqrt(list_dot_product(h, h))) AS h FROM z1),
t(weak, strong, w) AS (VALUES {', '.join(f"('{a}', '{b}', {w}::DOUBLE)" for a, b, w in MBCL)}),
b AS (SELECT weak, strong, w, x.batch, x.user_idx, x.h AS hw, y.h AS hs FROM t JOIN z x ON x.behavior = weak JOIN z y ON y.behavior = strong AND y.user_idx = x.user_idx),
m AS (SELECT a.weak, a.strong, a.w, a.batch, a.user_idx, c.user_idx AS other, list_dot_product(a.hs, c.hw) / {TAU} AS sim FROM b a JOIN b c ON a.weak = c.weak AND a.strong = c.strong AND a.batch = c.batch),
r AS (SELECT *, row_number() OVER (PARTITION BY weak, strong, batch, user_idx ORDER BY user_idx = other DESC, sim DESC, other) AS place FROM m QUALIFY place <= {HARD + 1}),
e AS (SELECT weak, strong, w, batch, user_idx, ln(sum(exp(sim))) - max(CASE WHEN user_idx = other THEN sim END) AS loss FROM r GROUP BY ALL)
SELECT batch, weak, strong, count(*) AS users, round(avg(loss) * w, 6) AS loss FROM e GROUP BY batch, weak, strong, w HAVING count(*) >= 4""")
def behavior_contrast(p: Pipeline) -> DataFrame:
    """The contrast of each pair of behaviours in batches of users."""
    rows = p.events.select((F.floor(F.col("user_idx") / USERS)).alias("batch"), F.col("behavior").alias("kind"), F.col("user_idx").alias("node")).distinct()
    made = layers.node_vectors(rows, P.dims, SEED)
    return objectives.behavior_contrast(made.select(F.floor(F.col("node") / USERS).alias("batch"), F.col("node").alias("user_idx"), F.col("kind").alias("behavior"), "h"), MBCL, HARD, 4, TAU)


@register(
    "mask_mean_length",
    " SELECT count(*) AS users, round(avg(n), 6) AS mean_items FROM (SELECT user_idx, count(item_idx) AS n FROM eu LEFT JOIN primary_mask USING (user_idx) "
    "GROUP BY 1)",
)
def mask_mean_length(p: Pipeline) -> DataFrame:
    """A18"""
    return masks.mean_length(masks.mask_arrays(p.mask(), p.users))


@register(
    "degree_ccdf_points",
    ", o AS (SELECT degree, round(sum(c) OVER (ORDER BY degree DESC)::DOUBLE / sum(c) OVER (), 9) AS p, row_number() OVER (ORDER BY degree) - 1 "
    "AS place, count(*) OVER () AS n FROM (SELECT n AS degree, count(*) AS c FROM pop WHERE n > 0 GROUP BY 1)) SELECT degree, p "
    "FROM o WHERE n <= 12 OR place IN (SELECT round(pow(10.0, i * log10(greatest((SELECT max(n) FROM o) - 1, 1)::DOUBLE) / 11))::INT "
    "FROM (SELECT unnest(range(12)) AS i))",
)
def degree_ccdf_points(p: Pipeline) -> DataFrame:
    """K8"""
    return profile.ccdf_points(profile.ccdf(profile.degrees(p.events, p.split.items.select("item_idx"), "item_idx")), 12)


_EDGES = {b: f"(SELECT count(*) FROM ev WHERE behavior = '{b}')" for b in BEHAVIORS}
_EDGES["purchase"] = f"({_EDGES['purchase']} + (SELECT count(*) FROM positives))"
_N = {"users": "(SELECT count(*) FROM uv)", "products": "(SELECT count(*) FROM iv)", "categories": "(SELECT count(*) FROM cv)", "brands": "(SELECT count(*) FROM bv)"}
_ALL, _PAIRS = " + ".join(_EDGES.values()), f"{_N['users']} * {_N['products']}"
_VALUES = _N | {"nodes": " + ".join(_N.values())} | {f"edges_{b}": x for b, x in _EDGES.items()} | {"edges_belongsTo": "(SELECT count(*) FROM meta)", "edges_producedBy": "(SELECT count(*) FROM meta)", "edges_behavior": _ALL}
_VALUES |= {f"sparsity_{b}": f"1.0 - {x}::DOUBLE / ({_PAIRS})" for b, x in _EDGES.items()} | {f"per_user_{b}": f"{x}::DOUBLE / {_N['users']}" for b, x in _EDGES.items()}
_VALUES |= {"per_user": f"({_ALL})::DOUBLE / {_N['users']}", "density": f"({_ALL})::DOUBLE / ({_PAIRS})"} | {f"{b}_per_purchase": f"{_EDGES[b]}::DOUBLE / {_EDGES['purchase']}" for b in ("view", "cart")}
_VALUES |= {f"{x}_pairs": f"(SELECT count(*) FROM positives WHERE part = '{x}')" for x in ("val", "test")} | {f"{x}_users": f"(SELECT count(DISTINCT user_idx) FROM positives WHERE part = '{x}')" for x in ("val", "test")}


@register("dataset_summary", " " + " UNION ALL ".join(f"SELECT '{n}' AS metric, round(({x})::DOUBLE, 6) AS value" for n, x in _VALUES.items()))
def dataset_summary(p: Pipeline) -> DataFrame:
    """E1, E2, E7"""
    p = p.materialised()
    return profile.summary(p.events, p.split.positives, p.split.users, p.split.items, p.meta, "purchase")


@register(
    "stage_counts",
    " " + " UNION ALL ".join(f"SELECT '{n}' AS stage, count(*) AS n FROM {t}" for n, t in (("raw", "raw"), ("clean", "clean"), ("kcore", "k3"), ("train_events", "ev"), ("positives", "positives"), ("items", "iv"))),
)
def stage_counts(p: Pipeline) -> DataFrame:
    """E9"""
    return profile.stage_counts({"raw": p.raw, "clean": p.clean, "kcore": p.log, "train_events": p.events, "positives": p.split.positives, "items": p.split.items})


@register(
    "index_bounds",
    " " + " UNION ALL ".join(f"SELECT '{n}' AS name, '{c}' AS \"column\", min({c}) AS least, max({c}) AS most, count(*) - count({c}) AS nulls FROM {t}" for n, t in (("events", "ev"), ("positives", "positives")) for c in ("user_idx", "item_idx")),
)
def index_bounds(p: Pipeline) -> DataFrame:
    """A17"""
    return profile.bounds({"events": (p.events, ["user_idx", "item_idx"]), "positives": (p.split.positives, ["user_idx", "item_idx"])})


#: Violations by check; in braces the names of the tables.
SQL_CHECKS = {
    "Q1_event_bounds": "SELECT 1 FROM {ev} WHERE user_idx NOT IN (SELECT user_idx FROM uv) UNION ALL SELECT 1 FROM {ev} WHERE item_idx NOT IN (SELECT item_idx FROM iv)",
    "Q2_behavior_ids": "SELECT 1 FROM {ev} WHERE behavior_id IS NULL OR behavior_id NOT IN (0, 1, 2)",
    "Q3_eval_bounds": "SELECT 1 FROM {pos} ANTI JOIN uv USING (user_idx) UNION ALL SELECT 1 FROM {pos} ANTI JOIN iv USING (item_idx)",
    "Q4_train_eval_leak": "SELECT DISTINCT user_idx, item_idx FROM {pos} SEMI JOIN pairs USING (user_idx, item_idx)",
    "Q5_train_window": f"SELECT 1 FROM {{ev}} WHERE ts >= {T1}",
    "Q5_val_window": f"SELECT 1 FROM {{pos}} WHERE part = 'val' AND (ts < {T1} OR ts >= {T2})",
    "Q5_test_window": f"SELECT 1 FROM {{pos}} WHERE part = 'test' AND ts < {T2}",
    "Q6_truth_unique": "SELECT 1 FROM {pos} GROUP BY part, user_idx, item_idx HAVING count(*) > 1",
    "Q6_truth_equal": "(SELECT part, user_idx, item_idx FROM {pos} EXCEPT ALL SELECT part, user_idx, item_idx FROM {truth}) UNION ALL (SELECT part, user_idx, item_idx FROM {truth} EXCEPT ALL SELECT part, user_idx, item_idx FROM {pos})",
    "Q7_positive_in_mask": "SELECT DISTINCT user_idx, item_idx FROM {pos} SEMI JOIN {prim} USING (user_idx, item_idx)",
    "Q8_candidates": "SELECT 1 FROM {cand} ANTI JOIN iv USING (item_idx)",
    "Q8_candidates_lacking": "SELECT 1 FROM iv ANTI JOIN {cand} USING (item_idx)",
    "Q9_primary_in_seen": "SELECT 1 FROM {prim} ANTI JOIN {seen} USING (user_idx, item_idx)",
    "Q9_primary_equals_seen": "SELECT 1 WHERE NOT EXISTS (SELECT user_idx, item_idx FROM {prim} EXCEPT SELECT user_idx, item_idx FROM {seen}) AND NOT EXISTS (SELECT user_idx, item_idx FROM {seen} EXCEPT SELECT user_idx, item_idx FROM {prim}) AND EXISTS (SELECT 1 FROM {ev} SEMI JOIN eu USING (user_idx) WHERE behavior <> 'purchase')",
    "Q9_older_mask_differs": "SELECT DISTINCT user_idx FROM ((SELECT user_idx, item_idx FROM {prim} EXCEPT ALL SELECT user_idx, item_idx FROM {older}) UNION ALL (SELECT user_idx, item_idx FROM {older} EXCEPT ALL SELECT user_idx, item_idx FROM {prim}))",
    "Q10_one_structural_edge": "SELECT item_idx FROM {meta} GROUP BY 1 HAVING count(*) <> 1",
    "Q11_items_with_metadata": "SELECT item_idx FROM iv ANTI JOIN {meta} USING (item_idx)",
    "Q11_node_counts": "SELECT * FROM (SELECT 'user' AS t, (SELECT count(*) FROM uv) AS n UNION ALL SELECT 'product', (SELECT count(*) FROM iv) UNION ALL SELECT 'category', (SELECT count(DISTINCT category_idx) FROM {meta}) UNION ALL SELECT 'brand', (SELECT count(DISTINCT brand_idx) FROM {meta})) ANTI JOIN {auth} USING (t, n)",
    "Q13_null_indices": "SELECT 1 FROM {pos} WHERE user_idx IS NULL OR item_idx IS NULL",
}


def _checked(**tables: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"check\", count(*) AS violations FROM ({q.format(**tables)})" for c, q in SQL_CHECKS.items())


SOUND = """,
truth AS (SELECT part, user_idx, item_idx FROM positives),
auth AS (SELECT 'user' AS t, (SELECT count(*) FROM uv) AS n UNION ALL SELECT 'product', (SELECT count(*) FROM iv) UNION ALL SELECT 'category', (SELECT count(*) FROM cv) UNION ALL SELECT 'brand', (SELECT count(*) FROM bv))"""


@register(
    "quality_report",
    f"{SOUND} " + _checked(ev="ev", pos="positives", truth="truth", prim="primary_mask", seen="seen_mask", older="primary_mask", cand="iv", meta="meta", auth="auth"),
)
def quality_report(p: Pipeline) -> DataFrame:
    """Q1-Q13 of the prepared tables."""
    return p.verify()


#: The same tables with faults of every kind; column lists are user_idx, item_idx, ... of each.
BROKEN = f"""{SOUND},
bev AS MATERIALIZED (SELECT CASE WHEN user_idx % 50 = 7 THEN user_idx + 1000000 ELSE user_idx END AS user_idx, CASE WHEN item_idx % 53 = 9 THEN -1 - item_idx ELSE item_idx END AS item_idx, behavior,
  CASE WHEN item_idx % 47 = 3 THEN NULL WHEN item_idx % 47 = 5 THEN 9 ELSE behavior_id END AS behavior_id, CASE WHEN user_idx % 31 = 4 THEN ts + {T2} ELSE ts END AS ts FROM ev),
bpos AS MATERIALIZED (SELECT part, user_idx, item_idx, ts FROM positives UNION ALL SELECT part, user_idx, item_idx, ts FROM positives WHERE user_idx % 11 = 2
  UNION ALL SELECT 'val', user_idx, item_idx, ts FROM train WHERE user_idx % 37 = 5 UNION ALL SELECT part, user_idx + 1000000, item_idx, ts FROM positives WHERE user_idx % 13 = 3
  UNION ALL SELECT part, user_idx, CAST(NULL AS BIGINT), ts FROM positives WHERE user_idx % 17 = 4 UNION ALL SELECT 'test', user_idx, item_idx, ts FROM positives WHERE part = 'val' AND user_idx % 19 = 6),
bprim AS MATERIALIZED (SELECT * FROM primary_mask UNION ALL SELECT user_idx, -5 FROM eu WHERE user_idx % 23 = 8), bolder AS (SELECT * FROM primary_mask WHERE user_idx % 29 <> 1),
bcand AS (SELECT item_idx FROM iv WHERE item_idx % 41 <> 2 UNION ALL SELECT -1 - item_idx FROM iv WHERE item_idx % 43 = 1),
bmeta AS (SELECT item_idx, category_idx, brand_idx FROM meta WHERE item_idx % 83 <> 2 UNION ALL SELECT item_idx, category_idx, brand_idx FROM meta WHERE item_idx % 79 = 1),
bauth AS (SELECT t, CASE t WHEN 'product' THEN n + 1 ELSE n END AS n FROM auth)"""


@register(
    "quality_report_broken",
    f"{BROKEN} " + _checked(ev="bev", pos="bpos", truth="truth", prim="bprim", seen="seen_mask", older="bolder", cand="bcand", meta="bmeta", auth="bauth"),
)
def quality_report_broken(p: Pipeline) -> DataFrame:
    """Q1-Q13 of tables with planted faults."""
    n = lambda c, k, r: F.col(c) % k == r
    p = p.materialised()
    events, positives, users, meta = p.events, p.split.positives, p.users, p.meta
    sound = split.ground_truth(p.split)
    bad = events.withColumns({
        "user_idx": F.when(n("user_idx", 50, 7), F.col("user_idx") + 1000000).otherwise(F.col("user_idx")),
        "item_idx": F.when(n("item_idx", 53, 9), -1 - F.col("item_idx")).otherwise(F.col("item_idx")),
        "behavior_id": F.when(n("item_idx", 47, 3), F.lit(None)).when(n("item_idx", 47, 5), 9).otherwise(F.col("behavior_id")),
        "timestamp": F.when(n("user_idx", 31, 4), F.col("timestamp") + T2).otherwise(F.col("timestamp")),
    })
    columns = ["part", "user_idx", "item_idx", "timestamp"]
    held = positives.unionByName(positives.where(n("user_idx", 11, 2))).unionByName(p.split.train.where(n("user_idx", 37, 5)).withColumn("part", F.lit("val")).select(*columns))
    held = held.unionByName(positives.where(n("user_idx", 13, 3)).withColumn("user_idx", F.col("user_idx") + 1000000)).unionByName(positives.where(n("user_idx", 17, 4)).withColumn("item_idx", F.lit(None).cast("long")))
    held = readers.cut_lineage(held.unionByName(positives.where("part = 'val'").where(n("user_idx", 19, 6)).withColumn("part", F.lit("test"))))
    primary, seen = (masks.train_mask(events, users, b) for b in (("purchase",), tuple(BEHAVIORS)))
    items = p.split.items
    candidates = items.where(~n("item_idx", 41, 2)).select("item_idx").unionByName(items.where(n("item_idx", 43, 1)).select((-1 - F.col("item_idx")).alias("item_idx")))
    sp = replace(p.split, positives=held, candidates=candidates)
    authority = edges.node_counts(p.split, meta).withColumn("n", F.col("n") + (F.col("node_type") == "product").cast("long"))
    more = primary.unionByName(users.where(n("user_idx", 23, 8)).withColumn("item_idx", F.lit(-5).cast("long")))
    return quality.report(sp, bad, meta.where(~n("item_idx", 83, 2)).unionByName(meta.where(n("item_idx", 79, 1))), S, (more, seen), primary.where(~n("user_idx", 29, 1)), authority, sound)


_INPUT = {
    "user_dims": "SELECT 1 FROM eu0 WHERE h IS NULL OR len(h) <> 64", "item_dims": "SELECT 1 FROM ei0 WHERE h IS NULL OR len(h) <> 64",
    "users_without_vector": "SELECT 1 FROM ea0 ANTI JOIN eu0 USING (user_idx)", "vectors_without_user": "SELECT 1 FROM eu0 ANTI JOIN ea0 USING (user_idx)",
    "truth_of_other_users": "SELECT DISTINCT user_idx FROM et0 ANTI JOIN ea0 USING (user_idx)", "users_out_of_range": "SELECT 1 FROM ea0 WHERE user_idx < 0 OR user_idx >= 400",
    "users_without_positive": "SELECT 1 FROM ea0 ANTI JOIN (SELECT user_idx FROM et0 WHERE item_idx IS NOT NULL) USING (user_idx)",
    "positives_below_range": "SELECT 1 FROM et0 WHERE item_idx < 0", "positives_above_range": "SELECT 1 FROM et0 WHERE item_idx >= (SELECT count(*) FROM ei0)",
}


@register("eval_input_checks", """,
eu0 AS (SELECT vec_id AS user_idx, CASE WHEN vec_id % 31 = 3 THEN e[1:10] WHEN vec_id % 31 = 5 THEN NULL ELSE e END AS h FROM vec WHERE vec_id % 7 <> 1), ei0 AS (SELECT vec_id AS item_idx, CASE WHEN vec_id % 29 = 2 THEN e[1:3] ELSE e END AS h FROM vec),
ea0 AS (SELECT vec_id AS user_idx FROM vec WHERE vec_id % 11 <> 4 UNION ALL SELECT -1 - vec_id FROM vec WHERE vec_id % 37 = 2),
et0 AS (SELECT vec_id AS user_idx, CASE WHEN vec_id % 17 = 1 THEN NULL WHEN vec_id % 17 = 2 THEN vec_id + 100000 WHEN vec_id % 17 = 3 THEN -vec_id ELSE vec_id END AS item_idx FROM vec WHERE vec_id % 13 <> 5) """ + " UNION ALL ".join(f"SELECT '{c}' AS \"check\", count(*) AS violations FROM ({q})" for c, q in _INPUT.items()))
def eval_input_checks(p: Pipeline) -> DataFrame:
    """M3, on vectors, users and positives with planted faults."""
    e = readers.table(p.raw.sparkSession, p.dir, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    at = lambda k, r: F.col("vec_id") % k == r
    users = e.where(~at(7, 1)).select(F.col("vec_id").alias("user_idx"), F.when(at(31, 3), F.slice("e", 1, 10)).when(at(31, 5), F.lit(None)).otherwise(F.col("e")).alias("uv"))
    items = e.select(F.col("vec_id").alias("item_idx"), F.when(at(29, 2), F.slice("e", 1, 3)).otherwise(F.col("e")).alias("iv"))
    asked = e.where(~at(11, 4)).select(F.col("vec_id").alias("user_idx")).unionByName(e.where(at(37, 2)).select((-1 - F.col("vec_id")).alias("user_idx")))
    item = F.when(at(17, 1), F.lit(None)).when(at(17, 2), F.col("vec_id") + 100000).when(at(17, 3), -F.col("vec_id")).otherwise(F.col("vec_id"))
    return ranking.check_input(users, items, asked, e.where(~at(13, 5)).select(F.col("vec_id").alias("user_idx"), item.alias("item_idx")), 64, 400)
