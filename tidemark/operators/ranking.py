"""Full-ranking evaluation (M1-M8, J9-J11, A13) and two rankers that need no training."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import digest, dot, top_per_group


#: Users and items of one block at most, users of a block that are scored at once, and pairs that are scored exactly at once.
USERS, ITEMS = 8192, 32_768
ROWS = 256
EXACT = 1 << 16
SPAN = 1 << 20
#: Items of one user that a task pairs with all of the user's items.
HEAVY = 1000


def tiles(df: DataFrame, key: str, most: int) -> tuple[DataFrame, int]:
    """Rows dealt to tiles of at most about `most` rows, and to at least four where there are enough."""
    n = df.count()
    parts = max(1, -(-n // min(most, max(64, -(-n // 4)))))
    return df.withColumn("_tile", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), parts


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner product of each row of x with the same row of y, summed in the order of the dimensions."""
    out = np.zeros(len(x))
    for i in range(0, len(x), EXACT):
        out[i : i + EXACT] += np.cumsum(x[i : i + EXACT] * y[i : i + EXACT], axis=1)[:, -1]
    return out


def places(owners: np.ndarray, names: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (row, column) of each pair (a, b) in sorted owners and names, of which several may be equal; ascending rows."""
    (r, rs), (c, cs) = ((low, np.searchsorted(known, wanted, "right") - low) for known, wanted in ((owners, a), (names, b)) for low in (np.searchsorted(known, wanted),))
    each = rs * cs
    pair = np.repeat(np.arange(len(a)), each)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
    row, column = r[pair] + nth // cs[pair], c[pair] + nth % cs[pair]
    order = np.argsort(row, kind="stable")
    return row[order], column[order]


def best(x: np.ndarray, y: np.ndarray, row: np.ndarray, column: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, product): the k largest for each row of x, ties to the smaller row of y, without the pairs (row, column).

    A product in single precision lies within `margin` of the exact one, by the bound for sums in any order. The
    k-th largest of the maxima of groups of columns is no more than the k-th largest of all, so what is
    less than it by over twice that can't be among the k; all others are scored exactly.
    """
    peak = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0))
    tame = peak <= 1e15  # not so for NaN
    with np.errstate(all="ignore"):
        longest = np.sqrt((y * y).sum(1)).max() if tame else 0.0
        y32 = y.astype(np.float32).T if tame else None
    width = max(1, len(y) // (10 * k))
    n = len(y) // width
    held = np.empty((min(ROWS, len(x)), len(y)), np.float32 if tame else np.float64)
    out = []
    for i in range(0, len(x), ROWS):
        part = x[i : i + ROWS]
        if tame:
            scores = np.matmul(part.astype(np.float32), y32, out=held[: len(part)])
            size = np.sqrt((part * part).sum(1))
            margin = 4 * (x.shape[1] + 4) * 2.0**-24 * size * longest + 1e-30 * (1 + size + longest)
        else:
            with np.errstate(all="ignore"):
                scores = held[: len(part)]
                for j, u in enumerate(part):
                    scores[j] = products(np.broadcast_to(u, y.shape), y)
            scores[np.isnan(scores)] = -np.inf
            margin = np.zeros(len(part))
        a, b = np.searchsorted(row, (i, i + len(part)))
        scores[row[a:b] - i, column[a:b]] = -np.inf
        if n > k:
            least = np.partition(scores[:, : n * width].reshape(len(part), width, n).max(1), n - k, axis=1)[:, n - k].astype(np.float64)
            bound = np.where(np.isfinite(least), least - margin, least).astype(scores.dtype)
        else:
            bound = np.full(len(part), -np.inf, scores.dtype)
        at, place = np.divmod(np.flatnonzero(scores >= bound[:, None]), len(y))
        seen = scores[at, place] > -np.inf
        at, place = at[seen], place[seen]
        with np.errstate(all="ignore"):
            exact = products(part[at], y[place]) if tame else scores[at, place]
        order = np.lexsort((-exact, at))
        at, place, exact = at[order], place[order], exact[order]
        first = np.searchsorted(at, np.arange(len(part)))
        kept = np.arange(len(at)) - first[at] < k
        out.append((at[kept] + i, place[kept], exact[kept]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def score_vectors(users: DataFrame, items: DataFrame, mask: DataFrame, k: int) -> DataFrame:
    """Users (user_idx, uv) x items (item_idx, iv) minus mask -> top k by inner product, ties to the smaller item.

    Full ranking scores every pair by definition: each pair of a user tile and an item tile is one block,
    scored with numpy, and only each user's k best of a block leave it. Their scores are summed in
    the order of the dimensions, in double (see best). A masked pair goes to its own block alone.
    """
    users, n_users = tiles(users, "user_idx", USERS)
    items, n_items = tiles(items, "item_idx", ITEMS)
    number = lambda user, item: F.col(user).cast("long") * n_items + F.col(item)
    single = all(dict(df.dtypes)[c] == "array<float>" for df, c in ((users, "uv"), (items, "iv")))
    kind = "array<float>" if single else "array<double>"
    left = users.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n_items - 1)))).select(number("_tile", "_other").alias("block"), "user_idx", F.lit(0).cast("long").alias("item_idx"), F.lit(False).alias("hidden"), F.col("uv").cast(kind).alias("uv"))
    hidden = mask.where("user_idx IS NOT NULL AND item_idx IS NOT NULL").select("user_idx", F.col("item_idx").cast("long").alias("item_idx"), F.pmod(F.xxhash64("user_idx"), F.lit(n_users)).alias("_user"), F.pmod(F.xxhash64("item_idx"), F.lit(n_items)).alias("_item"))
    left = left.unionByName(hidden.select(number("_user", "_item").alias("block"), "user_idx", "item_idx", F.lit(True).alias("hidden"), F.lit(None).cast(kind).alias("uv")))
    right = items.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n_users - 1)))).select(number("_other", "_tile").alias("block"), "item_idx", F.col("iv").cast(kind).alias("iv"))

    def block(rows: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        masked = rows["hidden"].to_numpy(bool)
        u, masked = rows[~masked].sort_values("user_idx"), rows[masked]
        if not len(u) or not len(i):
            return pd.DataFrame({"user_idx": np.zeros(0, np.int64), "item_idx": np.zeros(0, np.int64), "score": np.zeros(0)})
        i = i.sort_values("item_idx")
        owners, names, x, y = u["user_idx"].to_numpy(), i["item_idx"].to_numpy(), np.stack(u["uv"].to_numpy()).astype(np.float64), np.stack(i["iv"].to_numpy()).astype(np.float64)
        row, place, score = best(x, y, *places(owners, names, masked["user_idx"].to_numpy(np.int64), masked["item_idx"].to_numpy(np.int64)), k)
        return pd.DataFrame({"user_idx": owners[row], "item_idx": names[place], "score": score})

    found = left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(block, "user_idx bigint, item_idx bigint, score double")
    return top_per_group(found, ["user_idx"], [F.desc("score"), F.asc("item_idx")], k)


def popularity(events: DataFrame, items: DataFrame) -> DataFrame:
    """C15 counts: events of each item, zero for items without."""
    counts = events.groupBy("item_idx").agg(F.count("*").alias("n"))
    return items.join(counts, "item_idx", "left").select("item_idx", F.coalesce("n", F.lit(0)).alias("n"))


def rank_by_popularity(pop: DataFrame, users: DataFrame, mask: DataFrame, k: int) -> DataFrame:
    """Top k unmasked items of each user by one common order.

    A user with m masked items needs no more than the first k + m items of that order: these places are
    asked for by number, and the order is cut at the largest of them. Places are
    numbered within ranges of SPAN ids of the same count and shifted by the ranges' running counts.
    """
    held = users.join(mask.groupBy("user_idx").agg(F.count("*").alias("m")), "user_idx", "left").select("user_idx", F.coalesce("m", F.lit(0)).alias("m"))
    most = held.agg((F.max("m") + k).alias("most"))
    ranged = pop.select("item_idx", F.col("n").alias("score"), F.floor(F.col("item_idx") / SPAN).alias("_range"))
    counts = ranged.groupBy("score", "_range").agg(F.count("*").alias("_c"))
    before = counts.select("score", "_range", (F.sum("_c").over(Window.orderBy(F.desc("score"), "_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before"))
    needed = before.join(most, F.col("_before") < F.col("most"))
    local = F.row_number().over(Window.partitionBy("score", "_range").orderBy("item_idx"))
    order = ranged.join(needed, ["score", "_range"]).withColumn("place", F.col("_before") + local).where("place <= most").select("item_idx", "score", "place")
    asked = held.select("user_idx", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m") + k)).alias("place"))
    pairs = asked.join(order, "place").join(mask, ["user_idx", "item_idx"], "left_anti")
    return top_per_group(pairs.select("user_idx", "item_idx", "score"), ["user_idx"], [F.desc("score"), F.asc("item_idx")], k)


def rank_by_cooccurrence(pairs: DataFrame, users: DataFrame, mask: DataFrame, k: int) -> DataFrame:
    """Score of an item: users it shares with the items that the user has, summed.

    All pairs of a user's items are made; a user with more than HEAVY items is parted, and each part of the
    items meets all of them, so such a user is the work of many tasks.
    """
    parts = pairs.groupBy("user_idx").agg(F.ceil(F.count("*") / HEAVY).cast("int").alias("parts"))
    sized = pairs.join(parts, "user_idx")
    left = sized.select("user_idx", "item_idx", F.pmod(F.xxhash64("item_idx"), F.col("parts")).cast("int").alias("part"))
    other = sized.select("user_idx", F.col("item_idx").alias("item_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    common = left.join(other, ["user_idx", "part"]).where("item_idx <> item_b").groupBy("item_idx", "item_b").agg(F.count("*").alias("c"))
    history = pairs.join(users, "user_idx", "left_semi").withColumnRenamed("item_idx", "item_b")
    scored = history.join(common, "item_b").groupBy("user_idx", "item_idx").agg(F.sum("c").alias("score")).join(mask, ["user_idx", "item_idx"], "left_anti")
    return top_per_group(scored, ["user_idx"], [F.desc("score"), F.asc("item_idx")], k)


def evaluate(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...], mode: str = "full") -> DataFrame:
    """M1, M2: (k, hr, ndcg), averaged over all users with a positive; users without a ranked row count 0.

    Masked items never rank and missing ranks don't exist, so neither can be a hit. Every mode ranks fully.
    """
    sizes = truth.groupBy("user_idx").agg(F.count_distinct("item_idx").alias("size"))
    return metrics(sizes, ranked.join(truth.select("user_idx", "item_idx").distinct(), ["user_idx", "item_idx"]), ks)


def evaluate_classes(ranked: DataFrame, classes: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """evaluate() where the positives of a user are the other ids that share a label with it; classes: (idx, label).

    The pairs, which grow with the square of a class, are not made: a ranked row is a hit if the labels of
    both meet, and the sizes come from the numbers of ids with the same labels.
    """
    held = classes.where("idx IS NOT NULL AND label IS NOT NULL").groupBy("idx").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    sets = held.groupBy("labels").agg(F.count("*").alias("n"))
    of = sets.select(F.col("labels").alias("mine"), F.explode("labels").alias("label")).join(sets.select("labels", "n", F.explode("labels").alias("label")), "label")
    sizes = of.select("mine", "labels", "n").distinct().groupBy(F.col("mine").alias("labels")).agg((F.sum("n") - 1).alias("size")).where("size > 0")
    sizes = held.join(sizes, "labels").select(F.col("idx").alias("user_idx"), "size")
    ours, theirs = (held.select(F.col("idx").alias(name), F.col("labels").alias(labels)) for name, labels in (("user_idx", "_ours"), ("item_idx", "_theirs")))
    hits = ranked.join(ours, "user_idx").join(theirs, "item_idx").where((F.col("user_idx") != F.col("item_idx")) & F.arrays_overlap("_ours", "_theirs"))
    return metrics(sizes, hits, ks)


def metrics(sizes: DataFrame, hits: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, hr, ndcg) of the users of sizes (user_idx, size: number of positives); hits: the ranked rows that are positives."""
    at = sizes.where("user_idx IS NOT NULL").select("user_idx", "size", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    hits = hits.groupBy("user_idx").agg(F.collect_list("rank").alias("ranks"))
    gain = lambda r: F.lit(1.0) / F.log2(r.cast("double") + 1.0)
    total = lambda ranks: F.aggregate(ranks, F.lit(0.0), lambda s, r: s + gain(r))
    per = at.join(hits, "user_idx", "left").withColumn("got", F.filter(F.coalesce("ranks", F.array().cast("array<bigint>")), lambda r: r <= F.col("k")))
    ideal = total(F.sequence(F.lit(1).cast("bigint"), F.least("k", "size").cast("bigint")))
    per = per.select("k", F.when(F.size("got") > 0, 1.0).otherwise(0.0).alias("hr"), (total(F.array_sort("got")) / F.greatest(ideal, F.lit(1e-12))).alias("ndcg"))
    return per.groupBy("k").agg(F.round(F.avg("hr"), 6).alias("hr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


def single_positive(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """M5, M6: recall and NDCG over (user, item) rows, each on its own."""
    rows = truth.join(ranked, ["user_idx", "item_idx"], "left").select("rank", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    hit = F.col("rank").isNotNull() & (F.col("rank") <= F.col("k"))
    return rows.groupBy("k").agg(F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("recall"), F.round(F.avg(F.when(hit, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)), 6).alias("ndcg"))


def against_baseline(metrics: DataFrame, baseline: dict[int, tuple[float, float]]) -> DataFrame:
    """M7: change in percent against stored (recall, ndcg) by k."""
    spark = metrics.sparkSession
    stored = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({k}, {r}D, {n}D)" for k, (r, n) in baseline.items()) + " AS b(k, base_recall, base_ndcg)")
    change = lambda now, base: F.round(100.0 * (F.col(now) - F.col(base)) / F.col(base), 4)
    return metrics.join(stored, "k").select("k", change("recall", "base_recall").alias("recall_pct"), change("ndcg", "base_ndcg").alias("ndcg_pct"))


def subsample(users: DataFrame, seed: str, n: int) -> DataFrame:
    """K5: n users, those first in hash order; all if n is 0 or not less than their number."""
    return users if n <= 0 else users.orderBy(digest(seed, F.col("user_idx")), "user_idx").limit(n)


def eval_epoch(users: DataFrame, items: DataFrame, truth: DataFrame, mask: DataFrame, ks: tuple[int, ...], seed: str, n: int = 0) -> DataFrame:
    """M8: (k, hr, ndcg) of n of the users with a positive, by full ranking of their vectors, in one call."""
    chosen = subsample(truth.select("user_idx").distinct(), seed, n)
    kept = [df.join(chosen, "user_idx", "left_semi") for df in (users, mask, truth)]
    return evaluate(score_vectors(kept[0], items, kept[1], max(ks)), kept[2], ks)


def check_input(users: DataFrame, items: DataFrame, asked: DataFrame, truth: DataFrame, dims: int, n_users: int) -> DataFrame:
    """M3: (check, violations) of an evaluation's input.

    users (user_idx, uv), items (item_idx, iv): vectors; asked (user_idx): the users to evaluate; truth
    (user_idx, item_idx): their positives; n_users: the authoritative number of users.
    """
    count = lambda name, rows: rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
    whole = items.agg(F.count("*").alias("n_items"))
    bounded = truth.crossJoin(F.broadcast(whole))
    checks = [
        count("user_dims", users.where(F.col("uv").isNull() | (F.size("uv") != dims))),
        count("item_dims", items.where(F.col("iv").isNull() | (F.size("iv") != dims))),
        count("users_without_vector", asked.join(users, "user_idx", "left_anti")),
        count("vectors_without_user", users.join(asked, "user_idx", "left_anti")),
        count("truth_of_other_users", truth.select("user_idx").distinct().join(asked, "user_idx", "left_anti")),
        count("users_out_of_range", asked.where((F.col("user_idx") < 0) | (F.col("user_idx") >= n_users))),
        count("users_without_positive", asked.join(truth.where("item_idx IS NOT NULL"), "user_idx", "left_anti")),
        count("positives_below_range", truth.where("item_idx < 0")),
        count("positives_above_range", bounded.where("item_idx >= n_items")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
