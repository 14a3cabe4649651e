"""Neighbour and negative sampling in hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import digest, hash32, top_per_group
from tidemark.operators.ranking import rank_by_popularity, score_vectors

#: Ids that one task sums up.
SPAN = 1 << 18


def without_replacement(edges: DataFrame, k: int, seed: str) -> DataFrame:
    """At most k edges of each (rel, src), parallel edges apart; edges carry rel, src, dst, ts, position."""
    return top_per_group(edges, ["rel", "src"], [digest(seed, F.col("rel"), F.col("src"), F.col("position")), F.asc("position")], k, "pick")


def with_replacement(edges: DataFrame, k: int, seed: str) -> DataFrame:
    """K slots for each (rel, src) with edges; a slot holds the edge at hash mod degree."""
    slots = edges.where("position = 0").select("rel", "src", "degree", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
    slots = slots.select("rel", "src", "slot", F.pmod(hash32(seed, F.col("rel"), F.col("src"), F.col("slot")), F.col("degree")).alias("position"))
    return slots.join(edges, ["rel", "src", "position"]).select("rel", "src", F.col("slot").cast("long").alias("slot"), "dst", "ts")


def second_hop(first: DataFrame, meta: DataFrame, copies: int) -> DataFrame:
    """Each sampled product edge goes on to its category and brand, with its tag and time; `copies` parallel edges as a count."""
    both = meta.select("item_idx", F.explode(F.array(F.struct(F.lit("belongsTo").alias("rel2"), F.col("category_idx").alias("dst2")), F.struct(F.lit("producedBy").alias("rel2"), F.col("brand_idx").alias("dst2")))).alias("e")).select("item_idx", "e.*")
    return first.join(both, first.dst == both.item_idx).select("src", F.col("rel").alias("tag"), F.col("dst").alias("product"), "rel2", "dst2", "ts", F.lit(copies).cast("long").alias("multiplicity"))


def user_subgraph(edges: DataFrame, meta: DataFrame, seeds: DataFrame, h1: int, h2: int, seed: str) -> DataFrame:
    """Nodes of each seed user's subgraph, once per seed: (seed, node_type, node)."""
    first = without_replacement(edges.join(seeds.withColumnRenamed("user_idx", "src"), "src", "left_semi"), h1, seed)
    second = second_hop(first, meta, h2)
    out = seeds.select(F.col("user_idx").alias("seed"), F.lit("user").alias("node_type"), F.col("user_idx").alias("node"))
    out = out.unionByName(first.select(F.col("src").alias("seed"), F.lit("product").alias("node_type"), F.col("dst").alias("node")))
    out = out.unionByName(second.select(F.col("src").alias("seed"), F.when(F.col("rel2") == "belongsTo", "category").otherwise("brand").alias("node_type"), F.col("dst2").alias("node")))
    return out.distinct()


def subgraph_edges(edges: DataFrame, meta: DataFrame, seeds: DataFrame, h1: int, h2: int, seed: str) -> DataFrame:
    """(seed, src_type, rel, dst_type, src, dst, origin, ts): the ten relations of each seed user's subgraph.

    A product is one node of a seed however many edges lead to it. A structural edge carries the behaviour
    that brought its product in (origin) and that edge's time; it stands for its h2 parallel copies. A seed
    without events has no edges.
    """
    first = without_replacement(edges.join(seeds.withColumnRenamed("user_idx", "src"), "src", "left_semi"), h1, seed)
    second = second_hop(first, meta, h2)
    forward = first.select(F.col("src").alias("seed"), F.lit("user").alias("src_type"), "rel", F.lit("product").alias("dst_type"), "src", "dst", F.lit(None).cast("string").alias("origin"), "ts")
    kind = F.when(F.col("rel2") == "belongsTo", "category").otherwise("brand")
    forward = forward.unionByName(second.select(F.col("src").alias("seed"), F.lit("product").alias("src_type"), F.col("rel2").alias("rel"), kind.alias("dst_type"), F.col("product").alias("src"), F.col("dst2").alias("dst"), F.col("tag").alias("origin"), "ts"))
    named = F.when(F.col("rel") == "belongsTo", "contains").when(F.col("rel") == "producedBy", "brands").otherwise(F.concat(F.lit("rev_"), F.col("rel")))
    back = forward.select("seed", F.col("dst_type").alias("src_type"), named.alias("rel"), F.col("src_type").alias("dst_type"), F.col("dst").alias("src"), F.col("src").alias("dst"), "origin", "ts")
    return forward.unionByName(back)


def found_in_subgraph(rows: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """The rows (by, item_idx, ...) whose item is a product node of their batch's subgraph."""
    products = nodes.where("node_type = 'product'").select(*by, F.col("node").alias("item_idx")).distinct()
    return rows.join(products, [*by, "item_idx"], "left_semi")


def product_subgraph(meta: DataFrame, products: DataFrame, h2: int) -> DataFrame:
    """Structural edges of seed products, tagged purchase, without times."""
    first = products.select(F.lit("purchase").alias("rel"), F.col("item_idx").alias("src"), F.col("item_idx").alias("dst"), F.lit(None).cast("long").alias("ts"))
    return second_hop(first, meta, h2).select(F.col("src").alias("seed"), "tag", "rel2", "dst2", "multiplicity")


def product_edges(meta: DataFrame, products: DataFrame, h2: int) -> DataFrame:
    """G8 in the form of subgraph_edges: both directions, origin purchase, no times."""
    rows = product_subgraph(meta, products, h2)
    kind = F.when(F.col("rel2") == "belongsTo", "category").otherwise("brand")
    forward = rows.select("seed", F.lit("product").alias("src_type"), F.col("rel2").alias("rel"), kind.alias("dst_type"), F.col("seed").alias("src"), F.col("dst2").alias("dst"), F.col("tag").alias("origin"), F.lit(None).cast("long").alias("ts"))
    named = F.when(F.col("rel") == "belongsTo", "contains").otherwise("brands")
    return forward.unionByName(forward.select("seed", F.col("dst_type").alias("src_type"), named.alias("rel"), F.col("src_type").alias("dst_type"), F.col("dst").alias("src"), F.col("src").alias("dst"), "origin", "ts"))


def node_totals(edges: DataFrame) -> DataFrame:
    """Largest index + 1 of each node type."""
    ends = edges.select(F.col("src_type").alias("node_type"), F.col("src").alias("i")).unionByName(edges.select(F.col("dst_type").alias("node_type"), F.col("dst").alias("i")))
    return ends.groupBy("node_type").agg((F.max("i") + 1).alias("num_nodes"))


def smoothed(counts: DataFrame, power: float, by: list[str]) -> DataFrame:
    """P proportional to (n + 1) ** power, summing to 1 within `by`."""
    mass = F.pow(F.col("n") + 1.0, F.lit(power))
    sums = counts.groupBy(*by).agg(F.sum(mass).alias("_s"))
    joined = counts.join(sums, by) if by else counts.crossJoin(sums)
    return joined.withColumn("p", mass / F.col("_s")).drop("_s")


def behavior_popularity(events: DataFrame, items: DataFrame, behaviors: list[str], power: float) -> DataFrame:
    """(behavior, item, p) by behaviour, and 'global', the mean over behaviours; uniform where nothing occurs."""
    grid = items.select("item_idx", F.explode(F.array(*map(F.lit, behaviors))).alias("behavior"))
    counts = grid.join(events.groupBy("behavior", "item_idx").agg(F.count("*").alias("n")), ["behavior", "item_idx"], "left").na.fill(0, ["n"])
    each = smoothed(counts, power, ["behavior"]).select("behavior", "item_idx", "p")
    return each.unionByName(each.groupBy("item_idx").agg(F.avg("p").alias("p")).select(F.lit("global").alias("behavior"), "item_idx", "p"))


def first_unseen(draws: DataFrame, fill: DataFrame, history: DataFrame, n: int) -> DataFrame:
    """draws (user_idx, item_idx, neg, slot) -> (user_idx, item_idx, neg, pick): the first n items that are neither the positive nor seen.

    A positive with fewer gets the user's next items of fill (user_idx, neg, rank: unseen ones in a fixed
    order, 2 n + 1 of them), so it comes out short only where the user has no unseen item left.
    """
    seen = history.select("user_idx", F.col("item_idx").alias("neg")).distinct()
    once = draws.where("neg <> item_idx").groupBy("user_idx", "item_idx", "neg").agg(F.min("slot").alias("slot")).join(seen, ["user_idx", "neg"], "left_anti")
    few = draws.select("user_idx", "item_idx").distinct().join(once.groupBy("user_idx", "item_idx").agg(F.count("*").alias("c")), ["user_idx", "item_idx"], "left").where(F.coalesce("c", F.lit(0)) < n)
    later = few.join(fill, "user_idx").where("neg <> item_idx").select("user_idx", "item_idx", "neg", (F.col("rank") + (1 << 30)).alias("slot"))
    every = once.select("user_idx", "item_idx", "neg", F.col("slot").cast("long").alias("slot")).unionByName(later).groupBy("user_idx", "item_idx", "neg").agg(F.min("slot").alias("slot"))
    return top_per_group(every, ["user_idx", "item_idx"], [F.asc("slot"), F.asc("neg")], n, "pick").select("user_idx", "item_idx", "neg", "pick")


def fill_order(pop: DataFrame, positives: DataFrame, history: DataFrame, n: int) -> DataFrame:
    """(user_idx, neg, rank): each user's 2 n + 1 most popular unseen items."""
    return rank_by_popularity(pop, positives.select("user_idx").distinct(), history.select("user_idx", "item_idx").distinct(), 2 * n + 1).select("user_idx", F.col("item_idx").alias("neg"), "rank")


def uniform_negatives(positives: DataFrame, history: DataFrame, pop: DataFrame, n: int, tries: int, seed: str) -> DataFrame:
    """For each positive n items that the user doesn't have: the first unseen of n + tries hash draws, then the most popular ones."""
    total = pop.agg(F.count("*").alias("n_items"))
    draws = positives.select("user_idx", "item_idx").distinct().crossJoin(F.broadcast(total)).select("user_idx", "item_idx", "n_items", F.explode(F.sequence(F.lit(0), F.lit(n + tries - 1))).alias("slot"))
    draws = draws.select("user_idx", "item_idx", "slot", F.pmod(hash32(seed, F.col("user_idx"), F.col("item_idx"), F.col("slot")), F.col("n_items")).alias("neg"))
    return first_unseen(draws, fill_order(pop, positives, history, n), history, n)


def intervals(pop: DataFrame, power: float) -> DataFrame:
    """(item_idx, low, high): consecutive intervals of whole numbers, as long as 1000 (n + 1) ** power, in the order of items.

    Items are summed within spans of ids and shifted by the spans' running sums.
    """
    mass = pop.select("item_idx", F.round(1000.0 * F.pow(F.col("n") + 1.0, F.lit(power))).cast("long").alias("mass"), F.floor(F.col("item_idx") / SPAN).alias("span"))
    spans = mass.groupBy("span").agg(F.sum("mass").alias("total"))
    before = spans.select("span", (F.sum("total").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before"))
    upto = F.sum("mass").over(Window.partitionBy("span").orderBy("item_idx").rowsBetween(Window.unboundedPreceding, 0))
    return mass.withColumn("upto", upto).join(F.broadcast(before), "span").select("item_idx", (F.col("before") + F.col("upto") - F.col("mass")).alias("low"), (F.col("before") + F.col("upto")).alias("high"))


def popular_negatives(positives: DataFrame, history: DataFrame, pop: DataFrame, n: int, tries: int, power: float, seed: str) -> DataFrame:
    """N2's popular part: n unseen items drawn in proportion to (popularity + 1) ** power over all items.

    A draw is a place on the line of all items' intervals. Draws and intervals meet by equal cells of that
    line, as many as there are items, so no draw is compared with all items.
    """
    line = intervals(pop, power)
    whole = line.agg(F.max("high").alias("total"), F.count("*").alias("cells"))
    cell = lambda place: F.floor(place * F.col("cells") / F.col("total"))
    drawn = positives.select("user_idx", "item_idx").distinct().crossJoin(F.broadcast(whole)).select("user_idx", "item_idx", "total", "cells", F.explode(F.sequence(F.lit(0), F.lit(n + tries - 1))).alias("slot"))
    place = F.pmod(F.conv(F.substring(digest(seed, F.col("user_idx"), F.col("item_idx"), F.col("slot"), "popular"), 1, 15), 16, 10).cast("long"), F.col("total"))
    drawn = drawn.withColumn("place", place).withColumn("cell", cell(F.col("place")))
    cells = line.crossJoin(F.broadcast(whole)).select(F.col("item_idx").alias("neg"), "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    draws = drawn.join(cells, "cell").where("low <= place AND place < high").select("user_idx", "item_idx", "neg", "slot")
    return first_unseen(draws, fill_order(pop, positives, history, n), history, n)


def hard_negatives(positives: DataFrame, history: DataFrame, users: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """N2's hard part: the n unseen items of highest score for the user, without the positive itself."""
    best = score_vectors(users, items, history.select("user_idx", "item_idx").distinct(), n + 1).select("user_idx", F.col("item_idx").alias("neg"), F.col("rank").alias("place"))
    others = positives.select("user_idx", "item_idx").distinct().join(best, "user_idx").where("neg <> item_idx")
    return top_per_group(others, ["user_idx", "item_idx"], [F.asc("place")], n, "pick").select("user_idx", "item_idx", "neg", "pick")


def mixed_negatives(positives: DataFrame, history: DataFrame, pop: DataFrame, users: DataFrame, items: DataFrame, n: int, seed: str, power: float = 0.75) -> DataFrame:
    """(user_idx, item_idx, neg, kind): a quarter uniform, a quarter by smoothed popularity, the rest of highest score.

    users (user_idx, uv) and items (item_idx, iv) are the vectors that score.
    """
    quarter = max(1, n // 4)
    kinds = {"uniform": uniform_negatives(positives, history, pop, quarter, 10, seed), "popular": popular_negatives(positives, history, pop, quarter, 10, power, seed), "hard": hard_negatives(positives, history, users, items, n - 2 * quarter)}
    out = None
    for kind, rows in kinds.items():
        rows = rows.select("user_idx", "item_idx", "neg", F.lit(kind).alias("kind"))
        out = rows if out is None else out.unionByName(rows)
    return out
