"""From signatures to links: texts that share a signature value are a group, and groups are verified in rounds.

Each two texts of a group must be compared, but groups overlap, and chance values chain them, so
comparing every group, or every connected cluster of groups, repeats or squares the work:

1. Each text goes to the largest of its groups only, which gives local components.
2. Groups whose texts went to several tiles and are in several components meet again: those of up to FEW
   texts with all of them that another is near to in size, larger ones with one representative of each component.
3. Only larger groups still in several components, of which one has several texts here, meet with all
   their texts; pairs of one component are not compared again.

So a group of very many near copies sends each text about once, whatever number of values they share.
In 2 and 3 groups that overlap are put together, so that a text in very many like groups meets once (see overlaid).
Texts meet by their bitmaps, which step 1 makes, and only those that these leave a partner are sent again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.frames import by_bucket, discard, likely, signed, store, sweep
from tidemark.llm.graph import attach, components
from tidemark.llm.tiles import CELL, links, near, pair_tiles, single_tiles

FEW = 8
#: A quarter of the members of a part of the tiles that is not parted further.
LEAST = 8_000_000
POSTING = np.dtype([("key", "<u8"), ("node", "<i8")])
#: Low bits of a group's name that are a hash of its texts; its size stands above them.
HASHED = np.uint64(42)


def groups(packed: DataFrame, buckets: int) -> DataFrame:
    """Packed postings (key, node) -> (group, node): the nodes of each key that several have.

    A group's name is its size (up to 2**21), then a hash of its nodes: the larger name is the larger
    group, and keys that the same nodes share are one group. Different groups of one name are compared together.
    """

    def gathered(bucket: int, raw: bytes) -> Iterator[pa.RecordBatch]:
        postings = np.frombuffer(raw, POSTING)
        order = np.argsort(postings["key"])
        key = postings["key"][order]
        same = key[1:] == key[:-1]
        twin = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        key, node = key[twin], postings["node"][order[twin]]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[fresh], node[fresh]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[: len(key)]
        size = np.diff(np.append(begin, len(key)))
        node = node[np.repeat(size > 1, size)]
        size = size[size > 1]
        if not len(size):
            return
        begin = np.cumsum(size) - size
        content = W.mix(np.add.reduceat(W.mix(node.view(np.uint64)), begin))
        name = np.minimum(size, (1 << 21) - 1).astype(np.uint64) << HASHED | content >> (np.uint64(64) - HASHED)
        keep = np.zeros(len(size), bool)
        keep[np.unique(name, return_index=True)[1]] = True
        rows = np.repeat(keep, size)
        name, node = np.repeat(name, size)[rows], node[rows]
        for i in range(0, len(node), 100_000):
            yield pa.RecordBatch.from_arrays([signed(x[i : i + 100_000]) for x in (name, node)], names=["group", "node"])

    return by_bucket(packed, buckets, gathered, "group bigint, node bigint")


def near_in_size(members: DataFrame, percent: int) -> DataFrame:
    """members (cluster, node, n, ...) without those whose cluster has no other of a size that allows percent / 100; clusters are small.

    Of the sizes in order, the nearest to a member's are next to it, and two sets of that Jaccard have sizes of that ratio.
    """
    order = Window.partitionBy("cluster").orderBy("n")
    beside = members.withColumns({"_less": F.lag("n").over(order), "_more": F.lead("n").over(order)})
    return beside.where((F.col("_less") * 100 >= F.col("n") * percent) | (F.col("_more") * percent <= F.col("n") * 100)).drop("_less", "_more")


def overlaid(members: DataFrame) -> DataFrame:
    """members (cluster, node, n, label) with the clusters that have the same least node put together where that makes no more pairs.

    Clusters that overlap much mostly have the same least node (by hash), as in MinHash. Those put together have up to CELL
    nodes, each of them once; larger clusters, and those whose union has more pairs than they have, stay as they are.
    """
    sized = store(attach(members, "cluster", ["node"], home=F.min(F.xxhash64("node")), size=F.count("*")), "members")
    small = attach(sized.where(F.col("size") <= CELL), "home", ["node"], union=F.count_distinct("node"), pairs=F.sum("size"))
    joint = (F.col("union") <= CELL) & (F.col("union") * F.col("union") <= F.col("pairs"))
    small = small.withColumn("cluster", F.when(joint, F.col("home")).otherwise(F.col("cluster"))).dropDuplicates(["cluster", "node"])
    out = small.select(members.columns).unionByName(sized.where(F.col("size") > CELL).select(members.columns))
    out._stored_at = sized._stored_at
    return out


def verified(packed: DataFrame, nodes: DataFrame, fetch: Callable[[DataFrame], DataFrame], buckets: int, percent: int, read: Callable[[list[bytes]], Iterable[np.ndarray]]) -> tuple[DataFrame, DataFrame]:
    """(links, nodes in groups), stored: (a, b) that span the components of all links of Jaccard percent / 100 or more.

    packed: postings; nodes: (node, n, ...), n > 0 members or about so many; fetch(nodes in groups, with the tile of each)
    gives (node, tile, data), of which `read` makes sets. The texts are fetched once, and those sent again are met by
    node. What a round sends again is cut to parts of about all members, whose shuffle files go before the next.
    """
    shared = store(groups(packed, buckets).distinct(), "groups")
    sweep(shared.sparkSession)
    chosen = shared.groupBy("node").agg(F.max("group").alias("cluster"))
    dealt = store(chosen.join(nodes, "node"), "members")
    known = store(single_tiles(dealt).withColumn("tile", F.col("tiles")[0]["tile"]), "members")
    discard(dealt)
    data = store(fetch(known), "data")
    sweep(shared.sparkSession)
    first = store(links(data.select("tile", F.lit(0).alias("cell"), F.col("node").alias("label"), "node", "data"), buckets, percent, read, sketched=True), "links")
    sweep(shared.sparkSession)
    sketches = first.where("sketch IS NOT NULL").select(F.col("a").alias("node"), F.col("b").alias("size"), "sketch")
    sizes = sketches.select("node", F.col("size").alias("n"))
    found = first.where("sketch IS NULL").select("a", "b")
    found._stored_at = first._stored_at
    most = max(known.agg(F.sum("n")).first()[0] or 0, 4 * LEAST)

    def parted(rows: DataFrame, weight: Column, made: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
        """made() of the rows, some tiles at a time, so that the shuffle files hold about all texts once."""
        parts = max(1, -(-int(rows.agg(F.sum(weight)).first()[0] or 0) // most))
        out = []
        for i in range(parts):
            out.append(store(made(rows.where(F.pmod("tile", F.lit(parts)) == i) if parts > 1 else rows), name))
            sweep(shared.sparkSession)
        if parts == 1:
            return out[0]
        whole = store(reduce(DataFrame.unionByName, out), name)
        for step in out:
            discard(step)
        return whole

    def compared(asked: DataFrame) -> DataFrame:
        """Links of members (cluster, node, n, label), which meet by their sketches first and then, where those leave a partner, by their texts."""
        laid = overlaid(asked)
        together = store(laid, "members")
        discard(laid)
        tiles = store(pair_tiles(together).select("node", "n", F.explode("tiles").alias("t")).select("node", "n", "t.tile", "t.cell", "t.label"), "members")
        discard(together)
        asked_for = likely(sketches, tiles, ["node"])
        left = parted(tiles, F.col("n") / 4, lambda x: near(x.drop("n").join(asked_for, "node"), buckets, percent), "near")
        discard(tiles)
        texts = store(left.distinct().join(sizes, "node"), "members")
        asked_for = likely(data.select("node", "data"), texts, ["node"])
        out = parted(texts, F.col("n"), lambda x: links(x.join(asked_for, "node"), buckets, percent, read).select("a", "b"), "links")
        for step in (left, texts):
            discard(step)
        return out

    tile = known.select("node", "tile")
    marked = shared.join(tile, "node").join(found.withColumnsRenamed({"b": "node", "a": "label"}), "node", "left")
    marked = store(marked.select(F.col("group").alias("cluster"), "node", "tile", F.coalesce("label", "node").alias("label")), "marked")
    spread = attach(marked, "cluster", ["node"], texts=F.count("*"), t0=F.min("tile"), t1=F.max("tile"), l0=F.min("label"), l1=F.max("label"))
    open_ = store(spread.where("t0 <> t1 AND l0 <> l1").select("cluster", "node", "label", "texts"), "open")
    discard(shared)
    discard(marked)
    few, many = open_.where(F.col("texts") <= FEW).drop("texts"), open_.where(F.col("texts") > FEW).drop("texts")
    if not open_.isEmpty():
        one = many.groupBy("cluster", "label").agg(F.min("node").alias("node"), F.count("*").alias("texts"))
        asked = store(one.select("cluster", "node", "label").join(sizes, "node").unionByName(near_in_size(few.join(sizes, "node"), percent)), "members")
        parts = [found, compared(asked)]
        discard(asked)
        several = one.groupBy("cluster").agg(F.max("texts").alias("most")).where("most > 1")
        again = many.join(several, "cluster", "left_semi")
        if not again.isEmpty():
            names = open_.select("node", "label").distinct()
            by_label = parts[1].join(names.withColumnsRenamed({"node": "a", "label": "la"}), "a").join(names.withColumnsRenamed({"node": "b", "label": "lb"}), "b")
            merged = components(by_label.select(F.col("la").alias("a"), F.col("lb").alias("b")))
            again = store(again.join(merged.withColumnsRenamed({"node": "label", "component": "root"}), "label", "left").select("cluster", "node", F.coalesce("root", "label").alias("label")), "members")
            left = attach(again, "cluster", ["node"], l0=F.min("label"), l1=F.max("label")).where("l0 <> l1").drop("l0", "l1")
            rest = store(left.join(sizes, "node"), "members")
            discard(again)
            parts.append(compared(rest))
            discard(merged)
            discard(rest)
        found = store(reduce(DataFrame.unionByName, parts), "links")
        for step in parts:
            discard(step)
    for step in (open_, data):
        discard(step)
    return found, known
