"""Connected components: inside one task with numpy, across the cluster with joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import discard, store

#: Parts into which the rows of one key are split where each of them meets its key's aggregate.
SALTS = 64
#: Edges that one task contracts, at 16 bytes each.
PART = 2_000_000


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each node's component for edges a-b over nodes 0..n-1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        label = new[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def attach(rows: DataFrame, key: str, by: list[str], **aggregates: Column) -> DataFrame:
    """rows with aggregates of all rows of their key; `by` names columns that tell the rows of a key apart.

    The aggregates are made on the map side first, then sent once to each salt that their key's rows have,
    so a key with a third of all rows is joined in SALTS tasks and one with a single row in one.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    made = salted.groupBy(key).agg(*[c.alias(n) for n, c in aggregates.items()], F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    which = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.col("salts").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), s)) != 0)
    return salted.join(made.withColumn("salt", F.explode(which)).drop("salts"), [key, "salt"]).drop("salt")


def is_star_forest(edges: DataFrame) -> bool:
    """Whether each a has one b and no b is an a."""
    forks = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    chains = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi")
    return forks.unionByName(chains).isEmpty()


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a part -> each vertex's edge to the smallest of its component in that part."""
    held = [[np.asarray(c) for c in batch.columns] for batch in batches]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        names, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_components(index[: len(a)], index[len(a) :], len(names))
        moved = root != np.arange(len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], names=["a", "b"])


def components(edges: DataFrame, part: int = PART, rounds: int = 60) -> DataFrame:
    """(node, component) of each node of edges (a, b); component is its smallest node.

    Parts of about `part` edges are contracted to stars, each in a task; where that is one part, it is the
    result. Else large-star and small-star steps alternate (each vertex hangs its larger, then its smaller
    neighbours on the smallest one) until every vertex hangs on the smallest of its component. A vertex
    with very many neighbours is split by salts. Each round is stored in the shared folder and the one
    before deleted.
    """
    first = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    parts = max(1, -(-first.count() // part))
    dealt = first.coalesce(1) if parts == 1 else first.repartition(parts, "a", "b")
    edges = store(dealt.mapInArrow(contracted, "a bigint, b bigint"), "edges")
    discard(first)
    for _ in range(rounds):
        if parts == 1 or is_star_forest(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = attach(both, "a", ["b"], m=F.min("b")).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        low = attach(large, "a", ["b"], m=F.min("b"))
        small = low.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = store(small, "edges")
        discard(edges)
        edges = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    out._stored_at = edges._stored_at
    return out
