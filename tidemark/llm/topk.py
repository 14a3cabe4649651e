"""Exact top-k inner products: a KD-tree per shard, searched best box first.

Vectors are dealt to shards of about SHARD rows. A shard's tree splits at the median of the widest
dimension down to LEAF rows; each node has a tight box. No vector in a box has a larger inner
product with q than the sum over dimensions of max(q * low, q * high). A query visits a shard's
nodes by falling bound and stops when the bound falls below its k-th best score. Each block of
queries first meets one shard; its k-th scores then go with it to all others.

Equal rows travel as one with their number, so a vector that a third of all rows repeat is one row of
one shard. Sums are made in floating numbers where those are exact, else in 64-bit integers, else in
integers of any size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import partitions, store

SHARD, LEAF, BLOCK = 4096, 256, 256
ROW = "shard int, kind int, block int, dim int, ids binary, rows binary, copies binary, vectors binary, extra binary"
NAMES = [x.split(" ")[0] for x in ROW.split(", ")]
FOUND = "query_row bigint, query_id bigint, times bigint, vec_id bigint, vec_row bigint, copies bigint, score bigint"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of rows, node spans and children, lower corners, upper corners); node 0 is the root."""
    order, nodes, low, high = np.arange(len(vectors)), [], [], []
    waiting = [(0, len(vectors), -1)]
    while waiting:
        begin, end, parent = waiting.pop()
        part = vectors[order[begin:end]]
        low.append(part.min(0))
        high.append(part.max(0))
        me = len(nodes)
        nodes.append([begin, end, -1, -1])
        if parent >= 0:
            nodes[parent][2 if nodes[parent][2] < 0 else 3] = me
        wide = int(np.argmax(high[-1] - low[-1]))
        if end - begin > LEAF and high[-1][wide] > low[-1][wide]:
            half = (end - begin) // 2
            order[begin:end] = order[begin:end][np.argpartition(part[:, wide], half)]
            waiting += [(begin + half, end, me), (begin, begin + half, me)]
    return order, np.array(nodes, np.int64), np.array(low), np.array(high)


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): floating numbers where these hold it, else integers of any size."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * x)
    if np.isfinite(out).all():
        return out
    return np.array([math.floor(v) if math.isfinite(v) else int(w) * int(scale) for v, w in zip(out.ravel().tolist(), x.ravel().tolist(), strict=True)], object).reshape(x.shape)


def kind_for(a: np.ndarray, b: np.ndarray) -> type:
    """The numbers in which inner products of the rows of a and b are exact; floating ones let BLAS do the work."""
    if a.dtype == object or b.dtype == object:
        return object
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float64 if most < 1 << 52 else np.int64 if most < 1 << 62 else object


def cast(x: np.ndarray, kind: type) -> np.ndarray:
    if kind is object and x.dtype != object:
        return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)
    return x.astype(kind, copy=False)


class Shard:
    """A shard's tree and vectors, cast once for each kind of numbers."""

    def __init__(self, row: dict, scale: float):
        self.at, dim = (row["shard"], row["dim"]), row["dim"]
        self.ids, self.rows, self.copies = (np.frombuffer(row[c], np.int64) for c in ("ids", "rows", "copies"))
        box = np.frombuffer(row["extra"], np.float64).reshape(-1, 4 + 2 * dim)
        self.nodes = box[:, :4].astype(np.int64)
        self.vectors = whole(np.frombuffer(row["vectors"], np.float64).reshape(-1, dim), scale)
        self.low, self.high = whole(box[:, 4 : 4 + dim], scale), whole(box[:, 4 + dim :], scale)
        self.held: dict[type, tuple[np.ndarray, ...]] = {}

    def cast(self, kind: type) -> tuple[np.ndarray, ...]:
        if kind not in self.held:
            self.held[kind] = tuple(cast(x, kind) for x in (self.vectors, self.low, self.high))
        return self.held[kind]


def limited(x: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; those beyond are the nearest one."""
    if x.dtype == object:
        return np.array([min(max(v, LEAST), MOST) for v in x.ravel().tolist()], np.int64).reshape(x.shape)
    return x.astype(np.int64)


def search(queries: np.ndarray, own: np.ndarray, bound: np.ndarray, index: Shard, k: int) -> list[list[tuple[int, int, int, int, int]]]:
    """For each query, the (score, -id, -row, row, copies) of the shard that can be among its k best over all shards."""
    kind = kind_for(queries, index.vectors)
    queries = cast(queries, kind)
    vectors, low, high = index.cast(kind)
    nodes, ids, rows, copies = index.nodes, index.ids, index.rows, index.copies
    top = limited(np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T)
    out = []
    for q in range(len(queries)):
        best: list[tuple[int, int, int, int, int]] = []
        least, held, heap = int(bound[q]), 0, [(-int(top[q, 0]), 0)]
        while heap and -heap[0][0] >= least:
            begin, end, left, right = nodes[heapq.heappop(heap)[1]]
            if left >= 0:
                for child in (left, right):
                    if top[q, child] >= least:
                        heapq.heappush(heap, (-int(top[q, child]), child))
                continue
            score = limited(vectors[begin:end] @ queries[q])
            for i in np.flatnonzero(score >= least):
                n = int(copies[begin + i]) - int(rows[begin + i] == own[q])
                if not n:
                    continue
                heapq.heappush(best, (int(score[i]), -int(ids[begin + i]), -int(rows[begin + i]), int(rows[begin + i]), n))
                held += n
                while held - best[0][4] >= k:
                    held -= heapq.heappop(best)[4]
                if held >= k:
                    least = max(least, best[0][0])
        out.append(best)
    return out


def exact_top_k(table: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score): the k largest inner products of floor(scale * x).

    Candidates are all rows but the query's own, of the same number of dimensions; ties go to the smaller
    vec_id. Vectors that are null, empty or hold a null or non-finite component take no part, nor rows
    without vec_id. Repeated rows are rows of their own. Components may be any finite numbers; a score
    beyond a long counts as the nearest long.
    """
    parts = partitions(table)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id IS NOT NULL AND size(embedding) > 0").where(finite)
    shards = max(1, -(-rows.count() // SHARD))
    once = rows.groupBy("vec_id", "embedding", "asks").agg(F.count("*").alias("copies"))
    dealt = once.select("vec_id", F.size("embedding").alias("dim"), "asks", "copies", F.col("embedding").alias("v"), F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int").alias("shard"))

    def row(*values: object) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes() if isinstance(x, np.ndarray) else x], t) for x, t in zip(values, TYPES, strict=True)], names=NAMES)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            shard, dim = columns["shard"].to_numpy(), columns["dim"].to_numpy()
            ids, copies, asks = columns["vec_id"].to_numpy(), columns["copies"].to_numpy(), columns["asks"].to_numpy(zero_copy_only=False)
            for key in {*zip(shard.tolist(), dim.tolist(), strict=True)}:
                at = np.flatnonzero((shard == key[0]) & (dim == key[1]))
                held.setdefault(key, []).append((ids[at], copies[at], asks[at], columns["v"].take(pa.array(at)).flatten().to_numpy().reshape(-1, key[1])))
        upto: dict[int, int] = {}
        for (shard, dim), group in sorted(held.items()):
            ids, copies, asks, vectors = (np.concatenate(x) for x in zip(*group, strict=True))
            first = np.lexsort((*vectors.T[::-1], ids))
            ids, copies, asks, vectors = ids[first], copies[first], asks[first], vectors[first]
            begin = upto.get(shard, 0)
            names = (shard << 32) + begin + np.arange(len(ids))
            upto[shard] = begin + len(ids)
            order, nodes, low, high = tree(vectors)
            yield row(shard, 0, -1, dim, ids[order], names[order], copies[order], vectors[order], np.concatenate([nodes.astype(np.float64), low, high], axis=1))
            at = np.flatnonzero(asks)
            for i in range(0, len(at), BLOCK):
                b = at[i : i + BLOCK]
                yield row(shard, 1, i // BLOCK, dim, ids[b], names[b], copies[b], vectors[b], np.full(len(b), LEAST, np.int64))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard | None = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    shard = Shard(r, scale)
                elif shard and shard.at == (r["shard"], r["dim"]):
                    ids, names, copies = (np.frombuffer(r[c], np.int64) for c in ("ids", "rows", "copies"))
                    best = search(whole(np.frombuffer(r["vectors"], np.float64).reshape(-1, r["dim"]), scale), names, np.frombuffer(r["extra"], np.int64), shard, k)
                    flat = [(int(names[q]), int(ids[q]), int(copies[q]), -b[1], b[3], b[4], b[0]) for q in range(len(ids)) for b in best[q]]
                    if flat:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*flat, strict=True)], names=[x.split(" ")[0] for x in FOUND.split(", ")])

    def meet(asked: DataFrame) -> DataFrame:
        return index.where("kind = 0").unionByName(asked.select(*NAMES)).repartition(min(parts, shards), "shard").sortWithinPartitions("shard", "dim", "kind", "block").mapInArrow(answer, FOUND)

    index = store(dealt.repartition(min(parts, shards), "shard").mapInArrow(build, ROW), "trees")
    asked = index.where("kind = 1")
    first = store(meet(asked), "first")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                names = np.frombuffer(r["rows"], np.int64).tolist()
                known = dict(zip(r.pop("q") or [], r.pop("b") or [], strict=True))
                r["extra"] = np.array([known.get(n, LEAST) for n in names], np.int64)
                yield row(*(r[n] for n in NAMES))

    kth = first.groupBy("query_row").agg(F.sum("copies").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    by_home = kth.groupBy(F.shiftright("query_row", 32).cast("int").alias("shard")).agg(F.collect_list("query_row").alias("q"), F.collect_list("least").alias("b"))
    carried = asked.join(by_home, "shard", "left").select(*NAMES, "q", "b").mapInArrow(bounded, ROW)
    others = carried.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("to <> shard").withColumn("shard", F.col("to")).drop("to")
    every = first.unionByName(meet(others)) if shards > 1 else first
    upto = F.sum("copies").over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row").rowsBetween(Window.unboundedPreceding, 0))
    placed = every.withColumn("before", upto - F.col("copies")).where(F.col("before") < k)
    ranked = placed.withColumn("rank", F.explode(F.sequence((F.col("before") + 1).cast("int"), F.least(F.col("before") + F.col("copies"), F.lit(k)).cast("int"))))
    return ranked.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", "rank", "vec_id", "score")


TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
