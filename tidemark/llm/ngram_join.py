"""N-gram Jaccard join: documents whose sets of five-word shingles have a Jaccard of 0.8 or more.

Exact: no link between different texts is lost.

1. Documents with equal sets are one node, told by a 128-bit digest of the set; its 64-bit name is checked
   to be no other digest's (see frames.named).
2. The shingles of a fixed third of the hash space are counted over all nodes. A partner of a set
   of n lacks at most n - ceil(0.8 n) of its shingles, so a node with more shingles that no other
   node has is out. This needs no list of common shingles and nothing is broadcast.
3. Two sets with Jaccard >= 0.8 share one of their n - ceil(0.8 n) + 1 first members in any order
   that holds for all sets. The order is: the counted third by frequency, then the rest by hash.
   So passages that many documents share come late and bring few nodes together.
4. Nodes that share such a member are a group, verified in size-banded tiles with bitmap bounds and
   exact intersections (see candidates); the verified links are joined to components.

Only components are given, not the number of links: within one the pairs that are already joined are
not compared, as they grow with the square of a group.

Null or empty text, or text without words, has an empty set and links with nothing. Words of a long
text are hashed SEGMENT bytes at a time. Repeated
rows keep one result row each. A null doc_id stays null and never names a component: its row has the
smallest doc_id of the others, or null. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.candidates import POSTING, verified
from tidemark.llm.frames import SLICE_BYTES, Packer, by_bucket, discard, likely, named, partitions, slices, store, sweep
from tidemark.llm.graph import attach, components

PERCENT = 80
#: Postings sent to a node: of a shared shingle (its hash and count), or (third's size, -set size).
SHARED = np.dtype([("key", "<u8"), ("token", "<u8"), ("count", "<i4")])
#: Bytes of a text that are taken apart at once.
SEGMENT = 2_000_000
#: Stands for a null doc_id where texts are fetched again.
NO_ID = -(1 << 63)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    if n > 1 or len(data) <= SEGMENT:
        word, row, _, _ = W.words(data, offsets)
    else:  # one long text
        word = np.concatenate([W.words(data[a:b], np.array([0, b - a]))[0] for a, b in W.segments(data, SEGMENT)])
        row = np.zeros(len(word), np.int64)
    return W.sets(*W.shingles(word, row, n), n)


def counted(keys: np.ndarray) -> np.ndarray:
    """The third of the hash space whose shingles are counted."""
    return (keys & np.uint64(0xFFFF)) < np.uint64(21_846)


def leading(n: int) -> int:
    """Members of a set of n, in a common order, of which a partner has at least one."""
    return n - (n * PERCENT + 99) // 100 + 1


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, node, check: halves of the set's digest, or null, set size, size of its counted third)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            sets = shingle_sets(data, offsets)
            third = [int(counted(W.mix(x ^ W.BASE)).sum()) for x in sets]
            halves = W.digests([x.tobytes() for x in sets])
            none = np.array([not len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(halves[:, k], pa.int64(), mask=none) for k in (0, 1)), pa.array([len(x) for x in sets], pa.int64()), pa.array(third, pa.int64())], names=["doc_id", "node", "check", "n_shingles", "third"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, node bigint, check bigint, n_shingles bigint, third bigint")


def postings(docs: DataFrame, buckets: int, clashing: np.ndarray) -> DataFrame:
    """Packed (shingle, node): each set's counted third, and more where that is shorter than leading()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(buckets, POSTING), set()
        for _, data, offsets in slices(batches):
            for values in shingle_sets(data, offsets):
                if not len(values) or (node := W.name(values, clashing)) in seen:
                    continue
                seen.add(node)
                keys = W.mix(values ^ W.BASE)
                third = counted(keys)
                first = keys[third]
                if len(first) < leading(len(keys)):
                    first = np.concatenate([first, np.sort(keys[~third])[: leading(len(keys)) - len(first)]])
                records = np.empty(len(first), POSTING)
                records["key"], records["node"] = first, node
                packer.add(records)
            if packer.full():
                yield from packer.flush()
                seen.clear()
        yield from packer.flush()

    return docs.select("text").mapInArrow(run, Packer.schema)


def shared(packed: DataFrame, buckets: int) -> DataFrame:
    """Postings of the shingles that two or more nodes have, packed by node, with the number of nodes."""

    def reduce(bucket: int, raw: bytes) -> Iterator[pa.RecordBatch]:
        records = np.frombuffer(raw, POSTING)
        key = records["key"]
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        twin = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        key, node = key[twin], records["node"][order[twin]]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[fresh], node[fresh]
        _, index, count = np.unique(key, return_inverse=True, return_counts=True)
        count = np.minimum(count, 1 << 30)[index]
        out = np.empty(int((count > 1).sum()), SHARED)
        out["key"], out["token"], out["count"] = node[count > 1].view(np.uint64), key[count > 1], count[count > 1]
        packer = Packer(buckets, SHARED)
        packer.add(out)
        yield from packer.flush()

    return by_bucket(packed, buckets, reduce, Packer.schema)


def node_sizes(nodes: DataFrame, buckets: int) -> DataFrame:
    """(node, n, third), packed by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, SHARED)
        for batch in batches:
            out = np.empty(batch.num_rows, SHARED)
            out["key"] = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            out["count"], out["token"] = -batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            packer.add(out)
            if packer.full():
                yield from packer.flush()
        yield from packer.flush()

    return nodes.select("node", "n", "third").mapInArrow(run, Packer.schema)


def prefixes(packed: DataFrame, buckets: int) -> DataFrame:
    """For the nodes with few enough shingles of their own: their first shared members, packed by shingle."""

    def reduce(bucket: int, raw: bytes) -> Iterator[pa.RecordBatch]:
        records = np.frombuffer(raw, SHARED)
        late = np.where(records["count"] < 0, 0, 1 + ~counted(records["token"]))
        order = np.lexsort((records["token"], np.where(late == 2, 0, records["count"]), late, records["key"]))
        records, late = records[order], late[order]
        packer = Packer(buckets, POSTING)
        cut = np.flatnonzero(np.concatenate([[True], records["key"][1:] != records["key"][:-1]]))
        for begin, end in zip(cut, [*cut[1:], len(records)], strict=True):
            if end - begin < 2 or records["count"][begin] >= 0:
                continue
            n, third = -int(records["count"][begin]), int(records["token"][begin])
            known = int((late[begin:end] == 1).sum())
            left = leading(n) - (third - known)
            if left > 0:
                take = slice(begin + 1, begin + 1 + left) if left <= known else slice(begin + 1, end)
                out = np.empty(len(records[take]), POSTING)
                out["key"], out["node"] = records["token"][take], records["key"][begin].view(np.int64)
                packer.add(out)
        yield from packer.flush()

    return by_bucket(packed, buckets, reduce, Packer.schema)


def wanted_texts(docs: DataFrame, clashing: np.ndarray) -> DataFrame:
    """docs (text, node, tile) -> (node, tile, data: a text's bytes), where node names the text's set; a node about once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, data, offsets in slices(batches):
            rows = []
            for i, (node, tile, values) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), shingle_sets(data, offsets), strict=True)):
                if node not in seen and len(values) and W.name(values, clashing) == node:
                    seen.add(node)
                    rows.append((node, tile, data[offsets[i] : offsets[i + 1]].tobytes()))
            if len(seen) > 100_000:
                seen.clear()
            for i in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows[i : i + 500], strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["node", "tile", "data"])

    return docs.select("text", "node", "tile").mapInArrow(run, "node bigint, tile bigint, data binary")


def sets_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sets of texts, made as they are asked for, SLICE_BYTES of text at a time.

    Texts are sent in place of sets, as hashes can't be compressed and take several times the texts' disk.
    """
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= SLICE_BYTES:
            size += len(texts[j])
            j += 1
        yield from shingle_sets(np.frombuffer(b"".join(texts[i:j]), np.uint8), np.cumsum([0, *map(len, texts[i:j])]))
        i = j


def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, n_shingles, component_id), one row for each row of docs."""
    spark, buckets = docs.sparkSession, partitions(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored = store(profile(docs), "profile")
    apart = stored.where("node is not null").groupBy("node").agg((F.min("check") != F.max("check")).alias("apart")).where("apart")
    sized, clashing = named(stored, apart)
    classes = store(sized.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("fetch"), F.max("n_shingles").alias("n"), F.max("third").alias("third")), "classes")
    common = shared(postings(docs, buckets, clashing), buckets).unionByName(node_sizes(classes, buckets))
    texts = docs.withColumn("fetch", F.coalesce("doc_id", F.lit(NO_ID)))

    def fetch(known: DataFrame) -> DataFrame:
        wanted = known.select("fetch", "node", "tile")
        return wanted_texts(likely(texts.select("text", "fetch"), wanted, ["fetch"]).join(wanted, "fetch"), clashing)

    found, known = verified(prefixes(common, buckets), classes.select("node", "n", "fetch"), fetch, buckets, PERCENT, sets_of)
    discard(known)
    joined = components(found)
    discard(found)
    sweep(spark)
    rooted = classes.join(joined.withColumnRenamed("component", "root"), "node").select("node", "doc_id", "root")
    final = store(attach(rooted, "root", ["node"], component_id=F.min("doc_id")).select("node", "component_id").unionByName(classes.join(joined, "node", "left_anti").select("node", F.col("doc_id").alias("component_id"))), "components")
    discard(joined)
    discard(classes)
    return sized.join(final, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
