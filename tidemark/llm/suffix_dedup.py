"""Suffix-array dedup: bytes covered by a string of MINIMUM bytes that also starts in an earlier document.

1. Equal texts are one node, told by SHA-256; all but its smallest doc_id are covered whole.
2. Every window of MINIMUM bytes has one anchor, the 20-byte string in it of least hash (leftmost of
   equals). Equal windows have equal anchors, so only anchors that two or more nodes have matter.
   They are found in one packed shuffle of hashes.
3. For those anchors the runs of windows that they stand for (50 to 80 bytes) meet in their bucket; of
   equal runs in a task's chunk only the earliest document's are sent, as the others are known to go.
   The different texts of an anchor's runs, each with its earliest document, go into a suffix array and
   its Burrows-Wheeler transform, whose intervals are expanded breadth-first: level l + 1 follows from
   level l by one backward step of all suffixes at once, which gives the common prefixes in increasing
   order and stops at MINIMUM.
4. A suffix interval at that depth is one window; the documents in it later than its first are
   covered there. Spans are merged by document.

An anchor whose runs make more than HOT bytes is worked off window by window, in parts by a hash of the
window, so that no array grows with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.candidates import POSTING
from tidemark.llm.frames import Packer, by_bucket, discard, named, partitions, slices, store, sweep
from tidemark.llm.graph import attach

MINIMUM, GRAM = 50, 20
WIDTH = MINIMUM - GRAM + 1
LONGEST = MINIMUM + WIDTH - 1
PLACE = np.uint64((1 << 26) - 1)
SEGMENT = 1 << 21
CHUNK, HOT = 1_000_000, 4_000_000
NO_ID = -(1 << 63)
RUN = np.dtype([("key", "<u8"), ("node", "<i8"), ("doc", "<i8"), ("start", "<i8"), ("size", "<i8"), ("text", "u1", (LONGEST,))])
SPAN = np.dtype([("key", "<u8"), ("start", "<i8"), ("end", "<i8")])


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, row, first window, last window) of each run of windows with one anchor; places are in data.

    Anchors are least of many hashes, so their hashes are mixed again: else they'd gather in the first buckets.
    """
    out = []
    for base in range(0, max(1, len(data)), SEGMENT):
        out.append(_windows(data[base : base + SEGMENT + MINIMUM - 1], offsets, base))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _windows(data: np.ndarray, offsets: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
    n = len(data) - MINIMUM + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = W.prefix_sums(data)
    grams = W.mix((sums[GRAM:] - sums[:-GRAM]) * W.powers(len(sums), "q")[: len(sums) - GRAM])
    low = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= WIDTH:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = WIDTH - span
    low = np.minimum(low[: len(low) - rest], low[rest:])[:n] if rest else low[:n]
    chosen = (low & PLACE).astype(np.int64)
    crosses = np.zeros(n + 1, np.int64)
    inside = offsets[(offsets > base) & (offsets < base + len(data))] - base
    np.add.at(crosses, np.maximum(inside - MINIMUM + 1, 0), 1)
    np.add.at(crosses, np.minimum(inside, n), -1)
    at = np.flatnonzero(np.cumsum(crosses[:-1]) == 0)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (chosen[at[1:]] != chosen[at[:-1]]) | (at[1:] != at[:-1] + 1)]))
    first, last = at[begin], at[np.concatenate([begin[1:], [len(at)]]) - 1]
    return W.mix(grams[chosen[first]] ^ W.BASE), np.searchsorted(offsets, first + base, "right") - 1, first + base, last + base


def nodes_of(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, clashing: np.ndarray) -> np.ndarray:
    """64-bit names of the texts, from their SHA-256."""
    view = memoryview(np.ascontiguousarray(data))
    raw = b"".join([hashlib.sha256(view[offsets[i] : offsets[i + 1]]).digest()[:16] for i in range(part.num_rows)])
    return W.names(np.frombuffer(raw, np.int64).reshape(-1, 2), clashing)


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, node, check: the first 128 bits of sha, n_bytes, sha) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            view = memoryview(data)
            shas = [hashlib.sha256(view[offsets[i] : offsets[i + 1]]).digest() for i in range(part.num_rows)]
            halves = np.frombuffer(b"".join([s[:16] for s in shas]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(np.diff(offsets)), pa.array([s.hex() for s in shas])], names=["doc_id", "node", "check", "n_bytes", "sha"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, node bigint, check bigint, n_bytes bigint, sha string")


def anchors(docs: DataFrame, buckets: int, clashing: np.ndarray) -> DataFrame:
    """Packed (anchor, node) of every text; texts seen before in a task are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(buckets, POSTING), set()
        for part, data, offsets in slices(batches):
            key, row, _, _ = windows(data, offsets)
            nodes = nodes_of(part, data, offsets, clashing)
            fresh = np.zeros(part.num_rows, bool)
            for i, node in enumerate(nodes.tolist()):
                if node not in seen:
                    seen.add(node)
                    fresh[i] = True
            keep = fresh[row]
            records = np.empty(int(keep.sum()), POSTING)
            records["key"], records["node"] = key[keep], nodes[row[keep]]
            packer.add(records)
            if packer.full():
                yield from packer.flush()
                seen.clear()
        yield from packer.flush()

    return docs.select("text").mapInArrow(run, Packer.schema)


def shared(packed: DataFrame, buckets: int) -> DataFrame:
    """Packed (node, anchor) of the anchors that two or more nodes have."""

    def reduce(bucket: int, raw: bytes) -> Iterator[pa.RecordBatch]:
        records = np.frombuffer(raw, POSTING)
        order = np.argsort(records["key"])
        key = records["key"][order]
        same = key[1:] == key[:-1]
        twin = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        key, node = key[twin], records["node"][order[twin]]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        if not len(key):
            return
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
        key, node = key[fresh], node[fresh]
        _, index, count = np.unique(key, return_inverse=True, return_counts=True)
        many = count[index] > 1
        out = np.empty(int(many.sum()), POSTING)
        out["key"], out["node"] = node[many].view(np.uint64), key[many].view(np.int64)
        packer = Packer(buckets, POSTING)
        packer.add(out)
        yield from packer.flush()

    return by_bucket(packed, buckets, reduce, Packer.schema)


def grouped(packed: DataFrame, buckets: int, dtype: np.dtype) -> DataFrame:
    """Packed records keyed by node -> (node, data), one row per node."""

    def reduce(bucket: int, raw: bytes) -> Iterator[pa.RecordBatch]:
        records = np.frombuffer(raw, dtype)
        records = records[np.argsort(records["key"], kind="stable")]
        begin = np.flatnonzero(np.concatenate([[True], records["key"][1:] != records["key"][:-1]]))
        end = np.concatenate([begin[1:], [len(records)]])
        for i in range(0, len(begin), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(records["key"][begin[i : i + 2000]].view(np.int64)), pa.array([records[x:y].tobytes() for x, y in zip(begin[i : i + 2000], end[i : i + 2000], strict=True)], pa.binary())], names=["node", "data"])

    return by_bucket(packed, buckets, reduce, "node bigint, data binary")


def by_text(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(records in an order that brings equal texts together, by document; whether a text differs from the one before).

    The order is that of a hash; bytes decide what is equal. A clash could only part equal texts, which
    then are two texts of the same suffix array.
    """
    columns = np.ascontiguousarray(records["text"]).view(np.uint64).reshape(len(records), -1)
    name = records["size"].astype(np.uint64)
    for i in range(columns.shape[1]):
        name = W.mix(name * W.BASE + columns[:, i])
    order = np.lexsort((records["doc"], name))
    columns, records = columns[order], records[order]
    begin = np.ones(len(records), bool)
    begin[1:] = (records["size"][1:] != records["size"][:-1]) | (columns[1:] != columns[:-1]).any(1) | (records["key"][1:] != records["key"][:-1])
    return records, begin


def earliest(records: np.ndarray) -> np.ndarray:
    """The runs of each text's earliest document; of the others their spans, merged, as records of size 0 (start to doc).

    Those have the hash of their node as key, so they are dealt evenly however common their text is.
    """
    records, begin = by_text(records)
    later = records["doc"] > records["doc"][begin][np.cumsum(begin) - 1]
    gone = records[later]
    gone = gone[np.lexsort((gone["start"], gone["node"]))]
    if not len(gone):
        return records
    new = np.ones(len(gone), bool)  # runs of one node overlap or touch from one to the next
    new[1:] = (gone["node"][1:] != gone["node"][:-1]) | (gone["start"][1:] > (gone["start"] + gone["size"])[:-1])
    first = np.flatnonzero(new)
    out = np.zeros(len(first), RUN)
    out["node"], out["start"] = gone["node"][first], gone["start"][first]
    out["doc"] = np.maximum.reduceat(gone["start"] + gone["size"], first)
    out["key"] = W.mix(out["node"].view(np.uint64) ^ W.BASE)
    return np.concatenate([records[~later], out])


def runs(docs: DataFrame, buckets: int, clashing: np.ndarray) -> DataFrame:
    """docs (text, fetch, node, data: its shared anchors) -> packed runs of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, RUN)
        for part, data, offsets in slices(batches):
            key, row, first, last = windows(data, offsets)
            keep = np.zeros(len(key), bool)
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            docs_, nodes = part.column(1).to_numpy(), part.column(2).to_numpy()
            mine = nodes_of(part, data, offsets, clashing)
            for i, known in enumerate(part.column(3).to_pylist()):
                if mine[i] == nodes[i]:
                    wanted = np.sort(np.frombuffer(known, POSTING)["node"].view(np.uint64))
                    own = key[cut[i] : cut[i + 1]]
                    keep[cut[i] : cut[i + 1]] = wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own
            key, row, first, last = key[keep], row[keep], first[keep], last[keep]
            padded = np.concatenate([data, np.zeros(LONGEST, np.uint8)])
            for i in range(0, len(key), 20_000):
                s = slice(i, i + 20_000)
                records = np.zeros(len(key[s]), RUN)
                records["key"], records["node"], records["doc"] = key[s], nodes[row[s]], docs_[row[s]]
                records["start"], records["size"] = first[s] - offsets[row[s]], last[s] - first[s] + MINIMUM
                reach = np.arange(LONGEST)
                records["text"] = padded[first[s, None] + reach] * (reach < records["size"][:, None])
                packer.add(records)
                if packer.full():
                    yield from packer.flush(reduced=earliest)
        yield from packer.flush(reduced=earliest)

    return docs.select("text", "fetch", "node", "data").mapInArrow(run, Packer.schema)


def equal_windows(texts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The class of each window of MINIMUM bytes of the texts, by text and place; equal windows have one class.

    The suffix array is sorted to depth 56 by doubling from 7; intervals are then expanded level by level on
    its Burrows-Wheeler transform, from the last depth below MINIMUM, whose ranks are at hand, to MINIMUM.
    """
    width = texts.shape[1]
    inside = np.arange(width + 1) < size[:, None]
    code = np.zeros((len(texts), width + 1), np.uint64)
    code[:, :width] = texts
    code = ((code + np.uint64(1)) * inside)[np.arange(width + 1) <= size[:, None]]  # one 0 ends each text
    n = len(code)
    key = np.zeros(n, np.uint64)
    for t in range(7):
        key[: n - t] |= code[t:] << np.uint64(9 * (6 - t))
    depth = 7
    while True:
        order = np.argsort(key)
        fresh = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh).astype(np.uint64)
        if depth >= MINIMUM:
            break
        level, known = depth, rank
        key = rank << np.uint64(32)
        key[: n - depth] |= rank[depth:]
        depth *= 2
    position = np.empty(n, np.int64)
    position[order] = np.arange(n)
    step = position[np.minimum(order + 1, n - 1)]  # where the suffix one symbol on stands: a backward step's inverse
    left = (np.repeat(np.cumsum(size + 1) - 1, size + 1) - np.arange(n))[order]  # symbols up to the text's end
    head = known[order]
    border = np.ones(n, bool)  # border[j]: the common prefix of suffixes j - 1 and j is shorter than the level
    border[1:] = (head[1:] != head[:-1]) | (left[1:] < level)
    held = np.flatnonzero(~border)
    for _ in range(level, MINIMUM):
        interval = np.cumsum(border)
        apart = interval[step[held]] != interval[step[held - 1]]
        border[held[apart]] = True
        held = held[~apart]
        if not len(held):
            break
    interval = np.cumsum(border)
    count = size - MINIMUM + 1
    begin = np.cumsum(size + 1) - size - 1
    at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    return interval[position[at]]


def least_of(window: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window the earliest document of its class."""
    order = np.argsort(window, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], window[order[1:]] != window[order[:-1]]]))
    out = np.empty(len(window), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(doc[order], cut), np.diff(np.append(cut, len(window))))
    return out


def hot_least(texts: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """least_of() for texts that together are too long for one suffix array: their windows, in parts by a hash.

    A window whose hash no other has is alone in its class and needs no comparison.
    """
    count = size - MINIMUM + 1
    owner = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    flat = np.ascontiguousarray(texts).reshape(-1)
    at = owner * texts.shape[1] + place
    eight = W.chunks(flat)
    name = np.zeros(len(owner), np.uint64)
    for k in (*range(0, MINIMUM - 8, 8), MINIMUM - 8):
        name = W.mix(name ^ eight[at + k])
    order = np.argsort(name, kind="stable")
    same = name[order[1:]] == name[order[:-1]]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]  # equal hashes stand together
    out, i = doc[owner], 0
    while i < len(order):
        j = min(len(order), i + CHUNK // (MINIMUM + 1))
        j = int(np.searchsorted(name[order], name[order[j - 1]], "right"))
        mine = order[i:j]
        own = flat[at[mine][:, None] + np.arange(MINIMUM)]
        out[mine] = least_of(equal_windows(own, np.full(len(mine), MINIMUM)), doc[owner[mine]])
        i = j
    return out


def covered(records: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, start, end) of covered spans; records hold every run of their anchors, and spans that are known (size 0)."""
    known = records["size"] == 0
    yield records["node"][known], records["start"][known], records["doc"][known]
    records = records[~known]
    if not len(records):
        return
    records, begin = by_text(records)
    unique = np.flatnonzero(begin)
    group = np.cumsum(begin) - 1
    key, doc = records["key"][unique], records["doc"][unique]
    by_key = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[by_key[1:]] != key[by_key[:-1]]])
    anchor = np.cumsum(fresh) - 1
    ends = np.append(unique[1:], len(records))
    many = np.bincount(anchor, weights=records["doc"][unique[by_key]] != records["doc"][ends[by_key] - 1]) > 0
    wanted = (np.bincount(anchor) > 1) | many  # anchors with several texts, or several documents of one
    by_key, anchor = by_key[wanted[anchor]], anchor[wanted[anchor]]
    mass = np.cumsum(records["size"][unique[by_key]] + 1)
    i = 0
    while i < len(by_key):
        j = max(i + 1, int(np.searchsorted(mass, (mass[i - 1] if i else 0) + CHUNK, "right")))
        j = int(np.searchsorted(anchor, anchor[j - 1], "right"))  # anchors stay whole
        if j - i > 1 and mass[j - 1] - (mass[i - 1] if i else 0) > HOT and anchor[i] != anchor[j - 1]:
            j = int(np.searchsorted(anchor, anchor[j - 1], "left"))  # a hot one goes on its own
        part = by_key[i:j]
        text, size = records["text"][unique[part]], records["size"][unique[part]]
        if mass[j - 1] - (mass[i - 1] if i else 0) > HOT:
            low = hot_least(text, size, np.ascontiguousarray(doc[part]))
        else:
            count = size - MINIMUM + 1
            low = least_of(equal_windows(text, size), np.repeat(doc[part], count))
        i = j
        yield from hits(records, unique[part], ends[part], low)


def hits(records: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Spans of the records begin[i] to end[i] of each text i where their document is later than low, the windows' earliest ones."""
    size = records["size"][begin]
    count = size - MINIMUM + 1
    at = np.cumsum(count) - count
    copies = end - begin
    text = np.repeat(np.arange(len(begin)), copies)
    record = np.repeat(begin - np.cumsum(copies) + copies, copies) + np.arange(len(text))
    for i in range(0, len(text), 50_000):
        t, r = text[i : i + 50_000], record[i : i + 50_000]
        n = count[t]
        which = np.repeat(np.arange(len(t)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        hit = low[at[t][which] + place] < records["doc"][r][which]
        which, place = which[hit], place[hit]
        if not len(which):
            continue
        new = np.concatenate([[True], (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1)])
        first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(which)) - 1
        owner = r[which[first]]
        yield records["node"][owner], records["start"][owner] + place[first], records["start"][owner] + place[last] + MINIMUM


def covered_spans(packed: DataFrame, buckets: int) -> DataFrame:
    def reduce(bucket: int, raw: bytes) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, SPAN)
        for node, start, end in covered(np.frombuffer(raw, RUN)):
            out = np.empty(len(node), SPAN)
            out["key"], out["start"], out["end"] = np.ascontiguousarray(node).view(np.uint64), start, end
            packer.add(out)
        yield from packer.flush()

    return by_bucket(packed, buckets, reduce, Packer.schema)


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal covered runs (start, end), in order."""
    spans = spans[np.argsort(spans["start"], kind="stable")]
    reach = np.maximum.accumulate(spans["end"])
    begin = np.concatenate([[True], spans["start"][1:] > reach[:-1]])
    return np.stack([spans["start"][begin], reach[np.concatenate([np.flatnonzero(begin)[1:], [len(spans)]]) - 1]], 1)


KEPT = "fetch bigint, node bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string"


def cut_out(docs: DataFrame, with_text: bool, clashing: np.ndarray) -> DataFrame:
    """docs (text, fetch, node, data: spans) -> KEPT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in KEPT.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for part, data, offsets in slices(batches):
            out, mine = [], nodes_of(part, data, offsets, clashing)
            for i, (fetch, node, raw) in enumerate(zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                text = data[offsets[i] : offsets[i + 1]]
                if mine[i] == node:
                    spans = merged(np.frombuffer(raw, SPAN))
                    edges = np.concatenate([[0], spans.ravel(), [len(text)]]).reshape(-1, 2)
                    kept = b"".join(text[a:b].tobytes() for a, b in edges)
                    out.append((fetch, node, int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.select("text", "fetch", "node", "data").mapInArrow(run, KEPT)


def suffix_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """documents -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept, sha]), one row each.

    A null text is empty; texts shorter than MINIMUM bytes lose nothing. A null doc_id counts as
    smaller than all others. Rows of one doc_id are one place: neither is earlier than the other.
    With with_text, `kept` holds the text that stays where some bytes go (characters cut in two go
    whole), null for a text that stays whole, and `sha` the SHA-256 of the whole text.
    """
    spark, buckets = docs.sparkSession, partitions(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at = F.coalesce("doc_id", F.lit(NO_ID))
    stored = store(profile(docs), "profile")
    sized, clashing = named(stored, stored.groupBy("node").agg((F.min("check") != F.max("check")).alias("apart")).where("apart"))
    classes = store(sized.where(F.col("n_bytes") >= MINIMUM).groupBy("node").agg(F.min(at).alias("fetch")), "classes")
    known = store(grouped(shared(anchors(docs, buckets, clashing), buckets), buckets, POSTING), "anchors")
    sweep(spark)
    texts = docs.withColumn("fetch", at)
    met = texts.join(known.join(classes, "node"), "fetch")
    spans = store(grouped(covered_spans(runs(met, buckets, clashing), buckets), buckets, SPAN), "spans")
    discard(known)
    sweep(spark)
    kept = cut_out(texts.join(spans.join(classes, "node"), "fetch"), with_text, clashing).dropDuplicates(["fetch", "node"])
    every = attach(sized.withColumn("at", at), "node", ["doc_id"], least=F.min("at")).join(kept.withColumnRenamed("fetch", "at"), ["at", "node"], "left")
    gone = F.coalesce((F.col("at") > F.col("least")) & (F.col("n_bytes") >= MINIMUM), F.lit(False))
    out = [
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        out += [F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept"), "sha"]
    return every.select(*out)
