"""Line dedup: one line of each group of nearly equal lines stays in the corpus, in its first place.

Lines are split at newlines and compared without outer white space; blank lines stay. Equal lines
are one node, told by a 128-bit digest. A line's set holds its SHINGLE-byte strings, as numbers (a
shorter line is one). Signatures are one-permutation MinHash over BINS bins, each empty bin filled
from the first full one of an order of its own; BANDS bands of ROWS bins find a pair of Jaccard 0.8
with probability 0.999. Bands are so many rows long that lines of common syllables, which share many
short shingles, rarely share a band. Lines that share one are a group, whose pairs are verified by
exact Jaccard in size-banded tiles (see candidates), and the verified links are joined by distributed
union-find.

A line's places are reduced where they are read: of the places of one line in a task's chunk all but
the first are known to go and never leave it, so a line that a third of all texts hold sends one
place per chunk. Groups then meet with one place for each of their different lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.candidates import POSTING, verified
from tidemark.llm.frames import Packer, by_bucket, discard, free, likely, named, partitions, slices, store, sweep
from tidemark.llm.graph import attach, components

SHINGLE, BINS, BANDS, ROWS, PERCENT = 5, 144, 24, 6, 80
#: DONORS[i]: the bins in the order in which they fill bin i where it is empty.
DONORS = np.argsort(W.mix(np.arange(BINS * BINS, dtype=np.uint64)).reshape(BINS, BINS), axis=1)
NO_ID = -(1 << 63)
SIGNED = 64_000
BLOCK = 4096
#: Shingles of a line that are hashed at once.
SEGMENT = 1 << 16
PLACE = np.dtype([("key", "<u8"), ("check", "<i8"), ("at", "<i8"), ("h", "<i8"), ("line", "<i4"), ("n", "<i4")])
FOUND = "kind int, bucket int, node bigint, check bigint, at bigint, h bigint, line int, n int, data binary"
KINDS = dict(zip((x.split(" ")[0] for x in FOUND.split(", ")), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True))


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number in its text, start, end) of each line that isn't blank, without outer white space."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 4
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    row = np.searchsorted(offsets, begin, "right") - 1
    first = np.concatenate([[True], row[1:] != row[:-1]])
    number = np.arange(len(begin)) - np.maximum.accumulate(np.where(first, np.arange(len(begin)), 0))
    solid = np.flatnonzero(~W.SPACE[data])
    low = np.searchsorted(solid, begin)
    high = np.searchsorted(solid, np.concatenate([begin[1:], [len(data)]]))
    full = high > low
    return row[full], number[full], solid[low[full]], solid[high[full] - 1] + 1


def line_digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    return W.digests([raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])


def shingle_sets(lines: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingles of each line; lines are taken together as long as they are short."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(lines):
        j, held = i, 0
        while j < len(lines) and (j == i or held + len(lines[j]) <= SEGMENT):
            held += len(lines[j])
            j += 1
        data = np.frombuffer(b"".join(lines[i:j]), np.uint8)
        length = np.array([len(x) for x in lines[i:j]])
        size = np.minimum(SHINGLE, length)
        key = W.chunks(data)[:-1] & np.repeat(W.LOW_BYTES[size], length) | np.repeat(size.astype(np.uint64) << W.U(56), length)
        key, end = W.mix(key), np.cumsum(length)
        out += [W.distinct(key[a:b]) for a, b in zip((end - length).tolist(), (end - size + 1).tolist(), strict=True)]
        i = j
    return out


def signatures(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(lines, BINS) least shingle hashes, empty bins filled."""
    eight, none = W.chunks(data), np.iinfo(np.uint64).max
    size = np.minimum(SHINGLE, end - start)
    count = end - start - size + 1
    out = np.full(len(start) * BINS, none, np.uint64)
    upto, i = np.cumsum(count), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] - count[i] + SEGMENT, "right")))
        for piece in range(0, int(count[i]) if j == i + 1 else 1, SEGMENT):  # a long line on its own, piece by piece
            n = np.minimum(count[i:j] - piece, SEGMENT) if j == i + 1 else count[i:j]
            at = np.repeat(start[i:j] + piece - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            mask, length = W.LOW_BYTES[size[i:j]], size[i:j].astype(np.uint64) << W.U(56)
            whole = size[i:j].min() == SHINGLE
            key = W.mix(eight[at] & mask[0] | length[0] if whole else eight[at] & np.repeat(mask, n) | np.repeat(length, n))
            cell = np.repeat(np.arange(i, j) * BINS, n) + ((key >> W.U(32)) * W.U(BINS) >> W.U(32)).astype(np.int64)
            np.minimum.at(out, cell, key)
        i = j
    empty = np.flatnonzero(out == none)
    full = out.copy()
    for turn in range(BINS):
        if not len(empty):
            break
        row, cell = np.divmod(empty, BINS)
        out[empty] = full[row * BINS + DONORS[cell, turn]]
        empty = empty[out[empty] == none]
    return out.reshape(-1, BINS)


def found_rows(kind: int, **columns: np.ndarray | list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)) if c == "kind" else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in KINDS.items()], names=list(KINDS))


def reduced(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each line, its later places) of PLACE records; equal places are one."""
    records = records[np.lexsort((records["line"], records["h"], records["at"], records["check"], records["key"]))]
    begin = np.ones(len(records), bool)
    begin[1:] = (records["key"][1:] != records["key"][:-1]) | (records["check"][1:] != records["check"][:-1])
    first = records[begin]
    owner = first[np.cumsum(begin) - 1]
    later = (records["at"] != owner["at"]) | (records["h"] != owner["h"]) | (records["line"] != owner["line"])
    return first, records[later]


def going(records: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of kind 2, one per text: the numbers of lines that go."""
    if not len(records):
        return
    records = records[np.lexsort((records["line"], records["h"], records["at"]))]
    begin = np.flatnonzero(np.concatenate([[True], (records["at"][1:] != records["at"][:-1]) | (records["h"][1:] != records["h"][:-1])]))
    end = np.append(begin[1:], len(records))
    for i in range(0, len(begin), 5000):
        a, b = begin[i : i + 5000], end[i : i + 5000]
        yield found_rows(2, at=records["at"][a], h=records["h"][a], data=[records["line"][x:y].tobytes() for x, y in zip(a, b, strict=True)])


def places(docs: DataFrame, buckets: int) -> DataFrame:
    """FOUND rows of kind 0 (packed first places of a chunk's lines, by bucket) and kind 2 (places that go)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets, PLACE)

        def flush() -> Iterator[pa.RecordBatch]:
            if packer.size:
                first, later = reduced(np.concatenate(packer.parts))
                packer.parts, packer.size = [first], first.nbytes
                for batch in packer.flush():
                    yield found_rows(0, bucket=batch.column(0).to_numpy(), data=batch.column(1).to_pylist())
                yield from going(later)

        for part, data, offsets in slices(batches):
            row, number, start, end = lines(data, offsets)
            halves = line_digests(data, start, end)
            records = np.empty(len(row), PLACE)
            records["key"], records["check"] = halves[:, 0].view(np.uint64), halves[:, 1]
            records["at"], records["h"] = (part.column(i).to_numpy()[row] for i in (1, 2))
            records["line"], records["n"] = number, np.minimum(end - start, np.iinfo(np.int32).max)
            packer.add(records)
            if packer.full():
                yield from flush()
        yield from flush()

    return docs.select("text", "at", "h").mapInArrow(run, FOUND)


def first_places(packed: DataFrame, buckets: int) -> DataFrame:
    """Packed places -> FOUND rows of kind 1 (a line with its first place), 2 (places that go) and 3 (names that two lines share)."""

    def reduce(bucket: int, raw: bytes) -> Iterator[pa.RecordBatch]:
        first, later = reduced(np.frombuffer(raw, PLACE))
        shared = first["key"][1:][first["key"][1:] == first["key"][:-1]].view(np.int64)
        if len(shared):
            yield found_rows(3, node=np.unique(shared))
        for i in range(0, len(first), 50_000):
            part = first[i : i + 50_000]
            yield found_rows(1, node=part["key"].view(np.int64), **{c: part[c] for c in ("check", "at", "h", "line", "n")})
        yield from going(later)

    return by_bucket(packed, buckets, reduce, FOUND)


def bands(docs: DataFrame, buckets: int, clashing: np.ndarray) -> DataFrame:
    """Packed (band value, node) of each line; lines seen lately in a task are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = Packer(buckets, POSTING), set()
        for _, data, offsets in slices(batches):
            _, _, start, end = lines(data, offsets)
            if not len(start):
                continue
            node = W.names(line_digests(data, start, end), clashing)
            fresh = np.array([x not in seen for x in node.tolist()])
            seen.update(node[fresh].tolist())
            _, once = np.unique(node, return_index=True)
            fresh &= np.isin(np.arange(len(node)), once)
            start, end, node = start[fresh], end[fresh], node[fresh]
            for i in range(0, len(node), BLOCK):
                sign = signatures(data, start[i : i + BLOCK], end[i : i + BLOCK])
                records = np.empty((len(sign), BANDS), POSTING)
                mixed = (sign.reshape(-1, BANDS, ROWS) * W.powers(ROWS + 1)[1:]).sum(2, dtype=np.uint64)
                records["key"], records["node"] = W.mix(mixed + np.arange(1, BANDS + 1, dtype=np.uint64)), node[i : i + BLOCK, None]
                packer.add(records.reshape(-1))
                if packer.full():
                    yield from packer.flush()
            if len(seen) > SIGNED:
                seen.clear()
        yield from packer.flush()

    return docs.select("text").mapInArrow(run, Packer.schema)


def wanted_lines(docs: DataFrame) -> DataFrame:
    """docs (text, wanted: array<struct<line, node, tile>>) -> (node, tile, data: the line's bytes), a line about once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part, data, offsets in slices(batches):
            row, number, start, end = lines(data, offsets)
            raw, cut, rows = data.tobytes(), np.searchsorted(row, np.arange(part.num_rows + 1)), []
            for i, wanted in enumerate(part.column(1).to_pylist()):
                place = dict(zip(number[cut[i] : cut[i + 1]].tolist(), range(cut[i], cut[i + 1]), strict=True))
                for w in wanted:
                    if w["node"] not in seen and (k := place.get(w["line"])) is not None:
                        seen.add(w["node"])
                        rows.append((w["node"], w["tile"], raw[start[k] : end[k]]))
            if len(seen) > SIGNED:
                seen.clear()
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 2000], strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["node", "tile", "data"])

    return docs.select("text", "wanted").mapInArrow(run, "node bigint, tile bigint, data binary")


def unpacked(found: DataFrame) -> DataFrame:
    """FOUND rows of kind 2 -> (at, h, gone: numbers of lines); a text has one row per task that saw it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], names=["at", "h", "gone"])

    return found.where("kind = 2").select("at", "h", "data").mapInArrow(run, "at bigint, h bigint, gone array<int>")


def without(text: str, gone: set[int]) -> str:
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def line_dedup(docs: DataFrame, report: tuple[str, str, str] = ("_lines", "_removed", "_sha256")) -> DataFrame:
    """docs with their columns, text without the removed lines, and the counts of lines and of removed lines, and the SHA-256 of the text.

    `report` names these three; a name that docs have already gets a mark at its end. The first place of
    a group of lines is the least by doc_id (null first), then a hash of the whole text, then line
    number. A document stays even where all its lines go. Null text stays null. Rows equal in doc_id and
    text are one place, and keep the same lines. An empty table gives no rows.
    """
    spark, buckets = docs.sparkSession, partitions(docs)
    taken = list(docs.columns)
    at, h, lost = (taken.append(x) or x for x in (free(taken, "_at"), free(taken, "_h"), free(taken, "_gone")))
    added = []
    for name in report:
        added.append(free([*docs.columns, *added], name))
    keyed = docs.withColumn(at, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(h, F.xxhash64(F.coalesce("text", F.lit(""))))
    plain = keyed.select(F.col("text").cast("string").alias("text"), F.col(at).alias("at"), F.col(h).alias("h"))
    local = store(places(plain, buckets), "places")
    met = store(first_places(local.where("kind = 0").select("bucket", "data"), buckets), "lines")
    firsts = met.where("kind = 1").select("node", "check", "at", "h", "line", "n")
    nodes, clashing = named(firsts, met.where("kind = 3").select("node"))

    def fetch(known: DataFrame) -> DataFrame:
        wanted = known.groupBy("at", "h").agg(F.collect_list(F.struct("line", "node", "tile")).alias("wanted"))
        return wanted_lines(likely(plain, known.select("at", "h"), ["at", "h"]).join(wanted, ["at", "h"]))

    links, known = verified(bands(plain, buckets, clashing), nodes.drop("check"), fetch, buckets, PERCENT, shingle_sets)
    joined = components(links)
    discard(links)
    sweep(spark)
    place = F.struct("at", "h", "line")
    grouped = attach(joined.withColumnRenamed("component", "root").join(known.select("node", "at", "h", "line"), "node"), "root", ["node"], first=F.min(place))
    near = grouped.where(place != F.col("first")).select("at", "h", F.array("line").alias("gone"))
    every = unpacked(local).unionByName(unpacked(met)).unionByName(near)
    gone = store(every.groupBy(F.col("at").alias(at), F.col("h").alias(h)).agg(F.flatten(F.collect_list("gone")).alias(lost)), "gone")
    for step in (local, met, joined, known):
        discard(step)
    sweep(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index("text")
            texts, count, removed, sha = [], [], [], []
            for text, numbers in zip(batch.column(where), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                text, numbers = text.as_py(), set(numbers or ())
                count.append(text.count("\n") + 1 if text else 0)
                removed.append(len(numbers))
                texts.append(without(text, numbers) if numbers else text)
                sha.append(hashlib.sha256((texts[-1] or "").encode("utf-8", "surrogatepass")).hexdigest())
            columns = [pa.array(texts, pa.string()) if i == where else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=[*batch.schema.names[:-1], *added])

    texts = docs.withColumn("text", F.col("text").cast("string"))
    schema = texts.withColumns(dict(zip(added, (F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit("")), strict=True))).schema
    rest = keyed.withColumn("text", F.col("text").cast("string")).join(gone, [at, h], "left").select(*docs.columns, lost)
    return rest.mapInArrow(cut, schema)
