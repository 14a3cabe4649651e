"""Document fingerprints from prefix polynomial hashes.

The prefix array H[i] = sum of c[j] * B**j over j < i, modulo the prime 2**31 - 1, answers whether any
two spans are equal, and a binary search over it finds the longest common extension of two places.
A fingerprint holds a 62-bit hash of the whole text and, for each of BINS parts of the hash space,
the least hash of the text's spans of SPAN code points there; likeness is the share of parts that
agree, an estimate of the Jaccard similarity of the two texts' spans.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import partitions
from tidemark.llm.words import mix

PRIME = np.uint64((1 << 31) - 1)
SHIFT = np.uint64(31)
FIRST, SECOND = 911_382_323, 972_663_749
SPAN, BINS = 8, 64
NONE = 0xFFFF
_powers: dict[tuple[int, bool], np.ndarray] = {}


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x below 2**63."""
    x = (x & PRIME) + (x >> SHIFT)
    x = (x & PRIME) + (x >> SHIFT)
    return np.where(x >= PRIME, x - PRIME, x)


def powers(n: int, base: int, inverse: bool = False) -> np.ndarray:
    have = _powers.get((base, inverse), np.ones(1, np.uint64))
    prime = int(PRIME)
    unit = pow(base, -1, prime) if inverse else base
    while len(have) < n:
        have = np.concatenate([have, reduced(have * np.uint64(pow(unit, len(have), prime)))])
    _powers[base, inverse] = have
    return have[:n]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


class PrefixHashes:
    """Span hashes of one text."""

    def __init__(self, points: np.ndarray, base: int = FIRST, before: np.ndarray | None = None):
        """before: the prefix array of a text that these points go on from."""
        start = 0 if before is None else len(before) - 1
        terms = reduced(points * powers(start + len(points), base)[start:])
        self.base = base
        sums = np.cumsum(terms, dtype=np.uint64)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), reduced(sums)]) if before is None else np.concatenate([before, reduced(sums + before[-1])])

    def __len__(self) -> int:
        return len(self.prefix) - 1

    def spans(self, start: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the spans of `size` points from each start; equal spans have equal hashes."""
        gap = reduced(self.prefix[start + size] + PRIME - self.prefix[start])
        return reduced(gap * powers(len(self.prefix), self.base, inverse=True)[start])

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), end - start)[0])

    def common(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest common extension of place i here and place j there."""
        low, high = 0, min(len(self) - i, len(other) - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(i, i + middle) == other.span(j, j + middle):
                low = middle
            else:
                high = middle - 1
        return low


def least(keys: np.ndarray) -> np.ndarray:
    """The least 52 bits of the hashes in each bin; all ones where there is none."""
    out = np.full(BINS, (1 << 52) - 1, np.uint64)
    if len(keys):
        keys = mix(keys + np.uint64(0x51AFD7ED))
        np.minimum.at(out, (keys >> np.uint64(58)).astype(np.int64), keys & np.uint64((1 << 52) - 1))
    return out


def windows(hashes: PrefixHashes, start: int, end: int) -> np.ndarray:
    """Keys of the spans that start in [start, end); a shorter text is one span."""
    end = min(end, len(hashes) - SPAN + 1)
    return hashes.spans(np.arange(start, end), SPAN) if end > start else np.zeros(0, np.uint64)


def digest(hashes: PrefixHashes, second: int, bins: np.ndarray) -> str:
    if len(hashes) < SPAN:
        bins = least(np.array([hashes.prefix[-1] + np.uint64(len(hashes))], np.uint64)) if len(hashes) else bins
    empty = bins == np.uint64((1 << 52) - 1)
    short = np.where(empty, NONE, (bins & np.uint64(0xFFFF)) % np.uint64(NONE))
    whole = (int(hashes.prefix[-1]) << 31) | second
    return f"{whole:016x}{len(hashes):08x}" + short.astype(">u2").tobytes().hex()


def total(points: np.ndarray, start: int = 0) -> int:
    """Hash of the whole text by the second base."""
    return int(reduced(points * powers(start + len(points), SECOND)[start:]).sum() % PRIME) if len(points) else 0


def likeness(a: str, b: str) -> float:
    """Share of the bins filled by either text that agree; 1 for equal texts, two empty ones among them."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[24:]), ">u2") for s in (a, b))
    filled = (x != NONE) | (y != NONE)
    return float(((x == y) & filled).sum() / max(1, filled.sum()))


class Document:
    """A text with its prefix hashes and what an edit of its last quarter keeps."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.points = doc_id, text, codes(text)
        n = len(self.points)
        self.kept = n - n // 4
        self.hashes = PrefixHashes(self.points)
        self.cut = max(0, self.kept - SPAN + 1)
        self.head = least(windows(self.hashes, 0, self.cut))
        self.second = total(self.points[: self.kept])
        self.fingerprint = digest(self.hashes, (self.second + total(self.points[self.kept :], self.kept)) % int(PRIME), np.minimum(self.head, least(windows(self.hashes, self.cut, n))))

    def edited(self, following: Document) -> tuple[str, str, int]:
        """(edited text, its fingerprint, code points it has in common with the text from the start)."""
        size = len(self.points) // 4
        text = self.text[: self.kept] + following.text[:size]
        tail = following.points[:size]
        hashes = PrefixHashes(tail, before=self.hashes.prefix[: self.kept + 1])
        bins = np.minimum(self.head, least(windows(hashes, self.cut, len(hashes))))
        return text, digest(hashes, (self.second + total(tail, self.kept)) % int(PRIME), bins), self.hashes.common(0, hashes, 0)


def ranged(rows: DataFrame, quantiles: list[float]) -> tuple[DataFrame, int]:
    """rows (doc_id, text, at, tie, place) with `range`, the number of their part of the order by (at, tie), and how many there are.

    The quantiles of place part the ranges. One that comes up m times holds about m shares of the rows: it
    is a range of its own, parted into m by tie, so ids that very many rows share are not one task's.
    """
    times = Counter(quantiles)
    cuts = sorted({c for v, m in times.items() for c in ((v, math.nextafter(v, math.inf)) if m > 1 else (v,))})
    if not cuts:
        return rows.withColumn("range", F.lit(0)), 1
    parts = [1] + [times.get(c, 1) for c in cuts]  # of the range below the first cut, then of those from each cut on
    begin = [0, *accumulate(parts)]
    cut = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="place", outputCol="cut").transform(rows)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cut").cast("int") + 1)
    share = F.floor((F.col("tie") / 2.0**64 + 0.5) * pick(parts))
    number = pick(begin[:-1]) + F.least(F.greatest(share, F.lit(0)), pick(parts) - 1)
    return cut.select("doc_id", "text", "at", "tie", number.cast("int").alias("range")), begin[-1]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix bigint"


def fingerprints(docs: DataFrame) -> DataFrame:
    """documents -> one row each: see RESULT; the next document is that of the next larger doc_id.

    Null text is empty. Rows are ordered by doc_id (null first), rows of one id by a hash of their
    text; the row after the last is the first, which for a single row is itself. Rows are dealt by
    ranges of that order; the first row of each range (one a range) is also sent to the range before.
    Rows equal in id and text are in one range. A text takes some 60 bytes a code point while it is worked on.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("tie", F.xxhash64("text"))
    count = partitions(docs)
    place = rows.withColumn("place", F.col("at").cast("double"))
    quantiles = place.approxQuantile("place", [i / count for i in range(1, count)], 0.25 / count) if count > 1 else []
    rows, count = ranged(place, quantiles)
    heads = sorted((r.range, r.head.at, r.head.tie) for r in rows.groupBy("range").agg(F.min(F.struct("at", "tie")).alias("head")).collect())
    before = spark.createDataFrame([(at, tie, heads[i - 1][0]) for i, (_, at, tie) in enumerate(heads)], "at long, tie long, target int")
    sent = rows.join(F.broadcast(before), ["at", "tie"], "left")
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("guard"))
    guard = F.struct(F.col("target").alias("range"), F.lit(1).alias("guard"))
    sent = sent.select("doc_id", "text", "at", "tie", F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, guard))).alias("to"))
    sent = sent.select("doc_id", "text", "at", "tie", F.col("to.range").alias("range"), F.col("to.guard").alias("guard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, last, closed, out = None, None, False, []
        names = [x.split(" ")[0] for x in RESULT.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for doc_id, text, where, is_guard in zip(columns["doc_id"].to_pylist(), columns["text"], columns["range"].to_pylist(), columns["guard"].to_pylist(), strict=True):
                if where != place:
                    place, last, closed = where, None, False
                if closed:
                    continue
                document = Document(doc_id, text.as_py())
                if last is not None:
                    edited, print_, common = last.edited(document)
                    out.append((last.doc_id, len(last.points), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), last.fingerprint, print_, likeness(last.fingerprint, print_), likeness(last.fingerprint, document.fingerprint), common))
                last, closed = document, bool(is_guard)
                if len(out) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return sent.repartitionById(count, F.col("range")).sortWithinPartitions("range", "guard", "at", "tie").drop("at", "tie").mapInArrow(run, RESULT)
