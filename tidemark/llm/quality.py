"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal updates.

Features are the words and word pairs of the whole text, as written (case kept), hashed into
2**BITS slots, and a few slots for the shape of words (upper case, marks at the end, repetition of
the word before). A slot's value is its share of the text's n-grams, scaled, so length doesn't
count. Training reads at most SAMPLE labelled rows of SAMPLE_BYTES of text, each once an epoch, in
one task; scoring is a sparse dot product of every text with the weights (2**BITS floats, 1 MB).
Texts longer than SEGMENT bytes are taken apart that much at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words as W
from tidemark.llm.folding import sigmoid, training_rows
from tidemark.llm.frames import slices

BITS = 18
SAMPLE, SAMPLE_BYTES = 12_000, 200_000_000
SEGMENT = 2_000_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
SCALE = 24.0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, row, value) of the n-grams of each text, not merged."""
    n = len(offsets) - 1
    if n > 1 or len(data) <= SEGMENT:
        slot, row, value, count, _ = raw_features(data, offsets, False)
    else:  # one long text: each part but the first begins with the last word of the one before, which isn't counted again
        found, begin = [], 0
        for a, b in W.segments(data, SEGMENT):
            found.append(raw_features(data[begin:b], np.array([0, b - begin]), begin < a))
            begin = begin + found[-1][4] if found[-1][4] >= 0 else begin
        part = [merged(f[0], f[2]) for f in found]
        slot, value = (np.concatenate(x) for x in zip(*part, strict=True))
        row, count = np.zeros(len(slot), np.int64), sum(f[3] for f in found)
    return slot, row, value / np.maximum(count[row], 1) * SCALE


def raw_features(data: np.ndarray, offsets: np.ndarray, seen: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(slot, row, number, words of each text, start of the last word or -1); if `seen`, the first word counts only as a neighbour."""
    word, row, start, end = W.words(data, offsets, lower=False)
    n = len(offsets) - 1
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(n, np.int64), -1
    pair = W.mix(word[:-1] * W.U(3) + word[1:])
    inner = np.flatnonzero(row[1:] == row[:-1])
    first, last = data[start], data[end - 1]
    upper = (first >= 65) & (first <= 90)
    capital = upper & (data[np.minimum(start + 1, end - 1)] >= 65) & (data[np.minimum(start + 1, end - 1)] <= 90)
    before = data[np.maximum(end - 2, start)]
    letter = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128)
    twice = ~letter & (before == last)
    repeat = np.zeros(len(word), bool)
    repeat[inner + 1] = word[inner] == word[inner + 1]
    shape = (last.astype(np.uint64) << W.U(8)) * (~letter) + (capital + 2 * twice + 4 * repeat + 8 * (end - start == 1)).astype(np.uint64)
    low = W.U((1 << BITS) - 1)
    new = slice(int(seen), None)
    slot = np.concatenate([(word & low)[new], pair[inner] & low, (W.mix(shape + W.U(77)) & low)[new]]).astype(np.int64)
    owner = np.concatenate([row[new], row[inner], row[new]])
    value = np.concatenate([np.full(len(word[new]), 1.0), np.full(len(inner), 1.0), np.full(len(word[new]), 4.0)])
    return slot, owner, value, np.bincount(row[new], minlength=n), int(start[-1])


def merged(slot: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slots, index = np.unique(slot, return_inverse=True)
    return slots, np.bincount(index, value)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """FTRL-proximal, one example at a time; (weights, bias)."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    rng = np.random.default_rng(7)

    def weight(at: np.ndarray) -> np.ndarray:
        far = np.abs(z[at]) > L1
        return np.where(far, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            at, x, y = examples[k]
            at, x = np.append(at, size - 1), np.append(x, 1.0)
            w = weight(at)
            g = (sigmoid(w @ x) - y) * x
            root = np.sqrt(n[at] + g * g)
            z[at] += g - (root - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    every = weight(np.arange(size))
    return every[:-1].astype(np.float32), float(every[-1])


def fit(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Train on rows (doc_id, text, y); the examples' features are made in parallel, the model in one task."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            slot, owner, value = features(data, offsets)
            out = [merged(slot[owner == i], value[owner == i]) for i in range(part.num_rows)] if part.num_rows < 4 else split(slot, owner, value, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([s.astype(np.int32).tobytes() for s, _ in out], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in out], pa.binary())], names=["doc_id", "y", "slots", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            for y, s, v in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                examples.append((np.frombuffer(s, np.int32), np.frombuffer(v, np.float32), y))
        if examples:
            weights, bias = train(examples)
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    found = rows.select("doc_id", "text", "y").mapInArrow(extract, "doc_id bigint, y int, slots binary, x binary")
    model = found.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "y").mapInArrow(learn, "weights binary, bias double").collect()
    return (np.frombuffer(model[0].weights, np.float32), model[0].bias) if model else (np.zeros(1 << BITS, np.float32), 0.0)


def split(slot: np.ndarray, owner: np.ndarray, value: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    key, index = np.unique(owner * (1 << BITS) + slot, return_inverse=True)
    total = np.bincount(index, value) if len(key) else np.zeros(0)
    cut = np.searchsorted(key >> BITS, np.arange(n + 1))
    return [(key[cut[i] : cut[i + 1]] & ((1 << BITS) - 1), total[cut[i] : cut[i + 1]]) for i in range(n)]


def quality_scores(docs: DataFrame, labels: DataFrame, held: str, threshold: float = 0.3) -> DataFrame:
    """documents -> (doc_id, held_out, score, predicted), one row each.

    `held` is SQL that tells from doc_id whether a label may not be learned. A null or empty text has the score of
    the bias alone. Without a usable label every score is 0.5. A null doc_id is not held out. Repeated rows
    are scored alike; other columns are ignored; an empty table gives no rows.
    """
    weights, bias = fit(training_rows(docs, labels, "quality", held, SAMPLE, SAMPLE_BYTES))
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, base = model.value
        for part, data, offsets in slices(batches):
            slot, owner, value = features(data, offsets)
            total = np.bincount(owner, weight[slot] * value, minlength=part.num_rows) if len(slot) else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigmoid(total + base))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(F.expr(held), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
