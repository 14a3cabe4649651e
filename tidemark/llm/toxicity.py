"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length.

Folding lower-cases, undoes full-width forms, and maps homoglyphs and digits or signs inside words to
the letters they stand for, in one pass. The lexicon holds words and word beginnings (STEMS letters)
that labelled toxic texts have far more often than others, learned from at most SAMPLE labelled rows of
SAMPLE_BYTES of text; matches start at a word's start, and whole words end at its end. Phrases of two or
three words around a lexicon word that occur in texts labelled clean are exceptions and cancel their
match. The score is a logistic function of the summed weight, of that sum over the number of words and
of the heaviest match, fitted on the same rows. The model follows the sample, not the corpus; its size
is checked before it is broadcast.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import BEYOND, text_groups
from tidemark.llm.folding import sigmoid, training_rows

SAMPLE, SAMPLE_BYTES = 12_000, 200_000_000
#: Bytes of the model that are broadcast at most.
MODEL_BYTES = 100_000_000
STEMS = (4, 5, 6, 7)
#: A lexicon entry occurs in at least LEAST toxic texts and ODDS times as often there as in others.
LEAST, ODDS = 5, 12.0

# Cyrillic and Greek homoglyphs, then digits and signs that stand for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "χ": "x"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

WORD = re.compile(r"[^\W_]+(?:[@$][^\W_]+)*")
PLAIN = str.maketrans(HOMOGLYPHS | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | dict.fromkeys("\u200b\u200c\u200d\u2060\ufeff"))
LEET = str.maketrans(DIGITS)
#: A run of letters, digits and signs, and where one of the latter stands beside a letter.
MIXED = re.compile(r"(?:[^\W_]|[@$])+")
LEET_HINT = re.compile(r"[^\W\d_][0-9@$]|[0-9@$][^\W\d_]")


def unmixed(run: re.Match[str]) -> str:
    """A run with a letter and a digit or sign, all as letters; signs at its end stay."""
    core = run[0].rstrip("@$")
    return core.translate(LEET) + run[0][len(core) :] if LEET_HINT.search(core) else run[0]


def folded(text: str) -> str:
    """Lower case, homoglyphs and full-width forms as plain letters, digits inside words as letters."""
    text = text.lower()
    if BEYOND.search(text):
        text = text.translate(PLAIN)
    return MIXED.sub(unmixed, text) if LEET_HINT.search(text) else text


def learn(rows: list[tuple[str, int]]) -> dict[str, float]:
    """Entry -> weight; an entry is a stem, or a word and a full stop."""
    toxic, clean, size = Counter(), Counter(), Counter()
    for text, y in rows:
        words = set(WORD.findall(folded(text)))
        entries = {w + "." for w in words} | {w[:k] for w in words for k in STEMS if len(w) > k}
        (toxic if y else clean).update(entries)
        size[bool(y)] += 1
    odds = {}
    for entry, n in toxic.items():
        if n >= LEAST:
            ratio = (n + 0.5) / (size[True] + 1) / ((clean[entry] + 0.5) / (size[False] + 1))
            if ratio >= ODDS:
                odds[entry] = math.log(ratio)
    out: dict[str, float] = {}
    for entry in sorted(odds, key=lambda e: (len(e.rstrip(".")), e)):
        stem = entry.rstrip(".")
        covering = [out[stem[:k]] for k in STEMS if stem[:k] in out and stem[:k] != entry]
        if not covering or max(covering) < odds[entry] - 1.0:
            out[entry] = odds[entry]
    return out


@lru_cache(4)
def automaton(lexicon: tuple[tuple[str, float], ...]) -> ahocorasick.Automaton:
    trie = ahocorasick.Automaton()
    for entry, weight in lexicon:
        stem = entry.rstrip(".")
        old = trie.get(stem, None) or (len(stem), 0.0, 0.0)
        trie.add_word(stem, (old[0], old[1], weight) if entry.endswith(".") else (old[0], weight, old[2]))
    trie.make_automaton()
    return trie


def matches(text: str, trie: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end of word, weight) of the words that the lexicon knows, the heaviest entry of each; text is folded."""
    best: dict[int, tuple[int, int, float]] = {}
    if len(trie):
        for last, (size, stem, whole) in trie.iter(text):
            start = last - size + 1
            if start and text[start - 1].isalnum():
                continue
            end = last + 1
            ends = end == len(text) or not text[end].isalnum()
            weight = max(stem, whole if ends else 0.0)
            if weight > best.get(start, (0, 0, 0.0))[2]:
                while end < len(text) and text[end].isalnum():
                    end += 1
                best[start] = (start, end, weight)
    return [best[k] for k in sorted(best)]


def phrases(text: str, found: list[tuple[int, int, float]]) -> list[list[str]]:
    """For each match its word with its neighbours: before, after, both."""
    spans = [m.span() for m in WORD.finditer(text)] if found else []
    starts = [a for a, _ in spans]
    out = []
    for start, end, _ in found:
        i, j = bisect_left(starts, start) - 1, bisect_left(starts, end)
        before = [text[spans[i][0] : spans[i][1]]] if i >= 0 else []
        after = [text[spans[j][0] : spans[j][1]]] if j < len(spans) else []
        word = text[start:end]
        out.append([" ".join(p) for p in ([*before, word], [word, *after], [*before, word, *after]) if len(p) > 1])
    return out


def measure(text: str, trie: ahocorasick.Automaton, exceptions: frozenset[str]) -> tuple[float, float, float]:
    """(summed weight, weight per hundred words, both as logarithms; heaviest) after exceptions."""
    text = folded(text)
    found = matches(text, trie)
    if found and exceptions:
        found = [m for m, around in zip(found, phrases(text, found), strict=True) if not any(p in exceptions for p in around)]
    total = sum(m[2] for m in found)
    words = text.count(" ") + text.count("\n") + 1
    return math.log1p(total), math.log1p(100.0 * total / (words + 10)), max((m[2] for m in found), default=0.0)


def fit(rows: list[tuple[str, int]]) -> tuple[tuple, frozenset, np.ndarray]:
    """(lexicon, exceptions, coefficients of the three measures and the bias)."""
    lexicon = tuple(sorted(learn(rows).items()))
    trie = automaton(lexicon)
    excepted, against = Counter(), Counter()
    for text, y in rows:
        plain = folded(text)
        for around in phrases(plain, matches(plain, trie)):
            (against if y else excepted).update(around)
    exceptions = frozenset(p for p, n in excepted.items() if n >= 2 and against[p] == 0)
    x = np.array([[*measure(t, trie, exceptions), 1.0] for t, _ in rows]).reshape(-1, 4)
    y = np.array([float(bool(v)) for _, v in rows])
    w = np.zeros(4)
    for _ in range(60 if len(rows) else 0):  # Newton steps of ridge logistic regression
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4), x.T @ (p - y) + 0.05 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return lexicon, exceptions, w


def train(docs: DataFrame, labels: DataFrame, held: str) -> tuple[tuple, frozenset, np.ndarray]:
    """Fit on at most SAMPLE labelled rows, in one task; a model of bounded size comes back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t or "", y) for batch in batches for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        model = pickle.dumps(fit(rows))
        if len(model) > MODEL_BYTES:
            raise ValueError(f"the lexicon and its exceptions take {len(model)} bytes; raise LEAST or ODDS, or lower SAMPLE")
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    rows = training_rows(docs, labels, "toxic", held, SAMPLE, SAMPLE_BYTES)
    got = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "y").mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0].model) if got else fit([])


def toxicity_scores(docs: DataFrame, labels: DataFrame, held: str, threshold: float = 0.3, whole: bool = False) -> DataFrame:
    """documents -> (doc_id, held_out, score, predicted, matched weight), one row each; if `whole`, also `row`, a struct of all columns.

    `held` is SQL that tells from doc_id whether a label may not be learned. A null or empty text matches nothing.
    Without labels nothing matches and every score is 0.5 at most. A null doc_id is not held out. Repeated
    rows are scored alike; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, held))
    names = ["doc_id", "score", "weight", *(["row"] if whole else [])]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, exceptions, w = model.value
        trie = automaton(lexicon)
        for batch in batches:
            for begin, texts in text_groups(batch, 1):
                x = np.array([[*measure(t, trie, exceptions), 1.0] for t in texts])
                kept = [batch.column(2).slice(begin, len(texts))] if whole else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(sigmoid(x @ w)), pa.array(x[:, 0]), *kept], names=names)

    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row)
    schema = "doc_id bigint, score double, weight double" + (f", row {rows.schema['row'].dataType.simpleString()}" if whole else "")
    scored = rows.mapInArrow(score, schema)
    return scored.select("doc_id", F.coalesce(F.expr(held), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "weight", *names[3:])
