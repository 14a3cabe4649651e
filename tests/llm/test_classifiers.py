import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality as Q
from tidemark.llm import toxicity as T
from tidemark.llm.folding import fold, training_rows
from tidemark.llm.queries import QUERIES
from tidemark.llm.quality import quality_scores

DIR = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("name", "label", "least"), [("op2_quality_classifier", "quality", 0.98), ("op6_toxicity", "toxic", 0.96)])
def test_held_out_accuracy(spark, name, label, least):
    got = QUERIES[name](spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least


def test_folding():
    assert T.folded("1D1OT ｉｄｉｏｔ іdіоt id​iot h3llo 2024 $cum 3 5th") == "idiot idiot idiot idiot hello 2024 scum 3 sth"


def test_exceptions_cancel():
    rows = [(f"you are a scumbag number {i} of this town", 1) for i in range(30)] + [(f"the blue scumbag fish swims at reef {i}", 0) for i in range(3)] + [(f"all is well on day {i} of this town", 0) for i in range(200)]
    lexicon, exceptions, w = T.fit(rows)
    trie = T.automaton(lexicon)
    assert any(e.startswith("scum") for e, _ in lexicon) and "blue scumbag" in exceptions
    assert T.measure("the blue scumbag fish", trie, exceptions)[0] == 0 < T.measure("what a 5cumbag", trie, exceptions)[0]


@pytest.mark.parametrize("scores", [quality_scores, T.toxicity_scores])
def test_odd_rows(spark, scores):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, ("bad worse" if i % 2 else "good fine") + f" {i}", "x", 1.0) for i in range(40)] + [(90, None, "", 0.0), (91, "", "", 0.0), (None, "bad", "", 0.0), (92, "w " * 50_000, "", 0.0), (92, "w", "", 0.0)], "doc_id long, text string, y string, score double")
    got = scores(docs, labels, fold(5, 0)).collect()
    assert len(got) == 45 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out is not None for r in got)
    assert scores(docs.limit(0), labels, fold(5, 0)).count() == 0
    assert scores(docs, labels.limit(0), fold(5, 0)).count() == 45


def plain_fold(text):
    """Character by character, run by run."""
    text = "".join(T.HOMOGLYPHS.get(c, chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else "" if c in "\u200b\u200c\u200d\u2060\ufeff" else c) for c in text.lower())
    out, run = [], ""
    for c in text + "\n":
        if c.isalnum() or c in "@$":
            run += c
            continue
        core = run.rstrip("@$")
        mixed = any((a.isalpha() and b in "0123456789@$") or (b.isalpha() and a in "0123456789@$") for a, b in zip(core, core[1:], strict=False))
        out.append(("".join(T.DIGITS.get(x, x) for x in core) if mixed else core) + run[len(core) :] + c)
        run = ""
    return "".join(out)[:-1]


def plain_score(text, lexicon, exceptions, w):
    """Each entry tried at each word's start."""
    text = plain_fold(text)
    starts = [i for i, c in enumerate(text) if c.isalnum() and (i == 0 or not text[i - 1].isalnum())]
    ends = [next((j for j in range(i, len(text)) if not text[j].isalnum()), len(text)) for i in starts]
    total, top = 0.0, 0.0
    for k, (start, end) in enumerate(zip(starts, ends, strict=True)):
        best = max((x for e, x in lexicon if text.startswith(e.rstrip("."), start) and (not e.endswith(".") or start + len(e) - 1 == end)), default=0.0)
        if not best:
            continue
        word = text[start:end]
        before, after = [text[starts[k - 1] : ends[k - 1]]] if k else [], [text[starts[k + 1] : ends[k + 1]]] if k + 1 < len(starts) else []
        around = [" ".join(p) for p in ([*before, word], [word, *after], [*before, word, *after]) if len(p) > 1]
        if not any(p in exceptions for p in around):
            total, top = total + best, max(top, best)
    words = text.count(" ") + text.count("\n") + 1
    x = np.array([math.log1p(total), math.log1p(100 * total / (words + 10)), top, 1.0])
    return 1 / (1 + math.exp(-float(x @ w)))


def test_toxicity_against_a_plain_matcher(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = fold(4, 2)
    model = T.train(docs, labels, held)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    matched = 0
    for r in T.toxicity_scores(docs, labels, held).collect():
        if len(texts[r.doc_id]) < 3000:
            assert abs(r.score - plain_score(texts[r.doc_id], *model)) < 1e-9
            matched += r.weight > 0
    assert matched > 5


def test_folding_is_linear():
    began = time.time()
    assert T.folded("a" * 1_000_000 + " h3llo").endswith(" hello") and T.folded("a1" * 500_000)[:4] == "aiai"
    assert time.time() - began < 5


def test_one_row_per_labelled_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "c" * 50), (3, "d" * 50), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    got = sorted(map(tuple, training_rows(docs, labels, "quality", "doc_id < 0", 100, 10_000).collect()))
    assert got == [(1, "a", 1), (2, "c" * 50, 1), (3, "d" * 50, 0), (4, "", 1)]
    assert sum(len(r.text) for r in training_rows(docs, labels, "quality", "doc_id < 0", 100, 60).collect()) <= 60


MASK = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_features(text):
    """Slot -> value, word by word."""
    words = [w for w in text.encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)).split(b" ") if w]
    hashes, slots = [], Counter()
    for w in words:
        h = mix((len(w) * 0xD6E8FEB86659FD93 + 0x9E3779B97F4A7C15) & MASK)
        for k in range(0, min(len(w), 256), 8):
            h = mix(h ^ int.from_bytes(w[k : k + 8], "little"))
        hashes.append(h)
    size = 1 << Q.BITS
    for i, (w, h) in enumerate(zip(words, hashes, strict=True)):
        slots[h % size] += 1.0
        if i:
            slots[mix((hashes[i - 1] * 3 + h) & MASK) % size] += 1.0
        upper = lambda c: 65 <= c <= 90
        letter = 97 <= (w[-1] | 32) <= 122 or w[-1] >= 128
        capital = upper(w[0]) and upper(w[min(1, len(w) - 1)])
        twice = not letter and w[max(len(w) - 2, 0)] == w[-1]
        repeat = i > 0 and hashes[i - 1] == h
        shape = (0 if letter else w[-1] << 8) + capital + 2 * twice + 4 * repeat + 8 * (len(w) == 1)
        slots[mix(shape + 77) % size] += 4.0
    return {s: v / max(len(words), 1) * Q.SCALE for s, v in slots.items()}


def test_quality_against_a_plain_loop(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    held = fold(5, 0)
    rows = training_rows(docs, labels, "quality", held, Q.SAMPLE, Q.SAMPLE_BYTES).orderBy(F.xxhash64("doc_id"), "doc_id", "y").collect()
    examples = [({**{s: float(np.float32(v)) for s, v in plain_features(r.text).items()}, -1: 1.0}, r.y) for r in rows]
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= Q.L1 else -(z[i] - math.copysign(Q.L1, z[i])) / ((Q.BETA + math.sqrt(n[i])) / Q.ALPHA + Q.L2)

    rng = np.random.default_rng(7)
    for _ in range(Q.EPOCHS):
        for k in rng.permutation(len(examples)):
            x, y = examples[k]
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / Q.ALPHA * w[i]
                n[i] += g * g
    scores = {r.doc_id: r.score for r in quality_scores(docs, labels, held).collect()}
    for r in docs.collect():
        total = weight(-1) + sum(weight(i) * v for i, v in plain_features(r.text or "").items())
        assert abs(scores[r.doc_id] - 1 / (1 + math.exp(-total))) < 1e-4


def test_long_texts_have_the_same_features(monkeypatch):
    rng = np.random.default_rng(8)
    raw = " ".join(rng.choice(["Yes", "no!!", "NO", "a", "a", "maybe.", "12"], 5000)).encode()
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    slot, _, value = Q.features(data, offsets)
    want = Q.merged(slot, value)
    monkeypatch.setattr(Q, "SEGMENT", 333)
    slot, _, value = Q.features(data, offsets)
    got = Q.merged(slot, value)
    assert np.array_equal(got[0], want[0]) and np.allclose(got[1], want[1])
