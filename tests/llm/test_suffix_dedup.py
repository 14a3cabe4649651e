import hashlib
import random
import tracemalloc

import numpy as np

from tidemark.llm import suffix_dedup as S


def brute(rows):
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < doc:
                gone[p : p + 50] = True
        kept = bytes(b for b, g in zip(raw, gone[:-1], strict=True) if not g)
        out.append((doc, len(raw), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])[: len(raw)]).sum()) if len(raw) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randrange(8, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(0, 7))]
        text = rng.choice(rows)[1] if rows and rng.random() < 0.2 else " ".join(parts)
        if rows and rng.random() < 0.2 and text:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("xyz") + text[at + 1 :]
        rows.append((i * 3, text))
    rows += [(1000, "a" * 300), (1001, "a" * 49), (1002, "ab" * 100 + "a" * 60), (1003, "ab" * 25), (1004, "b" + "a" * 49), (1005, None), (1006, ""), (1007, "\x00" * 60 + "z"), (1008, "\x00" * 70)]
    rng.shuffle(rows)
    return rows


def test_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = S.suffix_dedup(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node long, n_bytes long"))
        assert sorted(map(tuple, got.collect())) == brute(rows)


def test_small_chunks_and_segments(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    offsets = np.array([0, 10, 1500, 1500, 2600, 4000])
    want = S.windows(data, offsets)
    monkeypatch.setattr(S, "SEGMENT", 333)
    key, row, first, last = S.windows(data, offsets)
    every = lambda k, r, a, b: {(int(x), int(y), p) for x, y, i, j in zip(k, r, a, b, strict=True) for p in range(i, j + 1)}
    assert every(key, row, first, last) == every(*want)


def test_empty_table_repeats_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert S.suffix_dedup(spark.createDataFrame([], schema)).count() == 0
    text = "".join(map(str, range(60)))
    got = S.suffix_dedup(spark.createDataFrame([(3, text), (3, text), (4, text), (5, text + "!"), (None, "q" * 55), (3, "q" * 60)], schema)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(-1, 55, 0, 0), (3, 60, 60, 1), (3, 110, 0, 0), (3, 110, 0, 0), (4, 110, 110, 1), (5, 111, 110, 1)]


def test_one_anchor_in_very_many_contexts():
    """100,000 different runs of one anchor, some with a window in common, stay within bounded memory."""
    rng = np.random.default_rng(3)
    n = 100_000
    records = np.zeros(n, S.RUN)
    records["key"], records["doc"], records["node"], records["size"] = 7, np.arange(n) + 5, np.arange(n), S.LONGEST
    text = rng.integers(97, 123, (n, S.LONGEST)).astype(np.uint8)
    text[:, 30:50] = np.arange(97, 117)
    text[50_000:50_100, 10:70] = text[:100, 10:70]  # eleven windows of a hundred later documents
    text[50_000:50_100, 9], text[50_000:50_100, 70] = 48, 49
    records["text"] = text
    tracemalloc.start()
    spans = {(int(a), int(b), int(c)) for part in S.covered(records) for a, b, c in zip(*part, strict=True)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert spans == {(50_000 + i, 10, 70) for i in range(100)}
    assert peak < 1_000_000_000


def test_equal_runs_are_decided_by_the_transform():
    rng = np.random.default_rng(4)
    texts = rng.integers(97, 99, (30, S.LONGEST)).astype(np.uint8)
    size = rng.integers(S.MINIMUM, S.LONGEST + 1, 30)
    texts *= np.arange(S.LONGEST) < size[:, None]
    texts[10:20, :60] = texts[0, :60]
    size[10:20], size[0] = 60, 60
    texts[10:20, 60:], texts[0, 60:] = 0, 0
    windows = [bytes(t[p : p + 50]) for t, n in zip(texts, size, strict=True) for p in range(n - 49)]
    found = S.equal_windows(texts, size).tolist()
    assert len(set(zip(windows, found, strict=True))) == len(set(windows)) == len(set(found))


def test_runs_of_a_chunk_reduce_to_the_earliest():
    records = np.zeros(4, S.RUN)
    records["key"], records["doc"], records["node"], records["size"], records["start"] = 9, [3, 1, 1, 8], [30, 10, 10, 80], 55, [0, 0, 70, 20]
    records["text"][:, :55] = 97
    got = S.earliest(records)
    assert sorted(got["doc"][got["size"] > 0].tolist()) == [1, 1]
    assert {(int(r["node"]), int(r["start"]), int(r["doc"])) for r in got if r["size"] == 0} == {(30, 0, 55), (80, 20, 75)}


def test_expansion_starts_from_the_last_known_depth(monkeypatch):
    rng = random.Random(6)
    letters = lambda n: bytes(rng.choice(b"ab c") for _ in range(n))
    passage, size = letters(60), np.array([80, 75, 80, 50, 64])
    texts = np.zeros((5, 80), np.uint8)
    for row, n in zip(texts, size, strict=True):
        row[:n] = np.frombuffer((passage[: n // 2 + 15] + letters(80))[:n], np.uint8)
    sums, plain = [], np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda *a, **k: sums.append(1) or plain(*a, **k))
    found = S.equal_windows(texts, size).tolist()
    monkeypatch.undo()
    windows = [bytes(row[p : p + 50]) for row, n in zip(texts, size, strict=True) for p in range(n - 49)]
    assert len(set(zip(windows, found, strict=True))) == len(set(windows)) == len(set(found)) < len(windows)
    assert len(sums) < 35
