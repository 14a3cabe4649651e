import math
import random

from pyspark.sql import functions as F

from tidemark.llm import topk


def brute(rows, every, k=5):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in fine]
    out = []
    for a, (q, x) in enumerate(ints):
        if q % every == 0:
            scored = sorted((-sum(s * t for s, t in zip(x, y, strict=True)), i) for b, (i, y) in enumerate(ints) if a != b and len(x) == len(y))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def rows_of(n, dim, seed):
    rng = random.Random(seed)
    vectors = [[round(rng.gauss(0, 0.2), 3) for _ in range(dim)] for _ in range(n)]
    return [(i, rng.choice(vectors) if i % 7 == 0 else vectors[i]) for i in range(n)]


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "LEAF", 8)
    rows = rows_of(300, 6, 1) + [(400, None), (401, []), (402, [None] * 6), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (None, [0.1] * 6), (405, [0.5, 0.5]), (410, [0.25, 0.5]), (5, [0.3] * 6), (5, [0.3] * 6)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, shard int, rank int")
    got = topk.exact_top_k(df, F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.exact_top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    got = topk.exact_top_k(spark.createDataFrame([(0, [1.0, -0.5]), (50, [0.5, 0.25])], schema), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 50, 256 * 128 - 128 * 64), (50, 1, 0, 256 * 128 - 128 * 64)]


def test_large_components_and_copies(spark):
    """Scores beyond 2**53 and beyond a long, and rows that repeat very often."""
    rows = [(0, [1e8, 1.0]), (50, [2.0**40, -3.5]), (100, [3.0, 1.0]), (101, [1e300, 1.0]), (102, [-1e300, 0.5]), (103, [1e8, 0.99999999])] + [(150, [0.5, 0.5])] * 40 + [(151, [0.5, 0.25])] * 3
    got = sorted(map(tuple, topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()))
    limit = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    ints = [(i, [math.floor(256 * x) if abs(x) < 1e299 else int(x) * 256 for x in v]) for i, v in rows]
    want = []
    for a, (q, x) in enumerate(ints):
        if q % 50 == 0:
            scored = sorted((-limit(sum(s * t for s, t in zip(x, y, strict=True))), i) for b, (i, y) in enumerate(ints) if a != b)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    assert (0, 2, 100, 25600000000 * 768 + 65536) not in want and any(r[:1] == (100,) and r[3] == (1 << 63) - 1 for r in got)
