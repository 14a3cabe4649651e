import random

import pytest

from tidemark.llm.graph import attach, components
from pyspark.sql import functions as F


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {(x, find(x)) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("kind", ["random", "path", "star", "empty", "loops"])
def test_components(spark, kind):
    rng = random.Random(2)
    edges = {
        "random": [(rng.randrange(-100, 100), rng.randrange(-100, 100)) for _ in range(120)],
        "path": [(i, i + 1) for i in rng.sample(range(60), 60)],
        "star": [(0, i) for i in range(1, 300)] + [(500, i) for i in range(250, 400)],
        "empty": [], "loops": [(3, 3), (4, 5), (5, 4)],
    }[kind]
    for part in (1_000_000, 40):  # one part, and several that rounds join
        got = components(spark.createDataFrame(edges, "a long, b long"), part).collect()
        assert set(map(tuple, got)) == brute(edges) and len(got) == len(brute(edges))


def test_attach(spark):
    df = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 7), (None, 8)], "k long, v long")
    got = {(r.k, r.v, r.least, r.n) for r in attach(df, "k", ["v"], least=F.min("v"), n=F.count("*")).collect()}
    assert got == {(1, i, 0, 500) for i in range(500)} | {(2, 7, 7, 1)}
