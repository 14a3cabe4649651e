import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import candidates, tiles
from tidemark.llm.frames import likely
from tidemark.llm.ngram_join import ngram_jaccard_join

SCHEMA = "doc_id long, text string, node string, cluster string"


def brute(rows):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    root = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return {(d, len(sets[d]), root[d]) for d in ids}


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    rows, base = [], []
    for i in range(n):
        kind = i % 4
        if kind and base:
            words = list(rng.choice(base))
            for _ in range(rng.randrange(1, 6)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(999)}"
        else:
            words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(60, 200))] + passage
            base.append(words)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return [*rows, (1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One TWO"), (1005, "one two three"), (1006, "word " * 20_000), (1007, "word " * 30_000)]


def test_brute_force(spark):
    rows = corpus()
    got = ngram_jaccard_join(spark.createDataFrame([(*r, "n", "c") for r in rows], SCHEMA))
    assert set(map(tuple, got.collect())) == brute(rows)


def test_split_clusters_find_the_same(spark, monkeypatch):
    rows = corpus(90, 5)
    monkeypatch.setattr(tiles, "CELL", 2)
    got = ngram_jaccard_join(spark.createDataFrame([(*r, "n", "c") for r in rows], SCHEMA))
    assert set(map(tuple, got.collect())) == brute(rows)


def test_empty_table_and_null_ids(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "a b c d e f g"
    got = ngram_jaccard_join(spark.createDataFrame([(None, text, "", ""), (4, text, "", ""), (4, text, "", "")], SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got) == [(False, 4), (False, 4), (True, 4)]


def test_repeated_ids_with_other_texts(spark):
    rows = [(1, "a b c d e f g h i j k l m n"), (1, "q r s t u v w x y z"), (2, "a b c d e f g h i j k l m n o")]
    got = ngram_jaccard_join(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))
    assert got.agg(F.count_distinct("component_id")).first()[0] == 1


def test_texts_are_sent_and_not_their_hashes(spark, monkeypatch):
    sent = []

    def store(df, name, kept=candidates.store):
        out = kept(df, name)
        if name == "data":
            sent.extend(r.size for r in out.select(F.length("data").alias("size")).collect())
        return out

    monkeypatch.setattr(candidates, "store", store)
    monkeypatch.setattr(candidates, "LEAST", 400)  # so the tiles go in several parts
    rows = corpus(40, 7)
    got = ngram_jaccard_join(spark.createDataFrame([(*r, "n", "c") for r in rows], SCHEMA))
    assert set(map(tuple, got.collect())) == brute(rows)
    assert sent and sum(sent) <= sum(len(t or "") for _, t in rows if len(t or "") < 5000)


def test_only_texts_near_in_size_meet_again(spark):
    members = spark.createDataFrame([(1, i, n) for i, n in enumerate((80, 100, 126, 400))] + [(2, 9, 79), (2, 10, 100)], "cluster long, node long, n long")
    assert {r.node for r in candidates.near_in_size(members, 80).collect()} == {0, 1}


def test_like_groups_are_put_together(spark):
    rng = random.Random(2)
    like = {c: set(rng.sample(range(20), 18)) for c in range(40)}
    star = {100 + c: {50, 51 + 2 * c, 52 + 2 * c} for c in range(30)}  # these share one node and no pair
    members = spark.createDataFrame([(c, x, 7, x) for group in (like, star) for c, nodes in group.items() for x in nodes], "cluster long, node long, n long, label long")
    got = {}
    for r in candidates.overlaid(members).collect():
        got.setdefault(r.cluster, []).append(r.node)
    assert all(len(x) == len(set(x)) for x in got.values())
    assert all(any(nodes <= set(x) for x in got.values()) for nodes in [*like.values(), *star.values()])
    assert sum(min(x) < 20 for x in got.values()) < 10
    assert sum(len(x) ** 2 for x in got.values()) <= sum(len(x) ** 2 for x in [*like.values(), *star.values()])


def test_filter_of_keys_leaves_what_is_wanted_and_few_others(spark):
    docs = spark.createDataFrame([(None if i == 7 else i, str(i)) for i in range(40_000)], "fetch long, text string")
    wanted = docs.where("fetch % 10 = 0").select("fetch")
    left = likely(docs, wanted, ["fetch"])
    assert left.columns == docs.columns and left.join(wanted, "fetch").count() == 4000
    assert left.count() < 9000
    assert likely(docs, wanted.limit(0), ["fetch"]).count() == 0


def test_texts_that_share_passages_only_are_sent_once(spark, monkeypatch):
    sent = []

    def links(rows, *given, kept=candidates.links, **named):
        sent.append(rows.count())
        return kept(rows, *given, **named)

    monkeypatch.setattr(candidates, "links", links)
    rng = random.Random(11)
    passages = [" ".join(f"p{i}.{k}" for k in range(9)) for i in range(30)]
    rows = [(i, " ".join([f"w{i}.{k}" for k in range(12)] + rng.sample(passages, 8))) for i in range(60)]
    got = ngram_jaccard_join(spark.createDataFrame([(*r, "n", "c") for r in rows], SCHEMA))
    assert set(map(tuple, got.collect())) == brute(rows)
    assert 0 < sum(sent) <= len(rows)


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(4)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    sets = []
    for n in (1, 2, 5, 40, 300, 300, 3000):
        base = draw(n)
        sets += [base, *(np.union1d(rng.permutation(base)[: max(1, round(len(base) * keep))], draw(round(len(base) * (1 - keep)))) for keep in (0.95, 0.9, 0.85, 0.5))]
    size, label = np.array([len(x) for x in sets]), np.arange(len(sets)) // 2
    for cells in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
        near = tiles.near_members(cells, label, size, [tiles.sketch(x) for x in sets], 80)
        linked = {i for i, a in enumerate(sets) for j, b in enumerate(sets) if label[i] != label[j] and (cells[i] != cells[j] or not cells.any()) and 180 * len(np.intersect1d(a, b)) >= 80 * (len(a) + len(b))}
        assert linked and linked <= set(np.flatnonzero(near).tolist()) and not near.all()
