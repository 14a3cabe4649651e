import numpy as np
import pytest

from tidemark.llm import words as W
from tidemark.llm.frames import free, named, partitions
from tidemark.llm.line_dedup import line_digests
from tidemark.llm.ngram_join import ngram_jaccard_join, shingle_sets


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out, out.translate(str.maketrans("ab", "ba"))


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_words_that_clash_modulo_a_power_of_two(spark):
    """Polynomial hashes modulo 2**64 can't tell these apart, whatever their base."""
    a, b = thue_morse(1024)
    docs = spark.createDataFrame([(1, " ".join(["x", "y", "z", "u", a])), (2, " ".join(["x", "y", "z", "u", b]))], "doc_id long, text string")
    assert sorted(r.component_id for r in ngram_jaccard_join(docs).collect()) == [1, 2]
    data, at = arrays([a, b, a])
    names = line_digests(data, at[:-1], at[1:])
    assert names[0].tolist() == names[2].tolist() != names[1].tolist()


def test_word_hash():
    words = ["", "a", "b", "ab", "ba", "abcdefgh", "abcdefgi", "abcdefghi", "x" * 255, "x" * 256, "x" * 257, "x" * 258, "x" * 257 + "y", "q" * 100_000, "q" * 99_999 + "r", *thue_morse(1024)]
    data, at = arrays(["pad", *words, *words])
    got = W.word_hash(data, at[1:-1], at[2:])
    assert got[: len(words)].tolist() == got[len(words) :].tolist() and len(set(got.tolist())) == len(words)


def test_long_texts_in_segments(monkeypatch):
    rng = np.random.default_rng(5)
    text = " ".join("".join(map(chr, rng.integers(97, 100, rng.integers(1, 30)))) for _ in range(3000)) + "  " + "w" * 5000 + "\n end"
    data, offsets = arrays([text])
    want = shingle_sets(data, offsets)[0]
    monkeypatch.setattr("tidemark.llm.ngram_join.SEGMENT", 700)
    assert np.array_equal(shingle_sets(data, offsets)[0], want)
    parts = W.segments(data, 700)
    assert parts[0][0] == 0 and parts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


def test_names_of_digests_that_share_a_half(spark):
    rows = [(1, 7, 100), (2, 7, 200), (3, 8, 300), (4, 7, 100)]
    df = spark.createDataFrame(rows, "id long, node long, check long")
    clashes = spark.createDataFrame([(7,)], "node long")
    fixed, values = named(df, clashes)
    assert sorted((r.id, r.node) for r in fixed.collect()) == [(1, 100), (2, 200), (3, 8), (4, 100)]
    assert W.names(np.array([r[1:] for r in rows]), values).tolist() == [100, 200, 8, 100]


def test_free_names_and_buckets(spark):
    assert free(["_at", "_AT_"], "_at") == "_at__"
    assert partitions(spark.range(10)) == 4


def test_shared_folder_must_be_set_on_a_cluster(spark, monkeypatch):
    from tidemark.sources import readers

    class Cluster:
        master = "spark://host:7077"

    class Session:
        sparkContext = Cluster()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        readers.shared_folder(Session())
