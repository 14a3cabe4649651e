import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written and read as the driver does."""
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, DIR).write.parquet(path)
        made = spark.read.parquet(path)
        out.append((name, docs, made))
        docs = made
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "line_dedup", "ngram_jaccard_join", "suffix_array_dedup", "best_fit_packing"]
    assert all(made.columns == docs.columns for _, docs, made in stages[:-1])


def test_decisions_take_effect(spark, stages):
    (_, docs, clean), (_, _, lines), (_, _, single), (_, _, passages), (_, packed_from, packed) = stages
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    gone = set(texts(docs)) - set(texts(clean))
    assert all(labels.get(d, 1) == 1 for d in gone)
    before, after = texts(clean), texts(lines)
    blank = " \t\n\r\x0b\x0c"
    assert set(after) <= set(before) and all((before[d] or "").strip(blank) for d in set(before) - set(after))
    assert all((t or "").strip(blank) or not (before[d] or "").strip(blank) for d, t in after.items())
    seen = set()
    for doc in sorted(after):
        for line in (x.strip(" \t\n\r\x0b\x0c") for x in (after[doc] or "").split("\n")):
            assert not line or line not in seen
            seen.add(line)
    assert set(texts(single)) <= set(after) and all(after[d] == t for d, t in texts(single).items())
    windows = {}
    for doc, text in sorted(texts(passages).items()):
        raw = (text or "").encode()
        original = texts(single)[doc].encode()
        assert len(raw) <= len(original)
        for p in range(len(original) - 49):
            windows.setdefault(original[p : p + 50], doc)
        assert raw == original or any(windows[original[p : p + 50]] < doc for p in range(len(original) - 49))
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in packed.collect():
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert pieces == {d: len(tokens.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts(packed_from).items()}


def test_run_gives_the_last_stage(spark, stages):
    name = lambda df: hashlib.sha256(repr(sorted(tuple(r)[:5] for r in df.collect())).encode()).hexdigest()
    assert name(corpus_pipeline.run(spark, DIR)) == name(stages[-1][2])


WORDS = "able bird calm dust echo fern gold harp iron jade kelp lime moss neon opal pine quay reef salt tide".split()


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(100)) for _ in range(n))


def test_planted_copies_go_and_no_empty_documents_come(spark):
    texts = {i: "\n".join(prose(10 * i + k) for k in range(3)) for i in range(20)}
    rows = dict(texts)
    rows |= {100 + i: texts[i] for i in range(6)}  # exact
    rows |= {200 + i: texts[i].replace(texts[i].split()[30], "other1", 1) for i in range(6)}  # one line near
    rows |= {300 + i: texts[i] + "\n" + texts[i].split("\n")[0] for i in range(6)}  # a line more, that repeats
    single = {i: prose(1000 + i, 150) for i in range(400, 405)}
    rows |= single | {i + 100: t.replace(t.split()[80], "other2", 1) for i, t in single.items()}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()] + [(900, "", "en", "s", 0), (901, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/planted-{name}"
        stage(spark, docs, DIR).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    kept = {r.doc_id: r for r in docs.collect()}
    assert set(kept) == set(texts) | set(single) | {900, 901}
    assert all(kept[i].text == t and kept[i].n_chars == len(t) for i, t in (texts | single).items())


def test_near_copies_that_line_dedup_leaves_go_by_the_join(spark):
    """Lines too far apart by characters, while the texts' words are close: the third stage's own work."""
    words = [prose(7000 + i, 5) for i in range(60)]
    other = ["\n".join(" ".join(words[k : k + 2]) for k in range(0, 60, 2)), "\n".join(" ".join(words[k : k + 3]) for k in range(0, 60, 3))]
    docs = spark.createDataFrame([(1, other[0]), (2, other[1]), (3, prose(5))], "doc_id long, text string")
    left = corpus_pipeline.remove_lines(spark, docs, DIR)
    assert {r.doc_id for r in left.collect()} == {1, 2, 3}
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_a_kind(spark, left, DIR).collect()} == {1, 3}


CLASHING = "_at double, _h string, _gone int, _lines int, _removed int, _sha256 string, _sha string, _kept string, score double, held_out int, predicted int, weight double, row string, node long, fetch long, label string"


def test_odd_rows_through_all_stages(spark):
    """Nulls in every column, empty texts, repeated rows and columns with the names that operators use."""
    extra = (7.5, "h", 3, 4, 5, "s", "t", "k", 0.9, 1, 1, 2.0, "r", 11, 12, "l")
    rows = [(i, prose(i), "en", "s", 9, *extra) for i in range(6)] + [(2, prose(2), "en", "s", 9, *extra)] * 2 + [(50, "", None, "s", None, *extra), (51, None, None, None, None, *([None] * len(extra))), (None, prose(77), "en", None, 9, *extra), (52, "word " * 30_000, "en", "s", 9, *extra), (53, " \n\n ", "en", "s", 9, *extra)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
    docs = spark.createDataFrame(rows, schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{spark.conf.get('spark.checkpoint.dir')}/odd-{name}"
        stage(spark, docs, DIR).write.mode("overwrite").parquet(path)
        made = spark.read.parquet(path)
        if k < 4:
            assert made.columns == docs.columns
            got = made.collect()
            assert {r.doc_id for r in got} == {0, 1, 2, 3, 4, 5, 50, 51, 52, 53, None}
            assert all(tuple(r)[5:] == extra for r in got if r.doc_id != 51) and all(tuple(r)[5:] == (None,) * len(extra) for r in got if r.doc_id == 51)
            docs = made
        else:
            assert {r.doc_id for r in made.collect()} == {0, 1, 2, 3, 4, 5, 50, 51, 52, 53, None}


def test_empty_table_through_all_stages(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, DIR)
        assert made.count() == 0 and (k == 4 or made.columns == docs.columns)
