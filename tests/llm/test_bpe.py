import hashlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tidemark.llm.bpe import bpe_round_trip, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  \n\n x", "It's we'll they've I'd 'S 'tis", "a  b   c\t\td \x85 \xa0x", "\x1c\x1d\x1e\x1f \x00\x01z", "naïve Straße ñandú ǅ ɏ ʰ", "日本語テキスト 123４５６ ٣٤ ⅷ ² ½ x²",
    "🙂👩‍👩‍👧 emoji", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", "<|endoftext", "x" * 500, "ab" * 3000, "!!!???...   ", "1234567890" * 40, " em　wide ​zero", "tttttttthhhheeee ĠĠ Ċ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_odd_texts(library):
    mine = encoder(PATH)
    for text in ODD:
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids, text
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_real_texts(library):
    mine = encoder(PATH)
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()[:300]:
        assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_exact_merging_agrees(library):
    mine = encoder(PATH)
    for word in ["abcdefgh" * 9, "zz" * 50, "theinging" * 8]:
        raw = word.encode()
        assert [mine.id_list[t] for t in mine.merged(raw)] == library.encode(word, add_special_tokens=False).ids


def test_query_rows(spark, library):
    rows = [(i, t, "s") for i, t in enumerate(ODD)] + [(99, None, "s"), (1, ODD[1], "s"), (None, "x y", "s")]
    got = bpe_round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.add((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert set(map(tuple, got)) == want


def test_empty_table(spark):
    assert bpe_round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
