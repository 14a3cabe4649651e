import hashlib
import os

from tidemark.llm import fingerprint as P
from tidemark.llm.fingerprint import PrefixHashes, codes, fingerprints, likeness

TEXTS = ["the quick brown fox jumps over the lazy dog " * 5, "", "ab", "ñandú 日本語 🙂 " * 20, "x" * 5000, "the quick brown fox jumps over the lazy dog " * 5, "word " * 40_000, "a much different text with its own words and phrases, none of them above"]


def test_spans_and_extensions():
    text = "abracadabra abracadabra! " * 7
    h = PrefixHashes(codes(text))
    for i, j, n in ((0, 7, 4), (0, 12, 11), (3, 5, 2), (0, 25, 100), (1, 2, 3)):
        assert (h.span(i, i + n) == h.span(j, j + n)) == (text[i : i + n] == text[j : j + n])
    for i, j in ((0, 12), (0, 25), (0, 7), (2, 3)):
        n = h.common(i, h, j)
        assert text[i : i + n] == text[j : j + n]
        assert max(i, j) + n == len(text) or text[i + n] != text[j + n]


def test_rows(spark):
    rows = [(i * 3 - 4, t, "s") for i, t in enumerate(TEXTS)] + [(None, "nothing", "s"), (100, None, "s")]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string, range string")).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    alone = {}
    for k, (doc, text, _) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        m = len(text) // 4
        edited = text[: len(text) - m] + following[:m]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert alone.setdefault(text, r.fingerprint) == r.fingerprint
        assert alone.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert r.near_edited == likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == likeness(r.fingerprint, got[order[(k + 1) % len(order)][0]].fingerprint)
        assert edited != text or r.near_edited == 1.0
        assert text[: r.common_prefix] == edited[: r.common_prefix]


def test_likeness_tells_edits_from_other_texts(spark):
    rows = [(i, " ".join(f"{chr(97 + (i * j) % 26)}w{(i * 7919 + j * j) % 997}" for j in range(200))) for i in range(1, 30)]
    for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.near_edited > 0.35 > 0.25 > r.near_next


def test_single_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert fingerprints(spark.createDataFrame([], schema)).count() == 0
    r = fingerprints(spark.createDataFrame([(1, "abcdefgh")], schema)).collect()
    assert len(r) == 1 and r[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprints(spark.createDataFrame([(1, "abcdefgh")] * 3 + [(1, "z")] * 2, schema)).count() == 5


MASK, PRIME = (1 << 64) - 1, (1 << 31) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_print(text):
    """The fingerprint span by span, in whole numbers of any size."""
    points = [ord(c) + 1 for c in text]
    total = lambda part, base: sum(c * pow(base, j, PRIME) for j, c in enumerate(part)) % PRIME
    spans = [total(points[i : i + P.SPAN], P.FIRST) for i in range(len(points) - P.SPAN + 1)]
    if 0 < len(points) < P.SPAN:
        spans = [total(points, P.FIRST) + len(points)]
    bins = {}
    for s in spans:
        key = mix((s + 0x51AFD7ED) & MASK)
        bins[key >> 58] = min(bins.get(key >> 58, 1 << 60), key & ((1 << 52) - 1))
    short = [(bins[b] & 0xFFFF) % P.NONE if b in bins else P.NONE for b in range(P.BINS)]
    return f"{total(points, P.FIRST) << 31 | total(points, P.SECOND):016x}{len(points):08x}" + "".join(f"{x:04x}" for x in short)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([s[i : i + 4] for i in range(24, len(s), 4)] for s in (a, b))
    filled = [(p, q) for p, q in zip(x, y, strict=True) if (p, q) != ("ffff", "ffff")]
    return sum(p == q for p, q in filled) / max(1, len(filled))


def test_against_plain_fingerprints(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text or "") < 1500]
    rows += [(10**6 + i, t) for i, t in enumerate(["", "a", "abcdefg", "abcdefgh", "ab" * 20, "ab" * 20, "日本語 ñ 🙂" * 9, "x" * 400])]
    assert len(rows) > 60
    rows.sort()
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (doc, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        r, mine, other = got[doc], plain_print(text), plain_print(edited)
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(text), mine, other)
        assert abs(r.near_edited - plain_likeness(mine, other)) < 1e-12 and abs(r.near_next - plain_likeness(mine, plain_print(following))) < 1e-12
        assert r.common_prefix == len(os.path.commonprefix([text, edited]))


def test_ids_that_many_rows_share_are_parted(spark):
    """Three quarters of the rows have no id; their range is parted by text."""
    rows = [(None, f"text number {i}") for i in range(300)] + [(i, f"other text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "coalesce(doc_id, -9223372036854775808L) as at", "xxhash64(text) as tie")
    df = df.withColumn("place", df["at"].cast("double"))
    ranged, count = P.ranged(df, df.approxQuantile("place", [i / 8 for i in range(1, 8)], 0.01))
    sizes = [r["count"] for r in ranged.groupBy("range").count().collect()]
    assert count >= 8 and max(sizes) < 100 and sum(sizes) == 400
    order = sorted((r.at, r.tie, r.range) for r in ranged.collect())
    assert [r[2] for r in order] == sorted(r[2] for r in order)
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 400 and len({r.fingerprint for r in got}) == 400
