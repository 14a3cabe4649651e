import random

from tidemark.llm import candidates
from tidemark.llm.line_dedup import SHINGLE, line_dedup


def brute(rows):
    """Exact: groups of all lines by exact Jaccard; rows are (doc_id, text), ids distinct."""
    places = [(doc, k, x.strip(" \t\n\r\x0b\x0c").encode()) for doc, text in sorted(rows) for k, x in enumerate((text or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    grams = lambda b: {b[i : i + SHINGLE] for i in range(max(1, len(b) - SHINGLE + 1))}
    sets = [grams(b) for _, _, b in places]
    root = list(range(len(places)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(places)):
        for j in range(i + 1, len(places)):
            c = len(sets[i] & sets[j])
            if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    gone = {(places[i][0], places[i][1]) for i in range(len(places)) if find(i) != i}
    return {doc: None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (doc, k) not in gone) for doc, text in rows}


def test_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh ñ") for _ in range(rng.randrange(2, 9)))
    base = [" ".join(word() for _ in range(rng.randrange(6, 30))) for _ in range(40)]
    rows = []
    for i in range(50):
        out = []
        for _ in range(rng.randrange(0, 9)):
            line = rng.choice(base) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(1, 30)))
            if rng.random() < 0.4 and len(line) > 40:
                at = rng.randrange(len(line))
                line = line[:at] + "#" + line[at + 1 :]
            out.append(rng.choice(["", "  "]) + line + rng.choice(["", "\r", " "]))
            if rng.random() < 0.2:
                out.append("")
        rows.append((i, "\n".join(out)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "a"), (104, "a\nab\n a "), (105, "long " * 20_000), (106, "x\n" + "long " * 20_000)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, line string, node int")).collect()}
    want = brute(rows)
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.line == "x" and r._lines - r._removed >= (1 if r.text else 0) for r in got.values())


def test_empty_table_and_repeats(spark):
    schema = "doc_id long, text string"
    assert line_dedup(spark.createDataFrame([], schema)).count() == 0
    rows = [(2, "same line here\nother words"), (2, "same line here\nother words"), (2, "same line here\nthird one"), (None, "same line here")]
    got = sorted((r.doc_id or -1, r.text) for r in line_dedup(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, "same line here"), (2, "other words"), (2, "other words"), (2, "third one")]


def test_short_lines_with_one_changed_character(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randrange(60, 100))).strip() for _ in range(60)]
    near = [x[: len(x) // 2] + "#" + x[len(x) // 2 + 1 :] for x in base]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame([(1, "\n".join(base)), (2, "\n".join(near))], "doc_id long, text string")).collect()}
    assert (got[1]._removed, got[2]._removed) == (0, 60)


def test_lines_of_one_pattern_are_sent_once(spark, monkeypatch):
    sent = []

    def links(rows, *given, kept=candidates.links, **named):
        sent.append(rows.count())
        return kept(rows, *given, **named)

    monkeypatch.setattr(candidates, "links", links)
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    pattern = letters(100)
    rows = [(i, pattern + letters(40)) for i in range(80)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == brute(rows)
    assert 0 < sum(sent) <= len(rows)
