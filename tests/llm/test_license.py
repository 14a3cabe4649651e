import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm.license import CUE, TEMPLATES, THRESHOLD, license_scan

FILES = [
    (1, "a/LICENSE.txt", "Released under the MIT License."),
    (2, "a/b/code.py", "some words\nof no matter"),
    (3, "a/b/c/code.py", None),
    (4, "a/b/c/own.py", "x\nLicensed under the Apache License, Version 2.0\nmore"),
    (5, "z/code.py", ""),
    (6, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3.\nfree text goes on here"),
    (7, "a/x/tie.py", "Copyright by no one\nthe driving license of a friend"),
    (8, "m.txt", "RELEASED UNDER THE MIT LICENCE"),
    (9, "w/only", "Licensed under CC BY-NC 4.0.\n\nLicensed under CC BY 4.0."),
    (10, "w/d/e", "long words " * 20_000 + "license"),
    (11, None, "nothing"),
]


def brute():
    terms = lambda s: Counter(t for t in re.split("[^a-z0-9]+", s.lower()) if t)
    lines = {d: [(k, x) for k, x in enumerate((t or "").split("\n")) if re.search(CUE, x)] for d, _, t in FILES}
    unique = {x for v in lines.values() for _, x in v}
    df = Counter(t for x in unique for t in terms(x))
    vec = lambda s: {t: n * (math.log((1 + len(unique)) / (1 + df[t])) + 1) for t, n in terms(s).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))

    def best(x):
        v = vec(x)
        found = [(-round(sum(v[t] * w[t] for t in v if t in w) / norm(v) / norm(w), 9), name) for name, w in ((n, vec(s)) for n, s in TEMPLATES.items())]
        return min(found) if -min(found)[0] >= THRESHOLD else None

    own, give = {}, {}
    for d, path, text in FILES:
        hits = [(b[0], k, b[1]) for k, x in lines[d] if (b := best(x))]
        if hits:
            own[d] = (min(hits)[2], -min(hits)[0])
            full = sum(1 for x in text.split("\n") if x.strip(" "))
            parts = path.split("/")
            if len(hits) == full or parts[-1].lower().split(".")[0] in ("license", "licence", "copying", "notice"):
                give.setdefault("/".join(parts[:-1]), []).append((path, *own[d]))
    out = set()
    for d, path, _ in FILES:
        if d in own:
            out.add((d, own[d][0], round(own[d][1], 6), "own"))
            continue
        parts = path.split("/") if path else []
        up = next((min(give["/".join(parts[:i])])[1:] for i in range(len(parts) - 1, -1, -1) if "/".join(parts[:i]) in give), None)
        out.add((d, up[0], round(up[1], 6), "directory") if up else (d, None, None, None))
    return out


def test_brute_force(spark):
    got = {tuple(r) for r in license_scan(spark.createDataFrame([(d, t, p, "x") for d, p, t in FILES], "doc_id long, text string, file string, license string"), F.col("file")).collect()}
    want = brute()
    assert {(a, b, d) for a, b, _, d in got} == {(a, b, d) for a, b, _, d in want}
    assert all(abs((a[2] or 0) - (b[2] or 0)) < 2e-6 for a, b in zip(sorted(got, key=lambda r: r[0]), sorted(want, key=lambda r: r[0]), strict=True))
    assert {r[0]: r[3] for r in got}[3] == "directory"


def test_empty_and_repeats(spark):
    schema = "doc_id long, text string, file string"
    assert license_scan(spark.createDataFrame([], schema), F.col("file")).count() == 0
    got = license_scan(spark.createDataFrame([(None, "Released under the MIT License.", "a")] * 2 + [(None, "b", None)], schema), F.col("file")).collect()
    assert sorted(r.license or "" for r in got) == ["", "MIT", "MIT"]


def test_headers_and_whole_texts(spark):
    from tidemark.llm.license_texts import TEXTS

    wrap = lambda x, mark="": "\n".join(mark + " ".join(x.split()[i : i + 12]) for i in range(0, len(x.split()), 12))
    code = "\n\n" + "import words\nprint(words)\n" * 200
    files = [
        (1, "g/main.py", "#!/usr/bin/python\n#\n" + wrap(TEXTS["GPL-3.0"][0], "# ") + code, "GPL-3.0"),
        (2, "m/LICENSE", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrap(TEXTS["MIT"][1]), "MIT"),
        (3, "m/deep/code.py", "print()", "MIT"),
        (4, "b/LICENSE.txt", "Copyright (c) 2020, Some One\n\n" + wrap(TEXTS["BSD-3-Clause"][0]), "BSD-3-Clause"),
        (5, "b2/LICENSE.txt", "Copyright (c) 2020, Some One\n\n" + wrap(TEXTS["BSD-2-Clause"][0]), "BSD-2-Clause"),
        (6, "c/main.c", "/*\n" + wrap(TEXTS["BSD-3-Clause"][0].replace(" 2. ", "\n\n2. "), " ") + "\n*/" + code, "BSD-3-Clause"),
        (7, "l/main.c", wrap(TEXTS["LGPL-3.0"][0], " * ") + code, "LGPL-3.0"),
        (8, "p/story.txt", "A copyright is no license.\n\n" + "plain words and more of them\n" * 50, None),
    ]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame([f[:3] for f in files], "doc_id long, file string, text string"), F.col("file")).collect()}
    assert {d: r.license for d, r in got.items()} == {f[0]: f[3] for f in files}
    assert got[3].origin == "directory" and got[2].origin == "own"
