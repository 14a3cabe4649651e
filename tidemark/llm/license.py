"""Licence scans, in DataFrame functions only.

Licence lines (lines with a cue word) are compared with licence templates by the cosine of their
TF-IDF vectors; document frequencies are those of the distinct licence lines of the whole input, so
a line that a third of all files carry is scored once. Paragraphs, the comment block at a file's head and
the whole file are compared in the same way, with the same frequencies, with the licences' headers,
titles and bodies (TEXTS). A file's licence is that of its best line or block, if that reaches
THRESHOLD. A file that is named as a licence file, or holds licence lines only, also gives its licence
to its directory; files without their own take that of the nearest ancestor directory that has one, by a
join of their ancestors' paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import store
from tidemark.llm.license_texts import TEXTS

THRESHOLD = 0.5
CUE = "(?i)licen[cs]e|copyright|released under|permission is hereby|spdx|public domain"
#: A block without one of these words is no licence.
BLOCK_CUE = CUE + "|redistribution and use|permission to use|mozilla public|creative commons|cc0"
#: Lines that belong to a comment, or are blank.
COMMENT = r"^\s*($|#|//|\*|/\*|--|;|%|'|<!--)"
NAMES = ("license", "licence", "copying", "notice", "unlicense")
NO_ID = -(1 << 63)

# The usual statements by which files name their licence.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the 2-Clause BSD License.",
    "BSD-3-Clause": "Released under the 3-Clause BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released to the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is licensed under the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def _terms(df: DataFrame, key: str, text: str) -> DataFrame:
    words = df.select(key, F.explode(F.split(F.lower(F.col(text)), "[^a-z0-9]+")).alias("term")).where("term <> ''")
    return words.groupBy(key, "term").agg(F.count("*").alias("tf"))


def _normed(terms: DataFrame, key: str) -> DataFrame:
    return terms.join(terms.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), key)


def _blocks(cued: DataFrame) -> DataFrame:
    """(at, h, line, content) of each paragraph, of the comment at the head, and of the whole file; content's words are parted by one space.

    line is the first of the block. Lines without a letter or digit part paragraphs.
    """
    lines = F.split("text", "\n")
    word = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    code = F.array_position(F.transform("lines", lambda x: x.rlike(COMMENT)), F.lit(False)).cast("int")
    starred = F.ltrim("text").startswith("/*") & F.col("text").contains("*/")
    head = F.when(starred, F.substring_index("text", "*/", 1)).when(code > 1, F.array_join(F.slice("lines", F.lit(1), code - 1), "\n"))
    solid = cued.withColumn("lines", lines).select("at", "h", "text", head.alias("head"), F.transform("lines", lambda x, i: F.struct(i.alias("line"), word(x).alias("content"))).alias("all"))
    whole = solid.select("at", "h", F.explode(F.array(word(F.coalesce("head", F.lit(""))), word(F.col("text")))).alias("content")).select("at", "h", F.lit(0).alias("line"), "content")
    joined = F.array_join(F.transform("all", lambda x: F.when(x["content"] == "", "\n").otherwise(F.concat(x["line"].cast("string"), F.lit(":"), x["content"]))), " ")
    first = F.regexp_extract("part", "^ *([0-9]+):", 1).cast("int")
    parts = solid.select("at", "h", F.explode(F.split(joined, "\n")).alias("part")).where("trim(part) <> ''")
    parts = parts.select("at", "h", first.alias("line"), F.trim(F.regexp_replace("part", "(^| )[0-9]+:", " ")).alias("content"))
    return parts.unionByName(whole).where(F.col("content").rlike(BLOCK_CUE)).dropDuplicates(["at", "h", "content"])


def license_scan(files: DataFrame, path: Column, templates: dict[str, str] = TEMPLATES, texts: dict[str, list[str]] = TEXTS) -> DataFrame:
    """files (doc_id, text) -> (doc_id, license, score, origin), one row each; path names a file, with '/' between directories.

    origin is 'own', 'directory' or null, where no licence is found (license and score are null too). A
    null or empty text has none of its own; a null path is in no directory. Ties go to the earlier line,
    then the smaller template name; of several licence files in a directory the smallest path counts.
    Rows equal in doc_id and text are one file.
    """
    spark = files.sparkSession
    quoted = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in item)) for item in templates.items())
    known = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(template, statement)")
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    longer = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quote(name)}, {quote(f'{name} {i}')}, {quote(x)})" for name, group in texts.items() for i, x in enumerate(group)) + " AS t(template, variant, statement)")
    keyed = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), path.alias("path"))
    keyed = keyed.withColumn("at", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("h", F.xxhash64("text"))
    cued = store(keyed.where(F.col("text").rlike(BLOCK_CUE)).dropDuplicates(["at", "h"]), "cued")
    solid = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    every = cued.select("at", "h", solid.alias("full"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    lines = store(every.where((F.trim("content") != "") & F.col("content").rlike(CUE)), "lines")
    distinct = lines.select("content").distinct()
    terms = _terms(distinct, "content", "content")
    total = distinct.agg(F.count("*").alias("total"))
    idf = terms.groupBy("term").agg(F.count("*").alias("df"))
    weigh = lambda t: t.join(idf, "term", "left").crossJoin(F.broadcast(total)).withColumn("w", F.col("tf") * (F.log((1 + F.col("total")) / (1 + F.coalesce("df", F.lit(0)))) + 1)).drop("df", "total", "tf")
    mine = _normed(weigh(terms), "content").withColumnsRenamed({"w": "lw", "norm": "ln"})
    theirs = _normed(weigh(_terms(known, "template", "statement")), "template").withColumnsRenamed({"w": "tw", "norm": "tn"})
    scored = mine.join(F.broadcast(theirs), "term").groupBy("content", "template").agg(F.round(F.sum(F.col("lw") * F.col("tw")) / F.max("ln") / F.max("tn"), 9).alias("score"))
    best = scored.groupBy("content").agg(F.min(F.struct((-F.col("score")).alias("minus"), "template")).alias("best")).where(-F.col("best.minus") >= THRESHOLD)
    hits = lines.join(best, "content").select("at", "h", "line", "best.minus", "best.template", "full")
    blocks = store(_blocks(cued).withColumn("block", F.md5("content")), "blocks")
    wide = _normed(store(weigh(_terms(blocks.dropDuplicates(["block"]), "block", "content")), "weights"), "block").withColumnsRenamed({"w": "lw", "norm": "ln"})
    long = _normed(weigh(_terms(longer, "variant", "statement")), "variant").withColumnsRenamed({"w": "tw", "norm": "tn"}).join(longer.drop("statement"), "variant")
    compared = wide.join(F.broadcast(long), "term").groupBy("block", "variant", "template").agg(F.round(F.sum(F.col("lw") * F.col("tw")) / F.max("ln") / F.max("tn"), 9).alias("score"))
    nearest = compared.groupBy("block").agg(F.min(F.struct((-F.col("score")).alias("minus"), "template")).alias("best")).where(-F.col("best.minus") >= THRESHOLD)
    hits = hits.unionByName(blocks.join(nearest, "block").select("at", "h", "line", "best.minus", "best.template", F.lit(None).cast("int").alias("full")))
    own = hits.groupBy("at", "h").agg(F.min(F.struct("minus", "line", "template")).alias("b"), F.count("full").alias("hits"), F.max("full").alias("full"))
    own = store(own.select("at", "h", F.col("b.template").alias("license"), (-F.col("b.minus")).alias("score"), F.coalesce(F.col("hits") == F.col("full"), F.lit(False)).alias("only")), "own")
    found = keyed.drop("text").join(own, ["at", "h"], "left").withColumn("parts", F.split("path", "/"))
    name = F.regexp_replace(F.lower(F.element_at("parts", -1)), "[.].*$", "")
    place = F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/")
    given = own.join(keyed.drop("text"), ["at", "h"]).withColumn("parts", F.split("path", "/"))
    givers = given.where(F.col("license").isNotNull() & (F.col("only") | name.isin(*NAMES)) & F.col("path").isNotNull())
    dirs = store(givers.groupBy(place.alias("dir")).agg(F.min(F.struct("path", "license", "score")).alias("given")), "dirs")
    lacking = found.where("license IS NULL AND path IS NOT NULL").select("at", "h", "path", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice("parts", 1, i), "/").alias("dir")))).alias("up"))
    above = lacking.select("at", "h", "path", "up.depth", "up.dir").join(dirs, "dir").groupBy("at", "h", "path").agg(F.max(F.struct("depth", "given.license", "given.score")).alias("n"))
    above = above.select("at", "h", "path", F.col("n.license").alias("dir_license"), F.col("n.score").alias("dir_score"))
    out = found.join(above, ["at", "h", "path"], "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "directory")
    return out.select("doc_id", F.coalesce("license", "dir_license").alias("license"), F.round(F.coalesce("score", "dir_score"), 6).alias("score"), origin.alias("origin"))


def _oracle() -> str:
    quoted = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in item)) for item in TEMPLATES.items())
    cue = CUE.removeprefix("(?i)")
    names = ", ".join(f"'{n}'" for n in NAMES)
    return f"""
WITH known(template, statement) AS (VALUES {quoted}),
files AS (SELECT doc_id, text, concat_ws('/', CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 20 AS VARCHAR), CASE WHEN doc_id % 20 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END) AS path FROM documents),
split AS (SELECT doc_id, path, string_split(text, chr(10)) AS parts FROM files WHERE regexp_matches(text, '{cue}', 'i')),
every AS (SELECT doc_id, path, unnest(parts) AS content, unnest(range(len(parts))) AS line FROM split),
solid AS (SELECT * FROM every WHERE trim(content, ' ') <> ''),
lines AS (SELECT * FROM solid WHERE regexp_matches(content, '{cue}', 'i')),
uniq AS (SELECT DISTINCT content FROM lines),
t1 AS (SELECT content, unnest(regexp_split_to_array(lower(content), '[^a-z0-9]+')) AS term FROM uniq),
terms AS (SELECT content, term, count(*) AS tf FROM t1 WHERE term <> '' GROUP BY ALL),
idf AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
tot AS (SELECT count(*) AS total FROM uniq),
t2 AS (SELECT template, unnest(regexp_split_to_array(lower(statement), '[^a-z0-9]+')) AS term FROM known),
tterms AS (SELECT template, term, count(*) AS tf FROM t2 WHERE term <> '' GROUP BY ALL),
lw AS (SELECT content, term, tf * (ln((1 + total) / (1 + df)) + 1) AS w FROM terms JOIN idf USING (term), tot),
tw AS (SELECT template, term, tf * (ln((1 + total) / (1 + coalesce(df, 0))) + 1) AS w FROM tterms LEFT JOIN idf USING (term), tot),
ln_ AS (SELECT content, sqrt(sum(w * w)) AS n FROM lw GROUP BY content),
tn AS (SELECT template, sqrt(sum(w * w)) AS n FROM tw GROUP BY template),
scored AS (SELECT lw.content, tw.template, round(sum(lw.w * tw.w) / max(ln_.n) / max(tn.n), 9) AS score FROM lw JOIN tw USING (term) JOIN ln_ ON ln_.content = lw.content JOIN tn ON tn.template = tw.template GROUP BY ALL),
best AS (SELECT content, template, score FROM scored WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY content ORDER BY score DESC, template) = 1),
hits AS (SELECT doc_id, path, line, template, score FROM lines JOIN best USING (content)),
own AS (SELECT doc_id, path, template AS license, score, count(*) OVER (PARTITION BY doc_id) AS hits FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line, template) = 1),
counted AS (SELECT doc_id, count(*) AS whole FROM solid GROUP BY doc_id),
found AS (SELECT files.doc_id, files.path, own.license, own.score, own.hits = counted.whole AS only_ FROM files LEFT JOIN own USING (doc_id) LEFT JOIN counted USING (doc_id)),
givers AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, path, license, score FROM found WHERE license IS NOT NULL AND (only_ OR regexp_replace(lower(regexp_extract(path, '[^/]*$')), '[.].*$', '') IN ({names}))),
dirs AS (SELECT * FROM givers QUALIFY row_number() OVER (PARTITION BY dir ORDER BY path) = 1),
lacking AS (SELECT doc_id, path, unnest([regexp_replace(path, '/[^/]*$', ''), regexp_replace(path, '/[^/]*/[^/]*$', ''), '']) AS dir, unnest([2, 1, 0]) AS depth FROM found WHERE license IS NULL),
above AS (SELECT lacking.doc_id, dirs.license, dirs.score FROM lacking JOIN dirs USING (dir) QUALIFY row_number() OVER (PARTITION BY lacking.doc_id ORDER BY depth DESC) = 1)
SELECT found.doc_id, coalesce(found.license, above.license) AS license, round(coalesce(found.score, above.score), 6) AS score,
  CASE WHEN found.license IS NOT NULL THEN 'own' WHEN above.license IS NOT NULL THEN 'directory' END AS origin
FROM found LEFT JOIN above USING (doc_id)"""


ORACLE = _oracle()
