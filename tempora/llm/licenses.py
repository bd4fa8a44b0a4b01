"""License scans with DataFrame operations only.

Every line of a file is a possible header. Lines and license templates are sparse TF-IDF vectors of their words (document
frequencies over all files), and a line's license is the template of the highest cosine, if that reaches ``LEAST``. The best
line gives a file's own license. A file whose name says that it holds a license (LICENSE, COPYING, NOTICE ...) gives its license to its directory, and a
file without one of its own inherits from the nearest directory above it that has one, by joining path prefixes.

Only lines with an anchor word are scored. Anchors are chosen from the frequencies so that a line without any cannot reach the
threshold (the template's weight outside of the anchors is too small, by Cauchy and Schwarz), so no line is lost. Equal
lines are scored once, and prefixes are made for distinct directories, so copies and crowded directories cost one row each.

Files that share a path are one file. A null text or path counts as empty; an empty file has no line that scores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import staged

LEAST = 0.6
WORD = "[a-z0-9]+"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|copyright|notice)([-._].*)?$"

#: The notices by which public licenses are declared.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license. Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License (CC BY 4.0)."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)


def scan(files: DataFrame, least: float = LEAST, templates=TEMPLATES) -> DataFrame:
    """(path, own_license, own_score, license_id, origin, inherited_from) for each path of files (path, text)."""
    spark = files.sparkSession
    files = files.select(F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    word_rows = files.select(F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    frequency = staged(word_rows.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    n = files.count()
    idf = (F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")

    made = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license_id string, text string")
    counts = made.select("template", "license_id", F.explode(words(F.col("text"))).alias("word")).groupBy("template", "license_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    weights = counts.join(frequency, "word", "left").withColumn("df", F.coalesce("df", F.lit(0))).select("template", "license_id", "word", (F.col("tf") * idf).alias("w"))
    rows = weights.collect()  # as many as the templates have words
    norm = {t: math.sqrt(sum(r.w**2 for r in rows if r.template == t)) for t in {r.template for r in rows}}
    anchors = sorted({w for t in norm for w in _anchors([r for r in rows if r.template == t], least * norm[t])})
    vectors = F.broadcast(spark.createDataFrame([(r.template, r.license_id, r.word, r.w / norm[r.template]) for r in rows], "template int, license_id string, word string, t double"))

    line = files.select("path", F.explode(F.split("text", "\n")).alias("line"))
    headers = staged(line.withColumn("words", words(F.col("line"))).filter(F.arrays_overlap("words", F.array(*map(F.lit, anchors)))).select("path", "line").distinct())
    own = headers.select("line").distinct()
    tf = own.select("line", F.explode(words(F.col("line"))).alias("word")).groupBy("line", "word").agg(F.count(F.lit(1)).alias("tf"))
    weighed = tf.join(frequency, "word").select("line", "word", (F.col("tf") * idf).alias("w"))
    size = weighed.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = weighed.join(vectors, "word").groupBy("line", "template", "license_id").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    scored = dots.join(size, "line").select("line", "license_id", F.round(F.col("dot") / F.col("size"), 6).alias("score")).filter(F.col("score") >= least)
    of_line = scored.groupBy("line").agg(F.max_by("license_id", _best()).alias("license_id"), F.max("score").alias("score"))
    of_path = staged(headers.join(of_line, "line").groupBy("path").agg(F.max_by("license_id", _best()).alias("own_license"), F.max("score").alias("own_score")))

    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    given = of_path.filter(F.regexp_replace("path", r"^.*/", "").rlike(LICENSE_FILE)).select(directory.alias("dir"), F.col("own_license").alias("license_id"), F.col("own_score").alias("score"))
    given = given.groupBy("dir").agg(F.max_by("license_id", _best()).alias("license_id"))
    paths = files.select("path").distinct().join(of_path, "path", "left").withColumn("dir", directory)
    dirs = paths.filter("own_license IS NULL").select("dir").distinct().select("dir", F.split("dir", "/").alias("parts"))
    above = dirs.select("dir", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"), "parts").select("dir", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("up"))
    nearest = above.join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("license_id", "up"), "depth").alias("from"))
    out = paths.join(nearest.withColumnRenamed("dir", "_dir"), (paths.dir == F.col("_dir")) & paths.own_license.isNull(), "left")
    named = F.regexp_replace("path", r"^.*/", "").rlike(LICENSE_FILE)
    origin = F.when(F.col("own_license").isNotNull(), F.when(named, F.lit("file")).otherwise(F.lit("header"))).when(F.col("from").isNotNull(), F.lit("inherited")).otherwise(F.lit("none"))
    return out.select("path", "own_license", "own_score", F.coalesce("own_license", "from.license_id").alias("license_id"), origin.alias("origin"), F.col("from.up").alias("inherited_from"))


def _best() -> Column:
    """Orders by score, ties to the lesser license: the complement of its characters' order."""
    return F.struct("score", F.transform(F.split("license_id", ""), lambda c: -F.ascii(c)))


def _anchors(rows: list, most: float) -> list[str]:
    """The words of a template that are left when the lightest, together below `most`, are set aside."""
    mass, rows = 0.0, sorted(rows, key=lambda r: (r.w, r.word))
    for i, r in enumerate(rows):
        mass += r.w**2
        if mass >= (most * 0.999) ** 2:
            return [x.word for x in rows[i:]]
    return []


def query(documents: DataFrame) -> DataFrame:
    """One row per document, at source/lang/(doc_id div 50)/; every tenth is a license file of its directory."""
    folder = F.floor(F.col("doc_id") / 50).cast("string")
    name = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = documents.select("doc_id", F.concat_ws("/", "source", "lang", folder, name).alias("path"), "text")
    found = scan(files.select("path", "text"))
    return files.select("doc_id", F.coalesce("path", F.lit("")).alias("path")).join(found, "path").select("doc_id", "path", "own_score", "license_id", "origin", "inherited_from")


def oracle() -> str:
    values = ", ".join("({}, '{}', '{}')".format(i, a, t.replace("'", "''")) for i, (a, t) in enumerate(TEMPLATES))
    return f"""
WITH files AS (SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id // 50 AS VARCHAR) || '/' || CASE WHEN doc_id % 10 = 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END AS path, coalesce(text, '') AS text FROM documents),
n AS (SELECT count(*) AS n FROM files),
df AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{WORD}'))) AS word FROM files) GROUP BY word),
t(template, license_id, text) AS (VALUES {values}),
tw AS (SELECT template, license_id, word, count(*) AS tf FROM (SELECT template, license_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM t) GROUP BY ALL),
tv AS (SELECT template, license_id, word, tf * (ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0) AS w FROM tw LEFT JOIN df USING (word), n),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tv GROUP BY template),
lines AS (SELECT DISTINCT path, unnest(string_split(text, chr(10))) AS line FROM files),
lw AS (SELECT line, word, count(*) AS tf FROM (SELECT line, unnest(regexp_extract_all(lower(line), '{WORD}')) AS word FROM (SELECT DISTINCT line FROM lines)) GROUP BY ALL),
lv AS (SELECT line, word, tf * (ln((n + 1.0) / (df + 1.0)) + 1.0) AS w FROM lw JOIN df USING (word), n),
ln_ AS (SELECT line, sqrt(sum(w * w)) AS norm FROM lv GROUP BY line),
dots AS (SELECT lv.line, tv.template, tv.license_id, sum(lv.w * tv.w / tn.norm) AS dot FROM lv JOIN tv USING (word) JOIN tn ON tn.template = tv.template GROUP BY ALL),
scored AS (SELECT dots.line, license_id, round(dot / norm, 6) AS score FROM dots JOIN ln_ ON ln_.line = dots.line WHERE round(dot / norm, 6) >= {LEAST}),
own AS (SELECT path, license_id AS own_license, score AS own_score FROM (SELECT path, license_id, score, row_number() OVER (PARTITION BY path ORDER BY score DESC, license_id) AS k FROM lines JOIN scored USING (line)) WHERE k = 1),
paths AS (SELECT DISTINCT path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
given AS (SELECT dir, license_id FROM (SELECT dir, own_license AS license_id, row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license) AS k FROM own JOIN paths USING (path) WHERE path LIKE '%/LICENSE-%') WHERE k = 1),
near AS (SELECT path, license_id, dir AS up, row_number() OVER (PARTITION BY path ORDER BY length(dir) DESC) AS k FROM (SELECT p.path, g.license_id, g.dir FROM paths p JOIN given g ON p.dir = g.dir OR starts_with(p.dir, g.dir || '/')))
SELECT f.doc_id, f.path, own.own_score, coalesce(own.own_license, near.license_id) AS license_id,
       CASE WHEN own.own_license IS NOT NULL THEN CASE WHEN f.path LIKE '%/LICENSE-%' THEN 'file' ELSE 'header' END WHEN near.license_id IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own.own_license IS NULL THEN near.up END AS inherited_from
FROM files f LEFT JOIN own USING (path) LEFT JOIN near ON near.path = f.path AND near.k = 1
"""
