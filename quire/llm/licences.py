"""Licence scan: sparse TF-IDF cosine of files, windows of terms and lines to templates, then inheritance from directories.

The document frequencies of the templates' terms are counted over all files; a term of no template weighs as one that no
file has. What reaches the cosine THRESHOLD with a template states that licence: the whole file with a full text of
``texts`` that is no shorter than FILE_SHARE of it (terms weighed by one and the logarithm of their count), every window of as many terms as a statement or a short
full text has, wherever its lines end, and every line. An SPDX identifier states what it names. By Cauchy and Schwarz a
window or line can reach the threshold only if it shares one of the template's key terms: its heaviest, up to the point
where what is left has a norm below THRESHOLD of the whole; and only if the squared weights of the template's terms that
it has are THRESHOLD squared of all. For lines, files without any key term are passed over by one pattern; for windows
and whole files, templates of whose terms a file has too few by the second bound. What these exact filters leave is
compared.

A licence file is one with such a name, one that is a full text as a whole, or one with at least FILE_SHARE of its words
in lines or windows that state its licence. It covers its directory and those below. A file that states no licence has
that of the nearest directory above it that a licence file covers, by joins on paths. DataFrame functions only.
"""

from __future__ import annotations

import json
import math
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm._store import settled

THRESHOLD, FILE_SHARE = 0.7, 0.5
TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
WORD = r"[^\x20\x09-\x0D]+"
FILE_NAME = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"

# Statements by which licences are known, as (licence, statement).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("proprietary", "All rights reserved."),
]

# Statements and titles that are looked for in windows only.
STATEMENTS = [
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
]
#: Full texts, each a file named for its licence; the short ones are looked for in windows too.
TEXTS = [(f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "texts").glob("*.txt"))]
SHORT = 300
#: A term is rare that at most one file of so many has; this speeds the filter and changes no result.
RARE = 20
SPDX = r"SPDX-License-Identifier:\s*\(*([A-Za-z0-9.+-]+(?:\)*\s+(?:AND|OR|WITH)\s+\(*[A-Za-z0-9.+-]+)*)"
#: What a file states, the more telling first.
WHOLE, TEXT, LINE, PART = range(4)


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def vocabulary() -> list[str]:
    return sorted({t for _, s in TEMPLATES for t in terms(s)})


def wide_vocabulary() -> list[str]:
    return sorted({t for _, s in TEMPLATES + STATEMENTS + TEXTS for t in terms(s)})


def _terms_of(text: str):
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _known(found):
    """Distinct terms of ``found`` that some template or full text has."""
    return F.array_intersect(found, F.split(F.lit(" ".join(wide_vocabulary())), " "))


def frequencies(files: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of files and how many have each term of the templates and full texts: a row for each such term."""
    own = _known(_terms_of("text"))
    counts = files.select(F.explode(F.array_append(own, F.lit("")).alias("t")).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()
    found = {r["t"]: r["n"] for r in counts}
    return found.pop("", 0), found


def weights(n_files: int, found: dict[str, int]) -> tuple[list[dict[str, float]], float]:
    """The templates' vectors, and the weight of a term of none."""
    idf = lambda t: math.log((1 + n_files) / (1 + found.get(t, 0))) + 1
    vectors = []
    for _, s in TEMPLATES:
        own = terms(s)
        vectors.append({t: own.count(t) * idf(t) for t in own})
    return vectors, math.log(1 + n_files) + 1


def rules(n_files: int, found: dict[str, int]) -> list[tuple[int, str, int, int, dict[str, float]]]:
    """(rule, licence, kind, length in terms, vector) of what windows and whole files are compared with."""
    idf = lambda t: math.log((1 + n_files) / (1 + found.get(t, 0))) + 1
    made = []
    for kind, (name, s) in [*[(WHOLE, x) for x in TEXTS], *[(TEXT, x) for x in TEXTS if len(terms(x[1])) <= SHORT], *[(PART, x) for x in TEMPLATES + STATEMENTS]]:
        own = terms(s)
        made.append((len(made), name, kind, len(own), {t: (1 + math.log(own.count(t)) if kind == WHOLE else own.count(t)) * idf(t) for t in sorted(set(own))}))
    return made


def key_terms(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    keys = set()
    for v in vectors:
        left, whole = sum(w * w for w in v.values()), sum(w * w for w in v.values())
        for t, w in sorted(v.items(), key=lambda x: (-x[1], x[0])):
            if left < (threshold * threshold - 1e-9) * whole:
                break
            keys.add(t)
            left -= w * w
    return sorted(keys)


def _fewest(vector: dict[str, float], need: float, rare: set[str]) -> int:
    """How many rare terms a file must have of a vector to hold ``need`` of its squares, even with all the others."""
    need -= sum(w * w for t, w in vector.items() if t not in rare)
    squares, n = sorted((w * w for t, w in vector.items() if t in rare), reverse=True), 0
    while need > 0 and n < len(squares):
        need, n = need - squares[n], n + 1
    return n


def _compared(files: DataFrame, made: list, n_files: int, found: dict[str, int], threshold: float) -> DataFrame:
    """path, id, words, kind, rule, name, score, at, n: the whole files and windows (from term ``at``, ``n`` terms) that reach the threshold. files: (path, text)."""
    spark = files.sparkSession
    need = {r: (threshold * threshold - 1e-9) * sum(w * w for w in v.values()) for r, _, _, _, v in made}
    rare = {t for t in wide_vocabulary() if RARE * found.get(t, 0) <= n_files}
    rule = [{"rule": r, "kind": kind, "n": n, "need": need[r], "fewest": _fewest(v, need[r], rare), "own": [{"term": t, "sq": w * w} for t, w in v.items()], "keys": key_terms([v], threshold)} for r, _, kind, n, v in made]
    schema = "rule int, kind int, n int, need double, fewest int, own array<struct<term:string,sq:double>>, keys array<string>"
    names = spark.createDataFrame([(r, name, math.sqrt(sum(w * w for w in v.values()))) for r, name, _, _, v in made], "rule int, name string, norm double")
    entries = spark.createDataFrame([(r, t, w) for r, _, _, _, v in made for t, w in v.items()], "rule int, term string, weight double")
    idf = spark.createDataFrame([(t, math.log((1 + n_files) / (1 + found.get(t, 0))) + 1) for t in wide_vocabulary()], "term string, idf double")
    every = F.from_json(F.lit(json.dumps(rule)), "array<struct<rule:int,n:int,kind:int,need:double,fewest:int,own:array<struct<term:string,sq:double>>>>")
    held = lambda own, has: F.aggregate(own, F.lit(0.0), lambda a, e: a + F.when(F.array_contains(has, e["term"]), e["sq"]).otherwise(0.0))
    rows = files.filter("path is not null").select("path", "text", _terms_of("text").alias("terms")).withColumn("known", _known(F.col("terms")))
    rows = rows.withColumn("rare", F.array_intersect("known", F.split(F.lit(" ".join(sorted(rare))), " ")))
    # a text fills no file of more terms than this; a window may lie anywhere
    could = lambda x: ((x["kind"] != WHOLE) | (FILE_SHARE * F.size("terms") <= x["n"])) & (F.size("rare") >= x["fewest"])
    fits = F.transform(F.filter(every, lambda x: could(x) & (held(x["own"], F.col("known")) >= x["need"])), lambda x: x["rule"])
    # outer: of an inner one Spark takes the filter apart and reads the terms anew for each comparison
    rows = rows.select("path", "text", "terms", F.explode_outer(fits).alias("rule")).filter("rule is not null")
    # written: read three times below, and few rows
    rows = settled(rows.select("path", F.xxhash64("path", "text").alias("id"), F.regexp_count("text", F.lit(WORD)).alias("words"), "terms", "rule"), "candidates")
    rows = rows.join(F.broadcast(spark.createDataFrame(rule, schema)), "rule").select("path", "id", "words", "terms", F.struct("rule", "kind", "n", "need", "own", "keys").alias("r"))
    size = F.size("terms")
    at = F.filter(F.transform("terms", lambda x, i: F.when(F.array_contains("r.keys", x), i)), lambda i: i.isNotNull())
    # every window that holds a key term; a text shorter than a window is one
    last = F.greatest(size - F.col("r.n"), F.lit(0))
    starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.least(F.greatest(i - F.col("r.n") + 1, F.lit(0)), last), F.least(i, last)))))
    parts = rows.filter(F.col("r.kind") != WHOLE).select("path", "id", "terms", "r", F.explode(starts).alias("at")).select("path", "id", "r", "at", F.slice("terms", F.col("at") + 1, F.col("r.n")).alias("terms"))
    parts = parts.filter(held(F.col("r.own"), F.col("terms")) >= F.col("r.need"))
    units = parts.unionByName(rows.filter(F.col("r.kind") == WHOLE).select("path", "id", "r", F.lit(0).alias("at"), "terms"))
    key = ["path", "id", "rule", "at"]
    tf = units.select("path", "id", F.col("r.rule").alias("rule"), F.col("r.kind").alias("kind"), "at", F.size("terms").alias("n"), F.explode("terms").alias("term")).groupBy(*key, "kind", "n", "term").agg(F.count("*").alias("tf"))
    # rows that repeat a path and a text count their terms twice: not so where the count's logarithm is taken
    copies = rows.groupBy("path", "id", F.col("r.rule").alias("rule")).agg(F.count("*").alias("copies"), F.max("words").alias("words"))
    counted = tf.join(copies, ["path", "id", "rule"]).withColumn("tf", F.col("tf") / F.col("copies"))
    unseen = math.log(1 + n_files) + 1
    weighed = counted.join(F.broadcast(idf), "term", "left").withColumn("w", F.when(F.col("kind") == WHOLE, 1 + F.log("tf")).otherwise(F.col("tf")) * F.coalesce("idf", F.lit(unseen)))
    weighed = weighed.join(F.broadcast(entries), ["rule", "term"], "left")
    sums = weighed.groupBy(*key, "kind", "n", "words").agg(F.sum(F.col("w") * F.coalesce("weight", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    scored = sums.join(F.broadcast(names), "rule").withColumn("score", F.round(F.col("dot") / (F.col("length") * F.col("norm")), 6))
    return scored.filter(F.col("score") >= threshold).select("path", "id", "words", "kind", "rule", "name", "score", "at", "n")


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """path, own_licence, own_score, licence, basis, licence_path of each row. files: (path, text).

    own_licence: null if nothing reaches the threshold, else of the first of these that does: the whole file, a window of
    a full text, a line or SPDX identifier, a window of a statement; of several the one most like a template (ties: the
    first place, then the first template); own_score: its cosine, 1 for an identifier. An expression of several
    identifiers is given as it stands, with one space between its parts; the endings -only and -or-later go from the
    names of known licences. licence: own_licence, or what the nearest covered directory above gives. basis:
    statement, file, directory or none; licence_path: the file that states it. Of several licence files of a directory
    the one with the highest score covers it, ties to the first path. Null text states nothing. A null path lies in no
    directory. Repeated rows are scanned each; rows that repeat a path state what the best of them states. An empty table
    gives no rows. Other columns are not looked at. Every term and line of a text of any length is scanned.
    """
    spark = files.sparkSession
    files = files.select("path", F.coalesce("text", F.lit("")).alias("text"))
    n_files, found = frequencies(files)
    vectors, unseen = weights(n_files, found)
    names = spark.createDataFrame([(i, name, math.sqrt(sum(w * w for w in v.values()))) for i, ((name, _), v) in enumerate(zip(TEMPLATES, vectors, strict=True))], "template int, name string, norm double")
    entries = spark.createDataFrame([(t, i, w) for i, v in enumerate(vectors) for t, w in sorted(v.items())], "term string, template int, weight double")
    idf = spark.createDataFrame([(t, math.log((1 + n_files) / (1 + found.get(t, 0))) + 1) for t in vocabulary()], "term string, idf double")
    keys = "|".join(re.escape(k) for k in sorted(key_terms(vectors, threshold), key=lambda k: (-len(k), k)))
    maybe = F.coalesce(F.lower("text").rlike(f"(?<![a-z0-9])(?:{keys})(?![a-z0-9])"), F.lit(False))
    hits = files.filter(maybe & F.col("path").isNotNull()).withColumn("words", F.regexp_count("text", F.lit(WORD)))
    lines = hits.select("path", "words", F.posexplode(F.split("text", "\n")).alias("line", "said")).filter(F.lower("said").rlike(f"(?<![a-z0-9])(?:{keys})(?![a-z0-9])"))
    lines = settled(lines.withColumn("id", F.xxhash64("path", "line", "said")), "lines")
    tf = lines.select("path", "id", "line", F.explode(F.regexp_extract_all(F.lower("said"), F.lit(TERM), F.lit(0))).alias("term")).groupBy("path", "id", "line", "term").agg(F.count("*").alias("tf"))
    # rows that repeat a path and a line count their terms twice, which changes no cosine
    # entries and idf: a row for each term of a template
    weighed = tf.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    norms = weighed.groupBy("path", "id", "line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("line_norm"))
    dots = weighed.join(F.broadcast(entries), "term").groupBy("path", "id", "line", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["path", "id", "line"]).join(F.broadcast(names), "template").withColumn("score", F.round(F.col("dot") / (F.col("line_norm") * F.col("norm")), 6))
    stated = scored.filter(F.col("score") >= threshold)
    best = Window.partitionBy("path", "id", "line").orderBy(F.desc("score"), "template")
    stated = stated.withColumn("rank", F.row_number().over(best)).filter("rank = 1").join(lines.select("path", "id", "line", "words", "said").distinct(), ["path", "id", "line"])
    by_line = stated.groupBy("path").agg(
        F.min(F.struct((-F.col("score")).alias("less"), "line", "template", "name")).alias("top"),
        F.collect_list(F.struct("name", F.regexp_count("said", F.lit(WORD)).alias("n"))).alias("said"), F.max("words").alias("words"),
    )
    in_statement = F.aggregate(F.filter("said", lambda x: x["name"] == F.col("top.name")), F.lit(0), lambda a, x: a + x["n"])
    line_file = in_statement >= FILE_SHARE * F.col("words")
    claims = by_line.select("path", F.lit(LINE).alias("kind"), "top.less", F.col("top.line").alias("place"), F.col("top.template").alias("rule"), F.col("top.name").alias("name"), line_file.alias("file"))
    # identifiers, one for each line that has one
    tagged = files.filter(F.col("path").isNotNull() & F.col("text").contains("SPDX-License-Identifier")).select("path", F.regexp_count("text", F.lit(WORD)).alias("words"), F.explode(F.split("text", "\n")).alias("said")).filter(F.col("said").contains("SPDX-License-Identifier"))
    tag = F.regexp_replace(F.regexp_replace(F.regexp_extract("said", SPDX, 1), r"\)*\s+", " "), r" \(+", " ")
    plain = F.regexp_replace(tag, r"^(L?GPL-[0-9.]+)-(?:only|or-later)$", "$1")
    tagged = tagged.select("path", "words", plain.alias("name"), F.regexp_count("said", F.lit(WORD)).alias("n")).filter("name <> ''")
    tags = tagged.groupBy("path", "name").agg((F.sum("n") >= FILE_SHARE * F.max("words")).alias("file"))
    claims = claims.unionByName(tags.select("path", F.lit(LINE).alias("kind"), F.lit(-1.0).cast("double").alias("less"), F.lit(-1).alias("place"), F.lit(-1).alias("rule"), "name", "file"))
    parts = settled(_compared(files, rules(n_files, found), n_files, found, threshold), "windows")
    most = Window.partitionBy("path", "id", "name")
    # the terms of a licence's best windows, against the words of its file
    full = parts.withColumn("most", F.max("score").over(most)).filter("score = most").groupBy("path", "id", "words", "name").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1))))).alias("covered")
    )
    full = full.filter(F.col("covered") >= FILE_SHARE * F.col("words")).select("path", "name").distinct()
    found_parts = parts.select("path", "kind", (-F.col("score")).alias("less"), F.col("at").alias("place"), "rule", "name", (F.col("kind") == WHOLE).alias("file"))
    claims = claims.unionByName(found_parts)
    own = claims.groupBy("path").agg(F.min(F.struct("kind", "less", "place", "rule", "name")).alias("top"), F.collect_set(F.when(F.col("file"), F.col("name"))).alias("as_file"))
    own = own.join(full.groupBy("path").agg(F.collect_set("name").alias("filled")), "path", "left")
    # a path's last part; what is before it is the directory
    directory = lambda p: F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise("")
    named = F.regexp_extract("path", "([^/]*)$", 1).rlike(FILE_NAME)
    is_file = named | F.array_contains("as_file", F.col("top.name")) | F.coalesce(F.array_contains("filled", F.col("top.name")), F.lit(False))
    own = settled(own.select("path", F.col("top.name").alias("own_licence"), (-F.col("top.less")).alias("own_score"), is_file.alias("is_file"), directory(F.col("path")).alias("dir")), "statements")
    covered = own.filter("is_file").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("less"), "path", "own_licence")).alias("top"))
    covered = covered.select(F.col("dir").alias("above"), F.col("top.own_licence").alias("dir_licence"), F.col("top.path").alias("dir_path"))
    places = files.filter("path is not null").select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    chain = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    reach = places.select("dir", F.posexplode(chain).alias("depth", "above")).join(covered, "above")
    nearest = reach.groupBy("dir").agg(F.max(F.struct("depth", "dir_licence", "dir_path")).alias("top")).select("dir", "top.dir_licence", "top.dir_path")
    here = files.select("path", directory(F.col("path")).alias("dir"))
    base = here.join(own.drop("dir"), "path", "left")
    # directories of more than a thousandth of all files, of which there are fewer than a thousand, are sent to their files
    large = settled(here.groupBy("dir").agg(F.count("*").alias("n")).filter(F.col("n") * 1000 > n_files).select("dir"), "large")
    given = settled(nearest.join(F.broadcast(large), "dir", "left_semi"), "given")
    out = base.join(F.broadcast(large), "dir", "left_semi").join(F.broadcast(given), "dir", "left").unionByName(base.join(F.broadcast(large), "dir", "left_anti").join(nearest, "dir", "left"))
    return out.select(
        "path", "own_licence", "own_score", F.coalesce("own_licence", "dir_licence").alias("licence"),
        F.when(F.col("own_licence").isNotNull(), F.when(F.col("is_file"), "file").otherwise("statement")).when(F.col("dir_licence").isNotNull(), "directory").otherwise("none").alias("basis"),
        F.when(F.col("own_licence").isNotNull(), F.col("path")).otherwise(F.col("dir_path")).alias("licence_path"),
    )


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of the directories source/lang."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))
    return scan(docs.select(path.alias("path"), "text"))


def _values() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quote(name)}, {quote(s)})" for i, (name, s) in enumerate(TEMPLATES))


OP9_SQL = rf"""
WITH templates(template, name, said) AS (VALUES {_values()}),
files AS (SELECT concat_ws('/', coalesce(source, '_'), coalesce(lang, '_'), coalesce(doc_id::VARCHAR, '_')) AS path, coalesce(source, '_') || '/' || coalesce(lang, '_') AS dir, coalesce(source, '_') AS parent, coalesce(text, '') AS text FROM documents),
total AS (SELECT count(*) AS n FROM files),
entries AS (SELECT template, name, term, count(*) AS tf FROM (SELECT template, name, unnest(regexp_extract_all(lower(said), '{TERM}')) AS term FROM templates) GROUP BY ALL),
words AS (SELECT DISTINCT path, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM files),
idf AS (SELECT term, ln((1 + any_value(n)) / (1 + count(path))::DOUBLE) + 1 AS idf FROM (SELECT DISTINCT term FROM entries) e LEFT JOIN words USING (term), total GROUP BY term),
lines AS (SELECT path, len(regexp_extract_all(text, '{WORD}')) AS words, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files),
tf AS (SELECT path, line, term, count(*) AS tf FROM (SELECT path, line, unnest(regexp_extract_all(lower(said), '{TERM}')) AS term FROM lines) GROUP BY ALL),
weighed AS (SELECT path, line, term, tf * coalesce(idf, ln(1 + n) + 1) AS w FROM tf LEFT JOIN idf USING (term), total),
norms AS (SELECT path, line, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
weights AS (SELECT template, name, term, tf * idf AS weight FROM entries JOIN idf USING (term)),
template_norms AS (SELECT template, sqrt(sum(weight * weight)) AS template_norm FROM weights GROUP BY template),
scored AS (SELECT path, line, template, any_value(name) AS name, round(sum(w * weight) / (any_value(norm) * any_value(template_norm)), 6) AS score FROM weighed JOIN weights USING (term) JOIN norms USING (path, line) JOIN template_norms USING (template) GROUP BY path, line, template),
stated AS (SELECT * FROM scored WHERE score >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY path, line ORDER BY score DESC, template) = 1),
tops AS (SELECT path, arg_min(name, (-score, line, template)) AS own_licence, max(score) AS own_score FROM stated GROUP BY path),
shares AS (SELECT path, sum(len(regexp_extract_all(said, '{WORD}'))) AS n, any_value(words) AS words FROM stated JOIN lines USING (path, line) JOIN tops USING (path) WHERE name = own_licence GROUP BY path),
own AS (SELECT path, own_licence, own_score, n >= {FILE_SHARE} * words AS is_file FROM tops JOIN shares USING (path)),
covered AS (SELECT dir, arg_min(own_licence, (-own_score, path)) AS licence, arg_min(path, (-own_score, path)) AS from_path FROM own JOIN files USING (path) WHERE is_file GROUP BY dir)
SELECT path, own_licence, own_score, coalesce(own_licence, licence) AS licence,
  CASE WHEN own_licence IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'statement' END WHEN licence IS NOT NULL THEN 'directory' ELSE 'none' END AS basis,
  CASE WHEN own_licence IS NOT NULL THEN path ELSE from_path END AS licence_path
FROM files LEFT JOIN own USING (path) LEFT JOIN covered USING (dir)
"""
