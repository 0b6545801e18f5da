import collections
import math

from pyspark.sql import functions as F

from quire.llm import licences as L

MIT = "Released under the MIT License."
ROWS = [
    ("repo/LICENSE", MIT), ("repo/a.txt", "no words of that kind"), ("repo/sub/b.txt", None), ("repo/sub/deep/c.txt", ""), ("repo/sub/COPYING.md", "Licensed under the Apache License, Version 2.0."),
    ("repo/d.txt", "some text\nLicensed under CC BY-NC 4.0.\nmore " + "text " * 40), ("repo/e.txt", "Licensed under CC BY 4.0.\n" + "text " * 40), ("other/f.txt", "x"), ("g.txt", "y"), (None, MIT),
    ("repo2/short.txt", f"hi\n{MIT}"), ("repo2/h.txt", "z"), ("repo/d.txt", "repeated path"), ("repo3/i.txt", "the license of the mit is under released"), ("repo3/j.txt", "w " * 50000 + "\n" + MIT),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "path string, text string").withColumn("line", F.lit("x")).withColumn("score", F.lit(1)).withColumn("dir", F.lit("q")).repartition(3)


def test_statements_and_inheritance(spark):
    out = L.scan(table(spark))
    assert out.count() == len(ROWS)
    got = {(r["path"]): (r["own_licence"], r["licence"], r["basis"], r["licence_path"]) for r in out.collect() if r["path"] != "repo/d.txt"}
    assert got["repo/LICENSE"] == ("MIT", "MIT", "file", "repo/LICENSE")
    assert got["repo/a.txt"] == (None, "MIT", "directory", "repo/LICENSE")
    assert got["repo/sub/b.txt"] == got["repo/sub/deep/c.txt"] == (None, "Apache-2.0", "directory", "repo/sub/COPYING.md")
    assert got["repo/e.txt"][:3] == ("CC-BY-4.0", "CC-BY-4.0", "statement")
    assert got["other/f.txt"] == got["g.txt"] == got[None] == (None, None, "none", None)
    assert got["repo2/short.txt"][2] == "file" and got["repo2/h.txt"] == (None, "MIT", "directory", "repo2/short.txt")
    assert got["repo3/j.txt"][:3] == ("MIT", "MIT", "statement")
    assert {r["own_licence"] for r in out.filter("path = 'repo/d.txt'").collect()} == {"CC-BY-NC-4.0"}


def test_cosine(spark):
    files = [(p, t) for p, t in ROWS if p and p != "repo/d.txt"]
    n = len(ROWS)
    has = [set(L.terms(t or "")) for _, t in ROWS]
    idf = {t: math.log((1 + n) / (1 + sum(t in h for h in has))) + 1 for t in L.vocabulary()}
    unseen = math.log(1 + n) + 1
    vec = lambda s: {t: k * idf.get(t, unseen) for t, k in collections.Counter(L.terms(s)).items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    got = {r["path"]: (r["own_licence"], r["own_score"]) for r in L.scan(table(spark)).collect()}
    for path, text in files:
        best = None
        for line in (text or "").split("\n"):
            v = vec(line)
            for name, s in L.TEMPLATES:
                t = vec(s)
                c = round(sum(w * t.get(k, 0) for k, w in v.items()) / (norm(v) * norm(t)), 6) if v else 0
                if c >= L.THRESHOLD and (best is None or c > best[1]):
                    best = name, c
        assert got[path] == (best or (None, None))


def test_key_terms_bound():
    vectors, _ = L.weights(1000, {t: 900 for t in ("the", "of", "this", "and", "under")})
    keys = set(L.key_terms(vectors, L.THRESHOLD))
    for v in vectors:
        rest = sum(w * w for t, w in v.items() if t not in keys)
        assert rest < L.THRESHOLD**2 * sum(w * w for w in v.values())


def test_empty(spark):
    assert L.scan(table(spark).limit(0)).count() == 0


HEADER = """/*
 * This program is free software; you can redistribute it
 * and/or modify it under the terms of the GNU General
 * Public License as published by the Free Software
 * Foundation; either version 2 of the License, or (at
 * your option) any later version.
 */
int main() { return 0; }
"""
APACHE = "Licensed under the Apache License, Version 2.0."


def test_windows_texts_and_identifiers(spark):
    """Statements beside other words or over several lines, full texts and identifiers, and what they pass on."""
    texts = dict(L.TEXTS)
    wrapped = "\n".join(" ".join(texts["MIT"].split()[at : at + 9]) for at in range(0, 200, 9))
    rows = [
        ("a/x.c", "// Released under the MIT License. Copyright 2020 Jane Roe and contributors"), ("b/x.c", f"These pages describe a machine that sorts post. {APACHE} Its authors keep a list of stations and of their trains."),
        ("c/x.c", "# SPDX-License-Identifier: Apache-2.0\n" + "code " * 60), ("c/y.c", "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) \n"), ("c/z.c", "/* SPDX-License-Identifier: GPL-3.0-or-later */"),
        ("d/x.c", HEADER + "code " * 300), ("e/LICENSE", wrapped), ("e/deep/er/x.c", "code"), ("f/words.txt", texts["GPL-3.0"]), ("f/deep/x.c", "code"), ("g/words.txt", texts["LGPL-3.0"]),
        ("h/x.c", "nothing of a licence, " * 20), ("i/words.txt", texts["BSD-2-Clause"].replace("\n", "\n * ")), ("j/words.txt", texts["BSD-3-Clause"]), ("k/words.txt", texts["CC0-1.0"]),
        ("l/x.c", wrapped + "code " * 3000), ("l/y.c", "code"),
    ]
    got = {r["path"]: (r["own_licence"], r["licence"], r["basis"]) for r in L.scan(table(spark, rows)).collect()}
    assert got["a/x.c"][0] == "MIT" and got["b/x.c"][0] == "Apache-2.0" and got["b/x.c"][2] == "statement"
    assert got["c/x.c"] == ("Apache-2.0", "Apache-2.0", "statement") and got["c/y.c"][0] == "MIT OR GPL-2.0-only" and got["c/z.c"][0] == "GPL-3.0"
    assert got["d/x.c"] == ("GPL-2.0", "GPL-2.0", "statement")
    assert got["e/LICENSE"] == ("MIT", "MIT", "file") and got["e/deep/er/x.c"] == (None, "MIT", "directory")
    assert got["f/words.txt"] == ("GPL-3.0", "GPL-3.0", "file") and got["f/deep/x.c"] == (None, "GPL-3.0", "directory")
    assert got["g/words.txt"][0] == "LGPL-3.0" and got["h/x.c"] == (None, None, "none")
    assert got["i/words.txt"] == ("BSD-2-Clause",) * 2 + ("file",) and got["j/words.txt"] == ("BSD-3-Clause",) * 2 + ("file",) and got["k/words.txt"][0] == "CC0-1.0"
    assert got["l/x.c"] == ("MIT", "MIT", "statement") and got["l/y.c"] == (None, None, "none")
