import collections
import hashlib
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import language, mixing, packing
from quire.llm.queries import ORACLES, QUERIES

from .common import documents, passage
from .test_substring import brute as brute_repeats

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda row: tuple(map(str, row))
    found = c.sql(ORACLES[name])
    order = [found.columns.index(x) for x in columns]
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=key)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append(after.count())
        docs = after
    assert seen[1] < seen[0] and seen[3] > seen[2]
    assert corpus_pipeline.run(spark, SF).count() > 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages_against_brute_force(spark):
    """Every stage on its own input, on a table of repeated, null and odd rows, with further columns of clashing names."""
    r = random.Random(4)
    a, b, c = passage(1, 60), passage(2, 60), passage(3, 60)
    near = a.split()
    near[30] = "changed"
    rows = [(0, a), (1, a), (1, b), (2, " ".join(near)), (2, c), (2, c), (None, b), (None, passage(4, 30)), (3, None), (4, ""), (5, "12 !!"), (6, c[:200] + " " + passage(5, 40)), (7, passage(6, 25) + " " + passage(6, 25))]
    rows += [(100 + i, passage(100 + i, r.randint(1, 50))) for i in range(60)]
    plain = documents(spark, rows, extra=False).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "s0").when(F.col("doc_id") % 3 == 1, "s1")).withColumn("lang", F.lit("en"))
    docs = plain.select("*", *[F.lit(1).alias(x) for x in ("gone", "stay", "all", "row", "t", "hash", "copies", "first")])
    key = lambda x: tuple(map(str, x))
    rows_of = lambda df, *names: sorted((tuple(x[n] for n in names) for x in df.collect()), key=key)

    def empty_stays_empty(stage, docs):
        assert stage(spark, docs.limit(0), SF).count() == 0

    # language: one language was learned and nothing tells it from others, so only evidence of none can reject
    two = docs.withColumn("lang", F.when(F.length("text") % 2 == 0, "en").otherwise("de"))
    model = language.train(two)
    judged = {x["doc_id"]: x for x in language.identify(two.withColumn("doc_id", F.xxhash64("text")), model, spans=False).collect()}
    texts = {x["h"]: x["text"] for x in two.select("text", F.xxhash64("text").alias("h")).collect()}
    good = {texts[h] for h, x in judged.items() if x["lang_pred"] != "und" and x["evidence"] >= language.LEAST_EVIDENCE}
    kept = corpus_pipeline.language_id(spark, two, SF)
    assert kept.columns == two.columns and good and rows_of(kept, "doc_id", "text") == sorted(((i, t) for i, t in rows if t in good), key=key)
    empty_stays_empty(corpus_pipeline.language_id, two)

    # near copies: groups by all pairs; the row of the smallest id stays, one of rows alike in id and text
    sets = [({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())) for w in (words(t.lower() if t else t) for _, t in rows)]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i) if sets[i] else ("none", i), []).append(rows[i])
    least = sorted((min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()), key=key)
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns and rows_of(kept, "doc_id", "text") == least
    empty_stays_empty(corpus_pipeline.near_dedup, docs)

    # repeated passages
    once = [(x["doc_id"], x["text"]) for x in kept.collect() if x["doc_id"] is not None]
    cut = rows_of(corpus_pipeline.substring_dedup_stage(spark, kept.filter("doc_id is not null"), SF), "doc_id", "text")
    want = brute_repeats(once, 20)
    assert [i for i, _ in cut] == sorted((i for i, (n, gone, _) in want.items() if not gone or gone < n), key=lambda x: key((x, 0)))
    assert all(hashlib.sha256(" ".join(words(t)).encode()).hexdigest() == want[i][2] for i, t in cut)
    empty_stays_empty(corpus_pipeline.substring_dedup_stage, docs)

    # mixing: as many copies of a text as mix() takes
    taken = collections.Counter()
    for x in mixing.mix(docs).collect():
        taken[x["doc_id"], x["source"], x["size"]] += x["copies"]
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns
    got = collections.Counter((x["doc_id"], x["source"], len(words(x["text"]))) for x in mixed.collect())
    assert got == +taken and sum(k[2] * n for k, n in got.items()) == sum(k[2] * n for k, n in taken.items())
    empty_stays_empty(corpus_pipeline.mix_sources, docs)

    # packing: every document's ids, once
    pieces = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    encode = Tokenizer.from_file(packing.default_tokenizer()).encode
    want = sorted((str(i), len(encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    assert sorted((str(p["doc_id"]), p["doc_tokens"]) for p in pieces if p["start"] == 0) == want and sum(p["length"] for p in pieces) == sum(n for _, n in want)
    empty_stays_empty(corpus_pipeline.pack_sequences, docs)


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    want = collections.Counter((r["doc_id"], r["doc_tokens"]) for r in docs.collect() if r["start"] == 0)
    assert collections.Counter((r["doc_id"], r["doc_tokens"]) for r in corpus_pipeline.run(spark, SF).collect() if r["start"] == 0) == want
