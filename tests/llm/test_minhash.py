import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import minhash as M
from quire.llm.components import components

from .common import documents, empty, odd_rows, passage, repeated


def brute(rows, width):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[a : a + width]) for a in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def run(df, width=4):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in M.near_duplicates(df, width).collect()}


def test_odd_texts(spark):
    assert run(documents(spark)) == brute(odd_rows(), 4)


def family(seed, n, words, most):
    """Copies of one text with words changed, so that many pairs lie near the threshold."""
    r = random.Random(seed)
    base = passage(seed, words).split()
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = f"n{r.randint(0, 40)}"
        yield " ".join(w)


@pytest.mark.parametrize("block, whole", [(8, 1 << 22), (1024, 1 << 22), (1024, 3000)])
def test_families(spark, monkeypatch, block, whole):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "BLOCK_SHINGLES", whole)
    texts = [t for seed, words in ((1, 60), (2, 90), (3, 400), (4, 900)) for t in family(seed, 40, words, words // 15)] + [passage(100 + i, 50) for i in range(20)]
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    assert run(documents(spark, rows)) == brute(rows, 4)


def test_repeated_and_empty(spark):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"], r["kept"], r["n_shingles"]) for r in M.near_duplicates(repeated(spark), 4).collect()), key=str)
    assert [x[:4] for x in got if not x[0]] == [(False, 1, 1, True)] * 3 + [(False, 2, 1, False)]
    # a row without an id is a copy like others, but without words a document of its own
    assert sorted((x[2:] for x in got if x[0]), key=str) == [(1, False, 37), (None, True, 0)]
    assert M.near_duplicates(empty(spark)).count() == 0


def test_rows_without_ids(spark):
    a, b = passage(11, 40), passage(12, 40)
    got = [(r["component_id"], r["kept"]) for r in M.near_duplicates(documents(spark, [(None, a), (None, a), (None, b)]), 4).collect()]
    assert sorted(got, key=str) == [(None, False), (None, True), (None, True)]


def test_deduplicated_rows(spark):
    a, b, c = passage(11, 40), passage(12, 40), passage(13, 40)
    rows = [(0, a), (1, a), (1, b), (2, c), (2, c), (None, c), (None, None), (3, ""), (3, ""), (None, b + " " + c)]
    df = documents(spark, rows).withColumn("gone", F.lit(1)).withColumn("stay", F.lit(2)).withColumn("all", F.lit(3))
    out = M.deduplicated(df)
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(0, a), (1, b), (2, c), (None, None), (3, ""), (3, ""), (None, b + " " + c)], key=str)
    assert M.deduplicated(empty(spark)).count() == 0


def thue_morse(n):
    """Words on which every polynomial modulo a power of two has one value."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_alike_to_polynomials(spark):
    one, two = thue_morse(10)
    rows = [(1, f"x {one} y z"), (2, f"x {two} y z"), (3, f"x {one} y z")]
    assert run(documents(spark, rows)) == brute(rows, 4)


def test_shared_counts_and_forest():
    r = random.Random(5)
    sets = [np.array(sorted(r.sample(range(300), r.randint(1, 120))), np.uint64) for _ in range(70)]
    sets += [np.arange(1000, 1400, dtype=np.uint64)] * 2
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got = M.shared_counts(sets)
    np.fill_diagonal(got, [len(s) for s in sets])
    assert got.tolist() == want
    linked = np.zeros((9, 9), bool)
    for a, b in [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 6), (6, 3), (7, 3)]:
        linked[a, b] = linked[b, a] = True
    edges = M.forest(linked)
    assert len(edges) == 6 and all(linked[e] for e in edges) and {v for _, v in edges} | {0, 3} == set(range(8))


def test_densified_bins_agree_as_similarity():
    r = random.Random(3)
    for size in (20, 100, 1000):
        agree = []
        for _ in range(40):
            union = [r.getrandbits(64) for _ in range(size)]
            a, b = np.array(sorted(union[: int(0.9 * size)]), np.uint64), np.array(sorted(union[size // 10 :]), np.uint64)
            s = M.signatures([a, b])
            agree.append((s[0] == s[1]).mean())
        assert abs(np.mean(agree) - 0.8) < 0.06


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5), (None, 3)]
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root}
