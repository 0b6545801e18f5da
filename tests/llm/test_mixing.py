import collections
import re

from pyspark.sql import functions as F

from quire.llm import mixing

from .common import documents, empty, odd_rows, repeated


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Shares dealt out by weight, the excess again among those below their cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def check(rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    goal = targets(dict(sizes))
    largest = max((r["size"] for r in rows), default=0)
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 2 * largest


def test_targets_are_met(spark):
    rows = [(i, "w " * (i * 37 % 90)) for i in range(3000)]
    df = documents(spark, rows)
    check(first := mixing.mix(df).collect())
    key = lambda r: r["doc_id"]
    assert sorted(first, key=key) == sorted(mixing.mix(df.repartition(5)).collect(), key=key)
    by = collections.defaultdict(lambda: [0, 0])
    for r in first:
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    assert all(abs(a - b) <= 0.02 * b for a, b in by.values())


def test_odd_repeated_empty(spark):
    got = mixing.mix(documents(spark)).collect()
    check(got)
    assert {r["doc_id"]: r["size"] for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in odd_rows()}
    check(mixing.mix(repeated(spark)).collect())
    assert mixing.mix(empty(spark)).count() == 0
    assert {r["target"] for r in mixing.mix(documents(spark, [(1, None), (2, "")])).collect()} == {0.0}


def test_documents_are_repeated(spark):
    df = documents(spark, [(i, "w " * (i % 9 + 1)) for i in range(300)])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter({k: v for k, v in copies.items() if v})


def test_repeated_ids_have_their_own_copies(spark):
    rows = [(i // 3, f"{i} " + "w " * (i * 7 % 40)) for i in range(300)] + [(5, "same text")] * 4 + [(None, f"{i} x") for i in range(9)]
    df = documents(spark, rows).withColumn("source", F.lit("s")).withColumn("all", F.lit(1)).withColumn("first", F.lit(2)).withColumn("r_id", F.lit(3))
    taken = sum(r["taken"] for r in mixing.mix(df).collect())
    out = mixing.mixed_documents(df)
    got = out.collect()
    assert out.columns == df.columns and sum(len(r["text"].split()) for r in got) == taken
    copies = collections.Counter((r["doc_id"], r["text"]) for r in got)
    assert all(n <= 2 * rows.count(k) for k, n in copies.items())


def test_seed_and_caps_that_are_no_integers(spark):
    df = documents(spark, [(i, "w " * (i * 37 % 90)) for i in range(900)])
    copies = lambda seed: {r["doc_id"]: r["copies"] for r in mixing.mix(df, seed=seed).collect()}
    assert copies(0) != copies(1) and copies(1) == copies(1)
    got = mixing.mix(df.withColumn("source", F.lit("s")), share=2.5, most=2.5).collect()
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 180 and max(r["copies"] for r in got) == 3
