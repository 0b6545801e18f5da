import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import neighbours


def brute(rows, queries, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in good:
            scores = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q))
            out[q] = [i for _, i in scores[:k]]
    return out


def vectors(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + 0.2 * r.normal(size=8)]) for i in range(600)]
    rows += [(1000 + i, [10.0, 20.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(100)]  # a common vector
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None] + [0.0] * 6), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2005, [1.0]), (2006, []), (None, [1.0] * 8)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("node", F.lit("x")).repartition(3)


def test_recall_and_ties(spark):
    rows, df = vectors(spark)
    queries = df.filter("vec_id % 20 = 0").select("vec_id")
    found = {}
    for r in neighbours.search(df, queries).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(found[r["query_id"]])
    expected = brute(rows, [i for i, _ in rows if i is not None and i % 20 == 0], 20)
    assert set(found) == set(expected) and 2000 not in found
    hits = sum(len(set(found[q]) & set(expected[q])) for q in expected)
    assert hits >= 0.95 * 20 * len(expected)
    # equal vectors tie, the smaller ids first, the query's own left out
    assert found[1000] == list(range(1001, 1021)) and found[1080] == list(range(1000, 1020))


def test_blocks_and_windows(spark, monkeypatch):
    """With small blocks windows span several; recall stays above 0.9."""
    monkeypatch.setattr(neighbours, "BLOCKS", (16, 64))
    rows, df = vectors(spark)
    found = neighbours.search(df, df.filter("vec_id % 20 = 0").select("vec_id"), window=0.12).groupBy("query_id").agg(F.collect_list("vec_id").alias("v")).collect()
    expected = brute(rows, [i for i, _ in rows if i is not None and i % 20 == 0], 20)
    assert sum(len(set(r["v"]) & set(expected[r["query_id"]])) for r in found) >= 0.9 * 20 * len(expected)


@pytest.mark.parametrize("spread", [0.0, 0.5, 1.0])
def test_uneven_lengths(spark, monkeypatch, spread):
    """Lengths of a lognormal spread, independent coordinates, production windows, many blocks: recall of the largest inner products."""
    monkeypatch.setattr(neighbours, "BLOCKS", (16, 4096))
    r = np.random.default_rng(5)
    x = r.normal(size=(6000, 32))
    x *= (np.exp(spread * r.normal(size=6000)) / np.linalg.norm(x, axis=1))[:, None]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    found = neighbours.search(df, df.filter("vec_id % 20 = 0").select("vec_id")).collect()
    scores = x[::20] @ x.T
    scores[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :20]
    got = {}
    for row in found:
        assert abs(row["score"] - x[row["query_id"]] @ x[row["vec_id"]]) < 1e-12
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    assert sum(len(got[20 * i] & set(b.tolist())) for i, b in enumerate(best)) >= 0.9 * 20 * 300


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"]): r["score"] for r in neighbours.search(few, few.filter("vec_id % 20 = 0").select("vec_id")).collect()}
    assert got == {(0, 1, 1): 0.5, (0, 2, 20): 0.0, (20, 1, 1): 0.5, (20, 2, 0): 0.0}
    none = few.limit(0)
    assert neighbours.search(none, none.select("vec_id")).count() == 0


def test_hilbert_steps():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = neighbours.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
