import os
import zlib

import numpy as np
import pytest
import zstandard

from quire.llm import quality

from .common import documents, empty, odd_rows, passage, repeated

SF = "/root/testdata/sf0.01"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_scores(spark):
    good = [(i, passage(i, 80)) for i in range(40)]
    bad = [(100 + i, "BUY!!! NOW$$$ " * 40 + str(i)) for i in range(40)]
    docs = documents(spark, good + bad)
    marks = labels(spark, [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (7, None, 0), (8, 5, 0), (9999, 0, 0)])
    model = quality.train(docs, marks)
    got = {r["doc_id"]: r for r in quality.score(documents(spark, [*odd_rows(), (200, passage(77, 90)), (201, "BUY!!! NOW$$$ " * 60)]), model).collect()}
    assert got[200]["predicted"] == 1 and got[201]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values()) and len(got) == len(odd_rows()) + 2
    assert got[4]["score"] == got[5]["score"] and got[1]["score"] == got[2]["score"]


def test_without_labels(spark):
    model = quality.train(documents(spark), labels(spark, [(1, 1, 0), (2, 1, 0), (3, 0, 0)]))
    scores = {r["score"] for r in quality.score(documents(spark), model).collect()}
    assert len(scores) == 1 and quality.score(repeated(spark), model).count() == 6 and quality.score(empty(spark), model).count() == 0
    assert {r["score"] for r in quality.score(documents(spark), quality.train(empty(spark), labels(spark, []))).collect()} == {0.5}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = quality.op7_quality(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_sizes_against_a_plain_reading():
    """Two sizes of each text, block by block, as zstandard gives them."""
    dicts = [b"the water and that which " * 40, b"buy now cheap pills here " * 40]
    model = quality.Model(dicts, np.array([3.0, -1.0, 0.5]))
    texts = [b"", b"the water and that", b"buy now", os.urandom(5000), ("é" * 3000).encode()]
    for t, (difference, size) in zip(texts, model.features(texts), strict=True):
        totals = []
        for d in dicts:
            press = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_dict_id=False, write_checksum=False, write_content_size=False)
            totals.append(sum(len(press.compress(t[a : a + quality.BLOCK])) for a in range(0, len(t), quality.BLOCK)))
        if t:
            assert abs(difference - (totals[1] - totals[0]) / len(t)) < 1e-9 + 8 / len(t) and abs(size - totals[0] / len(t)) < 1e-9 + 8 / len(t)
        else:
            assert difference == size == 0
    assert np.allclose(model.scores([b""]), 1 / (1 + np.exp(-0.5)))


def test_curve_against_gradient():
    """At the fitted weights the penalised likelihood is flat."""
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 2)) * [0.1, 3.0]
    y = (x[:, 0] * 10 - x[:, 1] + r.normal(size=300) > 0).astype(int)
    w = quality._fit(x, y, np.ones(300))
    p = 1 / (1 + np.exp(-(x @ w[:2] + w[2])))
    assert abs((y - p).sum()) < 1e-3 and (np.abs(((y - p)[:, None] * x).sum(axis=0) / x.std(axis=0) - 1e-2 * w[:2] * x.std(axis=0)) < 0.05).all()
