import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import packing

from .common import documents, empty, odd_rows, repeated

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_encoder(tokenizer):
    r = random.Random(1)
    texts = ["", "  a b", " a ", "a\n\nc d", "x<|endoftext|> y <|endoftext|>", "\x1c a\x1c b", "a  b", "don't 3's", "\x00 ÿ ok", "a.b, c.. d*. e.*f\ng.\nH i.\n"]
    texts += ["".join(r.choice("ab  \n\t1'.é<| ,AB*") for _ in range(r.randint(0, 14))) for _ in range(2000)]
    got = packing.Encoder(packing.default_tokenizer()).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def pieces(df):
    rows = sorted(df.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    at = {}
    for r in rows:
        assert r["offset"] == at.get(r["sequence_id"], 0) and r["length"] > 0
        at[r["sequence_id"]] = r["offset"] + r["length"]
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
    return rows, at


@pytest.mark.parametrize("size", [2048, 32])
def test_round_trip(spark, tokenizer, size):
    rows, filled = pieces(packing.pack(documents(spark), packing.default_tokenizer(), size))
    assert max(filled.values()) <= size
    for i, text in odd_rows():
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(b"".join(r["ids"] for r in own), np.uint32).tolist() == ids
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist() and {r["doc_tokens"] for r in own} == {len(ids)}
    # all but the last window of each of the three partitions are full
    assert sum(n < size for n in filled.values()) <= 3


def test_levels():
    r = random.Random(2)
    packer = packing.SumOfSquares(16)
    done = []
    for k in range(400):
        n = r.randint(1, 15)
        before = packer.levels.copy()
        window = packer.place(n, (k, n, 0, b"", n))
        # no other level would have given a smaller sum of squares
        sums = []
        for h in range(16 - n + 1):
            if h == 0 or before[h]:
                x = before.copy()
                x[h] -= h > 0
                x[h + n] += h + n < 16
                sums.append((x[1:16] ** 2).sum())
        assert (packer.levels[1:16] ** 2).sum() == min(sums)
        if window:
            done.append(sum(p[1] for p in window[1]))
    assert set(done) == {16}


def test_open_windows_are_bounded(spark, monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "OPEN_LIMIT", 4)
    rows, filled = pieces(packing.pack(documents(spark, [(i, "w " * (i * 13 % 50)) for i in range(200)]).coalesce(1), packing.default_tokenizer(), 64))
    assert sum(r["length"] for r in rows) == sum(len(tokenizer.encode("w " * (i * 13 % 50)).ids) + 1 for i in range(200))
    assert sum(n < 64 for n in filled.values()) <= 1


def test_repeated_and_empty(spark):
    rows, _ = pieces(packing.pack(repeated(spark), packing.default_tokenizer()))
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) >= 6
    assert packing.pack(empty(spark), packing.default_tokenizer()).count() == 0


def test_padding(spark):
    df = spark.createDataFrame([(1, 2048), (2, 1024), (3, 1000)], "sequence_id long, length long")
    assert tuple(packing.padding(df.withColumn("x", F.lit(1))).first()) == (3, 4072, 1048)
