import os
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quire.llm import language

from .common import documents, empty, odd_rows, repeated

SF = "/root/testdata/sf0.001"


def slow_viterbi(scores, penalty):
    n, k = scores.shape
    best, back = scores[0].copy(), []
    for t in range(1, n):
        step = best[None, :] - penalty * (1 - np.eye(k))
        back.append(step.argmax(axis=1))
        best = step.max(axis=1) + scores[t]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:], strict=False))
    return path[::-1], value


def test_viterbi():
    r = np.random.default_rng(1)
    lengths = [1, 7, 0, 30, 3, 600, 2]
    scores = r.normal(size=(sum(lengths), 3)).astype(np.float32)
    offs = np.append(0, np.cumsum(lengths))
    got = language.viterbi(scores, offs, 2.0)
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        if b > a:
            path, value = slow_viterbi(scores[a:b].astype(float), 2.0)
            assert abs(value(path) - value(got[a:b].tolist())) < 1e-3


def training(spark):
    en, de = "the and of with that this which water", "der und die das nicht wasser über schön"
    rows = [(i, (en if i % 2 else de) + " " + " ".join((en if i % 2 else de).split()[: i % 7 + 1])) for i in range(1, 60)]
    df = documents(spark, rows)
    return df.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))


def test_spans_and_odd_texts(spark):
    model = language.train(training(spark))
    assert model.langs == ["de", "en"]
    mixed = "the water and that which this with " * 2 + "der und die nicht schön das wasser über"
    rows = [*odd_rows(), (90, mixed), (91, "123 456 !!"), (92, "привет мир"), (93, "и the и")]
    got = {r["doc_id"]: r for r in language.identify(documents(spark, rows), model).collect()}
    for i in (4, 5, 6, 15, 91):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["spans"]) == ("und", 0.0, [])
    assert [s["lang"] for s in got[90]["spans"]] == ["en", "de"] and got[90]["spans"][1]["first_word"] == 14
    assert got[90]["lang_pred"] == "en" and 0.5 < got[90]["score"] < 1
    assert got[92]["lang_pred"] in ("de", "en") and 0 <= got[92]["score"] <= 1
    assert len(got) == len(rows)
    kept = language.identified(documents(spark, rows), model)
    assert kept.columns == documents(spark, rows).columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {4, 5, 6, 13, 15, 91, 92}  # 13 and 92 are of no learned language
    odd = documents(spark, rows).select("doc_id", "text", F.lit(1).alias("a b:c"), F.lit(2).alias("row"), F.lit(3).alias("t"))
    assert language.identified(odd, model).columns == odd.columns
    # nothing was learned: what has a letter stays
    nothing = language.train(empty(spark))
    assert {r["doc_id"] for r in language.identified(documents(spark, rows), nothing).collect()} == {i for i, _ in rows} - {4, 5, 6, 15, 91}
    assert language.identified(empty(spark), model).count() == 0


def test_repeated_empty_and_untrained(spark):
    model = language.train(training(spark))
    assert language.identify(repeated(spark), model).count() == 6
    assert language.identify(empty(spark), model).count() == 0
    nothing = language.train(empty(spark))
    assert {r["lang_pred"] for r in language.identify(documents(spark), nothing).collect()} == {"und"}


def test_scripts():
    rows, cells, script, n = language._grams(["abc", "мир", "漢字", "ß"], 18)
    assert [language.SCRIPTS[s] for s in script] == ["latin", "cyrillic", "han", "latin"] and n.tolist() == [3, 3, 2, 1]


def test_rare_and_many_languages(spark):
    """A language of one document among many is learned; tables shrink as languages grow in number."""
    rows = [(i, "the water and that which") for i in range(400)] + [(1000, "zxqj zxqv jqxz")]
    df = documents(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 1000, "xx").otherwise("en"))
    model = language.train(df, sample=20)
    assert model.langs == ["en", "xx"]
    assert {r["lang_pred"] for r in language.identify(documents(spark, [(1, "jqxz zxqj")]), model).collect()} == {"xx"}
    many = documents(spark, [(i, f"w{i} x{i} the") for i in range(300)]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string")))
    model = language.train(many)
    assert len(model.langs) > 200 and model.scores.size <= language.MOST_CELLS and language.table_bits(4) == language.TABLE_BITS
    assert language.identify(many, model).count() == 300


def plain_prediction(model, text):
    """The language of most letters by a step-by-step reading: words, scores, Viterbi."""
    words = (text or "").split()
    scored = [(language._letters(w), w) for w in words if regex.search(r"\p{L}", w)]
    if not scored:
        return "und", 0.0
    table, sizes = model.word_scores([x for x, _ in scored])
    path, _ = slow_viterbi(table.astype(float), language.SWITCH_PENALTY)
    votes = np.bincount(path, sizes, len(model.langs))
    return model.langs[int(votes.argmax())], float(votes.max() / votes.sum())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_predictions_against_a_plain_reading(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = language.identify(docs, model, spans=False).collect()
    assert len(got) == len(texts)
    for r in got:
        lang, score = plain_prediction(model, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 0.02, r


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = language.op4_language(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
