import hashlib

from quire.functions import text as T
from quire.plans import queries as Q


def test_whole_texts(spark, tmp_path):
    """What a text holds after its first characters reaches the variants and the key."""
    text = "word " * 30 + "THE_Last — fi ’ end"
    d = str(tmp_path)
    rows = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{d}/documents.parquet")
    assert Q.QUERIES["field_key_whole"](spark, d).first()["k"] == text.lower().replace(" ", "").replace("_", "")
    quote = "“" + text.replace("e", "’").replace("fi", "ﬁ") + "— \u00a0” "
    v = spark.createDataFrame([(quote,)], "q string").select(T.quote_variants("q").alias("v")).first()["v"]
    got = Q.QUERIES["quote_variants_whole"](spark, d).first()
    assert got["n"] == len(v) and got["variants"] == hashlib.md5("|".join(v).encode()).hexdigest() and all("nd" in x for x in v)


def test_every_page_starts(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(1, 4)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    titles = {r["title"] for r in Q.QUERIES["sections_from_all_starts"](spark, d).collect()}
    assert "Page 1" in titles
