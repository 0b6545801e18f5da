import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.constants import SUBSTITUTIONS

ODD = ["", " ", "a", "\x1ca b\x85", "a\n\n\n\nb ", "  x\ty ", "Straße ΑΒ", "one\r\ntwo\nthree\n", "\n", "a\x0bb\x0cc d", "“fine” – ‘x’ ﬁn"]


def run(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", f("x").alias("y")).collect()
    return [r["y"] for r in sorted(rows)]


def test_against_plain_rules(spark):
    assert run(spark, T.normalize_whitespace, ODD) == [re.sub(r"\s+", " ", x.strip()) for x in ODD]
    assert run(spark, T.strip, ODD) == [x.strip() for x in ODD]
    assert run(spark, T.clean_text, ODD) == [re.sub(r"\n{3,}", "\n\n", x).strip() for x in ODD]
    assert run(spark, T.lines, ODD) == [x.splitlines() for x in ODD]
    assert run(spark, T.word_count, ODD) == [len(x.split()) for x in ODD]
    assert run(spark, T.normalize_quote, ODD[:7]) == [re.sub(r"\s+", " ", x.strip()).casefold() for x in ODD[:7]]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab \t\n\r\x0b\x1c\x1e\x85  　", max_size=12), min_size=1, max_size=20))
def test_white_space_property(spark, texts):
    assert run(spark, T.normalize_whitespace, texts) == [" ".join(x.split()) for x in texts]
    assert run(spark, T.lines, texts) == [x.splitlines() for x in texts]


def variants(q):
    out = [q, q.strip(), " ".join(q.split())]
    for sign, plain in SUBSTITUTIONS:
        if sign in q:
            out += [q.replace(sign, plain), " ".join(q.replace(sign, plain).split())]
    return [x for x in dict.fromkeys(out) if x]


def test_quote_variants(spark):
    assert run(spark, T.quote_variants, ODD) == [variants(x) for x in ODD]


def test_preview_stem_color_page(spark):
    assert run(spark, lambda c: T.preview(c, 6), ["abcdef", "abcdefg"]) == ["abcdef", "abc..."]
    assert run(spark, T.book_stem, ["a/b.c/name.tar.gz", "x", ".hidden", "d/.hidden", "e/f."]) == ["name.tar", "x", ".hidden", ".hidden", "f"]
    assert run(spark, T.parse_color, ["1,0,0.5", "255, 0, 51", "1,2", "a,b,c", "-1,0,0"]) == [[1, 0, 0.5], [1.0, 0.0, 0.2], None, None, None]
    assert run(spark, T.coerce_page, ["12", " 7\n", "x", "", None, "-3", "1.0"]) == [12, 7, None, None, None, None, None]


@pytest.mark.parametrize("quote,text,expected", [("", "abc", False), ("[UNKNOWN]", "abc", True), ("b c", "a b\nc", True), ("b  c", "a b c", True), ("B", "b", False), (" ", "abc", True)])
def test_quote_in_text(spark, quote, text, expected):
    row = spark.range(1).select(T.quote_in_text(F.lit(quote), F.lit(text)).alias("y")).first()
    assert row["y"] is expected


def test_casefold_is_that_of_unicode(spark):
    words = ["Straße", "ΟΔΥΣΣΕΥΣ", "ὀδυσσεύς", "ﬁne ﬂow oﬀ eﬃcient ﬄ ﬅ ﬆ", "ŉ ſ", "ÄÖÜ éà", "ЖЁЙ", "", "plain"]
    df = spark.createDataFrame(list(enumerate(words)), "i int, w string")
    got = {r["i"]: r["f"] for r in df.select("i", T.casefold("w").alias("f")).collect()}
    assert got == {i: w.casefold() for i, w in enumerate(words)}
