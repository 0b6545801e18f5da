import json

import pytest
from pyspark.sql import functions as F

from quire.operators import estimate, provider, verify

NOTE = "book long, chapter_number long, seq long, page {page}, book_text string, annotation string, category string, grounding string, start_page long, end_page long"


def notes(spark, rows, end=2, page="long"):
    return spark.createDataFrame([(1, 1, i, p, q, a, "METHOD", "source_fact", 1, end) for i, (p, q, a) in enumerate(rows)], NOTE.format(page=page)).withColumn("validation_flags", verify.no_flags())


def pages(spark, texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "book long, page long, text string")


SAID = "A note of some words"


def test_cap_does_not_pad(spark):
    capped = verify.density_cap(notes(spark, [(1, "first quote", SAID), (1, "second quote", SAID), (1, "first  quote", SAID)]), 1).cache()
    assert tuple(verify.repair_report(capped).first())[2:] == (1, 0, 0, 1)
    assert [r["book_text"] for r in verify.kept_rows(capped).collect()] == ["first quote"]


def test_cap_coerces_and_drops(spark):
    rows = [(" 2", "a", SAID), ("x", "b", SAID), ("9", "c", SAID), ("2", "", SAID), ("2", "", SAID), (None, "d", SAID)]
    got = {r["seq"]: (r["status"], r["rank"]) for r in verify.density_cap(notes(spark, rows, page="string")).collect()}
    assert got == {0: ("kept", 1), 1: ("invalid", None), 2: ("oor", None), 3: ("kept", 2), 4: ("kept", 3), 5: ("invalid", None)}


def test_real_quote_wins_the_slot(spark):
    out = verify.validated_pipeline(notes(spark, [(1, "not there", SAID), (1, "real words", SAID)]), pages(spark, ["some real\nwords here", "other"]), 1).collect()
    assert [(r["page"], r["book_text"]) for r in out] == [(1, "real words")]


def test_unverifiable_quote(spark):
    out = verify.verify_quotes(notes(spark, [(1, "nowhere", SAID)]), pages(spark, ["a", "b"])).first()
    assert (out["book_text"], out["annotation"], out["validation_flags"]) == ("[UNKNOWN]", "[UNKNOWN]", ["quote_not_found", "annotation_unknown"])


def test_page_is_corrected(spark):
    out = verify.verify_quotes(notes(spark, [(1, "on page two", "")]), pages(spark, ["a", "it is on page two."])).first()
    assert (out["page"], out["book_text"], out["annotation"], out["validation_flags"]) == (2, "on page two", "[UNKNOWN]", ["page_corrected", "empty_annotation"])


def test_flags_in_order(spark):
    rows = [(1, "[UNKNOWN]", "This shows that"), (1, "a", "two words"), (1, "a", " ".join(["w"] * 141)), (1, "a", "[UNKNOWN]"), (3, "a", SAID)]
    got = {r["seq"]: r["validation_flags"] for r in verify.verify_quotes(notes(spark, rows), pages(spark, ["a"])).collect()}
    assert got[0] == ["quote_unknown", "generic_phrasing", "annotation_unknown"]
    assert got[1] == ["short_annotation"] and got[2] == ["long_annotation"] and got[3] == []
    assert got[4] == ["page_corrected"]


def test_categories(spark):
    rows = notes(spark, [(1, "a", SAID), (1, "a", "[UNKNOWN]")]).withColumn("category", F.when(F.col("seq") == 0, "PLOT").otherwise("METHOD")).withColumn("grounding", F.when(F.col("seq") == 0, "certain").otherwise("source_fact"))
    out = {r["seq"]: (r["category"], r["grounding"], r["validation_flags"]) for r in verify.normalize_row(rows).collect()}
    assert out == {0: ("CONTEXT", "uncertain", ["category_invalid", "grounding_invalid"]), 1: ("METHOD", "uncertain", [])}


@pytest.mark.parametrize(
    "body,errors",
    [
        ({"chapter_number": 1, "chapter_title": "x", "start_page": 1, "end_page": 2, "annotations": []}, []),
        ({"chapter_number": 1}, ["Missing field: chapter_title", "Missing field: start_page", "Missing field: end_page", "Missing field: annotations"]),
        ({"chapter_number": 1, "chapter_title": "x", "start_page": 1, "end_page": 2, "annotations": {}}, ["annotations must be an array"]),
        ({"chapter_number": 1, "chapter_title": "x", "start_page": 1, "end_page": 2, "annotations": [3, {"page": 1, "book_text": "", "annotation": "", "category": ""}]}, ["annotations[0] must be an object", "annotations[1] missing field: grounding"]),
    ],
)
def test_structure(spark, body, errors):
    out = verify.structure_hard(spark.createDataFrame([(1, json.dumps(body))], "book long, response string")).withColumn("b", verify.blocking_errors(F.col("errors"))).first()
    assert out["errors"] == errors and out["b"] == bool(errors)


def test_settings():
    assert estimate.Settings(2, "high").label() == "High"
    for bad in ({"quotes_per_page": 0}, {"quotes_per_page": 11}, {"quality": "best"}):
        with pytest.raises(ValueError):
            estimate.Settings(**bad)


def requests_of(spark, rows):
    """rows: (book, number, title, start_page, end_page, [(start, end, message)])."""
    chunks = [(b, n, t, s, e, [(i, x, y, m) for i, (x, y, m) in enumerate(c)]) for b, n, t, s, e, c in rows]
    return spark.createDataFrame(chunks, "book long, number long, title string, start_page long, end_page long, chunks array<struct<chunk_ix:int,chunk_start:long,chunk_end:long,message:string>>")


def test_retries(spark):
    def answer(message, errors):
        if message.startswith("broken"):
            raise RuntimeError("no line")
        if message.startswith("late") and not errors:
            return "nonsense"
        if message.startswith("thin"):
            return json.dumps({"annotations": [{"page": 1, "book_text": "q"}, "text"]})
        if message.startswith("note"):
            page = int(message[4:])
            return json.dumps({"chapter_number": 77, "annotations": [{"page": p, "book_text": f"q{p}", "annotation": "n", "category": "METHOD", "grounding": "source_fact"} for p in (page + 1, page)]})
        return json.dumps({"annotations": []})

    rows = [
        (1, 1, "A", 1, 2, [(1, 2, "late")]), (2, 1, "B", 1, 1, [(1, 1, "broken")]), (3, 4, "C", 1, 4, [(1, 2, "note1"), (3, 4, "note3")]), (4, 1, "D", 1, 1, [(1, 1, "thin")]),
        (5, 1, "E", 1, 4, [(1, 2, "note1"), (3, 4, "thin")]),
    ]
    got = {r["book"]: r for r in provider.annotate(requests_of(spark, rows), answer).collect()}
    assert [(got[b]["status"], got[b]["attempts"]) for b in range(1, 6)] == [("completed", 2), ("failed", 3), ("completed", 1), ("failed", 3), ("failed", 3)]
    assert got[2]["response"] is None and got[2]["errors"] == ["call failed: no line"] and [f["attempt"] for f in got[2]["failures"]] == [1, 2, 3]
    body = json.loads(got[3]["response"])
    # number, title and pages are the section's, rows in order of their pages
    assert (body["chapter_number"], body["chapter_title"], body["start_page"], body["end_page"]) == (4, "C", 1, 4) and [a["page"] for a in body["annotations"]] == [1, 2, 3, 4]
    assert got[4]["errors"] == [f"annotations[0] missing field: {f}" for f in ("annotation", "category", "grounding")] + ["annotations[1] must be an object"]
    # tokens of attempts that were answered; the second message of book 1 tells the errors
    assert got[2]["prompt_tokens"] == 0 and got[3]["prompt_tokens"] == 4 and got[1]["prompt_tokens"] == provider.characters(provider.corrected("late", ["call failed: Expecting value: line 1 column 1 (char 0)"]))
    assert provider.annotate(requests_of(spark, rows).limit(0), answer).count() == 0


def test_rule_is_that_of_the_columns(spark):
    """problems() in Python and structure_hard() in columns say the same."""
    row = {"page": 1, "book_text": "q", "annotation": "n", "category": "c", "grounding": "g"}
    whole = {"chapter_number": 1, "chapter_title": "t", "start_page": 1, "end_page": 2, "annotations": [row, {**row, "page": None}]}
    bodies = [whole, {}, {**whole, "annotations": {}}, {**whole, "annotations": [1, [], row, {}]}, {k: v for k, v in whole.items() if k != "end_page"}]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "book int, response string")
    got = {r["book"]: r["errors"] for r in verify.structure_hard(df).collect()}
    assert got == {i: provider.problems(b) for i, b in enumerate(bodies)}
