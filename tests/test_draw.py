import json

import pytest
from pyspark.sql import functions as F

from quire.operators import draw, place

TARGETS = [
    (1, "the quick brown", "A note of its own"), (2, "lazy dog and", "word " * 60), (3, "nowhere at all", "lost"), (4, "rown fox", "[UNKNOWN]"), (5, "quick brown fox", " second "),
]


@pytest.fixture(scope="module")
def page(spark):
    text = "the quick brown fox jumps over the lazy dog and more words here"
    pages = spark.createDataFrame([("b", 1, text)], "book string, page long, text string")
    boxes = [("b", 1, i, 72.0 + 50 * (i % 5), 72.0 + 14 * (i // 5), 72.0 + 50 * (i % 5) + 48, 83.0 + 14 * (i // 5), w) for i, w in enumerate(text.split())]
    words = spark.createDataFrame(boxes, "book string, page long, word_ix long, x0 double, y0 double, x1 double, y1 double, word string")
    sizes = spark.createDataFrame([("b", 1, 612.0, 300.0)], "book string, page long, width double, height double")
    books = spark.createDataFrame([("b", 1)], "book string, total_pages long")
    targets = spark.createDataFrame([(i, "b", 1, q, n, 1) for i, q, n in TARGETS], "target_id long, book string, page long, quote string, annotation string, chapter_number int")
    return draw.marked(place.find_quotes(targets, pages, words, books), words, sizes), words, sizes, boxes


def test_rows_of_a_small_page(page):
    marked, words, sizes, boxes = page
    rows = {}
    for r in draw.draw_rows(marked, words, sizes).collect():
        rows.setdefault(r["kind"], {}).setdefault(r["target_id"], []).append(r)
    box = lambda r: (r["x0"], r["y0"], r["x1"], r["y1"])
    # words 0 to 2 are one line with gaps of 2 points: one highlight; words 7 to 9 too; "rown fox" lies in words 2 and 3
    assert [box(r) for r in rows["highlight"][1]] == [(72.0, 72.0, 220.0, 83.0)]
    assert [box(r) for r in rows["highlight"][2]] == [(172.0, 86.0, 320.0, 97.0)]
    assert [box(r) for r in rows["highlight"][4]] == [(172.0, 72.0, 270.0, 83.0)]
    assert 3 not in rows["highlight"] and set(rows["note_box"]) == {1, 2, 5} and set(rows["note_text"]) == {1, 2, 5}
    # the column: 612 - 6 less the widest margin of 120; boxes in order of targets, none over another
    notes = [rows["note_box"][i][0] for i in (1, 2, 5)]
    assert all((r["x0"], r["x1"]) == (486.0, 606.0) for r in notes) and notes[0]["y0"] == 72.0
    spans = sorted((r["y0"], r["y1"]) for r in notes)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) and all(4 <= a and b <= 296 for a, b in spans)
    text = rows["note_text"][2][0]
    frame = rows["note_box"][2][0]
    assert box(text) == (frame["x0"] + 3, frame["y0"] + 3, frame["x1"] - 3, frame["y1"] - 3) and text["font_size"] < 8.0 and rows["note_text"][1][0]["font_size"] == 8.0
    assert rows["note_text"][5][0]["text"] == "second" and frame["opacity"] == 1.0 and rows["highlight"][1][0]["opacity"] == 0.35


def test_report(page, tmp_path):
    marked = page[0]
    counts = draw.report(marked).first()
    assert (counts["highlighted_count"], counts["notes_count"], counts["miss_count"]) == (4, 3, 1)
    draw.save_report(marked, str(tmp_path / "report"))
    body = json.loads(marked.sparkSession.read.text(str(tmp_path / "report")).first()["value"])
    assert [h["book_text"] for h in body["hits"]] == [q for i, q, _ in TARGETS if i != 3] and [h["note_added"] for h in body["hits"]] == [True, True, False, True]
    assert body["misses"] == [{"page": 1, "book_text": "nowhere at all", "reason": "quote_not_found", "chapter_number": 1}] and body["hits"][0]["rect_count"] == 3


def test_quotes_that_no_words_cover(page, spark):
    marked, words, sizes, _ = page
    found = marked.filter("target_id = 1").drop("rects", "note", "note_added").withColumn("start", F.lit(None).cast("int")).withColumn("stop", F.lit(None).cast("int"))
    got = draw.marked(found, words, sizes).first()
    assert (got["reason"], got["note_added"]) == ("highlight_failed", False) and draw.draw_rows(draw.marked(found, words, sizes), words, sizes).count() == 0
    assert draw.draw_rows(marked.limit(0), words, sizes).count() == 0
