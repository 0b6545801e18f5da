import csv
import json

import pytest
from pyspark.sql import functions as F

from quire.sources import files

NOTES = [(1, "He said \"yes\",\nthen left", "A note, with comma", "METHOD"), (0, "page zero", "x", "METHOD"), (2, "[UNKNOWN]", "x", "METHOD"), (2, " ", "x", "METHOD"), (3, "fine", "", "RESULT")]


def keep(df):
    return sorted((r["page"], r["book_text"], r["annotation"], r["annotation_type"]) for r in df.collect())


GOOD = [(1, NOTES[0][1], NOTES[0][2]), (3, "fine", "")]


def test_json_shapes(spark, tmp_path):
    rows = [{"page": p, "book_text": q, "annotation": a, "category": c} for p, q, a, c in NOTES]
    shapes = {"master": {"chapters": [{"chapter_number": 4, "chapter_title": "T", "annotations": rows}], "annotations": []}, "chapter": {"chapter_number": 4, "chapter_title": "T", "annotations": rows}, "list": [*rows, 7]}
    for name, body in shapes.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(body, ensure_ascii=False))
        out = files.load_targets(spark, str(path))
        assert keep(out) == [(*x, None) for x in GOOD]
        assert {r["chapter_number"] for r in out.collect()} == ({None} if name == "list" else {4})
    bad = tmp_path / "bad.json"
    bad.write_text('{"other": 1}')
    with pytest.raises(Exception, match="not a master"):
        files.load_targets(spark, str(bad)).collect()


@pytest.mark.parametrize("names", [("page", "source_text", "annotation", "category"), ("Page", "Book Text", "Annotation", "annotation_type")])
def test_csv_aliases(spark, tmp_path, names):
    path = tmp_path / "t.csv"
    with path.open("w", encoding="utf-8-sig", newline="") as f:
        csv.writer(f).writerows([names, *NOTES])
    assert keep(files.load_targets(spark, str(path))) == [(*GOOD[0], "METHOD"), (*GOOD[1], "RESULT")]


def test_run_quotes(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("﻿PAGE,Source_Text\n1,  A  b \n,skipped\n2,[UNKNOWN]\n2,\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_run_quotes(spark, str(path)).collect()] == [(1, "a b")]
    path.write_text("page,book text\nx,quote\n")
    with pytest.raises(Exception, match="not a page number"):
        files.read_run_quotes(spark, str(path)).collect()
    path.write_text("page,other\n1,quote\n")
    with pytest.raises(ValueError):
        files.read_run_quotes(spark, str(path))


def notes(spark):
    rows = [("b", 1, "One", 0, 2, "q\"1\"", "n1", "METHOD", "source_fact", []), ("b", 2, "Two", 0, 3, "q2", "n,2", "RESULT", "uncertain", ["page_corrected"])]
    return spark.createDataFrame(rows, "book string, chapter_number int, chapter_title string, seq long, page int, book_text string, annotation string, category string, grounding string, validation_flags array<string>")


def test_exports_round_trip(spark, tmp_path):
    payload = files.master_payload(notes(spark))
    files.write_json(payload, str(tmp_path / "master"))
    body = json.loads(spark.read.text(str(tmp_path / "master")).first()[0])
    assert [c["chapter_title"] for c in body["chapters"]] == ["One", "Two"] and body["chapters"][1]["annotations"][0]["validation_flags"] == ["page_corrected"]
    meta = spark.createDataFrame([("b", "", "high", 2)], "book string, source_filename string, quality string, density int")
    rows = files.master_csv(payload, meta)
    assert rows.drop("book", "ix").columns == ["document", "chapter", "chapter_title", "page", "category", "grounding", "source_text", "annotation", "quality", "density"]
    assert {(r["document"], r["quality"], r["density"]) for r in rows.collect()} == {("b", "high", "2")}
    files.write_csv(rows, str(tmp_path / "csv"))
    back = files.read_targets_csv(spark, str(tmp_path / "csv"))
    assert keep(back) == [(2, 'q"1"', "n1", "METHOD"), (3, "q2", "n,2", "RESULT")]


def test_formats_and_paths(spark):
    paths = ["a/B.PDF", "x.docx", "noext", "d.txt/file", "book.azw3"]
    got = [r["f"] for r in spark.createDataFrame(list(enumerate(paths)), "i int, p string").orderBy("i").select(files.detect_format(F.col("p")).alias("f")).collect()]
    assert got == [".pdf", None, None, None, ".azw3"]
    with pytest.raises(Exception, match="unsupported format"):
        spark.range(1).select(files.require_format(F.lit("x.docx"))).collect()
    o = spark.range(1).select(files.output_paths(F.lit("in/My Book.pdf"), F.lit(3), F.lit(2)).alias("o")).first()["o"]
    assert o["chapter_json"] == "in/My Book_notes/json/My Book_ch03.json" and o["failed"] == "in/My Book_notes/logs/My Book_ch03_failed_2.txt"


def test_converter_boundary(spark, tmp_path):
    (tmp_path / "one.txt").write_text("first\fsecond")
    raw = spark.read.format("binaryFile").load(str(tmp_path / "one.txt"))
    pages = files.convert(raw, lambda path, content: enumerate(content.decode().split("\f"), 1))
    assert [(r["page"], r["raw_text"]) for r in pages.orderBy("page").collect()] == [(1, "first"), (2, "second")]


def test_chapter_files(spark, tmp_path):
    from quire.sources import outputs

    folder = str(tmp_path / "json")
    rows = spark.createDataFrame([("Book", 2, '{"a": 2}'), ("Book", 10, '{"a": 10}'), ("Other", 1, "{}")], "stem string, chapter_number int, json string")
    outputs.save_chapter_json(rows, folder)
    outputs.save_chapter_json(spark.createDataFrame([("Book", 2, '{"a": "again"}')], rows.schema), folder)
    assert [tuple(r) for r in outputs.scan_chapter_dir(spark, folder, "Book").collect()] == [(2, '{"a": "again"}'), (10, '{"a": 10}')]
    assert outputs.delete_chapter_outputs(spark, folder, "Book") == 2 and outputs.delete_chapter_outputs(spark, folder, "Book") == 0
    assert (tmp_path / "json").exists() and outputs.delete_chapter_outputs(spark, folder, "Other") == 1 and not (tmp_path / "json").exists()
    log = str(tmp_path / "failed")
    for n in (1, 2):
        outputs.save_failed_response(spark.createDataFrame([("Book", 2, n, "bad")], "stem string, chapter_number int, attempt int, response string"), log)
    assert spark.read.json(log).count() == 2
