import os

import pytest

from quire.sources import convert


def program(folder, body):
    path = folder / "ebook-convert"
    path.write_text(f"#!/bin/sh\n{body}\n")
    os.chmod(path, 0o755)
    return str(path)


def test_conversions(tmp_path):
    pdf, book, out = tmp_path / "a.PDF", tmp_path / "b.epub", str(tmp_path / "new" / "b.pdf")
    pdf.write_text("x")
    book.write_text("y")
    assert convert.normalize_to_pdf(f'"{pdf}"', out) == (str(pdf), False)
    assert convert.normalize_to_pdf(str(book), out, program(tmp_path, 'cp "$1" "$2"')) == (out, True) and open(out).read() == "y"
    os.remove(out)
    for body, said in (("echo broken >&2; exit 3", "broken"), ("exit 1", "no details"), ("exit 0", "without a file"), ("exec sleep 5", "within")):
        with pytest.raises(RuntimeError, match=said):
            convert.normalize_to_pdf(str(book), out, program(tmp_path, body), timeout=0.5)
    with pytest.raises(FileNotFoundError):
        convert.normalize_to_pdf(str(tmp_path / "none.epub"), out)
    with pytest.raises(ValueError):
        convert.extension("x.docx")
    with pytest.raises(RuntimeError, match="not installed"):
        convert.normalize_to_pdf(str(book), out, str(tmp_path / "nowhere"))
    assert convert.program_name("nt") == "ebook-convert.exe" and convert.program_name("posix") == "ebook-convert"


def test_chapters_are_put_together(spark, tmp_path):
    from quire.sources import outputs

    folder, master = str(tmp_path / "chapters"), str(tmp_path / "masters")
    outputs.save_chapter_json(spark.createDataFrame([("a", 2, "{2}"), ("a", 1, "{1}"), ("b", 1, "{b}")], "stem string, chapter_number int, json string"), folder)
    # without its master a document's chapters stay
    assert outputs.finalize_chapter_outputs(spark, folder, "a", master) == 0 and outputs.scan_chapter_dir(spark, folder, "a").count() == 2
    spark.createDataFrame([("{}",)], "json string").write.text(master)
    assert outputs.finalize_chapter_outputs(spark, folder, "a", master) == 2
    assert [r["json"] for r in outputs.scan_chapter_dir(spark, folder, "b").collect()] == ["{b}"]
    assert outputs.finalize_chapter_outputs(spark, folder, "b", master) == 1 and not os.path.exists(folder)
