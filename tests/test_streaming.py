import json

from pyspark.sql.types import StructType

from quire.streaming import chapters


def test_upsert(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = StructType.fromDDL("book string, chapter_number int, version int, response string")

    def arrive(name, rows):
        (source / name).write_text("".join(json.dumps(dict(zip(schema.names, r, strict=True))) + "\n" for r in rows))
        chapters.upsert_chapters(chapters.read_chapters(spark, str(source), schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()

    arrive("1.json", [("a", 1, 1, "old"), ("a", 1, 2, "new"), ("b", 1, 1, "x")])
    arrive("2.json", [("a", 1, 1, "newer batch"), ("b", 2, 1, "y")])
    got = {(r["book"], r["chapter_number"]): r["response"] for r in chapters.current_chapters(spark, str(tmp_path / "out")).collect()}
    assert got == {("a", 1): "newer batch", ("b", 1): "x", ("b", 2): "y"}
