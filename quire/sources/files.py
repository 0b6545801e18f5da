"""Readers and writers of the formats: pages, targets, runs, chapter and master files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.constants import CSV_COLUMNS, EXTENSIONS, UNKNOWN
from quire.functions.text import book_stem, coerce_page, normalize_quote, strip

NOTE = "page string, book_text string, annotation string, category string, grounding string"
CHAPTER = f"chapter_number string, chapter_title string, start_page int, end_page int, source_filename string, quality string, density string, annotations array<string>"
# Names under which CSV files give a target's fields; the first that isn't empty counts.
ALIASES = {
    "page": ["page", "Page"], "book_text": ["source_text", "Source Text", "book_text", "Book Text"], "annotation": ["annotation", "Annotation"],
    "annotation_type": ["category", "Category", "annotation_type", "Annotation Type"], "chapter": ["chapter", "Chapter"],
}


def detect_format(path: Column) -> Column:
    """The lower-cased extension, or null if it is none of the known ones."""
    found = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return F.when(found.isin(EXTENSIONS), found)


def require_format(path: Column) -> Column:
    return F.coalesce(detect_format(path), F.raise_error(F.concat(F.lit(f"unsupported format, not one of {', '.join(sorted(EXTENSIONS))}: "), path)))


def convert(files: DataFrame, to_pages: Callable[[str, bytes], Iterator[tuple[int, str]]]) -> DataFrame:
    """(path, page, raw_text) of files (path, content), as binaryFile gives them, by a converter of one file; it runs in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, n, t) for p, c in zip(batch["path"], batch["content"], strict=True) for n, t in to_pages(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "page", "raw_text"])

    return files.select("path", "content").mapInPandas(run, "path string, page long, raw_text string")


def output_paths(path: Column, chapter: Column, attempt: Column, suffix: str = "_notes") -> Column:
    """Names of everything that is written for a source file and chapter, in a folder beside it: its name and ``suffix``."""
    stem, root = book_stem(path), F.regexp_replace(path, r"[^/]*$", "")
    base = F.concat(root, stem, F.lit(f"{suffix}/"))
    ch = F.concat(stem, F.lit("_ch"), F.lpad(chapter.cast("string"), 2, "0"))
    return F.struct(
        F.concat(base, F.lit("json/"), ch, F.lit(".json")).alias("chapter_json"), F.concat(base, F.lit("csv/"), ch, F.lit(".csv")).alias("chapter_csv"),
        F.concat(base, stem, F.lit("_master.json")).alias("master_json"), F.concat(base, stem, F.lit("_master.csv")).alias("master_csv"),
        F.concat(base, stem, F.lit("_highlighted.pdf")).alias("highlighted"), F.concat(base, F.lit("logs/"), ch, F.lit("_failed_"), attempt.cast("string"), F.lit(".txt")).alias("failed"),
    )


def row_to_target(rows: DataFrame) -> DataFrame:
    """rows (page, book_text, annotation, annotation_type, ...): those with a page from 1 and a quote; an empty type is null."""
    quote = strip(F.coalesce("book_text", F.lit("")))
    good = rows.withColumn("page", coerce_page("page")).filter((F.col("page") >= 1) & (quote != "") & (quote != UNKNOWN))
    return good.withColumn("annotation", F.coalesce("annotation", F.lit(""))).withColumn("annotation_type", F.nullif("annotation_type", F.lit("")))


def targets_from_json(documents: DataFrame) -> DataFrame:
    """Targets of documents (source, json): a master file, a chapter file, or a list; a document of no such shape stops the query.

    The master's chapters win where a document has both keys. Items that aren't objects are passed over. A type is not
    read from JSON.
    """
    text = F.trim("json")
    chapters, notes = F.get_json_object(text, "$.chapters"), F.get_json_object(text, "$.annotations")
    listed = F.when(F.startswith(text, F.lit("[")), F.array(F.to_json(F.struct(F.from_json(text, "array<string>").alias("annotations")))))
    as_chapters = F.when(chapters.isNotNull(), F.from_json(chapters, "array<string>")).when(notes.isNotNull(), F.array(text))
    shaped = documents.withColumn("parts", F.coalesce(as_chapters, listed, F.raise_error(F.concat(F.lit("not a master, a chapter or a list: "), "source")).cast("array<string>")))
    parsed = shaped.select("source", F.posexplode("parts").alias("part", "c")).select("source", "part", F.from_json("c", CHAPTER).alias("c"))
    rows = parsed.select("source", "part", "c.chapter_number", "c.chapter_title", F.posexplode("c.annotations").alias("ix", "a")).filter(F.json_object_keys("a").isNotNull())
    fields = rows.select("source", "part", "ix", F.col("chapter_number").try_cast("int").alias("chapter_number"), F.coalesce("chapter_title", F.lit("")).alias("chapter_title"), F.from_json("a", NOTE).alias("a"))
    return row_to_target(fields.select("source", "part", "ix", "chapter_number", "chapter_title", "a.page", "a.book_text", "a.annotation", F.lit(None).cast("string").alias("annotation_type")))


def read_targets_json(spark: SparkSession, path: str) -> DataFrame:
    return targets_from_json(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("json")))


def _csv(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    return read.toDF(*[c.removeprefix("﻿") for c in read.columns])


def targets_from_rows(rows: DataFrame) -> DataFrame:
    """Targets of rows under any of the known names."""
    pick = lambda field: F.coalesce(*[F.nullif(F.col(f"`{a}`"), F.lit("")) for a in ALIASES[field] if a in rows.columns], F.lit(None).cast("string"))
    return row_to_target(rows.select(*[pick(f).alias(f) for f in ALIASES])).withColumn("chapter_number", F.col("chapter").try_cast("int")).drop("chapter")


def read_targets_csv(spark: SparkSession, path: str) -> DataFrame:
    return targets_from_rows(_csv(spark, path))


def load_targets(spark: SparkSession, path: str) -> DataFrame:
    if path.lower().endswith(".json"):
        return read_targets_json(spark, path)
    if path.lower().endswith(".csv"):
        return read_targets_csv(spark, path)
    raise ValueError(f"neither .json nor .csv: {path}")


def run_quotes(rows: DataFrame) -> DataFrame:
    """(page, quote) of a run's rows, normalised; headers count without case, spaces and underscores. Blank pages, empty quotes and the sentinel go; any other page must be a number."""
    names = {c.lower().replace("ß", "ss").replace(" ", "").replace("_", ""): c for c in reversed(rows.columns)}
    quote = names.get("sourcetext") or names.get("booktext")
    if "page" not in names or quote is None:
        raise ValueError("page and source text columns are needed")
    page = strip(F.col(f"`{names['page']}`"))
    number = F.coalesce(page.try_cast("int"), F.raise_error(F.concat(F.lit("not a page number: "), page)).cast("int"))
    found = rows.filter(F.coalesce(page, F.lit("")) != "").select(number.alias("page"), normalize_quote(F.coalesce(F.col(f"`{quote}`"), F.lit(""))).alias("quote"))
    return found.filter(~F.col("quote").isin("", UNKNOWN.lower()))


def read_run_quotes(spark: SparkSession, path: str) -> DataFrame:
    return run_quotes(_csv(spark, path))


def master_payload(rows: DataFrame) -> DataFrame:
    """(book, json): rows of notes (book, chapter_number, chapter_title, seq, NOTE columns) nested into chapters and a book."""
    note = F.struct("seq", F.struct("page", "book_text", "annotation", "category", "grounding", "validation_flags").alias("n"))
    chapters = rows.groupBy("book", "chapter_number", "chapter_title").agg(F.array_sort(F.collect_list(note)).alias("n"))
    nested = chapters.select("book", F.struct("chapter_number", "chapter_title", F.transform("n", lambda x: x["n"]).alias("annotations")).alias("c"))
    books = nested.groupBy("book").agg(F.array_sort(F.collect_list("c")).alias("chapters"))
    return books.select("book", F.to_json(F.struct(F.col("book").cast("string").alias("book"), "chapters")).alias("json"))


def chapter_csv(rows: DataFrame) -> DataFrame:
    """The CSV columns; document, quality and density are the chapter's own."""
    return rows.select("book", "seq", F.coalesce("source_filename", F.lit("")).alias("document"), F.col("chapter_number").alias("chapter"), "chapter_title", "page", "category", "grounding", F.col("book_text").alias("source_text"), "annotation", "quality", F.col("density").cast("string").alias("density"))


def master_csv(payloads: DataFrame, metadata: DataFrame) -> DataFrame:
    """The CSV columns of master files (book, json); every row has the last run's quality and density, from metadata (book, source_filename, quality, density)."""
    chapters = payloads.select("book", F.get_json_object("json", "$.book").alias("name"), F.explode(F.from_json(F.get_json_object("json", "$.chapters"), f"array<struct<chapter_number:string,chapter_title:string,annotations:array<struct<{NOTE.replace(' string', ':string')}>>>>")).alias("c"))
    rows = chapters.select("book", "name", "c.chapter_number", "c.chapter_title", F.posexplode("c.annotations").alias("ix", "a")).join(metadata, "book", "left")
    return rows.select("book", "ix", F.coalesce(F.nullif("source_filename", F.lit("")), "name", F.lit("")).alias("document"), F.col("chapter_number").alias("chapter"), "chapter_title", "a.page", "a.category", "a.grounding", F.col("a.book_text").alias("source_text"), "a.annotation", "quality", F.col("density").cast("string").alias("density"))


def write_csv(rows: DataFrame, path: str, by: str | None = None) -> None:
    """The fixed columns, quoted so that read_targets_csv() reads them again."""
    writer = rows.select(*CSV_COLUMNS, *([by] if by else [])).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "")
    (writer.partitionBy(by) if by else writer).csv(path)


def write_json(payloads: DataFrame, path: str) -> None:
    payloads.select("json").write.mode("overwrite").text(path)

