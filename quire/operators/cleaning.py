"""Repeating headers and footers, and pages without them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.constants import HEADER_LINES, HEADER_RATIO, NO_TEXT
from quire.functions.text import clean_text, is_said, lines, normalize_whitespace, strip


def scan_pages(raw: DataFrame) -> DataFrame:
    """raw: (book, page, raw_text); adds text: cleaned, a sentinel for blank pages."""
    return raw.withColumn("text", F.when(strip(F.coalesce("raw_text", F.lit(""))) == "", NO_TEXT).otherwise(clean_text("raw_text")))


def repeating_lines(pages: DataFrame) -> DataFrame:
    """(book, line): first and last lines that come back on enough of a book's pages.

    The first HEADER_LINES non-blank normalised lines of each page are counted, and apart from them the last ones. A
    line counts as often as it occurs. It repeats if it has 3 characters or more and reaches 30 % of the pages, at least
    2. Books of one page have none.
    """
    books = pages.groupBy("book").agg(F.count("*").alias("pages")).filter("pages >= 2")
    held = pages.join(books.select("book"), "book", "left_semi").select("book", F.filter(lines("text"), is_said).alias("held"))
    plain = lambda c: F.transform(c, normalize_whitespace)  # noqa: E731  of the few lines at an end
    ends = F.array(
        F.struct(F.lit("head").alias("place"), plain(F.slice("held", 1, HEADER_LINES)).alias("lines")),
        F.struct(F.lit("foot").alias("place"), plain(F.slice("held", F.greatest(F.size("held") - HEADER_LINES + 1, F.lit(1)), HEADER_LINES)).alias("lines")),
    )
    found = held.select("book", F.explode(ends).alias("e")).select("book", "e.place", F.explode("e.lines").alias("line"))
    counts = found.groupBy("book", "place", "line").agg(F.count("*").alias("n"))
    enough = F.greatest(F.lit(2), F.floor(F.col("pages") * F.lit(HEADER_RATIO)))
    return counts.join(books, "book").filter((F.col("n") >= enough) & (F.length("line") >= 3)).select("book", "line").distinct()


def strip_headers_footers(pages: DataFrame) -> DataFrame:
    """pages with stripped: the text without any line whose normalised form repeats in its book; only stripped if none does."""
    marks = repeating_lines(pages).groupBy("book").agg(F.collect_set("line").alias("marks"))  # lines of one book's page ends
    both = pages.join(marks, "book", "left")
    # a line shorter than every mark is none, as normalising makes no line longer
    least = F.array_min(F.transform("marks", lambda m: F.length(m)))
    kept = F.array_join(F.filter(lines("text"), lambda x: (F.length(x) < least) | ~F.array_contains(F.col("marks"), normalize_whitespace(x))), "\n")
    return both.withColumn("stripped", F.when(F.col("marks").isNull(), strip("text")).otherwise(clean_text(kept))).drop("marks")


def chapter_text(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """(book, number, n_pages, chars, text): a section's pages in order, each under a line with its number."""
    inside = pages.join(sections, "book").filter(F.col("page").between(F.col("start_page"), F.col("end_page")))
    part = F.concat(F.lit("=== PAGE "), F.col("page").cast("string"), F.lit(" ===\n\n"), "text", F.lit("\n\n"))
    grouped = inside.groupBy("book", "number").agg(F.array_sort(F.collect_list(F.struct("page", part.alias("part")))).alias("parts"), F.sum(F.length("text")).cast("long").alias("chars"))
    return grouped.select("book", "number", F.size("parts").cast("long").alias("n_pages"), "chars", F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("text"))

