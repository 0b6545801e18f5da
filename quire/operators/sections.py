"""Sections of books: heading predicates, candidate sections by method, front matter, and the cascade of methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.constants import FRONT_MATTER, FRONT_PAGES, FRONT_WORDS, LINE_END, SECTION_NAMES, WS
from quire.functions.text import col, is_said, lines, strip, word_count

SECTION = ["book", "number", "title", "start_page", "end_page"]
#: Methods in the order in which they are tried.
METHODS = ["toc", "layout", "regex", "article_headings"]
# The patterns of headings.
_WORD_CHARS = r"[\pL\pN_]"
CHAPTER = rf"(?i)^(?:(?:chapter|part)[\s]+{_WORD_CHARS}+|(?:[0-9]+\.\s*)?chapter\s+[0-9]+)"
NAMED = rf"(?i)\A(?:[0-9]+(?:\.[0-9]+)*\.?\s+)?(?:{'|'.join(SECTION_NAMES)})\z"
NUMBERED = r"\A[0-9]+(?:\.[0-9]+){0,3}\.?\s+[A-Z][A-Za-z0-9][A-Za-z0-9,'’\- ]{1,70}\z"


#: A line may be a chapter's heading only in a text that this finds; one look at the text spares most pages the work by line.
_MAYBE_CHAPTER = rf"(?i)(?:\A|{LINE_END}){WS}*(?:chapter|part|[0-9]+\.\s*chapter)"


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def heading_regex(text: Column | str) -> Column:
    """The first line of up to 80 characters that starts like a chapter or part; null if none does."""
    held = F.transform(lines(text), strip)
    found = _first(F.filter(held, lambda x: (x != "") & (F.length(x) <= 80) & x.rlike(CHAPTER)))
    return F.when(col(text).rlike(_MAYBE_CHAPTER), found)


def heading_article(text: Column | str) -> Column:
    """Among the first six non-blank lines the first, of up to 80 characters, that names a section or is a numbered title."""
    held = F.transform(F.slice(F.filter(lines(text), is_said), 1, 6), strip)
    numbered = lambda x: (F.length(x) >= 8) & (word_count(x) <= 8) & x.rlike(NUMBERED)
    return _first(F.filter(held, lambda x: (F.length(x) <= 80) & (x.rlike(NAMED) | numbered(x))))


def heading_layout(blocks: DataFrame) -> DataFrame:
    """(book, page, title): on each page the first block that stands high, is set large, is short and has no punctuation of a sentence."""
    text = strip(F.array_join(F.transform("spans", lambda x: x["text"]), " "))
    size = F.array_max(F.transform("spans", lambda x: x["size"]))
    good = (F.col("y0") < 0.35 * F.col("page_height")) & (F.col("title") != "") & (word_count("title") <= 8) & (F.col("size") >= 13) & ~F.col("title").rlike(r"[.!?,;:]")
    found = blocks.withColumn("title", text).withColumn("size", size).filter(good)
    return found.groupBy("book", "page").agg(F.min_by("title", "block_ix").alias("title"))


def sections_from_starts(starts: DataFrame, books: DataFrame) -> DataFrame:
    """(book, number, title, start_page, end_page) from (book, ix, title, page): the first start of each page, up to the page before the next; books: (book, total_pages)."""
    once = starts.withColumn("r", F.row_number().over(Window.partitionBy("book", "page").orderBy("ix"))).filter("r = 1")
    order = Window.partitionBy("book").orderBy("page")
    numbered = once.withColumn("number", F.row_number().over(order).cast("long")).withColumn("next", F.lead("page").over(order) - 1)
    return numbered.join(books, "book").select("book", "number", "title", F.col("page").alias("start_page"), F.coalesce("next", "total_pages").alias("end_page"))


def scan_toc(toc: DataFrame) -> DataFrame:
    """Outline entries with a title and a page, whatever their level."""
    return toc.filter((strip("title") != "") & (F.col("page") >= 1)).withColumn("title", strip("title"))


def sections_toc(toc: DataFrame, books: DataFrame) -> DataFrame:
    return sections_from_starts(scan_toc(toc).select("book", F.col("toc_ix").alias("ix"), "title", "page"), books)


def _from_pages(pages: DataFrame, heading: Column, books: DataFrame) -> DataFrame:
    found = pages.select("book", F.col("page").alias("ix"), heading.alias("title"), "page").filter("title is not null")
    return sections_from_starts(found, books)


def sections_regex(pages: DataFrame, books: DataFrame) -> DataFrame:
    return _from_pages(pages, heading_regex("text"), books)


def sections_article(pages: DataFrame, books: DataFrame) -> DataFrame:
    return _from_pages(pages, heading_article("text"), books)


def sections_layout(blocks: DataFrame, books: DataFrame) -> DataFrame:
    return sections_from_starts(heading_layout(blocks).select("book", F.col("page").alias("ix"), "title", "page"), books)


def front_matter_page(text: Column | str) -> Column:
    """Fewer than 150 words, or one of the marks anywhere."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return (word_count(text) < FRONT_WORDS) | reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in FRONT_MATTER])


def content_start(pages: DataFrame, books: DataFrame) -> DataFrame:
    """(book, content_start): the first of the first 25 pages that is no front matter, else 1."""
    found = pages.filter(F.col("page") <= FRONT_PAGES).filter(~front_matter_page("text")).groupBy("book").agg(F.min("page").alias("p"))
    return books.select("book").join(found, "book", "left").select("book", F.coalesce("p", F.lit(1)).cast("long").alias("content_start"))


def exclude_front_matter(sections: DataFrame, starts: DataFrame) -> DataFrame:
    """Sections from the content's start on: starts moved up to it, what lies before it dropped, overlaps cut, numbered again.

    Books of which nothing is left have no rows; the cascade gives them one section.
    """
    moved = sections.join(starts, "book").withColumn("start_page", F.greatest("start_page", "content_start")).filter("start_page <= end_page")
    order = Window.partitionBy("book").orderBy("number")
    cut = moved.withColumn("next", F.lead("start_page").over(order)).withColumn("end_page", F.when(F.col("end_page") >= F.col("next"), F.col("next") - 1).otherwise(F.col("end_page"))).filter("start_page <= end_page")
    return cut.withColumn("number", F.row_number().over(order).cast("long")).select(*SECTION)


def fallback_section(books: DataFrame, starts: DataFrame) -> DataFrame:
    """One section from the content's start to the last page."""
    return books.join(starts, "book").select("book", F.lit(1).cast("long").alias("number"), F.lit("Full document").alias("title"), F.col("content_start").alias("start_page"), F.col("total_pages").alias("end_page"))


def detect_sections(books: DataFrame, pages: DataFrame, toc: DataFrame, blocks: DataFrame) -> DataFrame:
    """Sections by the first method that finds two or more in a book, with detection_method; else the whole document.

    All methods are computed over all books; a book takes the first by METHODS. Front matter is taken off what outlines,
    layout and chapter headings give, not off article headings.
    """
    starts = lambda df, ix: df.select("book", F.col(ix).alias("ix"), "title", "page")
    heads = pages.select("book", "page", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), h("text").alias("title")) for m, h in (("regex", heading_regex), ("article_headings", heading_article))])).alias("h"))
    heads = heads.filter("h.title is not null").select("book", F.col("page").alias("ix"), "h.title", "page", F.col("h.m").alias("method"))  # both in one reading of the pages
    rows = starts(scan_toc(toc), "toc_ix").withColumn("method", F.lit("toc")).unionByName(starts(heading_layout(blocks), "page").withColumn("method", F.lit("layout"))).unionByName(heads)
    # a book and a method are one book to sections_from_starts()
    as_books = books.select("book", "total_pages", F.explode(F.array(*map(F.lit, METHODS))).alias("method")).select(F.struct("book", "method").alias("book"), "total_pages")
    found = sections_from_starts(rows.select(F.struct("book", "method").alias("book"), "ix", "title", "page"), as_books)
    turn = F.array_position(F.array(*map(F.lit, METHODS)), F.col("book.method"))
    every = found.select(F.col("book.book").alias("book"), "number", "title", "start_page", "end_page", F.col("book.method").alias("detection_method"), turn.alias("turn"))
    counted = every.withColumn("n", F.count("*").over(Window.partitionBy("book", "turn"))).filter("n >= 2")
    chosen = counted.withColumn("best", F.min("turn").over(Window.partitionBy("book"))).filter("turn = best")
    starts = content_start(pages, books)
    methods = chosen.select("book", "detection_method").distinct()
    trimmed = exclude_front_matter(chosen.filter("detection_method <> 'article_headings'").select(*SECTION), starts).join(methods, "book")
    whole = chosen.filter("detection_method = 'article_headings'").select(*SECTION, "detection_method")
    found = trimmed.select(*SECTION, "detection_method").unionByName(whole)
    rest = books.join(found.select("book").distinct(), "book", "left_anti")
    return found.unionByName(fallback_section(rest, starts).withColumn("detection_method", F.lit("fallback")))


def join_pages_sections(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Pages with the section whose inclusive interval they lie in; pages before the first section are in none."""
    return pages.join(sections, "book").filter(F.col("page").between(F.col("start_page"), F.col("end_page")))


def get_page_text(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """wanted (book, page) with the page's text, empty if there is no such page."""
    return wanted.join(pages.select("book", "page", "text"), ["book", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))
