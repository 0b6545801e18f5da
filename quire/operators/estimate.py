"""Settings, selections, token and cost estimates, page chunks and the document frame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import constants as C
from quire.functions.text import estimated_tokens, strip

#: A count of a text's tokens: the stand-in, or functions.tokens.counter() of a real tokeniser.
Tokens = Callable[[Column], Column]


@dataclass(frozen=True)
class Settings:
    """Notes for each page (1 to 10), quality, and whether the quality was not asked for."""

    quotes_per_page: int = 1
    quality: str = "medium"
    quality_was_skipped: bool = False

    def __post_init__(self):
        if not 1 <= self.quotes_per_page <= 10:
            raise ValueError("quotes_per_page must be from 1 to 10")
        if self.quality not in C.QUALITY_FACTORS:
            raise ValueError(f"quality must be one of {', '.join(C.QUALITY_FACTORS)}")

    def label(self) -> str:
        return self.quality.capitalize()

    def metadata(self) -> dict:
        return {"quotes_per_page": self.quotes_per_page, "quality": self.quality, "quality_was_skipped": self.quality_was_skipped}


def quality_factor(quality: Column) -> Column:
    found = F.lit(1.0)
    for name, factor in C.QUALITY_FACTORS.items():
        found = F.when(quality == name, F.lit(factor)).otherwise(found)
    return found


def estimate_output_tokens(pages: Column, qpp: Column, quality: Column) -> tuple[Column, Column]:
    """Low and high estimate; fractions are cut off."""
    notes = F.greatest(pages, F.lit(1)).cast("double") * F.greatest(qpp, F.lit(1))
    return tuple((notes * F.lit(float(per)) * quality_factor(quality)).cast("long") for per in (C.OUTPUT_TOKENS_LOW, C.OUTPUT_TOKENS_HIGH))


def cost(input_tokens: Column, output_tokens: Column) -> Column:
    return input_tokens / F.lit(1e6) * C.INPUT_RATE + output_tokens / F.lit(1e6) * C.OUTPUT_RATE


def density_tier(qpp: Column) -> Column:
    return F.when(qpp <= 2, "selective").when(qpp <= 5, "balanced").otherwise("dense")


def skip_quality(pages: Column) -> Column:
    return pages >= C.SKIP_QUALITY_PAGES


def dense_high_warn(qpp: Column, quality: Column) -> Column:
    return (qpp >= C.DENSE_HIGH_QPP) & (quality == "high")


def parse_selection(text: Column) -> Column:
    """struct(numbers, error): distinct sorted numbers of a list such as ``1-3, 5``; numbers parted by spaces are a list too.

    error: empty, reversed, or invalid; numbers is then null.
    """
    spaced = F.regexp_replace(strip(text), r"\s*-\s*", "-")
    parts = F.filter(F.split(spaced, r"[,\s]+"), lambda x: x != "")
    low = lambda x: F.regexp_extract(x, r"^([0-9]+)", 1).try_cast("int")
    high = lambda x: F.regexp_extract(x, r"([0-9]+)$", 1).try_cast("int")
    error = (
        F.when(F.coalesce(F.size(parts), F.lit(0)) == 0, "empty")
        .when(F.exists(parts, lambda x: ~x.rlike(r"^[0-9]+(-[0-9]+)?$")), "invalid")
        .when(F.exists(parts, lambda x: low(x) > high(x)), "reversed")
    )
    good = F.filter(parts, lambda x: x.rlike(r"^[0-9]+(-[0-9]+)?$") & (low(x) <= high(x)))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(good, lambda x: F.sequence(low(x), high(x))))))
    return F.struct(F.when(error.isNull(), numbers).alias("numbers"), error.alias("error"))


def split_selection(selected: DataFrame, sections: DataFrame) -> DataFrame:
    """(book, number, is_valid) of selected numbers: whether the book has such a section."""
    have = sections.select("book", "number").distinct()
    valid = selected.join(have, ["book", "number"], "left_semi").withColumn("is_valid", F.lit(True))
    return valid.unionByName(selected.join(have, ["book", "number"], "left_anti").withColumn("is_valid", F.lit(False)))


def section_index(pages: DataFrame, sections: DataFrame, qpp: int = 1, quality: str = "medium", tokens: Tokens = estimated_tokens) -> DataFrame:
    """Pages, characters, tokens and output estimates of each section."""
    inside = pages.join(sections, "book").filter(F.col("page").between(F.col("start_page"), F.col("end_page")))
    sums = inside.groupBy("book", "number").agg(F.sum(F.length("text")).alias("chars"), F.sum(tokens(F.col("text"))).alias("tokens"))
    both = sections.join(sums, ["book", "number"], "left").withColumn("pages", F.col("end_page") - F.col("start_page") + 1)
    low, high = estimate_output_tokens(F.col("pages"), F.lit(qpp), F.lit(quality))
    return both.select("book", "number", "title", "pages", F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("tokens", F.lit(0)).alias("tokens"), low.alias("output_low"), high.alias("output_high"))


def selection_cost(index: DataFrame, selected: DataFrame, qpp: int = 1, quality: str = "medium") -> DataFrame:
    """One row for each book: totals of the selected sections; output comes from the pages' sum."""
    own = index.join(selected.select("book", "number").distinct(), ["book", "number"]).groupBy("book").agg(F.sum("tokens").alias("input_tokens"), F.sum("pages").alias("pages"))
    low, high = estimate_output_tokens(F.col("pages"), F.lit(qpp), F.lit(quality))
    sized = own.withColumn("output_low", low).withColumn("output_high", high)
    priced = sized.withColumn("cost_low", F.round(cost(F.col("input_tokens"), F.col("output_low")), 9)).withColumn("cost_high", F.round(cost(F.col("input_tokens"), F.col("output_high")), 9))
    return priced.withColumn("expected", F.col("pages") * qpp).withColumn("over_budget", F.col("cost_high") > C.BUDGET_WARNING)


def chunk_size(pages: Column, tokens: Column, qpp: Column) -> Column:
    """Pages of a request: within the output budget, the context, and 20 pages if there is more than one note a page."""
    per_page = F.greatest(F.lit(1), F.floor(tokens / pages))
    by_output = F.floor(F.lit(C.CHUNK_OUTPUT // C.TOKENS_PER_NOTE) / qpp)
    size = F.least(by_output, F.floor(F.lit(C.MAX_CONTEXT) / per_page), pages)
    size = F.when(qpp > 1, F.least(size, F.lit(C.DENSE_CHUNK_PAGES))).otherwise(size)
    return F.when(pages <= 1, F.lit(1)).otherwise(F.greatest(size, F.lit(1))).cast("long")


def page_chunks(sections: DataFrame) -> DataFrame:
    """sections with size: a row for each chunk (chunk_ix from 0, chunk_start, chunk_end, overlap_page: the page before, but for the first)."""
    out = sections.select("*", F.posexplode(F.sequence("start_page", "end_page", "size")).alias("chunk_ix", "chunk_start"))
    return out.withColumn("chunk_end", F.least(F.col("chunk_start") + F.col("size") - 1, F.col("end_page"))).withColumn("overlap_page", F.when(F.col("chunk_ix") > 0, F.col("chunk_start") - 1))


def merge_chunks(rows: DataFrame) -> DataFrame:
    """Notes of a section's chunks in one order: by page, then chunk, then place in the chunk; seq from 1."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("book", "number").orderBy("page", "chunk_ix", "chunk_seq")).cast("long"))


def doc_frame(pages: DataFrame, base_tokens: int | Column = 100, tokens: Tokens = estimated_tokens) -> DataFrame:
    """The opening pages that a request is framed with: non-blank ones of the first 8 while their tokens and base_tokens stay within 1500."""
    opening = pages.filter((F.col("page") <= C.FRAME_PAGES) & ~strip("text").isin("", C.NO_TEXT)).withColumn("tokens", tokens(page_block("page", "text")))
    running = opening.withColumn("running", F.sum("tokens").over(Window.partitionBy("book").orderBy("page")) + base_tokens)
    return running.filter(F.col("running") <= C.FRAME_TOKENS)


def page_block(page: str, text: str) -> Column:
    return F.concat(F.lit("=== PAGE "), F.col(page).cast("string"), F.lit(" ===\n"), F.col(text), F.lit("\n"))


def document_frame(books: DataFrame, sections: DataFrame, pages: DataFrame, tokens: Tokens = estimated_tokens) -> DataFrame:
    """(book, frame): title, author, list of sections and the opening pages that fit with them; books: (book, title, author)."""
    said = lambda c: F.coalesce(F.nullif(strip(F.coalesce(F.col(c), F.lit(""))), F.lit("")), F.lit("unavailable"))
    line = F.concat(F.lit("- "), F.col("number").cast("string"), F.lit(". "), "title", F.lit(" (pages "), F.col("start_page").cast("string"), F.lit(" to "), F.col("end_page").cast("string"), F.lit(")"))
    listed = sections.select("book", F.struct("number", line.alias("line")).alias("s")).groupBy("book").agg(F.array_sort(F.collect_list("s")).alias("s"))  # sections of one book
    names = F.coalesce(F.array_join("s.line", "\n"), F.lit("- unavailable"))
    head = F.concat(F.lit("The document (context; not to be quoted from here)\nTitle: "), said("title"), F.lit("\nAuthor: "), said("author"), F.lit("\nSections:\n"), names, F.lit("\n\nOpening text:"))
    headed = books.join(listed, "book", "left").select("book", head.alias("head"))
    sized = headed.withColumn("base", tokens(F.col("head")))
    fit = doc_frame(pages.join(sized.select("book", "base"), "book"), F.col("base"), tokens)
    opening = fit.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("page", page_block("page", "text").alias("t")))).alias("o"))  # within the frame's tokens
    return sized.join(opening, "book", "left").select("book", F.concat("head", F.lit("\n"), F.coalesce(F.array_join("o.t", "\n"), F.lit("unavailable"))).alias("frame"))


def usage_rollup(usage: DataFrame) -> DataFrame:
    """One row for each book: tokens and their cost."""
    sums = usage.groupBy("book").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    total = sums.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    return total.withColumn("cost", F.round(cost(F.col("prompt_tokens"), F.col("completion_tokens")), 9))


def user_message(chunks: DataFrame, frames: DataFrame, qpp: int = 1, quality: str = "medium") -> DataFrame:
    """chunks (book, number, title, chunk_start, chunk_end, overlap_page, overlap_text, text) with message: the book's frame, the page before as context, what is asked for, the pages."""
    both = chunks.join(frames, "book", "left")
    most = ((F.col("chunk_end") - F.col("chunk_start") + 1) * qpp).cast("string")
    body = F.concat_ws(
        "\n\n",
        F.col("frame"),
        F.when(F.coalesce("overlap_text", F.lit("")) != "", F.concat(F.lit("The page before (context; not to be quoted)\n\n=== PAGE "), F.col("overlap_page").cast("string"), F.lit(" ===\n\n"), "overlap_text")),
        F.lit("The pages to read; every quote is copied from one of them"),
        F.concat(F.lit("Section "), F.col("number").cast("string"), F.lit(": "), "title", F.lit("\nPages "), F.col("chunk_start").cast("string"), F.lit(" to "), F.col("chunk_end").cast("string")),
        F.concat(F.lit(f"Notes a page: at most {qpp}; quality: {quality}; notes in all: at most "), most),
        F.col("text"),
    )
    return both.withColumn("message", body).drop("frame")


def retry_message(message: Column, errors: Column) -> Column:
    """The message with the first 20 errors of the attempt before."""
    return F.when(F.size(errors) > 0, F.concat(message, F.lit("\n\nCorrect these:\n"), F.array_join(F.transform(F.slice(errors, 1, 20), lambda e: F.concat(F.lit("- "), e)), "\n"))).otherwise(message)


def first_misses(placements: DataFrame, most: int = 10) -> DataFrame:
    """The first misses of each book, by target: a report's top rows."""
    order = Window.partitionBy("book").orderBy("target_id")
    return placements.filter("reason is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
