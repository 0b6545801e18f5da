"""A whole run: selected sections to a model, answers checked and tried again, notes validated, chapters and masters put together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.constants import INPUT_RATE, OUTPUT_RATE, RETRIES
from quire.functions.text import coerce_page, estimated_tokens
from quire.operators import estimate, provider, verify
from quire.operators.estimate import Settings, Tokens
from quire.sources.files import CHAPTER, NOTE
from quire.sources.store import settled


@dataclass(frozen=True)
class Run:
    """What a run gives. answers: provider.annotate()'s rows with order and state (completed, failed, not_reached).

    notes: validated rows; summary: a row for each book; post_errors: what the density cap should have left empty.
    """

    answers: DataFrame
    notes: DataFrame
    repairs: DataFrame
    summary: DataFrame
    post_errors: DataFrame

    def failed_responses(self) -> DataFrame:
        """(book, chapter_number, attempt, response) of every attempt that failed, for outputs.save_failed_response()."""
        return self.answers.filter("state <> 'not_reached'").select("book", F.col("number").alias("chapter_number"), F.explode("failures").alias("f")).select("book", "chapter_number", "f.attempt", "f.response")

    def chapters(self) -> DataFrame:
        """(book, chapter_number, json) of completed sections, also of those without notes."""
        note = F.struct("page", "book_text", "annotation", "category", "grounding", "validation_flags")
        rows = self.notes.groupBy("book", "chapter_number").agg(F.array_sort(F.collect_list(F.struct("seq", note.alias("n")))).alias("n"))  # a section's pages times their limit
        done = self.answers.filter("state = 'completed'").select("book", F.col("number").alias("chapter_number"), F.col("title").alias("chapter_title"), "start_page", "end_page", "source_filename", "quality", "density")
        both = done.join(rows, ["book", "chapter_number"], "left").withColumn("annotations", F.coalesce("n.n", F.array()))
        return both.select("book", "chapter_number", F.to_json(F.struct("chapter_number", "chapter_title", "start_page", "end_page", "annotations", "source_filename", "quality", "density")).alias("json"))

    def masters(self) -> DataFrame:
        """(book, json): title, the run's figures and the completed chapters in order; books without a completed section have none."""
        parts = self.chapters().groupBy("book").agg(F.array_sort(F.collect_list(F.struct("chapter_number", "json"))).alias("c"))  # one book's chapters
        both = parts.join(self.summary, "book")
        head = F.to_json(F.struct(F.col("title").alias("book"), F.struct(*[c for c in self.summary.columns if c not in ("book", "title")]).alias("run")))
        return both.select("book", F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"chapters":['), F.array_join("c.json", ","), F.lit("]}")).alias("json"))


def requests(pages: DataFrame, books: DataFrame, sections: DataFrame, asked: DataFrame, settings: Settings = Settings(), tokens: Tokens = estimated_tokens) -> DataFrame:
    """asked (book, number, title, start_page, end_page, ...) with chunks: array of (chunk_ix, chunk_start, chunk_end, message)."""
    own = asked.select("book", "number", "title", "start_page", "end_page")
    inside = pages.join(own, "book").filter(F.col("page").between(F.col("start_page"), F.col("end_page")))
    sums = inside.groupBy("book", "number").agg(F.sum(tokens(F.col("text"))).alias("tokens"))
    n = F.col("end_page") - F.col("start_page") + 1
    sized = own.join(sums, ["book", "number"], "left").withColumn("size", estimate.chunk_size(n, F.coalesce("tokens", F.lit(0)), F.lit(settings.quotes_per_page))).drop("tokens")
    chunks = estimate.page_chunks(sized)
    part = F.concat(F.lit("=== PAGE "), F.col("page").cast("string"), F.lit(" ===\n\n"), "text", F.lit("\n\n"))
    placed = inside.join(sized.select("book", "number", "size"), ["book", "number"]).withColumn("chunk_ix", F.floor((F.col("page") - F.col("start_page")) / F.col("size")).cast("int"))
    texts = placed.groupBy("book", "number", "chunk_ix").agg(F.array_sort(F.collect_list(F.struct("page", part.alias("part")))).alias("parts"))  # a chunk's pages
    texts = texts.select("book", "number", "chunk_ix", F.array_join("parts.part", "").alias("text"))
    before = pages.select("book", F.col("page").alias("overlap_page"), F.col("text").alias("overlap_text"))
    whole = chunks.join(texts, ["book", "number", "chunk_ix"], "left").withColumn("text", F.coalesce("text", F.lit(""))).join(before, ["book", "overlap_page"], "left")
    told = estimate.user_message(whole, estimate.document_frame(books, sections, pages, tokens), settings.quotes_per_page, settings.quality)
    grouped = told.groupBy("book", "number").agg(F.array_sort(F.collect_list(F.struct("chunk_ix", "chunk_start", "chunk_end", "message"))).alias("chunks"))  # a section's chunks
    return asked.join(grouped, ["book", "number"])


def run_pipeline(pages: DataFrame, books: DataFrame, sections: DataFrame, selected: DataFrame, model: provider.Provider, settings: Settings = Settings(), retries: int = RETRIES, tokens: Tokens = estimated_tokens) -> Run:
    """pages (book, page, text), books (book, title, author, source_filename), sections (book, number, title, start_page, end_page), selected (book, number).

    Selected numbers that a book does not have are passed over. Sections are answered at the same time; of a book's
    sections, in order of their numbers, those after the first that failed count as not reached, as in a run one after
    the other. The answers are written to the shared folder before they are read. Sections without notes are completed.
    Null texts are empty; an empty selection gives no rows.
    """
    pages = pages.select("book", "page", F.coalesce("text", F.lit("")).alias("text"))
    asked = sections.join(selected.select("book", "number").distinct(), ["book", "number"])
    answers = settled(provider.annotate(requests(pages, books, sections, asked, settings, tokens), model, retries), "answers")
    stop = answers.filter("status = 'failed'").groupBy("book").agg(F.min("number").alias("stop"))
    state = F.when(F.col("number") > F.coalesce("stop", F.col("number")), "not_reached").otherwise(F.col("status"))
    named = books.select("book", F.coalesce("source_filename", F.lit("")).alias("source_filename"))
    answers = answers.join(stop, "book", "left").withColumn("state", state).drop("stop").join(named, "book").withColumn("quality", F.lit(settings.quality)).withColumn("density", F.lit(settings.quotes_per_page))
    done = answers.filter("state = 'completed'")
    given = done.select("book", F.col("number").alias("chapter_number"), "start_page", "end_page", F.posexplode(F.from_json("response", CHAPTER)["annotations"]).alias("ix", "a"))
    a = given.withColumn("a", F.from_json("a", NOTE))
    rows = a.select("book", "chapter_number", F.col("ix").cast("long").alias("seq"), coerce_page(F.col("a.page")).cast("long").alias("page"), *[F.coalesce(f"a.{c}", F.lit("")).alias(c) for c in ("book_text", "annotation", "category", "grounding")], "start_page", "end_page")
    first, second = verify.validation_steps(rows, pages, settings.quotes_per_page)
    notes = settled(verify.normalize_row(verify.kept_rows(second)), "notes")
    counts = [c for c in ("trimmed", "dropped_oor", "dropped_invalid", "dropped_duplicate")]
    repairs = verify.repair_report(first).unionByName(verify.repair_report(second)).groupBy(*verify.KEY).agg(*[F.sum(c).alias(c) for c in counts])
    limits = done.select("book", F.col("number").alias("chapter_number"), "start_page", "end_page")
    post_errors = verify.structure_post(notes.drop("start_page", "end_page"), limits, settings.quotes_per_page)
    return Run(answers, notes, repairs, _summary(answers, books, notes, repairs, settings), post_errors)


def _summary(answers: DataFrame, books: DataFrame, notes: DataFrame, repairs: DataFrame, settings: Settings) -> DataFrame:
    """A row for each book with a selected section; tokens and cost are of completed sections."""
    done = F.col("state") == "completed"
    numbers = lambda c: F.array_sort(F.collect_list(c))  # noqa: E731  a book's sections
    per_book = answers.groupBy("book").agg(
        numbers(F.col("number")).alias("chapters_requested"), numbers(F.when(done, F.col("number"))).alias("chapters_completed"), F.min(F.when(F.col("state") == "failed", F.col("number"))).alias("chapter_failed"),
        *[F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")],
    )
    flagged = verify.flagged_rows(notes).groupBy("book").agg(F.sum("flagged").alias("flagged_rows"))
    mended = repairs.groupBy("book").agg(F.sum("trimmed").alias("trimmed"), F.sum("dropped_oor").alias("dropped_oor"), F.sum("dropped_duplicate").alias("dropped_duplicate"))
    whole = per_book.join(books.select("book", "title", F.coalesce("author", F.lit("")).alias("author"), F.coalesce("source_filename", F.lit("")).alias("source_filename")), "book").join(flagged, "book", "left").join(mended, "book", "left")
    price = F.round(F.col("prompt_tokens") * F.lit(INPUT_RATE / 1e6) + F.col("completion_tokens") * F.lit(OUTPUT_RATE / 1e6), 9)
    for name in ("flagged_rows", "trimmed", "dropped_oor", "dropped_duplicate"):
        whole = whole.withColumn(name, F.coalesce(name, F.lit(0)))
    whole = whole.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).withColumn("cost", price)
    for name, value in settings.metadata().items():
        whole = whole.withColumn(name, F.lit(value))
    return whole
