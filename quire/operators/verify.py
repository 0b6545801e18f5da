"""Validation of notes: quotes against pages, density, structure, types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import constants as C
from quire.functions.text import casefold, coerce_page, normalize_whitespace, strip, tokenize, verified_quote, word_count

KEY = ["book", "chapter_number"]


def add_flags(flags: Column, *more: Column) -> Column:
    """flags and the new ones that aren't null, in order, each once."""
    return F.array_distinct(F.concat(flags, F.array_compact(F.array(*more))))


def no_flags() -> Column:
    return F.array().cast("array<string>")


def quote_pages(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(book, quote, p) of the pages that hold a quote, as it is or normalised, each once. quotes: (book, quote), distinct.

    A page that holds a quote has all its words but the first and last as whole words. So quotes of three words or more
    meet only the pages that have their longest inner word, by equality on book and word; the shorter ones meet every
    page of their book. Books without quotes are passed over.
    """
    wanted = quotes.filter(F.col("quote") != "").select("book", "quote", normalize_whitespace("quote").alias("plain_quote"), tokenize("quote").alias("words"))
    inner = F.transform(F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    keyed = wanted.withColumn("word", F.array_max(inner)["w"]).drop("words")
    held = pages.select("book", F.col("page").alias("p"), "text").join(keyed.select("book").distinct(), "book", "left_semi").withColumn("plain", normalize_whitespace("text"))
    hit = F.contains("text", F.col("quote")) | F.contains("plain", F.col("plain_quote"))
    index = held.select("book", "p", F.explode(F.array_distinct(F.split("plain", " "))).alias("word"))
    near = keyed.filter("word is not null").join(index, ["book", "word"]).drop("word")
    long = near.join(held, ["book", "p"]).filter(hit)
    short = keyed.filter("word is null").drop("word").join(held, "book").filter(hit)
    return long.select("book", "quote", "p").unionByName(short.select("book", "quote", "p"))


def find_quote_page(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """quotes (book, quote, ...) with found_page: the first page of the book that holds the quote, as it is or normalised; null if none does."""
    first = quote_pages(quotes.select("book", "quote").distinct(), pages).groupBy("book", "quote").agg(F.min("p").alias("found_page"))
    return quotes.join(first, ["book", "quote"], "left")


def note_flags(note: Column) -> list[Column]:
    """Flags of a note as it was given, in order, null where they don't apply."""
    stripped = strip(note)
    said = (stripped != "") & (stripped != C.UNKNOWN)
    words = word_count(stripped)
    return [
        F.when(stripped == "", "empty_annotation"),
        F.when(said & (words < C.SHORT_NOTE_WORDS), "short_annotation"),
        F.when(said & (words > C.LONG_NOTE_WORDS), "long_annotation"),
        F.when(said & reduce(lambda a, b: a | b, [F.startswith(casefold(stripped), F.lit(p)) for p in C.GENERIC_PREFIXES]), "generic_phrasing"),
    ]


def verify_quotes(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows (KEY, seq, page, book_text, annotation, start_page, end_page, validation_flags) checked against pages (book, page, text).

    A quote stays if its page holds it, moves to the first page of its section that does, or becomes the sentinel; flags
    tell which, then what the note lacks. Only rows whose own page fails meet the section's other pages.
    """
    numbered = rows.withColumn("plain_quote", normalize_whitespace("book_text"))
    held = pages.select("book", F.col("page").alias("p"), "text", normalize_whitespace("text").alias("plain"))
    hit = (F.col("book_text") != "") & (F.contains("text", F.col("book_text")) | F.contains("plain", F.col("plain_quote")))
    own = numbered.join(held.withColumnRenamed("book", "b"), (F.col("book") == F.col("b")) & (F.col("page") == F.col("p")) & F.col("page").between(F.col("start_page"), F.col("end_page")), "left")
    own = own.withColumn("is_own", F.coalesce(hit, F.lit(False))).drop("b", "p", "text", "plain")
    lost = own.filter(~F.col("is_own") & (F.col("book_text") != C.UNKNOWN)).select("book", "chapter_number", "book_text", "plain_quote", "start_page", "end_page").distinct()
    found = lost.join(held, "book").filter(F.col("p").between(F.col("start_page"), F.col("end_page"))).filter(hit)
    first = found.groupBy(*KEY, "book_text").agg(F.min("p").alias("first_page"))
    both = own.join(first, [*KEY, "book_text"], "left")
    state = (
        F.when(F.col("book_text") == C.UNKNOWN, "quote_unknown").when(F.col("is_own"), F.lit(None)).when(F.col("first_page").isNotNull(), "page_corrected").otherwise("quote_not_found")
    )
    moved = both.withColumn("state", state)
    page = F.when(F.col("state") == "page_corrected", F.col("first_page")).otherwise(F.col("page"))
    quote = F.when(F.col("state") == "quote_not_found", C.UNKNOWN).otherwise(F.col("book_text"))
    note = strip("annotation")
    gone = (note != "") & (note != C.UNKNOWN) & (F.col("new_quote") == C.UNKNOWN)
    checked = moved.withColumn("new_page", page).withColumn("new_quote", quote)
    flags = add_flags(
        F.col("validation_flags"), F.col("state"), *note_flags(F.col("annotation")), F.when(gone, "annotation_unknown"),
        F.when(F.col("new_page").isNull() | ~F.col("new_page").between(F.col("start_page"), F.col("end_page")), "invalid_page"),
    )
    checked = checked.withColumn("validation_flags", flags).withColumn("annotation", F.when((note == "") | gone, C.UNKNOWN).otherwise(F.col("annotation")))
    return checked.withColumn("page", F.col("new_page")).withColumn("book_text", F.col("new_quote")).drop("plain_quote", "is_own", "first_page", "state", "new_page", "new_quote")


def density_status(rows: DataFrame) -> DataFrame:
    """rows (KEY, seq, page, book_text, start_page, end_page) with status: invalid, oor, duplicate or kept, and the page as a number.

    Of rows of one page with the same normalised quote the first stays; blank quotes and the sentinel are never duplicates.
    """
    paged = rows.withColumn("page", coerce_page("page").cast("long"))
    key = normalize_whitespace(F.coalesce("book_text", F.lit("")))
    inside = F.col("page").between(F.col("start_page"), F.col("end_page"))
    marked = paged.withColumn("quote_key", key).withColumn("usable", F.coalesce(inside, F.lit(False)))
    order = F.row_number().over(Window.partitionBy(*KEY, "usable", "page", "quote_key").orderBy("seq"))
    return marked.withColumn(
        "status",
        F.when(F.col("page").isNull(), "invalid").when(~F.col("usable"), "oor").when((order > 1) & ~F.col("quote_key").isin("", C.UNKNOWN), "duplicate").otherwise("kept"),
    ).drop("quote_key", "usable")


def density_cap(rows: DataFrame, quotes_per_page: int | None = None) -> DataFrame:
    """rows with status (invalid, oor, duplicate, trimmed or kept) and rank (place on its page, null if dropped).

    With quotes_per_page, a page that has more keeps so many: quotes that are still in the document first, then in order.
    A page within the limit keeps its order. Nothing is padded.
    """
    marked = density_status(rows).withColumn("is_kept", F.col("status") == "kept")
    page = Window.partitionBy(*KEY, "page", "is_kept")
    n = F.count("*").over(page)
    last = F.when(F.lit(quotes_per_page is not None) & (n > (quotes_per_page or 0)) & ~verified_quote("book_text"), 1).otherwise(0)
    ranked = marked.withColumn("late", last).withColumn("rank", F.when(F.col("is_kept"), F.row_number().over(page.orderBy("late", "seq"))))
    if quotes_per_page is not None:
        ranked = ranked.withColumn("status", F.when(F.col("rank") > quotes_per_page, "trimmed").otherwise(F.col("status")))
        ranked = ranked.withColumn("rank", F.when(F.col("status") == "kept", F.col("rank")))
    return ranked.drop("late", "is_kept")


def kept_rows(capped: DataFrame) -> DataFrame:
    """The kept rows of density_cap(), numbered anew in their order: by page, then place on it."""
    order = Window.partitionBy(*KEY).orderBy("page", "rank")
    return capped.filter("status = 'kept'").withColumn("seq", F.row_number().over(order).cast("long")).drop("status", "rank")


def repair_report(capped: DataFrame) -> DataFrame:
    """Dropped and trimmed rows of each section."""
    count = lambda status: F.count_if(F.col("status") == status)
    return capped.groupBy(*KEY).agg(count("trimmed").alias("trimmed"), count("oor").alias("dropped_oor"), count("invalid").alias("dropped_invalid"), count("duplicate").alias("dropped_duplicate"))


def page_note_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY, "page").agg(F.count("*").alias("n"))


def normalize_row(rows: DataFrame) -> DataFrame:
    """Unknown categories and groundings are replaced and flagged; where quote or note is the sentinel, grounding is uncertain, without a flag."""
    bad_category, bad_grounding = ~F.coalesce(F.col("category").isin(C.CATEGORIES), F.lit(False)), ~F.coalesce(F.col("grounding").isin(C.GROUNDINGS), F.lit(False))
    flags = add_flags(F.col("validation_flags"), F.when(bad_category, "category_invalid"), F.when(bad_grounding, "grounding_invalid"))
    uncertain = bad_grounding | (F.col("book_text") == C.UNKNOWN) | (F.col("annotation") == C.UNKNOWN)
    return (
        rows.withColumn("validation_flags", flags)
        .withColumn("category", F.when(bad_category, C.FALLBACK_CATEGORY).otherwise(F.col("category")))
        .withColumn("grounding", F.when(uncertain, C.FALLBACK_GROUNDING).otherwise(F.col("grounding")))
    )


def flagged_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.count_if(F.size("validation_flags") > 0).alias("flagged"))


def structure_hard(responses: DataFrame) -> DataFrame:
    """responses (book, response: JSON text) with errors: what no repair can mend, in order; empty if sound."""
    top = F.coalesce(F.json_object_keys("response"), no_flags())
    missing = F.transform(F.array_except(F.array(*map(F.lit, C.TOP_FIELDS)), top), lambda f: F.concat(F.lit("Missing field: "), f))
    notes = F.get_json_object("response", "$.annotations")
    items = F.from_json(notes, "array<string>")
    keys = lambda x: F.json_object_keys(x)  # noqa: E731  null unless x is an object
    of_row = F.flatten(F.transform(items, lambda x, i: F.when(
        keys(x).isNull(), F.array(F.concat(F.lit("annotations["), i.cast("string"), F.lit("] must be an object")))
    ).otherwise(F.transform(F.array_except(F.array(*map(F.lit, C.ROW_FIELDS)), keys(x)), lambda f: F.concat(F.lit("annotations["), i.cast("string"), F.lit("] missing field: "), f)))))
    not_list = F.array(F.lit("annotations must be an array"))
    errors = F.when(F.size(missing) > 0, missing).when(~F.startswith(F.trim(notes), F.lit("[")), not_list).otherwise(F.coalesce(of_row, not_list))
    return responses.withColumn("errors", errors)


def blocking_errors(errors: Column) -> Column:
    marks = ["Missing field", "must be an array", "must be an object", "missing field:"]
    return F.exists(errors, lambda e: reduce(lambda a, b: a | b, [F.contains(e, F.lit(m)) for m in marks]))


def structure_post(rows: DataFrame, sections: DataFrame, quotes_per_page: int) -> DataFrame:
    """(KEY, kind, page, n): too many notes in a section or on a page, and pages outside it. sections: (KEY, start_page, end_page)."""
    both = rows.select(*KEY, "page").join(sections, KEY)
    pages = F.col("end_page") - F.col("start_page") + 1
    total = both.groupBy(*KEY, "start_page", "end_page").agg(F.count("*").alias("n")).filter(F.col("n") > pages * quotes_per_page).select(*KEY, F.lit("section_count").alias("kind"), F.lit(None).cast("long").alias("page"), "n")
    per_page = both.groupBy(*KEY, "start_page", "end_page", "page").agg(F.count("*").alias("n"))
    inside = F.col("page").between(F.col("start_page"), F.col("end_page"))
    outside = per_page.filter(~inside).select(*KEY, F.lit("page_range").alias("kind"), "page", "n")
    crowded = per_page.filter(inside & (F.col("n") > quotes_per_page)).select(*KEY, F.lit("page_count").alias("kind"), "page", "n")
    return total.unionByName(outside).unionByName(crowded)


def validated_pipeline(rows: DataFrame, pages: DataFrame, quotes_per_page: int) -> DataFrame:
    """The whole validation: range and duplicates, quotes, density, types. Order matters: rows outside their section go before any page is corrected."""
    return normalize_row(kept_rows(validation_steps(rows, pages, quotes_per_page)[1]))


def validation_steps(rows: DataFrame, pages: DataFrame, quotes_per_page: int) -> tuple[DataFrame, DataFrame]:
    """density_cap() of the rows as they came, without a limit, and of what is left of them, checked, with the limit."""
    first = density_cap(rows.withColumn("validation_flags", no_flags()))
    return first, density_cap(verify_quotes(kept_rows(first), pages), quotes_per_page)
