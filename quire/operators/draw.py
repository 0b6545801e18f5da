"""Highlights and margin notes as rows to draw, and the report of what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import place as P
from quire.sources.files import write_json

DRAWN = "book, page, target_id, layer, kind, ix, x0, y0, x1, y1, fill, opacity, border, border_width, text, font, font_size"


def _rgb(color: tuple[float, float, float]) -> Column:
    return F.array(*map(F.lit, color))


def quote_rects(found: DataFrame, words: DataFrame) -> DataFrame:
    """found (find_quotes()'s rows) with rects: the boxes of the quote's words, in order; null for a miss."""
    boxes = words.groupBy("book", "page").agg(F.array_sort(F.collect_list(F.struct("word_ix", F.struct("x0", "y0", "x1", "y1").alias("r")))).alias("boxes"))  # a page's words
    boxes = boxes.select("book", F.col("page").alias("found_page"), F.col("boxes.r").alias("boxes"))
    return found.join(boxes, ["book", "found_page"], "left").withColumn("rects", F.when(F.col("start").isNotNull(), F.slice("boxes", F.col("start") + 1, F.col("stop") - F.col("start")))).drop("boxes")


def marked(found: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    """found with rects, note (null if there is none to draw), note_added and reason; a quote that no words cover is highlight_failed.

    found: find_quotes()'s rows with annotation. sizes: (book, page, width, height).
    """
    rows = quote_rects(found, words)
    failed = F.col("method").isNotNull() & (F.coalesce(F.size("rects"), F.lit(0)) <= 0)
    rows = rows.withColumn("reason", F.when(failed, "highlight_failed").otherwise(F.col("reason")))
    drawn = F.col("reason").isNull() & F.col("method").isNotNull()
    rows = rows.withColumn("note", F.when(drawn, P.usable_note(F.col("annotation")))).withColumn("rects", F.when(drawn, F.col("rects")))
    return rows.withColumn("note_added", F.col("note").isNotNull())


def note_boxes(rows: DataFrame, words: DataFrame, sizes: DataFrame) -> DataFrame:
    """(book, page, target_id, note, font_size, x0, top, x1, bottom) of marked()'s notes, placed in order of target_id beside their quotes' first words."""
    edge = P.body_right_edge(words, sizes).select("book", "page", P.margin_band(F.col("free_margin"), F.col("width")).alias("band"))
    notes = rows.filter("note_added").select("book", F.col("found_page").alias("page"), F.col("target_id").cast("long").alias("seq"), "target_id", "note", F.col("rects")[0]["y0"].alias("y"))
    both = notes.join(edge, ["book", "page"]).join(sizes.select("book", "page", F.col("height").alias("page_height")), ["book", "page"])
    width = F.col("band.x1") - F.col("band.x0")
    sized = both.withColumn("font_size", P.note_fontsize(F.col("note"), width, F.col("page_height")))
    boxed = sized.withColumn("x0", F.col("band.x0")).withColumn("x1", F.col("band.x1")).withColumn("height", P.estimate_note_height(F.col("note"), width, F.col("font_size")) + 4)
    placed = P.place_notes(boxed).select("book", "page", "seq", "top", "bottom")
    return boxed.join(placed, ["book", "page", "seq"]).select("book", "page", "target_id", "note", "font_size", "x0", "top", "x1", "bottom")


def draw_rows(rows: DataFrame, words: DataFrame, sizes: DataFrame, color: tuple[float, float, float] = P.HIGHLIGHT_RGB) -> DataFrame:
    """DRAWN: what a drawing program puts on each page, by layer, target and ix, on marked()'s rows.

    Layer 0: a highlight for each line of a quote; 1: a note's box, 2: its text, set within the box by the padding. A
    target's highlight is drawn before its note; all are part of the page's content.
    """
    none, no_color = F.lit(None).cast("string"), F.lit(None).cast("array<double>")
    lines = rows.filter(F.size("rects") > 0).select("book", F.col("found_page").alias("page"), "target_id", F.posexplode(P.merge_line_rects(F.col("rects"))).alias("ix", "r"))
    highlights = lines.select(
        "book", "page", "target_id", F.lit(0).alias("layer"), F.lit("highlight").alias("kind"), "ix", "r.x0", "r.y0", "r.x1", "r.y1", _rgb(color).alias("fill"), F.lit(P.HIGHLIGHT_OPACITY).alias("opacity"),
        no_color.alias("border"), F.lit(0.0).alias("border_width"), none.alias("text"), none.alias("font"), F.lit(None).cast("double").alias("font_size"),
    )
    boxes = note_boxes(rows, words, sizes)
    frames = boxes.select(
        "book", "page", "target_id", F.lit(1).alias("layer"), F.lit("note_box").alias("kind"), F.lit(0).alias("ix"), "x0", F.col("top").alias("y0"), "x1", F.col("bottom").alias("y1"), _rgb(P.NOTE_FILL).alias("fill"),
        F.lit(P.NOTE_OPACITY).alias("opacity"), _rgb(P.NOTE_BORDER).alias("border"), F.lit(P.NOTE_BORDER_WIDTH).alias("border_width"), none.alias("text"), none.alias("font"), F.lit(None).cast("double").alias("font_size"),
    )
    texts = boxes.select(
        "book", "page", "target_id", F.lit(2).alias("layer"), F.lit("note_text").alias("kind"), F.lit(0).alias("ix"), (F.col("x0") + P.PAD).alias("x0"), (F.col("top") + P.PAD).alias("y0"), (F.col("x1") - P.PAD).alias("x1"), (F.col("bottom") - P.PAD).alias("y1"),
        _rgb(P.NOTE_TEXT).alias("fill"), F.lit(1.0).alias("opacity"), no_color.alias("border"), F.lit(0.0).alias("border_width"), F.col("note").alias("text"), F.lit(P.NOTE_FONT).alias("font"), "font_size",
    )
    return highlights.unionByName(frames).unionByName(texts)


def report(rows: DataFrame) -> DataFrame:
    """(book, highlighted_count, notes_count, miss_count) of marked()'s rows."""
    return rows.groupBy("book").agg(F.count_if(F.col("reason").isNull()).alias("highlighted_count"), F.count_if("note_added").alias("notes_count"), F.count_if(F.col("reason").isNotNull()).alias("miss_count"))


def report_json(rows: DataFrame) -> DataFrame:
    """(book, json): the counts, and every hit and miss in order of target_id; rows also have chapter_number and quote."""
    hit = F.struct("page", F.col("quote").alias("book_text"), F.size("rects").alias("rect_count"), "method", "chapter_number", "note_added")
    miss = F.struct("page", F.col("quote").alias("book_text"), "reason", "chapter_number")
    listed = lambda wanted, item: F.array_sort(F.collect_list(F.when(wanted, F.struct("target_id", item.alias("x")))))["x"]  # noqa: E731  one book's targets
    is_hit = F.col("reason").isNull()
    both = rows.groupBy("book").agg(listed(is_hit, hit).alias("hits"), listed(~is_hit, miss).alias("misses")).join(report(rows), "book")
    return both.select("book", F.to_json(F.struct("highlighted_count", "notes_count", "miss_count", "hits", "misses")).alias("json"))


def save_report(rows: DataFrame, path: str) -> None:
    write_json(report_json(rows), path)
