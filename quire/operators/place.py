"""Finding quotes among a page's words, and notes in its margin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.constants import UNKNOWN
from quire.functions.text import normalize_whitespace, quote_variants, strip, tokenize

# Fixed values of the layout, in points.
BAND, MARGIN_MIN, MARGIN_PREFERRED, PAD, FONT_MAX, FONT_MIN = 0.08, 72.0, 120.0, 3.0, 8.0, 6.0
LINE_TOLERANCE, GAP_TOLERANCE, TRIES = 2.0, 3.0, 24
HIGHLIGHT_RGB, HIGHLIGHT_OPACITY = (1.0, 0.92, 0.23), 0.35
NOTE_FILL, NOTE_OPACITY, NOTE_TEXT, NOTE_BORDER, NOTE_BORDER_WIDTH, NOTE_FONT = (1.0, 1.0, 1.0), 1.0, (0.0, 0.0, 0.0), (0.15, 0.15, 0.15), 0.5, "helv"
# Widths of printable ASCII from the space on in the public Helvetica metrics, in thousandths of the size.
HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
OTHER_WIDTH = 556
RECT = "struct<x0:double,y0:double,x1:double,y1:double>"


def usable_note(note: Column) -> Column:
    s = strip(F.coalesce(note, F.lit("")))
    return F.when((s != "") & (s != UNKNOWN), s)


def target_page_range(targets: DataFrame, books: DataFrame) -> DataFrame:
    """targets with reason page_out_of_range where the book has no such page, else null."""
    return targets.join(books, "book", "left").withColumn("reason", F.when(F.coalesce(~F.col("page").between(1, F.col("total_pages")), F.lit(True)), "page_out_of_range"))


def word_lists(words: DataFrame) -> DataFrame:
    """(book, page, words): the texts of a page's words in order, normalised. words: (book, page, word_ix, x0, y0, x1, y1, word)."""
    item = F.struct("word_ix", normalize_whitespace("word").alias("word"))
    return words.groupBy("book", "page").agg(F.array_sort(F.collect_list(item)).alias("words")).withColumn("words", F.col("words.word"))


def word_sequence_match(needle: Column, words: Column) -> Column:
    """struct(start, stop) of the first run of words [start, stop) that reads as needle, else null.

    A word that ends in a hyphen may join with the next one into one word of the needle. Plain words that equal the
    needle's first word, or may start it with a hyphen, are the only places tried. Both are arrays of strings, columns as
    they stand: an expression in their place is evaluated for every word.
    """
    n, m = F.size(needle), F.size(words)
    first = F.get(needle, F.lit(0))
    stem = lambda word: F.substr(word, F.lit(1), F.length(word) - 1)  # noqa: E731  without the hyphen

    def read(start: Column) -> Column:
        def step(at: Column, token: Column) -> Column:
            here, after = F.get(words, at), F.get(words, at + 1)
            joins = F.endswith(here, F.lit("-")) & (F.concat(stem(here), after) == token)
            return F.when(at < 0, at).when(here == token, at + 1).when(joins, at + 2).otherwise(F.lit(-1))

        return F.aggregate(needle, start, step)

    starts = F.transform(words, lambda w, i: F.when((w == first) | (F.endswith(w, F.lit("-")) & F.startswith(first, stem(w))), i))
    places = F.filter(F.array_compact(starts), lambda i: i <= m - n)
    runs = F.filter(F.transform(places, lambda i: F.struct(i.alias("start"), F.coalesce(read(i), F.lit(-1)).alias("stop"))), lambda r: r["stop"] > r["start"])
    return F.when((n > 0) & (n <= m), F.get(runs, F.lit(0)))


def covered(needle: Column, words: Column) -> Column:
    """struct(start, stop) of the words that the needle's first place in their text lies in, which may begin or end within a word; else null."""
    text, quote = F.array_join(words, " "), F.array_join(needle, " ")
    at = F.position(quote, text)
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    start = spaces(F.substr(text, F.lit(1), at - 1))
    return F.when((F.size(needle) > 0) & (at > 0), F.struct(start.alias("start"), (start + F.size(needle)).alias("stop")))


def neighbor_pages(targets: DataFrame) -> DataFrame:
    """targets with try_page and priority: its own page, the one before, the one after."""
    offsets = F.array(*[F.struct(F.lit(k).alias("priority"), F.lit(d).alias("offset")) for k, d in enumerate((0, -1, 1))])
    return targets.select("*", F.explode(offsets).alias("t")).select(*targets.columns, F.col("t.priority").alias("priority"), (F.col("page") + F.col("t.offset")).alias("try_page"))


def find_quotes(targets: DataFrame, pages: DataFrame, words: DataFrame, books: DataFrame) -> DataFrame:
    """targets (target_id, book, page, quote) with found_page, method, start, stop; method null and reason set for a miss.

    On each page tried, a spelling of the quote that the page's text holds (search_for; the text stands in for a
    page's search) comes before a run of its words (word_sequence). The target's own page comes first; only where that
    fails are its neighbours tried, the one before and the one after, whose number the method then carries. start and
    stop are of the run of words, or else of the words that the first place of the quote, normalised, lies in.
    """
    ranged = target_page_range(targets, books)
    wanted = ranged.filter("reason is null").select("target_id", "book", "page", tokenize("quote").alias("needle"), quote_variants("quote").alias("variants"))
    lists = word_lists(words)
    held = pages.select("book", F.col("page").alias("try_page"), "text").join(lists.select("book", F.col("page").alias("try_page"), "words"), ["book", "try_page"], "left")

    def tried(rows: DataFrame) -> DataFrame:
        """rows (target_id, book, try_page, needle, variants, ...) with how and run."""
        both = rows.join(held, ["book", "try_page"], "left")
        # behind explode() the run is a column as it stands and is worked out once
        with_run = both.withColumn("run", F.explode(F.array(word_sequence_match(F.col("needle"), F.coalesce("words", F.array().cast("array<string>"))))))
        searched = F.coalesce(F.exists("variants", lambda v: F.contains(F.col("text"), v)), F.lit(False))
        found = with_run.withColumn("how", F.when(searched, "search_for").when(F.col("run").isNotNull(), "word_sequence"))
        return found.withColumn("run", F.coalesce("run", F.when(searched, covered(F.col("needle"), F.col("words"))))).drop("text", "words")

    own = tried(wanted.withColumn("try_page", F.col("page"))).select("target_id", "book", "page", "needle", "variants", F.struct(F.lit(0).alias("priority"), "try_page", "how", "run").alias("own"))
    beside = F.when(F.col("own.how").isNull(), F.array(*[F.struct(F.lit(k).alias("priority"), (F.col("page") + d).alias("try_page")) for k, d in ((1, -1), (2, 1))])).otherwise(F.array().cast("array<struct<priority:int,try_page:bigint>>"))
    more = own.withColumn("t", F.explode_outer(beside)).select("target_id", "book", "own", "needle", "variants", F.col("t.priority").alias("priority"), F.col("t.try_page").alias("try_page"))
    every = tried(more).withColumn("b", F.when(F.col("own.how").isNotNull(), F.col("own")).when(F.col("how").isNotNull(), F.struct("priority", "try_page", "how", "run")))
    best = every.groupBy("target_id").agg(F.min("b").alias("b"))
    method = F.when(F.col("b.priority") > 0, F.concat("b.how", F.lit("_neighbor_p"), F.col("b.try_page").cast("string"))).otherwise(F.col("b.how"))
    out = ranged.join(best, "target_id", "left").withColumn("method", method)
    reason = F.coalesce("reason", F.when(F.col("method").isNull(), "quote_not_found"))
    return out.withColumn("reason", reason).select(*targets.columns, F.col("b.try_page").alias("found_page"), "method", F.col("b.run.start").alias("start"), F.col("b.run.stop").alias("stop"), "reason")


def highlight_report(placements: DataFrame) -> DataFrame:
    return placements.groupBy("book").agg(F.count_if(F.col("method").isNotNull()).alias("highlighted"), F.count_if(F.col("reason").isNotNull()).alias("missed"))


def body_right_edge(words: DataFrame, sizes: DataFrame) -> DataFrame:
    """(book, page, edge, free_margin): the right end of words outside the head and foot bands, and what is free beside it; sizes: (book, page, width, height)."""
    both = sizes.join(words.select("book", "page", "y0", "y1", F.col("x1").alias("right")), ["book", "page"], "left")
    inside = (F.col("y1") >= F.col("height") * BAND) & (F.col("y0") <= F.col("height") - F.col("height") * BAND)
    edge = both.groupBy("book", "page", "width").agg(F.coalesce(F.max(F.when(inside, F.col("right"))), F.lit(0.0)).alias("edge"))
    return edge.withColumn("free_margin", F.greatest(F.lit(0.0), F.col("width") - 6 - (F.col("edge") + 8)))


def margin_band(free: Column, width: Column) -> Column:
    """struct(x0, x1) of the notes' column."""
    wide = F.when(free >= MARGIN_MIN, F.least(free, F.lit(MARGIN_PREFERRED))).otherwise(F.lit(MARGIN_MIN))
    wide = F.least(wide, F.greatest(F.lit(12.0), width - 12))
    return F.struct((width - 6 - wide).alias("x0"), (width - 6).alias("x1"))


def text_width(text: Column, size: Column) -> Column:
    widths = F.array(*map(F.lit, HELVETICA))
    one = lambda c: F.coalesce(F.when(F.ascii(c).between(32, 126) & (F.length(c) == 1), F.get(widths, F.ascii(c) - 32)), F.lit(OTHER_WIDTH))
    total = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda a, c: a + one(c))
    return total * size / 1000.0


def estimate_note_height(note: Column, width: Column, size: Column) -> Column:
    """Height of a note wrapped greedily; a word wider than the column adds lines only where it starts a wrapped one."""
    inner = F.greatest(width - 2 * PAD, F.lit(12.0))
    space = size * HELVETICA[0] / 1000.0
    found = tokenize(note)
    parts = F.when(F.size(found) == 0, F.array(note)).otherwise(found)

    def step(state: Column, word: Column) -> Column:
        w = text_width(word, size)
        fits = state["at"] + space + w <= inner
        extra = F.greatest(F.lit(0), F.ceil(w / inner).cast("int") - 1)
        return F.when(state["at"] == 0, F.struct(state["lines"].alias("lines"), w.alias("at"))).when(fits, F.struct(state["lines"].alias("lines"), (state["at"] + space + w).alias("at"))).otherwise(F.struct((state["lines"] + 1 + extra).alias("lines"), w.alias("at")))

    lines = F.aggregate(parts, F.struct(F.lit(1).alias("lines"), F.lit(0.0).alias("at")), step)["lines"]
    return F.greatest(lines, F.lit(1)) * (size + 4) + 2 * PAD + 2


def note_fontsize(note: Column, width: Column, height: Column) -> Column:
    """The largest size from 8 down in half points at which the note's box is within 35 % of the page, at least 6."""
    sizes = F.array(*[F.lit(FONT_MAX - 0.5 * k) for k in range(int((FONT_MAX - FONT_MIN) * 2) + 1)])
    fit = F.filter(sizes, lambda s: estimate_note_height(note, width, s) + 4 <= height * 0.35)
    return F.coalesce(F.get(fit, F.lit(0)), F.lit(FONT_MIN))


def merge_line_rects(rects: Column) -> Column:
    """Rectangles of one line that touch, or nearly, become one; each is compared with the union so far."""
    keyed = F.array_sort(F.transform(rects, lambda r: F.struct(((r["y0"] + r["y1"]) / 2).alias("mid"), r["x0"].alias("x"), r.alias("r"))))

    def step(done: Column, item: Column) -> Column:
        r, last = item["r"], F.element_at(done, -1)
        same = F.abs(item["mid"] - (last["y0"] + last["y1"]) / 2) <= LINE_TOLERANCE
        union = F.struct(F.least(last["x0"], r["x0"]).alias("x0"), F.least(last["y0"], r["y0"]).alias("y0"), F.greatest(last["x1"], r["x1"]).alias("x1"), F.greatest(last["y1"], r["y1"]).alias("y1"))
        return F.when((F.size(done) > 0) & same & (r["x0"] <= last["x1"] + GAP_TOLERANCE), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(union))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(keyed, F.array().cast(f"array<{RECT}>"), lambda d, x: F.when(F.size(d) == 0, F.array(x["r"])).otherwise(step(d, x)))


def place_notes(notes: DataFrame) -> DataFrame:
    """notes (book, page, seq, x0, x1, y, height, page_height) with top: each note's place in its page's column.

    In order of seq. A note is pushed below the first box it overlaps, up to 24 times, else above it as often; if it
    still overlaps it stays there. A page's notes are folded within one array.
    """
    item = F.struct("seq", "x0", "x1", "y", "height")
    pages = notes.groupBy("book", "page").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("page_height").alias("page_height"))
    empty = F.array().cast("array<struct<seq:bigint,x0:double,top:double,x1:double,bottom:double>>")
    turns = F.sequence(F.lit(1), F.lit(TRIES))

    def place(done: Column, x: Column) -> Column:
        low, high = F.lit(4.0), F.col("page_height") - 4
        height = F.least(x["height"], high - low)
        clamp = lambda y: F.least(F.greatest(y, low), F.greatest(low, high - height))
        hit = lambda y: F.get(F.filter(done, lambda o: (y + height + 2 > o["top"]) & (o["bottom"] + 2 > y)), F.lit(0))
        down = F.aggregate(turns, clamp(x["y"]), lambda y, _: F.when(hit(y).isNull(), y).otherwise(clamp(hit(y)["bottom"] + 3)))
        up = F.aggregate(turns, clamp(x["y"]), lambda y, _: F.when(hit(y).isNull(), y).otherwise(clamp(hit(y)["top"] - height - 3)))
        top = F.when(hit(down).isNull(), down).otherwise(up)
        return F.concat(done, F.array(F.struct(x["seq"].alias("seq"), x["x0"].alias("x0"), top.alias("top"), x["x1"].alias("x1"), (top + height).alias("bottom"))))

    return pages.select("book", "page", F.explode(F.aggregate("items", empty, place)).alias("n")).select("book", "page", "n.seq", "n.x0", "n.top", "n.x1", "n.bottom")
