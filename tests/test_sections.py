from pyspark.sql import functions as F

from quire.operators import cleaning, estimate, sections


def heading(spark, f, text):
    return spark.range(1).select(f(F.lit(text)).alias("y")).first()["y"]


def test_article_headings(spark):
    assert heading(spark, sections.heading_article, "3. Methods and materials\nWe did this.") == "3. Methods and materials"
    assert heading(spark, sections.heading_article, "intro\n2.1 Participants\nmore") == "2.1 Participants"
    assert heading(spark, sections.heading_article, "We recruited forty people from three towns.") is None
    assert heading(spark, sections.heading_article, "a\nb\nc\nd\ne\nf\nAbstract") is None
    assert heading(spark, sections.heading_article, "  DISCUSSION  ") == "DISCUSSION"


def test_chapter_headings(spark):
    assert heading(spark, sections.heading_regex, "x\n chapter  IV the end") == "chapter  IV the end"
    assert heading(spark, sections.heading_regex, "Part of a whole") == "Part of a whole"
    assert heading(spark, sections.heading_regex, "12. Chapter 3") == "12. Chapter 3"
    assert heading(spark, sections.heading_regex, "Partly so\nChapter 1" + "x" * 80) is None


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_sections_from_starts_and_front_matter(spark):
    books = spark.createDataFrame([("a", 9)], "book string, total_pages long")
    starts = spark.createDataFrame([("a", 1, "one", 2), ("a", 2, "again", 2), ("a", 3, "two", 5), ("a", 4, "late", 12)], "book string, ix long, title string, page long")
    found = sections.sections_from_starts(starts, books)
    assert rows(found, "number", "title", "start_page", "end_page") == [(1, "one", 2, 4), (2, "two", 5, 11), (3, "late", 12, 9)]
    begin = spark.createDataFrame([("a", 6)], "book string, content_start long")
    assert rows(sections.exclude_front_matter(found, begin), "number", "title", "start_page", "end_page") == [(1, "two", 6, 11)]


def test_cascade_and_fallback(spark):
    long = " ".join(["word"] * 200)
    pages = spark.createDataFrame([("a", 1, "Copyright " + long), ("a", 2, f"Chapter 1\n{long}"), ("a", 3, f"Chapter 2\n{long}"), ("b", 1, long), ("b", 2, "short")], "book string, page long, text string")
    books = spark.createDataFrame([("a", 3), ("b", 2)], "book string, total_pages long")
    toc = spark.createDataFrame([], "book string, toc_ix long, title string, page long")
    blocks = spark.createDataFrame([], "book string, page long, block_ix int, y0 double, page_height double, spans array<struct<text:string,size:double>>")
    found = sections.detect_sections(books, pages, toc, blocks)
    assert rows(found, "book", "number", "title", "start_page", "end_page", "detection_method") == [("a", 1, "Chapter 1", 2, 2, "regex"), ("a", 2, "Chapter 2", 3, 3, "regex"), ("b", 1, "Full document", 1, 2, "fallback")]


def test_layout_headings(spark):
    block = lambda ix, y, text, size: ("a", 1, ix, y, 800.0, [(text, size)])
    blocks = spark.createDataFrame([block(0, 20.0, "A sentence.", 20.0), block(1, 60.0, "Small", 10.0), block(2, 90.0, "Big Title", 14.0), block(3, 100.0, "Other", 15.0), block(4, 500.0, "Low", 20.0)], "book string, page long, block_ix int, y0 double, page_height double, spans array<struct<text:string,size:double>>")
    assert rows(sections.heading_layout(blocks), "title") == [("Big Title",)]


def test_repeating_lines(spark):
    text = lambda n: f"My Book\n\nsome words {n}\nmore {n}\nPage foot"
    pages = spark.createDataFrame([("a", n, text(n)) for n in range(1, 5)] + [("b", 1, text(1))], "book string, page long, text string")
    assert rows(cleaning.repeating_lines(pages), "book", "line") == [("a", "My Book"), ("a", "Page foot")]
    kept = {(r["book"], r["page"]): r["stripped"] for r in cleaning.strip_headers_footers(pages).collect()}
    assert kept["a", 2] == "some words 2\nmore 2" and kept["b", 1].startswith("My Book")
    # a line twice in one page's first two counts twice
    twice = spark.createDataFrame([("c", 1, "dup\ndup\nx1\ny1"), ("c", 2, "a\nb\nc\nd")], "book string, page long, text string")
    assert rows(cleaning.repeating_lines(twice), "line") == [("dup",)]


def test_selection(spark):
    texts = ["5", "2-4, 6-7", "5, 7, 9", "4 - 7", "1 3 2", "8-3", "abc", "", " ", "1,,2"]
    found = [r["s"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").orderBy("i").select(estimate.parse_selection(F.col("x")).alias("s")).collect()]
    assert [x["numbers"] for x in found] == [[5], [2, 3, 4, 6, 7], [5, 7, 9], [4, 5, 6, 7], [1, 2, 3], None, None, None, None, [1, 2]]
    assert [x["error"] for x in found][5:9] == ["reversed", "invalid", "empty", "empty"]


def test_chunks(spark):
    size = lambda *x: spark.range(1).select(estimate.chunk_size(*map(F.lit, x)).alias("y")).first()["y"]
    assert [size(1, 10, 1), size(1000, 1000, 1), size(100, 1000, 2), size(10, 10_000_000, 1)] == [1, 454, 20, 1]
    one = spark.createDataFrame([("a", 1, 5, 2)], "book string, start_page long, end_page long, size long")
    assert rows(estimate.page_chunks(one), "chunk_ix", "chunk_start", "chunk_end", "overlap_page") == [(0, 1, 2, None), (1, 3, 4, 2), (2, 5, 5, 4)]
