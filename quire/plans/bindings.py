"""The driver's tables as books, pages, notes, runs and words; each binding also as SQL, written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.constants import CATEGORIES, GROUNDINGS, LINE_END, UNKNOWN, WS

ANN_CATEGORIES, ANN_GROUNDINGS = [*CATEGORIES, "PLOT", "method"], [*GROUNDINGS, "certain"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents of a source that one task numbers.
NUMBERED = 1 << 16


def src_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a book, its documents the pages, numbered by doc_id: a range of ids counts on from those before it, so that no task holds a source."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), "doc_id", "text", F.floor(F.col("doc_id") / NUMBERED).alias("ids"))
    sums = docs.groupBy("book", "ids").agg(F.count("*").alias("n"))
    before = sums.select(F.col("book").alias("b"), F.col("ids").alias("i"), (F.sum("n").over(Window.partitionBy("book").orderBy("ids")) - F.col("n")).alias("before"))  # a row for each source and range
    place = F.row_number().over(Window.partitionBy("book", "ids").orderBy("doc_id"))
    numbered = docs.withColumn("place", place).join(before, F.col("book").eqNullSafe(F.col("b")) & F.col("ids").eqNullSafe(F.col("i")))
    return numbered.select("book", (F.col("before") + F.col("place")).cast("long").alias("page"), "text")


def src_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """books_of(src_pages()) without the numbering."""
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("book")).agg(F.count("*").alias("total_pages"))


def books_of(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book").agg(F.max("page").alias("total_pages"))


def ordinals(books: DataFrame) -> DataFrame:
    """book with its place among the books; a row for each book."""
    return books.withColumn("ordinal", F.row_number().over(Window.orderBy("book")).cast("long"))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a book, five lines a page."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), F.split("text", "\n", -1).alias("lines"))
    starts = F.sequence(F.lit(1), F.size("lines"), F.lit(5))
    cut = docs.select("book", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("lines", i, F.lit(5)), "\n"))).alias("p", "text"))
    return cut.select("book", (F.col("p") + 1).cast("long").alias("page"), "text")


def conv_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), (F.col("turn") + 1).alias("page"), "text")


def conv_sections(pages: DataFrame) -> DataFrame:
    return pages.groupBy("book").agg(F.lit(1).cast("long").alias("chapter_number"), F.lit(1).cast("long").alias("start_page"), F.max("page").alias("end_page"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three notes on every page of a conversation, made so that every branch of validation is taken."""
    pages = conv_pages(spark, sf_dir)
    base = pages.join(conv_sections(pages), "book").select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    seq = (F.col("page") - 1) * 3 + F.col("k")
    v = (F.col("book") * 7 + seq) % 8
    plain = F.substr("text", 1 + 11 * F.col("k"), F.lit(60))
    earlier = F.replace(F.substr("text", 1 + 11 * F.greatest(F.col("k") - 1, F.lit(0)), F.lit(60)), F.lit(" "), F.lit("\n"))
    quote = F.when(v == 1, earlier).when(v == 5, F.reverse(plain)).when(v == 6, UNKNOWN).otherwise(plain)
    page = F.when(v == 3, F.col("page") % F.col("end_page") + 1).when(v == 4, F.col("end_page") + 5).otherwise(F.col("page"))
    turn = F.col("book") + F.col("page") + F.col("k")
    note = (
        F.when(turn % 6 == 0, "This passage shows how the parts hang together").when(turn % 6 == 1, "").when(turn % 6 == 2, "two words")
        .when(turn % 6 == 3, F.trim(F.repeat(F.lit("word "), 150))).otherwise("A note of its own that says something")
    )
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (turn % len(values) + 1).cast("int"))
    return base.select("book", "chapter_number", seq.alias("seq"), page.alias("page"), quote.alias("book_text"), note.alias("annotation"), pick(ANN_CATEGORIES).alias("category"), pick(ANN_GROUNDINGS).alias("grounding"), "start_page", "end_page")


def head_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B-SRC with headings as first lines of every tenth page."""
    pages = src_pages(spark, sf_dir)
    own = pages.join(ordinals(src_books(spark, sf_dir)), "book").withColumn("k", F.floor(F.col("page") / 10) + 1)
    k = F.col("k").cast("string")
    line = F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("Chapter "), k)).when(F.col("k") % 2 == 1, F.concat(k, F.lit(". Methods"))).otherwise(F.concat(F.lit("2."), k, F.lit(" Participants")))
    return own.select("book", "page", "ordinal", F.when(F.col("page") % 10 == 1, F.concat(line, F.lit("\n"), "text")).otherwise(F.col("text")).alias("text"))


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of every fourth book, with a blank title, a page 0 and a page twice."""
    books = ordinals(src_books(spark, sf_dir)).filter("ordinal % 4 = 0")
    e = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total_pages") - 1) / 12)))
    good = books.select("book", e.alias("toc_ix")).select("book", "toc_ix", F.concat(F.lit(" Part "), F.col("toc_ix").cast("string")).alias("title"), (1 + 12 * F.col("toc_ix")).alias("page"))
    odd = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("toc_ix"), F.lit(t).alias("title"), F.lit(p).cast("long").alias("page")) for i, t, p in ((100000, " ", 5), (100001, "Zero", 0), (100002, "Again", 13))]))
    return good.unionByName(books.select("book", odd.alias("o")).select("book", "o.*"))


def blocks(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """A block for each line of the pages with headings (head_pages(), if they are not given); first lines are set large."""
    one = (head_pages(spark, sf_dir) if pages is None else pages).select("book", "page", F.posexplode(F.split("text", "\n", -1)).alias("block_ix", "line"))
    return one.select("book", "page", "block_ix", (60.0 + 16 * F.col("block_ix")).alias("y0"), F.lit(792.0).alias("page_height"), F.array(F.struct(F.col("line").alias("text"), F.when(F.col("block_ix") == 0, 14.0).otherwise(10.0).alias("size"))).alias("spans"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes of conversation pages, eight to a line."""
    found = conv_pages(spark, sf_dir).withColumn("w", F.filter(F.split(F.regexp_replace("text", f"{WS}+", " "), " "), lambda x: x != ""))
    one = found.select("book", "page", F.posexplode("w").alias("ix", "word"))
    x0, y0 = 72.0 + 55 * (F.col("ix") % 8), 72.0 + 14 * F.floor(F.col("ix") / 8)
    return one.select("book", "page", F.col("ix").cast("long").alias("word_ix"), x0.alias("x0"), y0.alias("y0"), (x0 + 6 * F.length("word")).alias("x1"), (y0 + 11).alias("y1"), "word")


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_pages(spark, sf_dir).select("book", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs' quotes: the second's are cut short, altered or missing."""
    base = conv_pages(spark, sf_dir).select("book", "page", "text", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).withColumn("seq", (F.col("page") - 1) * 3 + F.col("k"))
    plain = F.lower(F.substr("text", 1 + 11 * F.col("k"), F.lit(60)))
    place = (F.col("book") * 10 + F.col("page")).alias("page")
    a = base.select(place, F.col("k").cast("long").alias("ix"), plain.alias("quote"))
    cut = F.substr(plain, F.lit(1), F.greatest(F.length(plain) - (F.col("seq") % 10).cast("int"), F.lit(1)))
    altered = F.concat(F.lit("xyz"), F.substr(plain, F.lit(4), F.lit(60)))
    b = base.filter("seq % 7 <> 0").select(place, F.col("k").cast("long").alias("ix"), F.when(F.col("seq") % 2 == 0, cut).otherwise(altered).alias("quote"))
    return a, b


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of notes as placement targets; some lie outside their book."""
    rows = annotations(spark, sf_dir)
    return rows.filter(f"book_text <> '{UNKNOWN}'").select((F.col("book") * 100000 + F.col("seq")).alias("target_id"), "book", "page", F.col("book_text").alias("quote"))


# ---- the same in SQL


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


def sql_words(x: str) -> str:
    return f"CASE WHEN {sql_norm(x)} = '' THEN 0 ELSE len(string_split({sql_norm(x)}, ' ')) END"


def sql_lines(x: str) -> str:
    parts = f"regexp_split_to_array({x}, '{LINE_END}')"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[:len({parts})-1] ELSE {parts} END"


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SRC = "src AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, text FROM documents), src_books AS (SELECT book, max(page) AS total_pages FROM src GROUP BY book), src_ord AS (SELECT *, row_number() OVER (ORDER BY book) AS ordinal FROM src_books)"
DOC = "doc AS (SELECT book, (i - 1) // 5 + 1 AS page, string_agg(line, chr(10) ORDER BY i) AS text FROM (SELECT doc_id AS book, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY ALL)"
CONV = "conv AS (SELECT conv_id AS book, turn + 1 AS page, text FROM conversations), conv_sec AS (SELECT book, 1::BIGINT AS chapter_number, 1::BIGINT AS start_page, max(page) AS end_page FROM conv GROUP BY book)"
ANN = CONV + f""", ann0 AS (SELECT *, (page - 1) * 3 + k AS seq, (book * 7 + (page - 1) * 3 + k) % 8 AS v, book + page + k AS t, substr(text, 1 + 11 * k, 60) AS plain
  FROM conv JOIN conv_sec USING (book), (SELECT unnest([0, 1, 2])::BIGINT AS k)),
ann AS (SELECT book, chapter_number, seq, CASE v WHEN 3 THEN page % end_page + 1 WHEN 4 THEN end_page + 5 ELSE page END AS page,
  CASE v WHEN 1 THEN replace(substr(text, 1 + 11 * greatest(k - 1, 0), 60), ' ', chr(10)) WHEN 5 THEN reverse(plain) WHEN 6 THEN '{UNKNOWN}' ELSE plain END AS book_text,
  CASE t % 6 WHEN 0 THEN 'This passage shows how the parts hang together' WHEN 1 THEN '' WHEN 2 THEN 'two words' WHEN 3 THEN trim(repeat('word ', 150)) ELSE 'A note of its own that says something' END AS annotation,
  {_sql_list(ANN_CATEGORIES)}[t % {len(ANN_CATEGORIES)} + 1] AS category, {_sql_list(ANN_GROUNDINGS)}[t % {len(ANN_GROUNDINGS)} + 1] AS grounding, start_page, end_page FROM ann0)"""
HEAD = SRC + """, head AS (SELECT book, page, ordinal, CASE WHEN page % 10 = 1 THEN
  CASE WHEN ordinal % 2 = 0 THEN 'Chapter ' || (page // 10 + 1) WHEN (page // 10 + 1) % 2 = 1 THEN (page // 10 + 1) || '. Methods' ELSE '2.' || (page // 10 + 1) || ' Participants' END || chr(10) || text ELSE text END AS text
  FROM src JOIN src_ord USING (book))"""
TOC = """toc AS (SELECT book, e AS toc_ix, ' Part ' || e AS title, 1 + 12 * e AS page FROM (SELECT book, unnest(range(0, (total_pages - 1) // 12 + 1)) AS e FROM src_ord WHERE ordinal % 4 = 0)
  UNION ALL SELECT book, o.i, o.t, o.p FROM src_ord, (VALUES (100000, ' ', 5), (100001, 'Zero', 0), (100002, 'Again', 13)) o(i, t, p) WHERE ordinal % 4 = 0)"""
BLOCKS = "blocks AS (SELECT book, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_ix FROM head)"
WORDS = CONV + f""", word AS (SELECT book, page, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS ix FROM (SELECT book, page, list_filter(string_split(regexp_replace(text, '{WS}+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM conv)),
boxes AS (SELECT book, page, ix AS word_ix, 72.0::DOUBLE + 55 * (ix % 8) AS x0, 72.0::DOUBLE + 14 * (ix // 8) AS y0, 72.0::DOUBLE + 55 * (ix % 8) + 6 * length(word) AS x1, 72.0::DOUBLE + 14 * (ix // 8) + 11 AS y1, word FROM word)"""
RUNS = CONV + """, rbase AS (SELECT book * 10 + page AS page, (page - 1) * 3 + k AS seq, k AS ix, lower(substr(text, 1 + 11 * k, 60)) AS plain FROM conv, (SELECT unnest([0, 1, 2])::BIGINT AS k)),
run_a AS (SELECT page, ix, plain AS quote FROM rbase),
run_b AS (SELECT page, ix, CASE WHEN seq % 2 = 0 THEN substr(plain, 1, greatest(length(plain) - seq % 10, 1)) ELSE 'xyz' || substr(plain, 4, 60) END AS quote FROM rbase WHERE seq % 7 <> 0)"""
